"""Linear support vector machines, many at once.

Each machine is Spark's ``LinearSVC`` (hinge loss on standardised features, an
L2 penalty, an intercept without one) solved by the same steps (Breeze's OWL-QN
without L1 penalty); all of them walk in step, so a pass over the rows serves
every machine that is not finished yet."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import RDD

from rankmix.operators.blocks import summed

LOCAL_BYTES = 1 << 25          # rows up to this size are given to every task
TOGETHER = 3                   # machines of such a task


@dataclass(frozen=True)
class Machine:
    """The task of one machine: one class against the others, on all rows but
    those of fold ``left_out``."""

    cls: int
    left_out: int | None = None


def _direction(grad, history):
    """L-BFGS: the inverse Hessian that the last steps tell of, times -grad."""
    out, a = grad.copy(), []
    if history:
        s, y = history[-1]
        sy = s @ y
        if not sy >= 0:
            return None
    for s, y in reversed(history):
        with np.errstate(divide="ignore", invalid="ignore"):
            a.append((s @ out) / (s @ y))
        if np.isnan(a[-1]):
            return None
        out = out - a[-1] * y
    if history:
        with np.errstate(divide="ignore", invalid="ignore"):
            out = out * (sy / (y0 := history[-1][1]).dot(y0))
    for (s, y), ai in zip(history, reversed(a)):
        out = out + (ai - (y @ out) / (s @ y)) * s
    return -out


def owlqn(x, max_iter: int, tolerance: float, memory: int = 10, window: int = 20):
    """Yields points and is sent ``(value, gradient)`` of each; returns the least.

    Ends when the value has moved by less than ``tolerance`` of the first one over
    ``window`` steps, when the gradient is as small, after ``max_iter`` steps, or when
    no step along the gradient can be found twice in a row."""
    value, grad = yield x
    first, recent, history, failed, step = value, [np.inf], [], False, 0
    while True:
        if step >= max_iter or (len(recent) >= 2 and abs(value - max(recent)) <= tolerance * first) or (
                np.linalg.norm(grad) <= max(tolerance * value, 1e-8)):
            return x
        found = None
        direction = _direction(grad, history)
        if direction is not None:
            direction = np.where(direction * grad < 0, direction, 0.0)
            orthant = np.where(x != 0, np.sign(x), np.sign(-grad))
            slope, shrink = direction @ grad, 0.1 if step < 1 else 0.5
            alpha = shrink * (0.5 / np.linalg.norm(grad) if step < 1 else 1.0)      # Breeze shrinks before it looks
            for _ in range(20):
                at = x + alpha * direction
                at = np.where(np.sign(at) == orthant, at, 0.0)
                v, g = yield at
                if v > value + alpha * slope * 1e-4:
                    by = shrink
                elif g @ direction < 0.9 * slope:
                    by = 2.1
                elif g @ direction > -0.9 * slope:
                    by = shrink
                else:
                    found = at, v, g
                    break
                alpha *= by
                if not 1e-10 <= alpha <= 1e10:
                    break
        if found is None:
            if failed:
                return x
            failed, history = True, []
            continue
        at, v, g = found
        history = [*history[1 - memory:], (at - x, g - grad)] if len(history) >= memory else [*history, (at - x, g - grad)]
        recent, failed, step = [*recent, v][-window:], False, step + 1
        x, value, grad = at, v, g


def _moments(rows: RDD, folds: int):
    """By fold: rows, mean and sum of squares around it."""
    def sums(b):
        own = [b[0][b[2] == k] for k in range(folds)]
        return np.array([len(x) for x in own], float), np.stack([x.sum(axis=0) for x in own])

    n, total = summed(rows, sums)
    centre = total.sum(axis=0) / n.sum()
    squares = summed(rows, lambda b: np.stack([((b[0][b[2] == k] - centre) ** 2).sum(axis=0) for k in range(folds)]))
    return n, total, squares, centre


def fit(rows: RDD, machines: list[Machine], folds: int, reg: float, max_iter: int, tolerance: float):
    """``(u, c)`` so that ``x @ u + c`` are the margins by machine.  ``rows`` are
    blocks with labels and folds."""
    n, total, squares, centre = _moments(rows, folds)
    inverse, shift, count = [], [], []
    for m in machines:
        keep = np.array([k != m.left_out for k in range(folds)])
        size, mean = n[keep].sum(), total[keep].sum(axis=0) / n[keep].sum()
        var = (squares[keep].sum(axis=0) - size * (mean - centre) ** 2) / max(size - 1, 1)
        std = np.sqrt(np.maximum(var, 0.0))
        std[std <= 1e-12 * np.abs(mean)] = 0.0
        inverse.append(np.divide(1.0, std, out=np.zeros_like(std), where=std != 0))
        shift.append(inverse[-1] * mean)
        count.append(size)
    inverse, shift, count = np.array(inverse), np.array(shift), np.array(count)

    solver = _Solver(machines, inverse, shift, count, reg, max_iter, tolerance)
    if 8 * n.sum() * len(centre) <= LOCAL_BYTES:
        # few rows: a task has them all and solves some machines, without a job for each step
        kept = rows.collect()
        held = rows.context.broadcast(tuple(np.concatenate([b[i] for b in kept]) for i in range(3)))
        groups = [list(range(i, min(i + TOGETHER, len(machines)))) for i in range(0, len(machines), TOGETHER)]
        got = rows.context.parallelize(groups, len(groups)).map(
            lambda at: solver.solve(at, lambda measure: measure(held.value))).collect()
        held.destroy()
        found = [w for group in got for w in group]
    else:
        found = solver.solve(list(range(len(machines))), lambda measure: summed(rows, measure))
    return solver.margins_of(np.arange(len(machines)), np.stack(found))


class _Solver:
    """Walks machines in step; ``total(measure)`` sums over all rows."""

    def __init__(self, machines, inverse, shift, count, reg, max_iter, tolerance):
        self.cls = np.array([m.cls for m in machines])
        self.out = np.array([-1 if m.left_out is None else m.left_out for m in machines])
        self.inverse, self.shift, self.count = inverse, shift, count
        self.reg, self.max_iter, self.tolerance = reg, max_iter, tolerance

    def margins_of(self, at, w):
        return (self.inverse[at] * w[:, :-1]).T, w[:, -1] - (self.shift[at] * w[:, :-1]).sum(axis=1)

    def evaluate(self, at, w, total):
        u, c = self.margins_of(at, w)
        cls, out, reg = self.cls[at], self.out[at], self.reg

        def measure(b):
            x, y, fold = b[:3]
            sign = np.where(y[:, None] == cls, 1.0, -1.0)
            lack = 1.0 - sign * (x @ u + c)
            on = (lack > 0) & (fold[:, None] != out)
            push = np.where(on, -sign, 0.0)
            return np.where(on, lack, 0.0).sum(axis=0), x.T @ push, push.sum(axis=0)

        loss, gx, gc = total(measure)
        count = self.count[at]
        grad = np.column_stack([(self.inverse[at] * gx.T - self.shift[at] * gc[:, None]) / count[:, None] + reg * w[:, :-1], gc / count])
        return loss / count + reg / 2 * (w[:, :-1] ** 2).sum(axis=1), grad

    def solve(self, at, total) -> list[np.ndarray]:
        size = self.inverse.shape[1] + 1
        runs = {i: owlqn(np.zeros(size), self.max_iter, self.tolerance) for i in at}
        wanted, found = {i: next(r) for i, r in runs.items()}, {}
        while wanted:
            now = list(wanted)
            values, grads = self.evaluate(np.array(now), np.stack([wanted[i] for i in now]), total)
            wanted = {}
            for i, v, g in zip(now, values, grads):
                try:
                    wanted[i] = runs[i].send((v, g))
                except StopIteration as end:
                    found[i] = end.value
        return [found[i] for i in at]
