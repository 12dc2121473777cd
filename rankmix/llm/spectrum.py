"""Leading eigenpairs of a symmetric matrix by contour integration (FEAST).

The projector on the eigenvectors with eigenvalues inside a circle is an
integral of the resolvent along it.  A quadrature replaces it by a few solves
with complex shifts; applied to a block of vectors and followed by a
Rayleigh-Ritz step it is repeated until the residuals vanish.

How many eigenvalues lie above a shift is the inertia of the shifted matrix
(Sylvester), read from the pivots of its tridiagonal form.  Bisection on those
counts says where to put the circles -- each around a group of neighbouring
eigenvalues with a gap on both sides -- and how many pairs each must give, so
none can be missed.
"""

from __future__ import annotations

import numpy as np

POINTS = 12            # of the quadrature on the upper half circle
ROUNDS = 80


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of an orthogonally similar matrix (Householder)."""
    a, n = a.copy(), len(a)
    for k in range(n - 2):
        x = a[k + 1:, k]
        size = np.linalg.norm(x)
        if size == 0:
            continue
        v = x.copy()
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        low = a[k + 1:, k + 1:]
        p = low @ v
        w = 2 * (p - (v @ p) * v)
        low -= np.outer(v, w) + np.outer(w, v)
        a[k + 1:, k] = a[k, k + 1:] = 0
        a[k + 1, k] = a[k, k + 1] = -np.copysign(size, x[0] if x[0] else 1.0)
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy()


def counts_above(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Eigenvalues above each shift: positive pivots of the shifted matrix."""
    tiny = np.finfo(float).tiny ** 0.5 + np.finfo(float).eps ** 2 * np.abs(off).max(initial=0.0)
    out = np.zeros(len(shifts), np.int64)
    pivot = np.full(len(shifts), np.inf)
    for k, d in enumerate(diagonal):
        pivot = d - shifts - (off[k - 1] ** 2 / pivot if k else 0.0)
        pivot = np.where(np.abs(pivot) < tiny, tiny, pivot)
        out += pivot > 0
    return out


def eigenvalue_brackets(a: np.ndarray, top: float, steps: int = 60) -> np.ndarray:
    """All eigenvalues, falling, to about rounding: bisection on the inertia."""
    d, e = tridiagonal(a)
    n = len(a)
    low, high = np.full(n, -1.001 * top), np.full(n, 1.001 * top)
    rank = np.arange(1, n + 1)
    for _ in range(steps):
        mid = (low + high) / 2
        enough = counts_above(d, e, mid) >= rank
        low, high = np.where(enough, mid, low), np.where(enough, high, mid)
    return (low + high) / 2


def eigenpairs_inside(a: np.ndarray, center: float, radius: float, count: int, top: float):
    """The ``count`` eigenvalues inside the circle, falling, and unit eigenvectors."""
    n = len(a)
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    angle = np.pi / 2 * (1 + nodes)                # the lower half of the circle is its conjugate
    turn = np.exp(1j * angle)
    shifted = [(center + radius * t) * np.eye(n) - a for t in turn]
    block = np.random.default_rng(7).standard_normal((n, min(n, 2 * count + 4)))
    for _ in range(ROUNDS):
        q = sum((w * t * np.linalg.solve(s, block)).real for w, t, s in zip(weights, turn, shifted)) * radius / 2
        basis, _ = np.linalg.qr(q)
        values, small = np.linalg.eigh(basis.T @ a @ basis)
        block = basis @ small
        inside = np.abs(values - center) < radius
        residual = np.linalg.norm(a @ block - block * values, axis=0)
        if inside.sum() == count and (residual[inside] <= 1e-14 * np.sqrt(n) * top).all():
            break
    values, vectors = values[inside][::-1], block[:, inside][:, ::-1]
    if len(values) != count:
        raise ArithmeticError(f"{count} eigenvalues lie within {radius} of {center}, {len(values)} were found")
    return values, vectors


def leading_components(a: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues that are positive beyond rounding, and
    their eigenvectors (each with its largest entry positive)."""
    n = len(a)
    top = float(np.abs(a).sum(axis=1).max()) if n else 0.0
    if not top:
        return np.empty(0), np.empty((n, 0))
    about = eigenvalue_brackets(a, top)
    wanted = min(wanted, int(np.count_nonzero(about > 4e-16 * n * top)))
    gap = np.concatenate([[np.inf], about[:-1] - about[1:], [np.inf]])        # above the first, between, below the last
    vectors, first = [], 0
    while first < wanted:
        last = first
        while gap[last + 1] < max(0.2 * (about[first] - about[last]), 1e-11 * top):
            last += 1
        width = about[first] - about[last]
        margin = min(gap[first], gap[last + 1], max(width, 0.1 * top)) / 2
        found = eigenpairs_inside(a, (about[first] + about[last]) / 2, width / 2 + margin, last - first + 1, top)
        vectors.append(found[1])
        first = last + 1
    if not vectors:
        return np.empty(0), np.empty((n, 0))
    # one Rayleigh-Ritz step over all groups keeps vectors of neighbouring ones orthogonal
    basis, _ = np.linalg.qr(np.hstack(vectors))
    values, small = np.linalg.eigh(basis.T @ a @ basis)
    values, vectors = values[::-1][:wanted], (basis @ small)[:, ::-1][:, :wanted]
    sign = np.sign(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(wanted)])
    return values, vectors * sign
