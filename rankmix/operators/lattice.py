"""The outputs of a fusion layer, evaluated for whole blocks of item rows.

An output is a weighted mean over a subset of models.  The subsets of one kind
(score or rank) and scheme form a lattice; walking it prefix by prefix gives
each subset's weighted sum from that of the subset without its last member:
one multiplication by class and model, one addition by class and output, whatever
the subset's size, and the sum's order is the members' order.

The work happens inside Spark's tasks on Arrow batches: item rows never fan out
to rows by output.  What leaves a task is what the caller asks for -- counts by
output and label, picks or a vote beside the item, or the fused matrices.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmix.functions import TOL
from rankmix.model import FusedSpec, ScoreSet, r_col, s_col
from rankmix.operators.weights import Weights

SC, RC = "SC", "RC"
BLOCK_VALUES = 1 << 19         # item x class values of a block


@dataclass(frozen=True)
class Step:
    """One step down in the lattice: ``model`` joins the subset at ``depth``;
    ``outputs`` are the places in the layout of the subset that it completes."""

    depth: int
    model: int
    outputs: tuple[int, ...]


def walk(subsets: dict[tuple[int, ...], list[int]]) -> list[Step]:
    """Steps that visit every subset, each prefix once, depth first."""
    below: dict[tuple, set] = {}
    for s in subsets:
        for d in range(len(s)):
            below.setdefault(s[:d], set()).add(s[d])
    steps, todo = [], [((), m) for m in sorted(below.get((), ()), reverse=True)]
    while todo:
        prefix, m = todo.pop()
        s = (*prefix, m)
        steps.append(Step(len(s), m, tuple(subsets.get(s, ()))))
        todo += [(s, x) for x in sorted(below.get(s, ()), reverse=True)]
    return steps


class Lattice:
    """The layout's outputs by kind and scheme, ready to be walked."""

    def __init__(self, layout: list[tuple[str, FusedSpec]], schemes: tuple[str, ...] = ()):
        groups: dict[tuple, dict] = {}
        for j, (kind, spec) in enumerate(layout):
            sid = None if spec.is_base else schemes.index(spec.scheme)
            groups.setdefault((kind, sid), {}).setdefault(tuple(sorted(spec.members)), []).append(j)
        self.walks = [(kind, sid, walk(subsets)) for (kind, sid), subsets in groups.items()]
        self.kinds = np.array([kind == RC for kind, _ in layout])
        self.size = len(layout)

    def outputs(self, scores, ranks, weights):
        """``(j, values)`` of every output, ``values`` by class and item; NaN
        where it has none.  ``scores`` and ``ranks`` hold a class x item array by
        model, ``weights[scheme][model]`` a number or one by item."""
        for kind, sid, steps in self.walks:
            source = scores if kind == SC else ranks
            terms, coefs = {}, {}
            sums, dens = [0.0], [0.0]
            for step in steps:
                i = step.model
                if i not in terms:
                    if sid is None:
                        coefs[i], terms[i] = 1.0, source[i]
                    else:
                        w = weights[sid][i]
                        with np.errstate(divide="ignore"):
                            c = w if kind == SC else np.where(w == 0, 0.0, 1.0 / w)
                        # a model without weight takes no part
                        coefs[i], terms[i] = c, np.where(w == 0, 0.0, c * source[i])
                d = step.depth
                del sums[d:], dens[d:]
                sums.append(terms[i] if d == 1 else sums[d - 1] + terms[i])
                dens.append(coefs[i] if d == 1 else dens[d - 1] + coefs[i])
                if step.outputs:
                    den = dens[d]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        values = sums[d] / np.where(den == 0, np.nan, den)
                    for j in step.outputs:
                        yield j, values


def pick(values: np.ndarray, largest: bool, tol: float = TOL) -> np.ndarray:
    """The lowest class within ``tol`` of the best value; -1 without any value."""
    best = np.fmax.reduce(values, axis=0) - tol if largest else np.fmin.reduce(values, axis=0) + tol
    out = np.full(values.shape[1], -1, np.int32)
    for k in range(len(values) - 1, -1, -1):
        np.copyto(out, k, where=values[k] >= best if largest else values[k] <= best)
    return out


def average_ranks(scores: np.ndarray) -> np.ndarray:
    """Average ranks by column (1 = highest, ties share the mean); NaN has none."""
    c, n = scores.shape
    order = np.argsort(-scores, axis=0, kind="stable")           # NaN last
    ordered = np.take_along_axis(scores, order, axis=0)
    place = np.arange(c)[:, None]
    new = np.ones((c, n), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.maximum.accumulate(np.where(new, place, 0), axis=0)
    ends = np.ones((c, n), bool)
    ends[:-1] = new[1:]
    last = np.minimum.accumulate(np.where(ends, place, c)[::-1], axis=0)[::-1]
    out = np.empty((c, n))
    np.put_along_axis(out, order, (first + last) / 2 + 1, axis=0)
    return np.where(np.isnan(scores), np.nan, out)


def ordinal_ranks(scores: np.ndarray) -> np.ndarray:
    """Ordinal ranks by column, ties to the lower class: one sort, whose
    permutation is inverted by writing the places back."""
    order = np.argsort(-scores, axis=0, kind="stable")
    out = np.empty(scores.shape)
    np.put_along_axis(out, order, np.arange(1.0, len(scores) + 1)[:, None], axis=0)
    return np.where(np.isnan(scores), np.nan, out)


# ------------------------------------------------------------- Arrow batches

class Items:
    """The arrays of one block of item rows."""

    def __init__(self, batch: pa.RecordBatch, n_models: int, n_classes: int, schemes: int, ranks: bool, constants,
                 allow_missing: bool):
        at = {name: i for i, name in enumerate(batch.schema.names)}
        self.batch, self.n = batch, len(batch)

        def matrix(name):
            col = batch.column(at[name])
            flat = col.flatten().to_numpy(zero_copy_only=False)
            if len(flat) != self.n * n_classes or col.null_count or (
                    self.n and not (np.diff(np.asarray(col.offsets)) == n_classes).all()):
                raise ValueError(f"{name}: every item needs an array of {n_classes} values")
            if not allow_missing and np.isnan(flat).any():
                raise ValueError(f"{name}: an item has no score for some class")
            return np.ascontiguousarray(flat.astype(np.float64, copy=False).reshape(self.n, n_classes).T)

        self.scores = [matrix(s_col(i)) for i in range(n_models)]
        self.ranks = None
        if ranks:
            self.ranks = ([matrix(r_col(i)) for i in range(n_models)] if r_col(0) in at
                          else [average_ranks(s) for s in self.scores])
        self.weights = []
        for sid in range(schemes):
            name = f"w{sid}"
            if name in at:
                flat = batch.column(at[name]).flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
                self.weights.append(list(flat.reshape(self.n, n_models).T))
            else:
                self.weights.append([np.float64(w) for w in constants[sid]])
        self.label = None
        if "label" in at:
            label = batch.column(at["label"])
            self.label = label.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            known = np.asarray(label.is_valid())
            if self.n and ((self.label[known] < 0) | (self.label[known] >= n_classes)).any():
                raise ValueError(f"labels have to lie in 0 .. {n_classes - 1}")


class Layer:
    """A layout's evaluation over a score set: the frame that tasks read (item
    rows beside their batch's weights) and how to read a block of it."""

    def __init__(self, ss: ScoreSet, weights: Weights | None, layout: list[tuple[str, FusedSpec]]):
        if not layout:
            raise ValueError("no output models")
        schemes = weights.schemes if weights is not None else ()
        self.ss, self.layout, self.lattice = ss, layout, Lattice(layout, schemes)
        self.frame = weights.frame if weights is not None else None
        self.needs_ranks = bool(self.lattice.kinds.any())
        constants = [None if weights.literal(s, 0) is None else [weights.literal(s, i) for i in range(ss.n_models)]
                     for s in schemes]
        self.read = (ss.n_models, ss.n_classes, len(schemes), self.needs_ranks, constants, ss.allow_missing)

    def rows(self, keep: list[str]) -> DataFrame:
        """Item rows with ``keep``, scores, ranks and the batch's weights."""
        ss, m = self.ss, self.ss.n_models
        df = ss.df
        if self.frame is not None:
            # both sides are clustered by batch_id (the weights come from the same
            # rows): no exchange; the side of one row a batch is the build side
            df = df.join(self.frame.hint("shuffle_hash"), on="batch_id", how="inner")
        ranks = [r_col(i) for i in range(m)] if self.needs_ranks and ss.has_ranks else []
        weights = [c for c in self.frame.columns if c != "batch_id"] if self.frame is not None else []
        return df.select(*keep, *[s_col(i) for i in range(m)], *ranks, *weights)

    def blocks(self, batches):
        step = max(1, BLOCK_VALUES // self.read[1])
        for b in batches:
            for at in range(0, len(b), step):
                yield Items(b.slice(at, step), *self.read)

    def outputs(self, items: Items):
        return self.lattice.outputs(items.scores, items.ranks, items.weights)

    def reader(self) -> "Layer":
        """What tasks need of it (no frames)."""
        out = object.__new__(Layer)
        out.lattice, out.read = self.lattice, self.read
        return out


def schema_of(df: DataFrame, names) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)


def label_counts(layer: Layer) -> DataFrame:
    """``(j, label, hits, n)``: items of each label and those of them whose pick
    is right.  A task adds up its own items; only its sums are shuffled."""
    me, size, c = layer.reader(), layer.lattice.size, layer.ss.n_classes

    def run(batches):
        hits, n = np.zeros((size, c), np.int64), np.zeros(c, np.int64)
        for items in me.blocks(batches):
            known = items.label >= 0
            n += np.bincount(items.label[known], minlength=c)
            for j, values in me.outputs(items):
                right = pick(values, not me.lattice.kinds[j]) == items.label
                hits[j] += np.bincount(items.label[right & known], minlength=c)
        labels = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(size), len(labels)), pa.int32()), pa.array(np.tile(labels, size), pa.int32()),
             pa.array(hits[:, labels].ravel()), pa.array(np.tile(n[labels], size))], names=["j", "label", "hits", "n"])

    return layer.rows(["label"]).mapInArrow(run, "j int, label int, hits long, n long").groupBy("j", "label").agg(
        F.sum("hits").alias("hits"), F.sum("n").alias("n"))


def item_picks(layer: Layer, keep: list[str], largest_rank: bool = False) -> DataFrame:
    """``(keep, picks)``: the item row with the picked class of every output."""
    me, size = layer.reader(), layer.lattice.size
    rows = layer.rows(keep)

    def run(batches):
        for items in me.blocks(batches):
            out = np.empty((items.n, size), np.int32)
            for j, values in me.outputs(items):
                out[:, j] = pick(values, largest_rank or not me.lattice.kinds[j])
            flat = pa.array(out.ravel(), mask=out.ravel() < 0)
            yield pa.RecordBatch.from_arrays(
                [items.batch.column(i) for i in range(len(keep))]
                + [pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, size, dtype=np.int32)), flat)],
                names=[*keep, "picks"])

    return rows.mapInArrow(run, f"{schema_of(rows, keep)}, picks array<int>")


def item_votes(layer: Layer, keep: list[str]) -> DataFrame:
    """``(keep, vote)``: the class that most outputs pick, the lowest on ties."""
    me, c = layer.reader(), layer.ss.n_classes
    rows = layer.rows(keep)

    def run(batches):
        for items in me.blocks(batches):
            votes = np.zeros((c, items.n), np.int32)
            at = np.arange(items.n)
            for j, values in me.outputs(items):
                p = pick(values, not me.lattice.kinds[j])
                votes[p[p >= 0], at[p >= 0]] += 1
            yield pa.RecordBatch.from_arrays(
                [items.batch.column(i) for i in range(len(keep))] + [pa.array(votes.argmax(axis=0).astype(np.int32))],
                names=[*keep, "vote"])

    return rows.mapInArrow(run, f"{schema_of(rows, keep)}, vote int")


def _list_column(values: np.ndarray) -> pa.Array:
    """class x item -> one list by item; NaN is null."""
    flat = np.ascontiguousarray(values.T).ravel()
    missing = np.isnan(flat)
    data = pa.array(flat, mask=missing) if missing.any() else pa.array(flat)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, len(values), dtype=np.int32)), data)


def scaled(values: np.ndarray) -> np.ndarray:
    """Min-max scaling of a whole batch; NaN where it is constant."""
    lo, hi = np.fmin.reduce(values, axis=None), np.fmax.reduce(values, axis=None)
    return (values - lo) / (hi - lo) if hi != lo else np.full(values.shape, np.nan)


def whole_batches(layer: Layer, keep: list[str], per_batch, schema: str) -> DataFrame:
    """``per_batch(items)`` yields record batches for each complete batch of
    items (at most ``batch_size`` rows; no exchange, rows are clustered)."""
    me = layer.reader()
    rows = layer.rows(["batch_id", "item_id", *[k for k in keep if k not in ("batch_id", "item_id")]])

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("item_id")
        if len(ids.unique()) < len(ids):
            raise ValueError("item ids have to be unique")
        return pa.Table.from_batches(list(per_batch(me, Items(table.combine_chunks().to_batches()[0], *me.read))))

    return rows.groupBy("batch_id").applyInArrow(run, schema)


def matrices(layer: Layer, normalize: bool = True, only: set[int] | None = None) -> DataFrame:
    """``(item_id, batch_id, j, values)`` of every output (of those in ``only``)."""
    rows = layer.rows(["item_id", "batch_id"])
    schema = f"{schema_of(rows, ['item_id', 'batch_id'])}, j int, values array<double>"

    def emit(me, items, normal):
        item, batch = (items.batch.column(items.batch.schema.names.index(k)) for k in ("item_id", "batch_id"))
        for j, values in me.outputs(items):
            if only is None or j in only:
                yield pa.RecordBatch.from_arrays(
                    [item, batch, pa.array(np.full(items.n, j, np.int32)),
                     _list_column(scaled(values) if normal and not me.lattice.kinds[j] else values)],
                    names=["item_id", "batch_id", "j", "values"])

    if normalize and not layer.lattice.kinds.all():
        return whole_batches(layer, ["item_id"], lambda me, items: emit(me, items, True), schema)
    me = layer.reader()          # ranks are not scaled: any block of rows will do

    def run(batches):
        for items in me.blocks(batches):
            yield from emit(me, items, False)

    return rows.mapInArrow(run, schema)


def round_counts(layer: Layer) -> DataFrame:
    """Everything that a round of the search asks for, from one pass: ``(j,
    correct, total, bad, top)``.  ``bad`` is 1 if the output has a missing value
    or, for scores, a constant batch; ``top`` is its largest value.  Without
    labels ``correct`` and ``total`` are 0."""
    def per_batch(me, items):
        label = items.label if items.label is not None else np.full(items.n, -1)
        known = label >= 0
        out = np.zeros((me.lattice.size, 3), np.int64)
        top = np.full(me.lattice.size, np.nan)
        for j, values in me.outputs(items):
            lo, top[j] = np.fmin.reduce(values, axis=None), np.fmax.reduce(values, axis=None)
            rank = me.lattice.kinds[j]
            out[j] = (np.count_nonzero((pick(values, not rank) == label) & known), np.count_nonzero(known),
                      np.isnan(values).any() or (not rank and lo == top[j]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(me.lattice.size), pa.int32()), *[pa.array(out[:, i]) for i in range(3)],
             pa.array(top, mask=np.isnan(top))], names=["j", "correct", "total", "bad", "top"])

    keep = ["label"] if layer.ss.has_label else []
    parts = whole_batches(layer, keep, per_batch, "j int, correct long, total long, bad long, top double")
    return parts.groupBy("j").agg(F.sum("correct").alias("correct"), F.sum("total").alias("total"),
                                  F.max("bad").alias("bad"), F.max("top").alias("top"))


def chosen_scores(layer: Layer, chosen: list[tuple[int, float | None]]) -> DataFrame:
    """``(item_id, batch_id, [label,] s0.., r0..)``: the chosen outputs (place in
    the layout; for ranks the largest one) as the scores of new models -- scores
    scaled over their batch, ranks turned into ``1 - (r - 1) / (top - 1)`` -- with
    their ordinal ranks."""
    keep = ["item_id", "batch_id"] + (["label"] if layer.ss.has_label else [])
    rows = layer.rows(keep)
    n = len(chosen)
    schema = schema_of(rows, keep) + "".join(f", {f(i)} array<double>" for f in (s_col, r_col) for i in range(n))

    def per_batch(me, items):
        got = {}
        wanted = {j for j, _ in chosen}
        for j, values in me.outputs(items):
            if j in wanted:
                got[j] = values if me.lattice.kinds[j] else scaled(values)
        new = []
        for j, top in chosen:
            values = got[j]
            if me.lattice.kinds[j]:
                values = 1.0 - (values - 1.0) / (top - 1.0) if top != 1 else np.full(values.shape, np.nan)
            new.append(values)
        names = items.batch.schema.names
        # equal values that differ in their last bits tie, as picks have it
        yield pa.RecordBatch.from_arrays(
            [items.batch.column(names.index(k)) for k in keep] + [_list_column(v) for v in new]
            + [_list_column(ordinal_ranks(np.round(v, 9))) for v in new],
            names=[*keep, *[s_col(i) for i in range(n)], *[r_col(i) for i in range(n)]])

    return whole_batches(layer, keep, per_batch, schema)
