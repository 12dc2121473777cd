"""Ranks and rank-score characteristics.

Per-item ranks (over the C classes of one item) are array expressions inside
the item row.  Ranks over a whole vector (all items of a model) need a
global order; ``global_rank`` gets it without funnelling a model through
one task: range partitioning on (model, order keys), a sort inside each
partition, the row position inside the partition (stamped once and
checkpointed), and per-partition offsets from a (partitions x models)-row
count table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankmix.functions import avg_rank_desc, has_ties, ordinal_rank_desc, rsc_desc
from rankmix.model import ScoreSet, s_col
from rankmix.session import default_partitions, ensure_checkpoint_dir

_POS_BITS = 33  # monotonically_increasing_id: partition index << 33 | row position


def global_rank(df: DataFrame, part: str, order: list, name: str = "rank",
                partitions: int | None = None) -> DataFrame:
    """Ordinal rank 1..n of every row within ``part`` by ``order`` (which must
    be a total order, e.g. end with a unique key)."""
    n = partitions or default_partitions(df.sparkSession)
    keys = [F.col(part)] + [F.col(c) if isinstance(c, str) else c for c in order]
    ordered = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    mid = F.monotonically_increasing_id()
    ided = ordered.select("*", F.shiftright(mid, _POS_BITS).alias("_pid"),
                          mid.bitwiseAND(F.lit((1 << _POS_BITS) - 1)).alias("_pos"))
    # positions must be read from ONE evaluation: the range bounds are
    # sampled and can differ between evaluations when the input order is not
    # fixed, so the stamped rows are written once to the checkpoint folder
    ensure_checkpoint_dir(df.sparkSession)
    ided = ided.checkpoint(eager=True)
    counts = ided.groupBy("_pid", part).agg(F.count(F.lit(1)).alias("_n"),
                                            F.min("_pos").alias("_start"))
    w = Window.partitionBy(part).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", part, "_start",
                            F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    # partitions x models rows: bounded by configuration, safe to broadcast
    out = ided.join(F.broadcast(offsets), on=["_pid", part], how="inner")
    return out.withColumn(name, F.col("_off") + F.col("_pos") - F.col("_start") + 1).drop(
        "_pid", "_pos", "_start", "_off")


def item_ranks(ss: ScoreSet, ordinal: bool = False) -> DataFrame:
    """Long ``(item_id, model, cls, score, rank)``; average (default) or
    ordinal ranks, 1 = highest score of the item."""
    if not ordinal:
        return _average_rank_rows(ss)
    rows = F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(s_col(i)).alias("s"), ordinal_rank_desc(F.col(s_col(i))).alias("r"))
        for i, m in enumerate(ss.models)]))
    df = ss.df.select("item_id", rows.alias("x"))
    return df.select("item_id", "x.model", F.posexplode(F.arrays_zip("x.s", "x.r"))).select(
        "item_id", "model", F.col("pos").alias("cls"), F.col("col.s").alias("score"),
        F.col("col.r").alias("rank"))


def _average_rank_rows(ss: ScoreSet) -> DataFrame:
    """``item_ranks`` by average ranks, for whole blocks of items in the tasks
    (``lattice.average_ranks``).  A NULL has no rank, NaN is the highest value."""
    from rankmix.operators.lattice import average_ranks, schema_of
    m = ss.n_models
    wide = ss.df.select("item_id", *[F.col(s_col(i)).cast("array<double>").alias(s_col(i)) for i in range(m)])

    def run(batches):
        for b in batches:
            for i in range(m):
                col = b.column(i + 1)
                sizes = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                for c in np.unique(sizes[sizes > 0]).tolist():
                    at = np.flatnonzero(sizes == c)
                    same = len(at) == len(sizes)
                    values = (col if same else col.take(pa.array(at))).flatten()
                    # codes keep the order and the ties of values, NaN on top
                    codes = np.unique(values.fill_null(0.0).to_numpy(zero_copy_only=False), return_inverse=True)[1].astype(np.float64)
                    missing = np.asarray(values.is_null())
                    codes[missing] = np.nan
                    ranks = average_ranks(np.ascontiguousarray(codes.reshape(-1, c).T)).T.ravel()
                    ids = b.column(0).take(pa.array(np.repeat(at, c)))
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(np.full(len(ranks), i, np.int32)), pa.array(np.tile(np.arange(c, dtype=np.int32), len(at))),
                         values, pa.array(ranks, mask=missing)], names=["item_id", "mi", "cls", "score", "rank"])

    rows = wide.mapInArrow(run, f"{schema_of(wide, ['item_id'])}, mi int, cls int, score double, rank double")
    names = F.array(*[F.lit(name) for name in ss.models])
    return rows.select("item_id", names[F.col("mi")].alias("model"), "cls", "score", "rank")


def item_rsc(ss: ScoreSet, of_ranks: bool = False) -> DataFrame:
    """Long ``(item_id, model, position, rank, value)``: every item's rank-score
    characteristic (row min-max scaled, sorted best first; position 1 = best)
    against its sorted average ranks.  ``of_ranks`` applies both to the item's
    average-rank values instead (the rank-side curve)."""
    src = [avg_rank_desc(F.col(s_col(i))) if of_ranks else F.col(s_col(i)) for i in range(ss.n_models)]
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), src[i].alias("a"))
                               for i, m in enumerate(ss.models)]))
    df = ss.df.select("item_id", rows.alias("x")).select(
        "item_id", "x.model", rsc_desc(F.col("x.a")).alias("f"), F.array_sort(avg_rank_desc(F.col("x.a"))).alias("r"))
    return df.select("item_id", "model", F.posexplode(F.arrays_zip("f", "r"))).select(
        "item_id", "model", (F.col("pos") + 1).alias("position"), F.col("col.r").alias("rank"),
        F.col("col.f").alias("value"))


def mean_rsc(ss: ScoreSet, of_ranks: bool = False) -> DataFrame:
    """``(model, position, rank, value)``, the rank-score characteristic of
    a model's class means over all items (``of_ranks``: means of its average
    ranks).  Both axes are sorted: the k-th value of the scaled means from the
    highest down stands beside the k-th of the means' average ranks."""
    # one row per (item, model, class) inside the task, summed map-side: the
    # plan does not grow with the class count
    src = [avg_rank_desc(F.col(s_col(i))) if of_ranks else F.col(s_col(i)) for i in range(ss.n_models)]
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("mi"), src[i].alias("a")) for i in range(ss.n_models)]))
    long = ss.df.select(rows.alias("x")).select("x.mi", F.posexplode("x.a").alias("cls", "v"))
    # means are rounded to 9 decimals before ranking: an average's last bits
    # depend on the summation order, which is not fixed across partitions
    means = long.groupBy("mi", "cls").agg(F.round(F.avg("v"), 9).alias("mean"))
    per = means.groupBy("mi").agg(F.transform(F.array_sort(F.collect_list(F.struct("cls", "mean"))),
                                              lambda p: p["mean"]).alias("a"))
    per = per.select("mi", rsc_desc(F.col("a")).alias("f"), F.array_sort(avg_rank_desc(F.col("a"))).alias("r"))
    names = F.array(*[F.lit(m) for m in ss.models])
    return per.select(names[F.col("mi")].alias("model"), F.posexplode(F.arrays_zip("f", "r"))).select(
        "model", (F.col("pos") + 1).alias("position"), F.col("col.r").alias("rank"), F.col("col.f").alias("value"))


def tie_counts(ss: ScoreSet) -> DataFrame:
    """``(model, items_with_ties)``: items whose scores have a tie."""
    aggs = [F.sum(F.when(has_ties(F.col(s_col(i))), 1).otherwise(0)).cast("long").alias(f"t{i}")
            for i in range(ss.n_models)]
    one = ss.df.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"t{i}").alias("items_with_ties"))
                               for i, m in enumerate(ss.models)]))
    return one.select(rows.alias("x")).select("x.*")


def rank_invert(ranks: DataFrame, value_col: str = "rank", by: list[str] | None = None) -> DataFrame:
    """``1 - (r - 1) / (max(r) - 1)`` with the max over all rows (per ``by``):
    turns ranks (1 = best) into scores in [0, 1] (K5).  The max is one small
    aggregate: per group it is broadcast-joined (groups are models: metadata
    sized); without groups it is read back as a scalar."""
    if by:
        mx = ranks.groupBy(*by).agg(F.max(value_col).alias("_mx"))
        joined = ranks.join(F.broadcast(mx), on=by)
        top = F.col("_mx")
    else:
        joined = ranks
        top = F.lit(float(ranks.agg(F.max(value_col)).first()[0]))
    return joined.withColumn("inverted", F.lit(1.0) - F.try_divide(
        F.col(value_col) - 1, top - 1)).drop("_mx")
