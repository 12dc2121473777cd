"""Fusion of regression models.

Input: one row per item with ``target`` and one prediction column per model
(``v0``..), or the long form ``(item_id, model, score)``.

* ranks (K3): ascending ordinal rank of each model's whole vector, ties by
  ``item_id`` — ``global_rank`` (range partitioned, no single task per model);
* rank-score characteristic (K7/K8): the whole vector min-max (or max) scaled
  and sorted best first;
* weights (F14): AC = 1; WC-CDS = mean cognitive diversity between the
  models' vector RSCs; WC-KDS = mean xi dissimilarity of the vector RSCs; both
  from one row by position (one shuffle), each model sorted once;
* fusion (F13): per subset and scheme the weighted mean of the vectors (SC)
  and of the ranks with inverse weights (RC); zero when no member has weight;
* report (C5/C6): R^2 = 1 - SSE/SST and RMSE per output.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmix.functions import lsum
from rankmix.operators.ranks import global_rank
from rankmix.operators.weights import AC, WCCDS, WCKDS, canonical_scheme

REGRESSION_SCHEMES = (AC, WCCDS, WCKDS)


def to_long(wide: DataFrame, models) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"v{i}").alias("score"))
                               for i, m in enumerate(models)]))
    return wide.select("item_id", rows.alias("x")).select("item_id", "x.model", "x.score")


def from_scores(scores: DataFrame, truth: DataFrame, models=None) -> tuple[DataFrame, tuple[str, ...]]:
    """Regression input from a score directory's rows ``(item_id, model, cls,
    score)``, whose files hold one value each, and the truth ``(item_id, label)``:
    ``item_id, target, v0..`` and the models' names in order.  Items without a
    truth or without some model's value raise when read."""
    if models is None:
        models = tuple(scores.agg(F.sort_array(F.collect_set("model")).alias("m")).first()["m"])
    values = [F.max(F.when((F.col("model") == m) & (F.col("cls") == 0), F.col("score"))).alias(f"v{i}")
              for i, m in enumerate(models)]
    rows = scores.select("item_id", "model", "cls", "score").unionByName(
        truth.select("item_id", F.lit(None).cast("string").alias("model"), F.lit(-1).alias("cls"),
                     F.col("label").cast("double").alias("score")))
    wide = rows.groupBy("item_id").agg(F.max(F.when(F.col("cls") == -1, F.col("score"))).alias("target"), *values)
    gaps = [F.when(F.col(c).isNull(), F.raise_error(F.concat(
        F.lit(f"no {n} for item "), F.col("item_id").cast("string")))).otherwise(F.col(c)).alias(c)
        for c, n in (("target", "truth"), *[(f"v{i}", f"value of {m}") for i, m in enumerate(models)])]
    return wide.select("item_id", *gaps), tuple(models)


def vector_ranks(long: DataFrame, partitions: int | None = None) -> DataFrame:
    """``(item_id, model, score, rank)``: ascending ordinal ranks per model."""
    return global_rank(long.select("item_id", "model", "score"), "model", ["score", "item_id"],
                       "rank", partitions)


def vector_rsc(long: DataFrame, scale: str = "minmax", partitions: int | None = None,
               ranked: DataFrame | None = None) -> DataFrame:
    """``(model, rank, value)``: scaled scores sorted from best (rank 1) down.

    ``scale="minmax"`` gives (x - min)/(max - min); ``"max"`` gives x / max.
    The descending order (score desc, item_id desc) is the exact reverse of
    the ascending vector ranks, so ``rank = n + 1 - ascending rank``: pass
    ``ranked`` (from ``vector_ranks``) to reuse one global ordering.
    """
    ranked = ranked if ranked is not None else vector_ranks(long, partitions)
    # one row per model: metadata sized
    stats = ranked.groupBy("model").agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"),
                                        F.count(F.lit(1)).alias("_n"))
    joined = ranked.join(F.broadcast(stats), on="model")
    if scale == "max":
        val = F.try_divide(F.col("score"), F.col("_hi"))
    else:
        val = F.try_divide(F.col("score") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return joined.select("model", (F.col("_n") + 1 - F.col("rank")).alias("rank"), val.alias("value"))


def _by_position(long: DataFrame, models, partitions: int | None = None, ranked: DataFrame | None = None) -> DataFrame:
    """One row for every position of the RSCs: ``pos`` and for each model i its
    value ``v{i}``, the first and last position with that value ``l{i}, h{i}``,
    and those of the next position ``nl{i}, nh{i}`` (NULL at the end)."""
    rsc = vector_rsc(long, partitions=partitions, ranked=ranked)
    index = F.element_at(F.create_map(*[x for i, m in enumerate(models) for x in (F.lit(m), F.lit(i))]), F.col("model"))
    rsc = rsc.select(index.alias("i"), F.col("rank").alias("pos"), "value")
    ties = rsc.groupBy("i", "value").agg(F.min("pos").alias("l"), F.max("pos").alias("h"))
    # a NULL value (a constant model) ties with itself
    rows = rsc.alias("r").join(ties.alias("t"), (F.col("r.i") == F.col("t.i")) & F.col("r.value").eqNullSafe(F.col("t.value")))
    rows = rows.select("r.i", "r.value", "l", "h", F.explode(F.array(
        F.struct(F.col("r.pos").alias("pos"), F.lit(0).alias("d")),
        F.struct((F.col("r.pos") - 1).alias("pos"), F.lit(1).alias("d")))).alias("at")).filter("at.pos > 0")
    aggs = []
    for i in range(len(models)):
        here, nxt = (F.col("i") == i) & (F.col("at.d") == 0), (F.col("i") == i) & (F.col("at.d") == 1)
        aggs += [F.max(F.when(here, F.col("value"))).alias(f"v{i}"), F.max(F.when(here, F.col("l"))).alias(f"l{i}"),
                 F.max(F.when(here, F.col("h"))).alias(f"h{i}"), F.max(F.when(nxt, F.col("l"))).alias(f"nl{i}"),
                 F.max(F.when(nxt, F.col("h"))).alias(f"nh{i}")]
    return rows.groupBy(F.col("at.pos").alias("pos")).agg(*aggs)


def _pair_sums(rows: DataFrame, m: int, n: int) -> DataFrame:
    """``(a, b, squares, steps)`` for ordered pairs of models.

    ``squares`` is the sum of squared differences of the two curves.  ``steps``
    is the sum of |r(t + 1) - r(t)|, where t orders the positions by A's value
    upward (ties by position) and r ranks B's values upward (ties by t).  Both
    curves fall with the position, so t runs through A's tie groups from the last
    position to the first, and r has a closed form: with A's group l .. h and B's
    group bl .. bh around a position,

        r = n - bh  +  max(0, bh - h)  +  position - max(l, bl) + 1,

    the smaller values, those of B's group that A puts earlier, and those of both
    groups up to here.  Only where one of A's groups ends and the next begins do
    the two ranks lie in different rows; they meet by the position between them.
    """
    def rank(pos, low, high, b_low, b_high):
        return n - b_high + np.maximum(0, b_high - high) + pos - np.maximum(low, b_low) + 1

    def run(batches):
        squares, steps = np.zeros((m, m)), np.zeros((m, m), np.int64)
        for batch in batches:
            col = {k: batch.column(i) for i, k in enumerate(batch.schema.names)}
            ints = {k: c.fill_null(0).to_numpy(zero_copy_only=False) for k, c in col.items() if not k.startswith("v")}
            pos = ints["pos"]
            values = [col[f"v{i}"].to_numpy(zero_copy_only=False) for i in range(m)]
            more = pos < n
            for a in range(m):
                low, high, n_low, n_high = (ints[f"{k}{a}"] for k in ("l", "h", "nl", "nh"))
                end = high == pos
                alone, next_alone = end & (low == pos), n_high == pos + 1
                near = more & (~end | (alone & next_alone))
                ups = [(more & end & ~(alone & next_alone) & next_alone, pos, 1), (end & (low < pos) & (low > 1), low - 1, 0)]
                downs = [(more & alone & ~next_alone, pos, 0), ((low == pos) & (high > pos) & (high < n), high, 0)]
                for b in range(m):
                    if a == b:
                        continue
                    d = values[a] - values[b]
                    squares[a, b] += np.nansum(d * d)
                    r0 = rank(pos, low, high, ints[f"l{b}"], ints[f"h{b}"])
                    r1 = rank(pos + 1, n_low, n_high, ints[f"nl{b}"], ints[f"nh{b}"])
                    steps[a, b] += np.abs(r1 - r0)[near].sum()
                    for name, parts in (("up", ups), ("down", downs)):
                        for on, key, nxt in parts:
                            if on.any():
                                k = int(np.count_nonzero(on))
                                yield _pair_rows(a, b, k, key[on], **{name: (r1 if nxt else r0)[on]})
        for a in range(m):
            for b in range(m):
                if a != b:
                    yield _pair_rows(a, b, 1, np.zeros(1, np.int64), squares=squares[a, b:b + 1], steps=steps[a, b:b + 1])

    parts = rows.mapInArrow(run, "a int, b int, key long, up long, down long, squares double, steps long")
    met = parts.groupBy("a", "b", "key").agg(F.max("up").alias("up"), F.max("down").alias("down"),
                                             F.sum("squares").alias("squares"), F.sum("steps").alias("steps"))
    return met.groupBy("a", "b").agg(
        F.sum("squares").alias("squares"),
        (F.sum(F.coalesce(F.abs(F.col("up") - F.col("down")), F.lit(0))) + F.sum(F.coalesce("steps", F.lit(0)))).alias("steps"))


def _pair_rows(a: int, b: int, k: int, key, up=None, down=None, squares=None, steps=None) -> pa.RecordBatch:
    cols = [pa.array(np.full(k, a), pa.int32()), pa.array(np.full(k, b), pa.int32()), pa.array(key, pa.int64())]
    for x, kind in ((up, pa.int64()), (down, pa.int64()), (squares, pa.float64()), (steps, pa.int64())):
        cols.append(pa.nulls(k, kind) if x is None else pa.array(x, kind))
    return pa.RecordBatch.from_arrays(cols, names=["a", "b", "key", "up", "down", "squares", "steps"])


def vector_strengths(long: DataFrame, models, partitions: int | None = None,
                     ranked: DataFrame | None = None) -> tuple[dict, dict]:
    """Diversity strength of every model by cognitive diversity and by xi
    (3 S / (N^2 - 1), mean over the other models as A), both from one pass over
    the models' RSCs (X5: whole vectors); each model is sorted once.  NULL for a
    single model, and for xi below two items."""
    ranked = ranked if ranked is not None else vector_ranks(long, partitions)
    m = len(models)
    # one row a model: metadata
    sizes = ranked.groupBy("model").agg(F.max("rank").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")).collect()
    n = max((int(r["n"]) for r in sizes), default=0)
    constant = {r["model"] for r in sizes if r["lo"] is None or r["lo"] == r["hi"]}
    cd, xi = {j: [] for j in range(m)}, {j: [] for j in range(m)}
    for r in _pair_sums(_by_position(long, models, partitions, ranked), m, n).collect() if m > 1 and n else []:
        if not constant & {models[r["a"]], models[r["b"]]}:        # a constant model has no curve
            cd[r["b"]].append((r["squares"] / n) ** 0.5)
        if n > 1:
            xi[r["b"]].append(3.0 * r["steps"] / (n * n - 1))
    return tuple({models[j]: sum(v) / len(v) if v else None for j, v in out.items()} for out in (cd, xi))


def ksi_strength_frame(long: DataFrame, models, partitions: int | None = None,
                       ranked: DataFrame | None = None) -> DataFrame:
    """``(model, strength)``: xi diversity strength over whole vectors."""
    _, xi = vector_strengths(long, models, partitions, ranked)
    return long.sparkSession.createDataFrame([(m, xi[m]) for m in models], "model string, strength double")


def regression_weights(long: DataFrame, models, schemes=REGRESSION_SCHEMES,
                       ranked: DataFrame | None = None) -> dict:
    schemes = [canonical_scheme(s) for s in schemes]
    unknown = [s for s in schemes if s not in REGRESSION_SCHEMES]
    if unknown:
        raise ValueError(f"scheme {unknown[0]} is not available for regression (needs accuracies "
                         f"or per-item class scores)")
    cd, xi = vector_strengths(long, models, ranked=ranked) if {WCCDS, WCKDS} & set(schemes) else ({}, {})
    return {s: {AC: dict.fromkeys(models, 1.0), WCCDS: cd, WCKDS: xi}[s] for s in schemes}


def fuse(wide_ranked: DataFrame, models, weights: dict, kinds=("SC", "RC")) -> DataFrame:
    """``(item_id, kind, fusion_model, value)`` for base models and every
    subset x scheme; ``wide_ranked`` has ``v{i}`` and ``q{i}`` (rank) columns."""
    m = len(models)
    rows = []
    for kind in kinds:
        src = "v" if kind == "SC" else "q"
        for i, name in enumerate(models):
            rows.append((kind, name, F.col(f"{src}{i}").cast("double")))
        for scheme, w in weights.items():
            for k in range(2, m + 1):
                for combo in combinations(range(m), k):
                    nums, dens = [], []
                    for i in combo:
                        wi = w[models[i]]
                        if wi is None or wi == 0:
                            continue
                        c = wi if kind == "SC" else 1.0 / wi
                        nums.append(F.col(f"{src}{i}").cast("double") * F.lit(c))
                        dens.append(F.lit(c))
                    name = "".join(models[i] for i in combo) + "_" + scheme
                    val = (F.lit(0.0) if not nums else
                           F.coalesce(F.try_divide(lsum(nums), lsum(dens)), F.lit(0.0)))
                    rows.append((kind, name, val))
    arr = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("fusion_model"),
                             v.alias("value")) for kind, name, v in rows])
    keep = ["item_id"] + (["target"] if "target" in wide_ranked.columns else [])
    return wide_ranked.select(*keep, F.explode(arr).alias("x")).select(*keep, "x.*")


def with_vector_ranks(wide: DataFrame, models, ranked: DataFrame | None = None) -> DataFrame:
    """Attach ``q{i}`` = ascending ordinal rank of ``v{i}`` (one shuffle on item_id)."""
    ranked = ranked if ranked is not None else vector_ranks(to_long(wide, models))
    piv = ranked.groupBy("item_id").agg(*[
        F.max(F.when(F.col("model") == mname, F.col("rank"))).alias(f"q{i}")
        for i, mname in enumerate(models)])
    return wide.join(piv, on="item_id")


def report(fused: DataFrame, mean_y: float, base_models, kinds=("SC",)) -> DataFrame:
    """``(model, r2, rmse)`` per output; base models are labelled ``Base_<m>``.
    ``mean_y`` is the target mean (one scalar aggregate by the caller)."""
    f = fused.filter(F.col("kind").isin(list(kinds)))
    err = F.col("target") - F.col("value")
    agg = f.groupBy("kind", "fusion_model").agg(
        F.sum(err * err).alias("sse"),
        F.sum((F.col("target") - F.lit(mean_y)) * (F.col("target") - F.lit(mean_y))).alias("sst"),
        F.count(F.lit(1)).alias("n"))
    label = F.when(F.col("fusion_model").isin(list(base_models)),
                   F.concat(F.lit("Base_"), F.col("fusion_model"))).otherwise(
        F.concat(F.col("kind"), F.lit("_"), F.col("fusion_model")))
    return agg.select(label.alias("model"),
                      (F.lit(1.0) - F.col("sse") / F.col("sst")).alias("r2"),
                      F.sqrt(F.col("sse") / F.col("n")).alias("rmse"))
