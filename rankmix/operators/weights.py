"""Diversity measures and weighting schemes.

Diversity weights depend only on the *first item of each batch*: per batch
one row is kept (``min(item_id)`` per batch, joined back on data already
clustered by ``batch_id``), the rank-score characteristic of every model is
taken on that row, and the M x M pairwise matrix is computed by array
functions inside that one row (M is metadata: no self-join, no pair rows).

A scheme is a function ``(score_set, ctx)`` returning a list of M floats
(same weights everywhere) or one Column giving the per-batch ARRAY of M
weights.  ``register_scheme`` adds new ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmix.functions import cd_of, ksi_of, order_of, rsc_desc
from rankmix.model import ScoreSet, s_col

# Scheme names and their accepted spellings.
AC, WCCDS, WCKDS, WCP = "AC", "WC-CDS", "WC-KDS", "WCP"
SCHEME_ALIASES = {"WCDS": WCCDS, "WCKDS": WCKDS}
UNSUPERVISED_SCHEMES = (AC, WCCDS, WCKDS)


def canonical_scheme(name: str) -> str:
    return SCHEME_ALIASES.get(name, name)


@dataclass
class SchemeContext:
    ss: ScoreSet
    first_cols: dict = field(default_factory=dict)


SchemeFn = Callable[[ScoreSet, SchemeContext], list]
_REGISTRY: dict[str, SchemeFn] = {}


def register_scheme(name: str, fn: SchemeFn) -> None:
    _REGISTRY[name] = fn


def scheme_names() -> tuple[str, ...]:
    return tuple(_REGISTRY)


def validate_schemes(schemes, supervised: bool = True) -> tuple[str, ...]:
    out = []
    for s in schemes:
        c = canonical_scheme(s)
        if c not in _REGISTRY:
            raise ValueError(f"unknown weighting scheme {s!r}; choose from {sorted(_REGISTRY)}")
        if c == WCP and not supervised:
            raise ValueError("WCP needs model accuracies, i.e. ground truth")
        out.append(c)
    return tuple(out)


# ---------------------------------------------------------------- first items

BROADCAST_BATCHES = 1_000_000      # first ids of at most 8 bytes each: 8 MB


def first_items(ss: ScoreSet) -> DataFrame:
    """``(batch_id, s0..)``: the scores of the lowest item id of every batch.

    The first ids come from the narrow id column alone (a hash aggregate with
    partial aggregation).  In a table clustered by ``batch_id`` they are joined
    back on ``batch_id`` (the one-row-per-batch side is the hash build side) and
    the first item is kept by a filter, written as a difference so that the
    optimizer keeps it as a condition instead of a second join key, which would
    shuffle the item rows.  Elsewhere they select the rows by id, as a broadcast
    list while a count shows that they are few, so that no other item's scores
    are kept, moved or written.
    """
    if ss.batch_size is None:
        raise ValueError("score set has no batches; call with_batches first")
    cols = [s_col(i) for i in range(ss.n_models)]
    if ss.table is not None:
        firsts = ss.df.groupBy("batch_id").agg(F.min("item_id").alias("_first"))
        rows = ss.df.select("batch_id", "item_id", *cols).join(
            firsts.hint("shuffle_hash"), on="batch_id", how="inner")
        return rows.filter((F.col("item_id") - F.col("_first")) == 0).select("batch_id", *cols)
    ids = ss.ids if ss.ids is not None else ss.df.select("item_id")
    firsts = ids.groupBy(F.floor(F.col("item_id") / F.lit(ss.batch_size)).alias("batch_id")).agg(
        F.min("item_id").alias("item_id"))
    few = firsts.count() <= BROADCAST_BATCHES
    rows = ss.df.select("item_id", *cols)
    return rows.join(F.broadcast(firsts) if few else firsts, "item_id").select("batch_id", *cols)


def pairwise_matrix(rsc: Column, n_classes: int, corr: str = "CD", order: Column | None = None) -> Column:
    """``P[j][i]`` = diversity of model i vs model j (NULL on the diagonal),
    from the ``M x C`` matrix of RSC rows (``order``: each row's ascending
    order, needed for xi).  Rows are lambda-bound, so nothing is evaluated
    twice, and the expression size does not depend on M."""
    if corr == "CD":
        return F.transform(rsc, lambda b, j: F.transform(
            rsc, lambda a, i: F.when(i != j, cd_of(a, b, n_classes))))
    return F.transform(rsc, lambda b, j: F.transform(
        F.arrays_zip(order.alias("o"), rsc.alias("a")),
        lambda oa, i: F.when(i != j, ksi_of(oa.getField("o"), oa.getField("a"), b, n_classes))))


def strength_of(pw: Column) -> Column:
    """Per model j the mean of ``P[j][i]`` over i != j, NULLs skipped."""
    def mean(row):
        vals = F.filter(row, lambda x: x.isNotNull())
        return F.try_divide(F.aggregate(vals, F.lit(0.0), lambda acc, x: acc + x),
                            F.size(vals).cast("double"))
    return F.transform(pw, mean)


def _staged(ss: ScoreSet) -> DataFrame:
    """Per batch: the RSC matrix of the first item, then both pairwise
    matrices — each staged as a column so it is evaluated once per batch."""
    m, n = ss.n_models, ss.n_classes
    rsc = F.array(*[rsc_desc(F.col(s_col(i))) for i in range(m)])
    first = first_items(ss).select("batch_id", rsc.alias("_rsc"))
    first = first.select("batch_id", "_rsc", F.transform("_rsc", order_of).alias("_ord"))
    return first.select("batch_id", "_rsc",
                        pairwise_matrix(F.col("_rsc"), n, "CD").alias("_pw_cd"),
                        pairwise_matrix(F.col("_rsc"), n, "KSI", F.col("_ord")).alias("_pw_ksi"))


def _pw_col(corr: str) -> str:
    return "_pw_cd" if corr == "CD" else "_pw_ksi"


def strengths(ss: ScoreSet, corr: str = "CD") -> DataFrame:
    """Long ``(batch_id, model, strength)``.  The generator is an outer one (no
    matrix is empty): of a plain one the optimizer infers a filter on the whole
    matrix and moves it below the join with the first ids, to every item row."""
    st = _staged(ss).select("batch_id", strength_of(F.col(_pw_col(corr))).alias("d"))
    names = F.array(*[F.lit(m) for m in ss.models])
    return st.select("batch_id", F.posexplode_outer("d").alias("i", "strength")).select(
        "batch_id", names[F.col("i")].alias("model"), "strength")


def pairwise(ss: ScoreSet, corr: str = "CD") -> DataFrame:
    """Long ``(batch_id, model_a, model_b, value)``: the off-diagonal matrix
    (``value`` = diversity of model_a vs model_b)."""
    names = F.array(*[F.lit(m) for m in ss.models])
    st = _staged(ss).select("batch_id", F.posexplode_outer(_pw_col(corr)).alias("j", "row"))
    out = st.select("batch_id", "j", F.posexplode_outer("row").alias("i", "value"))
    return out.filter(F.col("i") != F.col("j")).select(
        "batch_id", names[F.col("i")].alias("model_a"), names[F.col("j")].alias("model_b"), "value")


# ---------------------------------------------------------------- schemes
# A scheme returns per model a float (constant weight) or one Column: the
# per-batch ARRAY of M weights over the staged columns ``_rsc``, ``_pw_cd``
# and ``_pw_ksi`` of the first-item row.

def _ac(ss: ScoreSet, ctx: SchemeContext):
    return [1.0] * ss.n_models


def _wccds(ss: ScoreSet, ctx: SchemeContext):
    return strength_of(F.col("_pw_cd"))


def _wckds(ss: ScoreSet, ctx: SchemeContext):
    return strength_of(F.col("_pw_ksi"))


def _wcp(ss: ScoreSet, ctx: SchemeContext):
    if ss.accuracies is None:
        raise ValueError("WCP needs model accuracies (ground truth)")
    return [a * 0.01 for a in ss.accuracies]


register_scheme(AC, _ac)
register_scheme(WCCDS, _wccds)
register_scheme(WCKDS, _wckds)
register_scheme(WCP, _wcp)


@dataclass
class Weights:
    """Per scheme a list of per-model weights (float literal or Column over
    the per-batch frame ``frame``)."""

    schemes: tuple[str, ...]
    per_scheme: dict
    frame: DataFrame | None

    def column(self, scheme: str, i: int) -> Column:
        w = self.per_scheme[scheme][i]
        return w if isinstance(w, Column) else F.lit(float(w))

    def literal(self, scheme: str, i: int) -> float | None:
        w = self.per_scheme[scheme][i]
        return None if isinstance(w, Column) else float(w)


def weight_col_name(sid: int) -> str:
    return f"w{sid}"


def batch_weights(ss: ScoreSet, schemes) -> Weights:
    """Weights of every selected scheme.  Per-batch schemes are evaluated on
    the staged first-item rows: ``(batch_id, w<scheme id> ARRAY<DOUBLE>)``."""
    schemes = tuple(canonical_scheme(s) for s in schemes)
    ctx = SchemeContext(ss)
    raw = {s: _REGISTRY[s](ss, ctx) for s in schemes}
    per_batch = [(sid, s) for sid, s in enumerate(schemes) if isinstance(raw[s], Column)]
    frame = None
    if per_batch:
        frame = _staged(ss).select("batch_id", *[raw[s].alias(weight_col_name(sid))
                                                 for sid, s in per_batch])
    per_scheme = {}
    for sid, s in enumerate(schemes):
        if isinstance(raw[s], Column):
            per_scheme[s] = [F.col(weight_col_name(sid))[i] for i in range(ss.n_models)]
        else:
            per_scheme[s] = [float(w) for w in raw[s]]
    return Weights(schemes=schemes, per_scheme=per_scheme, frame=frame)


def weights_long(ss: ScoreSet, schemes) -> DataFrame:
    """Long ``(batch_id, scheme, model, weight)`` for every batch."""
    w = batch_weights(ss, schemes)
    batches = (w.frame if w.frame is not None
               else ss.df.select("batch_id").distinct())
    rows = []
    for s in w.schemes:
        for i, m in enumerate(ss.models):
            rows.append(F.struct(F.lit(s).alias("scheme"), F.lit(m).alias("model"),
                                 w.column(s, i).cast("double").alias("weight")))
    return batches.select("batch_id", F.explode(F.array(*rows)).alias("x")).select(
        "batch_id", "x.scheme", "x.model", "x.weight")
