"""Property checks: rank sums, weight-scale invariance,
equal weights = AC, one-model vote = the model."""
import hypothesis.strategies as st
from hypothesis import given, settings, HealthCheck
from pyspark.sql import functions as F

from rankmix.functions import avg_rank_desc, ordinal_rank_desc
from rankmix.model import ScoreSet
from rankmix.operators.combine import RC, SC, fused_matrices, fused_specs
from rankmix.operators.vote import subset_accuracy
from rankmix.operators.weights import batch_weights, register_scheme
from rankmix.sources.frames import with_batches, with_ranks

C = 4
row = st.lists(st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.75, 1.0]), min_size=C, max_size=C)
SETTINGS = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(st.lists(row, min_size=1, max_size=40))
def test_rank_sums(spark, rows):
    df = spark.createDataFrame([(r,) for r in rows], "s array<double>")
    got = df.select(F.aggregate(avg_rank_desc(F.col("s")), F.lit(0.0), lambda a, x: a + x).alias("a"),
                    F.aggregate(ordinal_rank_desc(F.col("s")), F.lit(0.0), lambda a, x: a + x).alias("o"),
                    F.array_sort(ordinal_rank_desc(F.col("s"))).alias("perm")).collect()
    for r in got:
        assert r.a == r.o == C * (C + 1) / 2
        assert r.perm == [1.0, 2.0, 3.0, 4.0]


def _set(spark, rows_a, rows_b, rows_c):
    data = [(i, i % C, a, b, c) for i, (a, b, c) in enumerate(zip(rows_a, rows_b, rows_c))]
    df = spark.createDataFrame(data, "item_id long, label int, s0 array<double>, s1 array<double>, "
                                     "s2 array<double>")
    ss = ScoreSet(df=df, models=("A", "B", "C"), n_classes=C)
    return with_ranks(with_batches(ss, 8, partitions=3))


register_scheme("DOUBLE", lambda ss, ctx: [2.0] * ss.n_models)
register_scheme("W1", lambda ss, ctx: [0.5, 0.25, 0.125])
register_scheme("W1x3", lambda ss, ctx: [1.5, 0.75, 0.375])


def _mats(ss, scheme, kind):
    specs = [s for s in fused_specs(ss.models, [scheme]) if not s.is_base]
    m = fused_matrices(ss, batch_weights(ss, [scheme]), specs, kinds=(kind,)).collect()
    return {(r.fusion_model.rsplit("_", 1)[0], r.item_id): [round(v, 9) if v is not None else None
                                                             for v in r["values"]] for r in m}


@SETTINGS
@given(st.lists(st.tuples(row, row, row), min_size=3, max_size=20))
def test_weight_scaling_and_equal_weights(spark, triples):
    ss = _set(spark, *zip(*triples))
    for kind in (SC, RC):
        assert _mats(ss, "W1", kind) == _mats(ss, "W1x3", kind)
        assert _mats(ss, "AC", kind) == _mats(ss, "DOUBLE", kind)


def test_vote_of_one_model_is_the_model(spark):
    rows = [(i, i % 3, (i * 7) % 3) for i in range(30)]
    wide = spark.createDataFrame(rows, "item_id long, label int, p0 int")
    acc = subset_accuracy(wide, 1, 3, [(0,)], ["m"]).first()
    assert acc.correct == sum(1 for _, lab, p in rows if lab == p)
