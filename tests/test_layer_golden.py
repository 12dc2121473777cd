"""Hand-checked layer on 2 items x 3 classes x 3 models (FIXTURES.md)."""
import pytest
from pyspark.sql import functions as F

from rankmix.model import ScoreSet
from rankmix.operators.combine import RC, SC, fused_matrices, fused_specs
from rankmix.operators.evaluate import accuracy
from rankmix.operators.weights import batch_weights, pairwise, strengths
from rankmix.sources.frames import with_batches, with_ranks

A = [[.7, .2, .1], [.3, .3, .4]]
B = [[.5, .4, .1], [.1, .6, .3]]
C = [[.2, .5, .3], [.2, .2, .6]]


@pytest.fixture(scope="module")
def g2(spark):
    rows = [(i, lab, A[i], B[i], C[i]) for i, lab in enumerate([0, 1])]
    df = spark.createDataFrame(rows, "item_id long, label int, s0 array<double>, s1 array<double>, s2 array<double>")
    ss = ScoreSet(df=df, models=("A", "B", "C"), n_classes=3)
    ss = with_ranks(with_batches(ss, 2048, partitions=2))
    return ss.with_df(ss.df, accuracies=(50.0, 100.0, 0.0))


def _mat(spark, ss, schemes, kind):
    specs = fused_specs(ss.models, schemes)
    m = fused_matrices(ss, batch_weights(ss, schemes), specs, kinds=(kind,)).collect()
    return {(r.fusion_model, r.item_id): [round(v, 6) for v in r["values"]] for r in m}


def test_avg_ranks(g2):
    r = {row.item_id: (row.r0, row.r1, row.r2) for row in g2.df.collect()}
    assert r[0] == ([1.0, 2.0, 3.0], [1.0, 2.0, 3.0], [3.0, 1.0, 2.0])
    assert r[1] == ([2.5, 2.5, 1.0], [3.0, 1.0, 2.0], [2.5, 2.5, 1.0])


def test_cd_and_strength(g2):
    pw = {(r.model_a, r.model_b): round(r.value, 6) for r in pairwise(g2, "CD").collect()}
    assert pw[("A", "B")] == 0.336788 and pw[("A", "C")] == 0.096225 and pw[("B", "C")] == 0.240563
    st = {r.model: round(r.strength, 6) for r in strengths(g2, "CD").collect()}
    assert st == {"A": 0.216506, "B": 0.288675, "C": 0.168394}


def test_ksi_without_ties_is_constant(g2):
    st = {r.model: round(r.strength, 6) for r in strengths(g2, "KSI").collect()}
    assert st == {"A": 0.75, "B": 0.75, "C": 0.75}


def test_sc_ac(spark, g2):
    m = _mat(spark, g2, ["AC"], SC)
    assert m[("AB_AC", 0)] == [1.0, 0.4, 0.0] and m[("AB_AC", 1)] == [0.2, 0.7, 0.5]
    assert m[("ABC_AC", 0)] == [1.0, 0.666667, 0.0]
    assert m[("ABC_AC", 1)] == [0.111111, 0.666667, 0.888889]


def test_rc_ac_and_cds(spark, g2):
    m = _mat(spark, g2, ["AC"], RC)
    assert m[("AB_AC", 1)] == [2.75, 1.75, 1.5]
    m = _mat(spark, g2, ["WC-CDS"], RC)
    assert m[("ABC_WC-CDS", 0)] == [1.847059, 1.576471, 2.576471]
    assert m[("BC_WC-CDS", 0)] == [2.263158, 1.368421, 2.368421]


def test_wcp_skips_zero_weight(spark, g2):
    m = _mat(spark, g2, ["WCP"], SC)
    assert m[("BC_WCP", 0)] == [0.8, 0.6, 0.0] and m[("BC_WCP", 1)] == [0.0, 1.0, 0.4]
    assert m[("ABC_WCP", 1)] == [0.142857, 0.857143, 0.5]


def test_accuracies(g2):
    schemes = ["AC", "WC-CDS", "WCP"]
    acc = accuracy(g2, batch_weights(g2, schemes), fused_specs(g2.models, schemes)).collect()
    got = {(r.kind, r.fusion_model): r.accuracy for r in acc}
    assert got[(SC, "AB_AC")] == 100.0 and got[(RC, "AB_AC")] == 50.0
    assert got[(SC, "BC_WCP")] == 100.0 and got[(RC, "BC_WCP")] == 100.0
    assert got[(SC, "BC_WC-CDS")] == 50.0 and got[(RC, "ABC_WC-CDS")] == 0.0
    assert got[(SC, "A")] == 50.0 and got[(SC, "B")] == 100.0 and got[(SC, "C")] == 0.0


def test_partition_count_invariance(spark, g2):
    schemes = ["AC", "WC-CDS"]
    base = accuracy(g2, batch_weights(g2, schemes), fused_specs(g2.models, schemes))
    one = with_batches(g2.with_df(g2.df.drop("batch_id"), batch_size=None), 2048, partitions=7)
    other = accuracy(one, batch_weights(one, schemes), fused_specs(one.models, schemes))
    key = ["kind", "fusion_model"]
    assert sorted(base.select(*key, "correct").collect()) == sorted(other.select(*key, "correct").collect())
