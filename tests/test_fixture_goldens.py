"""FIXTURES.md golden values at sf0.01 (F-ORD) and both scales (F-REG)."""
import pytest

from rankmix.operators.evaluate import base_accuracy
from rankmix.operators.weights import strengths
from rankmix.plans import layer as L
from rankmix.plans.catalog import reg_report, vote_fused_accuracy
from rankmix.sources.fixtures import ford_wide

SF01 = "/root/testdata/sf0.01"
S = ("AC", "WC-CDS", "WCP")


@pytest.fixture(scope="module")
def ss01(spark):
    return L.prepare(ford_wide(spark, SF01), 2048, S)


def test_ford_sf001(spark, ss01):
    assert {r.fusion_model: r.correct for r in base_accuracy(ss01).collect()} == \
        {"A": 3103, "B": 3317, "C": 3192, "D": 3256, "E": 3429}
    st = {r.model: round(r.strength, 6) for r in strengths(ss01, "CD").filter("batch_id = 0").collect()}
    assert st == {"A": 0.241761, "B": 0.184926, "C": 0.162532, "D": 0.168977, "E": 0.387468}
    acc = {(r.kind, r.fusion_model): r.correct for r in L.layer_accuracy(ss01, S).collect()}
    assert [(acc[("SC", f"ABCDE_{k}")], acc[("RC", f"ABCDE_{k}")]) for k in S] == \
        [(3701, 3547), (3645, 3539), (3715, 3541)]
    assert max(v for (k, _), v in acc.items() if k == "SC") == acc[("SC", "ABCDE_WCP")] == 3715
    assert max(v for (k, _), v in acc.items() if k == "RC") == acc[("RC", "BDE_AC")] == 3575
    assert vote_fused_accuracy(spark, SF01).first().correct == 3677


@pytest.mark.parametrize("sf,expected", [
    ("0.001", {"P": (0.100522, 137438.1885), "Q": (0.725672, 75900.953), "R": (0.008381, 144306.0531)}),
    ("0.01", {"P": (0.095796, 136915.0217), "Q": (0.152451, 132556.3091), "R": (0.000754, 143930.8885)}),
])
def test_freg(spark, sf, expected):
    rows = {r.model: (r.r2, r.rmse) for r in reg_report(spark, f"/root/testdata/sf{sf}").collect()}
    assert {m: rows[f"Base_{m}"] for m in expected} == expected
