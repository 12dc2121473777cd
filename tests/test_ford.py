"""F-ORD at sf0.001: base accuracies, strengths and layer values (FIXTURES.md)."""
import pytest

from rankmix.operators.evaluate import base_accuracy
from rankmix.operators.weights import strengths
from rankmix.plans import layer as L
from rankmix.sources.fixtures import ford_wide

from conftest import SF


@pytest.fixture(scope="module")
def ss(spark):
    return L.prepare(ford_wide(spark, SF), 2048, ("AC", "WC-CDS", "WCP"))


def test_base(ss):
    got = {r.fusion_model: r.correct for r in base_accuracy(ss).collect()}
    assert got == {"A": 362, "B": 399, "C": 389, "D": 389, "E": 450}


def test_strength_batch0(ss):
    st = {r.model: round(r.strength, 6) for r in strengths(ss, "CD").filter("batch_id = 0").collect()}
    assert st == {"A": 0.167184, "B": 0.155954, "C": 0.187444, "D": 0.174537, "E": 0.169303}


def test_layer(ss):
    acc = L.layer_accuracy(ss, ("AC", "WC-CDS", "WCP")).collect()
    got = {(r.kind, r.fusion_model): r.correct for r in acc}
    assert max(v for (k, _), v in got.items() if k == "SC") == 540 == got[("SC", "BCDE_AC")]
    assert max(v for (k, _), v in got.items() if k == "RC") == 513 == got[("RC", "BDE_AC")]
    assert (got[("SC", "ABCDE_AC")], got[("RC", "ABCDE_AC")]) == (523, 483)
    assert (got[("SC", "ABCDE_WC-CDS")], got[("RC", "ABCDE_WC-CDS")]) == (525, 487)
    assert (got[("SC", "ABCDE_WCP")], got[("RC", "ABCDE_WCP")]) == (534, 485)


def test_vote_over_fused(spark):
    from rankmix.plans.catalog import vote_fused_accuracy
    assert vote_fused_accuracy(spark, SF).first().correct == 497


def test_search_round1(spark, ss):
    from rankmix.plans.search import search
    h = search(ss, ("AC", "WC-CDS", "WCP"), max_rounds=2)
    assert [p[2] for p in h[0]["pooled"]] == [540, 539, 536, 534]
    assert h[1]["pooled"][0][2] == 545


def test_partition_count_invariance(spark):
    schemes = ("AC", "WC-CDS", "WC-KDS", "WCP")
    got = []
    for parts in (1, 7):
        ss = L.prepare(ford_wide(spark, SF), 2048, schemes, partitions=parts)
        acc = L.layer_accuracy(ss, schemes).select("kind", "fusion_model", "correct").collect()
        got.append(sorted(tuple(r) for r in acc))
    assert got[0] == got[1] and len(got[0]) == 218
