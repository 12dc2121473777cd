"""Four-item regression fusion (FIXTURES.md)."""
import pytest
from pyspark.sql import functions as F

from rankmix.plans import regression as R


@pytest.fixture(scope="module")
def wide(spark):
    rows = [(0, 3.0, 2.5, 3.0), (1, 1.0, 1.5, 2.0), (2, 4.0, 3.5, 5.0), (3, 2.0, 2.0, 0.0)]
    return spark.createDataFrame(rows, "item_id long, target double, v0 double, v1 double")


def test_ranks_and_rsc(wide):
    long = R.to_long(wide, ["P", "Q"])
    ranks = {(r.model, r.item_id): r["rank"] for r in R.vector_ranks(long, partitions=3).collect()}
    assert [ranks[("P", i)] for i in range(4)] == [3, 1, 4, 2]
    assert [ranks[("Q", i)] for i in range(4)] == [3, 2, 4, 1]
    rsc = {(r.model, r["rank"]): round(r.value, 6) for r in R.vector_rsc(long, partitions=3).collect()}
    assert [rsc[("P", k)] for k in range(1, 5)] == [1.0, 0.5, 0.25, 0.0]
    assert [rsc[("Q", k)] for k in range(1, 5)] == [1.0, 0.6, 0.4, 0.0]


def test_weights_fusion_report(wide):
    models = ["P", "Q"]
    long = R.to_long(wide, models)
    w = R.regression_weights(long, models)
    assert round(w["WC-CDS"]["P"], 6) == 0.090139 == round(w["WC-CDS"]["Q"], 6)
    fused = R.fuse(R.with_vector_ranks(wide, models), models, w)
    got = {(r.kind, r.fusion_model, r.item_id): round(r.value, 6) for r in fused.collect()}
    assert [got[("SC", "PQ_AC", i)] for i in range(4)] == [2.75, 1.75, 4.25, 1.0]
    assert [got[("RC", "PQ_AC", i)] for i in range(4)] == [3.0, 1.5, 4.0, 1.5]
    mean_y = wide.agg(F.avg("target")).first()[0]
    rep = {r.model: (round(r.r2, 6), round(r.rmse, 6)) for r in R.report(fused, mean_y, models).collect()}
    assert rep["Base_P"] == (0.85, 0.433013)
    assert rep["Base_Q"] == (-0.2, 1.224745)
    assert rep["SC_PQ_AC"] == (0.6625, 0.649519) == rep["SC_PQ_WC-CDS"]
