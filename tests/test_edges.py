"""Edge rows from FIXTURES.md: gaps in item ids and a short last batch,
identical models, a constant score row, a constant batch, a class missing
from the truth, one model only."""
from pyspark.sql import functions as F

from rankmix.model import ScoreSet
from rankmix.operators.combine import fused_specs
from rankmix.operators.evaluate import per_class_accuracy
from rankmix.operators.weights import batch_weights, first_items, strengths
from rankmix.plans import layer as L
from rankmix.plans.search import output_validity


def _set(spark, rows, models=("A", "B", "C")):
    cols = ", ".join(f"s{i} array<double>" for i in range(len(models)))
    df = spark.createDataFrame(rows, f"item_id long, label int, {cols}")
    return L.prepare(ScoreSet(df=df, models=models, n_classes=3), 4, (), partitions=3)


def test_gaps_short_batch_identical_and_constant(spark):
    same = [0.2, 0.5, 0.3]
    rows = [
        (1, 1, same, same, [0.3, 0.3, 0.3]),    # batch 0 starts at 1 (gap at 0); C constant
        (2, 0, [0.6, 0.3, 0.1], [0.6, 0.3, 0.1], [0.1, 0.2, 0.7]),
        (9, 2, [0.25, 0.25, 0.25], [0.25, 0.25, 0.25], [0.5, 0.4, 0.1]),  # batch 2: one constant item
    ]
    ss = _set(spark, rows)
    firsts = {r.batch_id: r for r in first_items(ss).collect()}
    assert sorted(firsts) == [0, 2] and firsts[0].s0 == same
    st = {(r.batch_id, r.model): r.strength for r in strengths(ss, "CD").collect()}
    # batch 0: A and B identical (CD 0), C's first row is constant (RSC NULL -> skipped)
    assert st[(0, "A")] == 0.0 and st[(0, "B")] == 0.0 and st[(0, "C")] is None
    # batch 2 holds one item whose A and B rows are constant: the AB score
    # combination is constant over that batch -> its min-max scaling is invalid
    schemes = ["AC", "WC-CDS"]
    val = {(r.kind, r.fusion_model): r.valid
           for r in output_validity(ss, batch_weights(ss, schemes), fused_specs(ss.models, schemes)).collect()}
    assert val[("SC", "AB_AC")] is False and val[("RC", "AB_AC")] is True
    # C has weight NULL in batch 0 under WC-CDS -> outputs with C are invalid
    assert val[("RC", "AC_WC-CDS")] is False and val[("RC", "AB_WC-CDS")] is False


def test_class_missing_from_truth_and_one_model(spark):
    rows = [(i, i % 2, [0.5, 0.3, 0.2] if i % 2 == 0 else [0.2, 0.7, 0.1]) for i in range(6)]
    ss = _set(spark, rows, models=("A",))
    pca = {(r.fusion_model, r.cls): (r.correct, r["count"], r.class_accuracy)
           for r in per_class_accuracy(ss, None, fused_specs(ss.models, []), kinds=("SC",)).collect()}
    assert pca[("A", 0)] == (3, 3, 1.0) and pca[("A", 1)] == (3, 3, 1.0)
    assert pca[("A", 2)] == (0, 0, None)
    st = strengths(ss, "CD").collect()
    assert all(r.strength is None for r in st)
    acc = L.layer_accuracy(ss, ["AC"]).collect()
    assert {(r.kind, r.fusion_model) for r in acc} == {("SC", "A"), ("RC", "A")}
