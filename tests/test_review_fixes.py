"""Cases that the first review found: names, missing scores, many models and
classes, curves, file round trips, left-over tables."""
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankmix.functions import array_pick, avg_rank_desc
from rankmix.model import ScoreSet
from rankmix.operators import evaluate, prep
from rankmix.operators.combine import RC, SC, fused_specs, subsets
from rankmix.operators.ranks import item_rsc, mean_rsc
from rankmix.plans import layer as L
from rankmix.plans import search as S
from rankmix.sources import files, frames

SCHEMES = ("AC", "WC-CDS")


def score_set(spark, models, n_items=12, n_classes=3, label=True):
    """Scores from a small rule, so that no two models agree."""
    score = lambda m, i, k: ((i * 7 + m * 5 + k * 3 + (i * m * k) % 11) % 13 + 1) / 14
    rows = [(i, i % n_classes, *[[score(m + 1, i, k) for k in range(n_classes)] for m in range(len(models))])
            for i in range(n_items)]
    cols = ", ".join(f"s{m} array<double>" for m in range(len(models)))
    df = spark.createDataFrame(rows, f"item_id long, label int, {cols}")
    return ScoreSet(df=df if label else df.drop("label"), models=tuple(models), n_classes=n_classes, has_label=label)


def test_outputs_of_one_display_name_stay_apart(spark):
    ss = L.prepare(score_set(spark, ["A", "AB", "BC", "C"]), 4, SCHEMES)
    acc = L.layer_accuracy(ss, ["AC"])
    rep = L.layer_report(acc).collect()
    assert len(rep) == 15 and sum(r.fusion_model == "ABC_AC" for r in rep) == 2
    labels = L.unsupervised_labels(ss, ["AC"])
    assert len(set(labels.columns)) == 31 and labels.count() == 12
    assert S.search(ss, ["AC"])[-1]["empty"] in (True, False)
    frames.release(ss)


def test_many_models_need_no_limit(spark):
    names = [f"m{i}" for i in range(15)]
    ss = score_set(spark, names, n_items=4)
    assert evaluate.base_accuracy(ss).count() == 15
    assert len(fused_specs(names, [])) == 15 and len(subsets(15, full_set_only=True)) == 1
    p = L.prepare(ss, 4, ["WCP"])
    assert len(p.accuracies) == 15
    assert L.layer_accuracy(p, ["AC"], max_size=2).count() == 2 * (15 + 105)
    frames.release(p)


def test_search_without_wcp_and_its_summary(spark):
    ss = L.prepare(score_set(spark, ["A", "B", "C"]), 4, ["AC"])
    assert ss.accuracies is None
    history = S.search(ss, ["AC"], max_rounds=2)
    out = S.search_summary(ss, history)
    assert out["gain"] >= 0 and out["ended_by_limit"] == history[-1]["limit"]
    votes = S.select_outputs(ss, ["AC"], method="Majority Vote")
    assert votes.count() == 12
    with pytest.raises(ValueError):
        S.select_outputs(ss, ["AC"], method="other")
    frames.release(ss)


def test_scores_stay_with_their_class(spark):
    rows = [(0, "a", 0, .1), (0, "a", 2, .9), (0, "b", 0, .4), (0, "b", 1, .3), (0, "b", 2, .3), (1, "b", 1, 1.0)]
    long = spark.createDataFrame(rows, "item_id long, model string, cls int, score double")
    truth = spark.createDataFrame([(0, 2), (2, 1)], "item_id long, label int")
    ss = frames.to_wide(long, truth=truth, partitions=2)
    got = {r.item_id: (r.s0, r.s1, r.label) for r in ss.df.collect()}
    assert got[0] == ([.1, None, .9], [.4, .3, .3], 2)
    assert got[1] == ([None] * 3, [None, 1.0, None], None)
    assert got[2] == ([None] * 3, [None] * 3, 1)
    with pytest.raises(ValueError):
        evaluate.check_score_set(ss)


def test_files_of_different_width_and_round_trip(spark, tmp_path):
    pd.DataFrame([[.7, .2, .1], [.3, .3, .4]]).to_csv(tmp_path / "wide_scores.csv")
    pd.DataFrame([[.1, .2, .3, .4]] * 3).to_csv(tmp_path / "wider_scores.csv")
    long = files.read_score_dir(spark, str(tmp_path))
    got = {m: n for m, n in long.groupBy("model").count().collect()}
    assert got == {"wide": 6, "wider": 12}
    assert long.filter("score is null").count() == 0
    files.write_wide_scores_csv(long.filter("model = 'wider'"), 4, str(tmp_path / "out"))
    back = files.read_written_scores(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, long.filter("model = 'wider'").collect()))


def test_truth_by_position_and_sink(spark, tmp_path):
    values = [(7 * i) % 5 for i in range(500)]
    pd.DataFrame({"0": values}, index=range(499, -1, -1)).to_csv(tmp_path / "t.csv")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = files.read_truth(spark, str(tmp_path / "t.csv"), by_position=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.label for r in sorted(rows)] == values
    files.write_table(spark.createDataFrame(rows).coalesce(1), str(tmp_path / "truth"))
    assert files.read_truth(spark, str(tmp_path / "truth")).count() == 500
    with pytest.raises(ValueError):
        files.write_table(spark.createDataFrame(rows).repartition(2), str(tmp_path / "two"))
        files.read_truth(spark, str(tmp_path / "two"), by_position=True)


def test_other_sources(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a;b\n1;x\n2;y\n")
    assert files.read_delimited(spark, str(tmp_path / "x.csv")).collect() == [(1, "x"), (2, "y")]
    spark.range(3).write.parquet(str(tmp_path / "p1"))
    spark.range(3, 5).write.parquet(str(tmp_path / "p2"))
    assert files.read_parquet_many(spark, str(tmp_path / "p1"), str(tmp_path / "p2")).count() == 5


def test_curves_sort_both_axes(spark):
    df = spark.createDataFrame([(0, [.2, .9, .4]), (1, [.4, .7, .2])], "item_id long, s0 array<double>")
    ss = ScoreSet(df=df, models=("a",), n_classes=3, has_label=False)
    got = [(r.position, r.rank, round(r.value, 6)) for r in mean_rsc(ss).orderBy("position").collect()]
    assert got == [(1, 1.0, 1.0), (2, 2.5, 0.0), (3, 2.5, 0.0)]
    one = [(r.rank, r.value) for r in item_rsc(ss).filter("item_id = 0").orderBy("position").collect()]
    assert [r for r, _ in one] == [1.0, 2.0, 3.0] and one[0][1] == 1.0
    ranks = [(r.rank, r.value) for r in mean_rsc(ss, of_ranks=True).orderBy("position").collect()]
    assert ranks == [(1.5, 1.0), (1.5, 1.0), (3.0, 0.0)]


def test_picks_and_ranks_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(0, [.3, None, .3, .1]), (1, [None, None]), (2, [.1, .2 + 1e-12, .2])],
                               "i long, a array<double>")
    got = {r.i: (r.p, r.r) for r in df.select("i", array_pick(F.col("a")).alias("p"), avg_rank_desc(F.col("a")).alias("r")).collect()}
    assert got[0] == (0, [1.5, None, 1.5, 3.0]) and got[1] == (None, [None, None]) and got[2][0] == 1


def test_a_thousand_classes(spark):
    ss = L.prepare(score_set(spark, ["A", "B", "C"], n_items=20, n_classes=1000), 20, ["AC"])
    assert L.layer_accuracy(ss, ["AC"]).count() == 2 * 7
    frames.release(ss)


def test_rank_pick_switch_and_no_window_for_ranks(spark):
    ss = L.prepare(score_set(spark, ["A", "B"], label=False), 4, ["AC"])
    low = L.unsupervised_labels(ss, ["AC"], kinds=(RC,)).orderBy("item_id").collect()
    high = L.unsupervised_labels(ss, ["AC"], kinds=(RC,), rank_pick="max").orderBy("item_id").collect()
    assert low != high
    plan = L.layer_matrices(ss, ["AC"], kinds=(RC,))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan
    # scaled scores come from whole batches, which are clustered already
    plan = L.layer_matrices(ss, ["AC"], kinds=(SC,))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan
    frames.release(ss)


def test_released_sets_leave_no_table(spark):
    before = {t.name for t in spark.catalog.listTables()}
    ss = L.prepare(score_set(spark, ["A", "B"]), 4, ["AC"])
    assert {t.name for t in spark.catalog.listTables()} != before
    frames.release(ss)
    assert {t.name for t in spark.catalog.listTables()} == before


def test_series_and_short_names(spark):
    ss = L.prepare(score_set(spark, ["random_forest", "svm"]), 4, ["AC"])
    acc = L.layer_accuracy(ss, ["AC"])
    rows = evaluate.performance_series(acc, ["AC"]).orderBy("position").collect()
    assert [r["size"] for r in rows] == [1, 1, 2] and rows[2].label == "random_forestsvm_AC"
    assert evaluate.short_names(["x"] * 28)[-2:] == ["A1", "B1"]
    short = dict(enumerate(evaluate.short_names(ss.models)))
    assert {r.label for r in evaluate.performance_series(acc, ["AC"], short).collect()} >= {"A", "B"}
    frames.release(ss)


def test_preparation_bounds(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, None)], "k long, v string")
    got = {r.k: r.v_code for r in prep.factorize(df, "v", "k").collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: -1}
    with pytest.raises(ValueError):
        prep.categories(df, "v", at_most=1)
    assert prep.one_hot(df, "v").columns == ["k", "v_b"]
