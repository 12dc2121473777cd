"""Score-directory scan and sinks on a small hand-written directory."""
import pandas as pd

from rankmix.operators.evaluate import base_accuracy
from rankmix.sources.files import read_score_dir, read_truth, write_scores
from rankmix.sources.frames import to_wide


def _write_dir(tmp_path):
    A = [[.7, .2, .1], [.3, .3, .4]]
    B = [[.5, .4, .1], [.1, .6, .3]]
    pd.DataFrame(A).to_csv(tmp_path / "alpha_model_scores.csv")
    pd.DataFrame(B).to_csv(tmp_path / "beta_scores.csv")
    pd.DataFrame({"0": [0, 1]}).to_csv(tmp_path / "ground_truths.csv")


def test_read_dir_and_accuracy(spark, tmp_path):
    _write_dir(tmp_path)
    long = read_score_dir(spark, str(tmp_path))
    assert sorted({r.model for r in long.select("model").distinct().collect()}) == ["alpha_model", "beta"]
    assert long.count() == 12
    truth = read_truth(spark, str(tmp_path / "ground_truths.csv"))
    ss = to_wide(long, truth=truth, partitions=2)
    got = {r.fusion_model: r.correct for r in base_accuracy(ss).collect()}
    assert got == {"alpha_model": 1, "beta": 2}
    pos = read_truth(spark, str(tmp_path / "ground_truths.csv"), by_position=True)
    assert sorted(tuple(r) for r in pos.collect()) == [(0, 0), (1, 1)]


def test_whole_scores_are_not_a_header(spark, tmp_path):
    """Rows of hard 0/1 scores, and of score 0 in a one-column file, stay."""
    two, one = [[1, 0], [0, 1], [0, 1], [1, 0]], [[0], [1], [0]]
    pd.DataFrame(two, index=[4, 5, 6, 7]).to_csv(tmp_path / "hard_scores.csv")
    pd.DataFrame(one, index=[5, 6, 7]).rename_axis("item_id").to_csv(tmp_path / "single_scores.csv")
    got = {(r.model, r.item_id, r.cls): r.score for r in read_score_dir(spark, str(tmp_path)).collect()}
    want = {("hard", 4 + i, k): float(v) for i, row in enumerate(two) for k, v in enumerate(row)}
    want |= {("single", 5 + i, 0): float(v) for i, (v,) in enumerate(one)}
    assert got == want


def test_prefix_names_and_sink(spark, tmp_path):
    _write_dir(tmp_path)
    long = read_score_dir(spark, str(tmp_path), prefix_only=True)
    assert sorted(r.model for r in long.select("model").distinct().collect()) == ["alpha", "beta"]
    out = tmp_path / "out"
    write_scores(long, str(out))
    back = spark.read.parquet(str(out))
    assert back.filter("model = 'beta'").count() == 6


def test_check_score_set(spark):
    import pytest
    from rankmix.model import ScoreSet
    from rankmix.operators.evaluate import check_score_set
    ok = spark.createDataFrame([(0, 1, [0.1, 0.9]), (1, 0, [0.6, 0.4])],
                               "item_id long, label int, s0 array<double>")
    assert check_score_set(ScoreSet(df=ok, models=("a",), n_classes=2))["rows"] == 2
    bad = spark.createDataFrame([(0, 3, [0.1, 0.9]), (0, 0, [0.6])],
                                "item_id long, label int, s0 array<double>")
    with pytest.raises(ValueError):
        check_score_set(ScoreSet(df=bad, models=("a",), n_classes=2))


def test_score_directory_to_layer(spark, tmp_path):
    """F-ORD written as one CSV per model, read back by the directory scan,
    gives the same layer as the in-memory derivation (FIXTURES numbers)."""
    from rankmix.plans import layer as L
    from rankmix.sources.fixtures import ford_wide
    from rankmix.sources.frames import to_long
    from conftest import SF

    ss = ford_wide(spark, SF)
    pdf = to_long(ss).toPandas()
    for m, g in pdf.groupby("model"):
        wide = g.pivot(index="item_id", columns="cls", values="score").sort_index()
        wide.to_csv(tmp_path / f"{m}_scores.csv")
    ss.df.select("item_id", "label").toPandas().set_index("item_id").rename(
        columns={"label": "0"}).to_csv(tmp_path / "ground_truths.csv")
    long = read_score_dir(spark, str(tmp_path))
    truth = read_truth(spark, str(tmp_path / "ground_truths.csv"))
    back = to_wide(long, truth=truth, batch_size=2048, partitions=4)
    assert back.models == ("A", "B", "C", "D", "E") and back.n_classes == 5
    prepared = L.prepare(back, 2048, ("AC", "WC-CDS", "WCP"))
    acc = {(r.kind, r.fusion_model): r.correct
           for r in L.layer_accuracy(prepared, ("AC", "WC-CDS", "WCP")).collect()}
    assert acc[("SC", "BCDE_AC")] == 540 and acc[("RC", "BDE_AC")] == 513
    assert acc[("SC", "ABCDE_WCP")] == 534


def test_score_folders_of_many_files(spark, tmp_path):
    """Folders with several files each, plain files and odd model names."""
    from rankmix.sources.files import read_score_folders, write_score_dir
    rows = [(i, m, k, (i * 3 + k) / 7 + j) for i in range(20) for j, m in enumerate(["a b", "x+y", "c_d"]) for k in range(3)]
    long = spark.createDataFrame(rows, "item_id long, model string, cls int, score double").repartition(4)
    write_score_dir(long, ["a b", "x+y", "c_d"], 3, str(tmp_path / "s"))
    (tmp_path / "s" / "plain_scores.csv").write_text(",0,1\n4,0.25,0.75\n")
    back = read_score_folders(spark, str(tmp_path / "s"))
    assert sorted(map(tuple, back.collect())) == sorted(rows + [(4, "plain", 0, 0.25), (4, "plain", 1, 0.75)])
    assert {r.model for r in read_score_folders(spark, str(tmp_path / "s"), prefix_only=True).collect()} == {"a b", "x+y", "c", "plain"}


def test_regression_from_a_score_directory(spark, tmp_path):
    import pytest
    from rankmix.plans import regression as R
    for j, m in enumerate(["p", "q"]):
        (tmp_path / f"{m}_scores.csv").write_text("index,0\n" + "".join(f"{i},{i * 1.5 + j}\n" for i in range(6)))
    (tmp_path / "ground_truths.csv").write_text("index,0\n" + "".join(f"{i},{i * 1.5 + 0.25}\n" for i in range(6)))
    truth = read_truth(spark, str(tmp_path / "ground_truths.csv"), value_type="double")
    wide, models = R.from_scores(read_score_dir(spark, str(tmp_path)), truth)
    assert models == ("p", "q")
    assert sorted(map(tuple, wide.collect())) == [(i, i * 1.5 + 0.25, i * 1.5, i * 1.5 + 1) for i in range(6)]
    rep = {r.model: r.rmse for r in R.report(R.fuse(wide, models, {"AC": dict.fromkeys(models, 1.0)}, ("SC",)), 4.0, models).collect()}
    assert rep == {"Base_p": 0.25, "Base_q": 0.75, "SC_pq_AC": 0.25}
    with pytest.raises(Exception, match="no truth for item 5"):
        R.from_scores(read_score_dir(spark, str(tmp_path)), truth.filter("item_id < 5"))[0].collect()


def test_both_sides_of_a_split(spark):
    from rankmix.operators.prep import split_by_value
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (4, "a")], "k long, v string")
    same, rest = split_by_value(df, "v", "a")
    assert sorted(r.k for r in same.collect()) == [1, 4] and sorted(r.k for r in rest.collect()) == [2, 3]
