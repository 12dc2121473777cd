"""Score directories read by line; the trained scorers at more rows: passes and jobs that do not grow with nodes,
machines or steps, and the same machines and trees as Spark's."""
import uuid

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC
from pyspark.sql import functions as F

from rankmix.operators import machines, scorers as M, trees as T
from rankmix.operators.blocks import blocks


@pytest.fixture(scope="module")
def noisy(spark):
    """Three overlapping classes around their own centres, some columns of few values."""
    rnd = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rnd.normal(0, 1.0, 6) + 1.2 * np.eye(6)[i % 3]] + [float(rnd.integers(3)), 1.0], float(i % 3))
            for i in range(600)]
    df = M.as_features(spark.createDataFrame(rows, "item_id long, v array<double>, label double").repartition(2), "v").persist()
    yield df
    df.unpersist()


def _jobs(spark, run):
    """What ``run()`` returns, and the jobs that it started."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("local", [0, 1 << 25])
def test_machines_are_sparks(spark, noisy, monkeypatch, local):
    monkeypatch.setattr(machines, "LOCAL_BYTES", local)
    rows = blocks(noisy, label="label", fold=F.lit(0))
    # sums in another order turn into other steps at the hinges, late in the search
    for steps, near, classes in ((4, 1e-7, (0, 2)), (25, 1e-3, (1,))):
        u, c = machines.fit(rows, [machines.Machine(k) for k in range(3)], 1, 0.01, steps, 1e-6)
        for k in classes:
            own = LinearSVC(regParam=0.01, maxIter=steps, tol=1e-6).fit(noisy.withColumn("label", (F.col("label") == k).cast("double")))
            assert np.allclose(own.coefficients.toArray(), u[:, k], atol=near) and abs(own.intercept - c[k]) < near
    rows.unpersist()


def test_left_out_folds_and_missing_classes(spark, noisy):
    """A machine that leaves a fold out is the one of the other folds' rows alone."""
    fold = F.pmod(F.floor(F.col("item_id") / 3), F.lit(3)).cast("int")
    rows = blocks(noisy, label="label", fold=fold)
    u, c = machines.fit(rows, [machines.Machine(1, 0), machines.Machine(2, 2)], 3, 0.01, 6, 1e-6)
    rows.unpersist()
    for i, (k, out) in enumerate(((1, 0), (2, 2))):
        own = LinearSVC(regParam=0.01, maxIter=6, tol=1e-6).fit(
            noisy.filter(fold != out).withColumn("label", (F.col("label") == k).cast("double")))
        assert np.allclose(own.coefficients.toArray(), u[:, i], atol=1e-7)


def test_svm_takes_few_jobs(spark, noisy):
    scores, jobs = _jobs(spark, lambda: M.svm_scores(noisy, noisy))
    assert jobs < 60                  # four by class and step before, thousands
    assert scores.count() == 1800


@pytest.mark.parametrize("depth", [1, 3])
def test_weighted_trees_are_sparks(spark, noisy, depth):
    weighted = noisy.withColumn("w", 1.0 + F.pmod("item_id", F.lit(7)) / 3.0)
    rows = blocks(weighted, label="label")
    n, x, y = T.sample_rows(rows, 1)
    ids = blocks(weighted, item="item_id").flatMap(lambda b: zip(map(tuple, b[0].tolist()), b[3])).collectAsMap()

    def weigh(x, y):
        return np.array([1.0 + ids[tuple(r)] % 7 / 3.0 for r in x.tolist()])
    tree, missed, every = T.weighted_tree(rows, T.Cuts(x, n).at(weigh(x, y)), 3, weigh, depth)
    rows.unpersist()
    own = DecisionTreeClassifier(maxDepth=depth, weightCol="w", seed=3).fit(weighted).transform(weighted)
    got = own.select("prediction", "label", "w", "v").toPandas()
    assert np.array_equal(T.tree_class(tree, np.array(got["v"].tolist())), got["prediction"].to_numpy())
    assert abs(got["w"][got["prediction"] != got["label"]].sum() - missed) < 1e-9 and abs(got["w"].sum() - every) < 1e-9


def test_adaboost_takes_a_job_a_round(spark, noisy):
    scores, jobs = _jobs(spark, lambda: M.adaboost_scores(noisy, noisy, 3, rounds=20))
    assert jobs <= 24                 # about six a round before
    assert scores.count() == 1800


# ------------------------------------------------------------- random forest

def _brute(bins, label, times, features, n_classes):
    """The leaf shares of a tree on all features, node by node."""
    counts = np.bincount(label, times, n_classes)
    best = ((counts ** 2).sum() / counts.sum() * (1 + 1e-12), None)
    for f in features:
        for cut in range(31):
            left = bins[:, f] <= cut
            a, b = (np.bincount(label[s], times[s], n_classes) for s in (left, ~left))
            if a.sum() and b.sum() and (score := (a ** 2).sum() / a.sum() + (b ** 2).sum() / b.sum()) > best[0]:
                best = score, (f, cut)
    if best[1] is None:
        return counts
    f, cut = best[1]
    left = bins[:, f] <= cut
    below = [_brute(bins[s], label[s], times[s], features, n_classes) for s in (left, ~left)]
    if all(isinstance(b, np.ndarray) for b in below) and below[0].argmax() == below[1].argmax():
        return counts
    return f, cut, *below


def _fallen(tree, row):
    while not isinstance(tree, np.ndarray):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree / tree.sum()


def test_a_grown_tree_against_brute_force(monkeypatch):
    rnd = np.random.default_rng(3)
    monkeypatch.setattr(T, "feature_sets", lambda rng, nodes, f: np.tile(np.arange(f), (nodes, 1)))
    for rows in (1, 2, 40, 160):
        bins, label = rnd.integers(0, 32, (rows, 4)).astype(np.uint8), rnd.integers(0, 3, rows)
        times, tested = rnd.integers(1, 4, rows).astype(np.uint8), rnd.integers(0, 32, (50, 4)).astype(np.uint8)
        tree = _brute(bins, label, times.astype(float), range(4), 3)
        got = T.grow(bins, label, times, tested, 3, 30, rnd)
        # equally good splits may be taken in another order: compare where the tree is without ties
        want = np.array([_fallen(tree, r) for r in tested])
        assert got.shape == want.shape and np.allclose(got.sum(axis=1), 1)
        assert np.allclose(got, want)


def test_a_tree_ends_at_its_depth():
    rnd = np.random.default_rng(6)
    bins, label = rnd.integers(0, 32, (500, 4)).astype(np.uint8), rnd.integers(0, 3, 500)
    p = T.grow(bins, label, np.ones(500, np.uint8), bins, 3, 2, rnd)
    assert len(np.unique(p, axis=0)) <= 4
    assert (T.grow(bins, label, np.ones(500, np.uint8), bins, 3, 30, rnd).argmax(axis=1) == label).mean() > 0.95


@pytest.mark.parametrize("at_once", [1 << 10, 1 << 28])
def test_forest_split_over_tasks(spark, noisy, monkeypatch, at_once):
    """With large nodes split from sums, and few trees shuffled at once, every test
    row still gets one row of shares, as good as the forest grown in one go."""
    monkeypatch.setattr(T, "LOCAL_ROWS", 100)
    monkeypatch.setattr(T, "SHUFFLE_BYTES", at_once)
    train, test = noisy.filter("item_id % 4 > 0"), noisy.filter("item_id % 4 = 0")
    forest = T.RandomForest(12, 30, 7)
    p = forest.scores(train, test).toPandas().sort_values("item_id")
    assert p["item_id"].tolist() == list(range(0, 600, 4))
    p = np.array(p["p"].tolist())
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all()
    assert (p.argmax(axis=1) == np.arange(0, 600, 4) % 3).mean() > 0.55
    again = np.array(forest.scores(train, test).toPandas().sort_values("item_id")["p"].tolist())
    assert np.allclose(p, again)


def test_a_forest_of_one_row(spark, noisy):
    """About a third of the bootstraps are empty."""
    p = T.RandomForest(30, 5, 2).scores(noisy.filter("item_id = 4"), noisy.filter("item_id < 9")).toPandas()
    assert len(p) == 9 and all(list(x) == [0.0, 1.0] for x in p["p"])


def test_forest_takes_jobs_by_batches_not_by_nodes(spark, noisy):
    scores, jobs = _jobs(spark, lambda: M.fit_and_score(noisy, noisy, {"random_forest": M.default_suite(8, 3)["random_forest"]}))
    assert jobs < 20
    assert scores.count() == 1800


def test_repeated_ids_are_rows_of_their_own(spark, noisy):
    twice = noisy.unionByName(noisy.filter("item_id < 50"))
    assert T.RandomForest(3, 5, 1).scores(noisy, twice).count() == 650
    assert M.adaboost_scores(noisy, twice, 3, rounds=3).count() == 1950


# ------------------------------------------------------------ score directories

def test_lines_are_read_as_cells_were(spark, tmp_path):
    """Blanks around cells, empty cells, quotes, numbers that only Spark reads, a
    header and names that need decoding: by line and by cell."""
    import math
    from rankmix.sources import files
    from rankmix.sources.frames import to_wide
    for name, text in {"a+b c": 'index,0,1,2\r\n"0",0.5,"0.25",\r\n1, 1e-3 ,NaN,0.1\n', "m%d_x": ',0,1,2\n 0 ,+1.5,2d,-Infinity\n1,0,1,2\n',
                       "short": "i,0,1\n0,0.5,0.5\n1,,\n"}.items():
        (tmp_path / f"{name}_scores.csv").write_bytes(text.encode())
    want = {("a+b c", 0): [0.5, 0.25, None], ("a+b c", 1): [0.001, math.nan, 0.1], ("m%d_x", 0): [1.5, 2.0, -math.inf],
            ("m%d_x", 1): [0.0, 1.0, 2.0], ("short", 0): [0.5, 0.5], ("short", 1): [None, None]}
    lines = files.read_score_folders(spark, str(tmp_path), by_line=True)
    got = {(r.model, r.item_id): r.scores for r in lines.collect()}
    assert got.keys() == want.keys() and all(repr(got[k]) == repr(want[k]) for k in want)
    for rows in (files.read_score_folders(spark, str(tmp_path)), files.read_score_dir(spark, str(tmp_path))):
        cells = {(r.model, r.item_id, r.cls): r.score for r in rows.collect()}
        assert repr(sorted(cells.items(), key=str)) == repr(sorted(
            [((*k, i), v) for k, vs in want.items() for i, v in enumerate(vs)], key=str))
    # a score set from lines is the one from cells
    a, b = (to_wide(x, batch_size=1) for x in (lines, files.read_score_folders(spark, str(tmp_path))))
    assert (a.models, a.n_classes) == (b.models, b.n_classes) == (("a+b c", "m%d_x", "short"), 3)
    assert repr(sorted(a.df.collect())) == repr(sorted(b.df.collect()))


def test_a_files_name_is_read_once_a_batch(spark, tmp_path):
    """Names were decoded for every cell, most of the query's time."""
    from rankmix.sources import files
    (tmp_path / "m_scores.csv").write_text("i,0,1\n" + "".join(f"{i},0.5,0.5\n" for i in range(5000)))
    plan = files.read_score_folders(spark, str(tmp_path), by_line=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "url_decode" not in plan and "UrlDecode" not in plan and "UrlCodec" not in plan and "regexp_extract" not in plan and "Generate" not in plan


def test_a_line_twice_is_an_error(spark, tmp_path):
    from rankmix.sources import files
    from rankmix.sources.frames import to_wide
    (tmp_path / "m_scores.csv").write_text("i,0,1\n0,0.5,0.5\n0,0.5,0.5\n")
    with pytest.raises(Exception, match="two scores"):
        to_wide(files.read_score_folders(spark, str(tmp_path), by_line=True), batch_size=4).df.collect()
