"""Scorers on the embeddings table: shapes, probabilities, user-model scoring."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from rankmix.operators import scorers as M
from rankmix.operators.prep import hash_split
from rankmix.sources.fixtures import table

from conftest import SF


@pytest.fixture(scope="module")
def split(spark):
    emb = table(spark, SF, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding",
                                                F.col("label").cast("double").alias("label"))
    emb = hash_split(M.as_features(emb, "embedding"), "item_id")
    return emb.filter(~F.col("is_test")), emb.filter(F.col("is_test"))


def _check(scores, n_test, n_classes):
    rows = scores.groupBy("item_id").agg(F.count("*").alias("n"), F.sum("score").alias("s")).collect()
    assert len(rows) == n_test
    assert all(r.n == n_classes and abs(r.s - 1.0) < 1e-9 for r in rows)


def test_adaboost(split):
    train, test = split
    s = M.adaboost_scores(train, test, 10, rounds=5)
    _check(s, test.count(), 10)


def test_svm(split):
    train, test = (rows.filter("label < 3") for rows in split)
    _check(M.svm_scores(train, test, folds=2), test.count(), 3)


def test_svm_ends_by_its_tolerance(spark):
    """More iterations than the default change nothing; 50 are not enough."""
    rnd = np.random.default_rng(9)
    rows = [(i, [float(v) for v in rnd.normal(size=30)], float(i % 2)) for i in range(120)]
    df = M.as_features(spark.createDataFrame(rows, "item_id long, v array<double>, label double").coalesce(1), "v").persist()
    got = [M.svm_scores(df, df, **more).orderBy("item_id", "cls").toPandas()["score"].to_numpy()
           for more in ({}, {"max_iter": 3000}, {"max_iter": 50})]
    df.unpersist()
    assert np.array_equal(got[0], got[1])
    assert np.abs(got[0] - got[2]).max() > 1e-6


@pytest.fixture(scope="module")
def blobs(spark):
    """Three classes around their own centres, split like the embeddings."""
    rnd = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rnd.normal(0, 0.6, 4) + 2.5 * np.eye(4)[i % 3]], float(i % 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "item_id long, v array<double>, label double").coalesce(1)
    df = hash_split(M.as_features(df, "v"), "item_id").persist()
    yield df.filter(~F.col("is_test")), df.filter(F.col("is_test"))
    df.unpersist()


@pytest.mark.parametrize("model", ["random_forest", "decision_tree", "mlp", "svm", "adaboost"])
def test_held_out_accuracy(blobs, model):
    """A constant scorer has about 33 %; every trained one has to learn the centres."""
    train, test = blobs
    if model == "svm":
        scores = M.svm_scores(train, test)
    elif model == "adaboost":
        scores = M.adaboost_scores(train, test, 3, rounds=20)
    else:
        scores = M.fit_and_score(train, test, {model: M.default_suite(4, 3)[model]})
    _check(scores, test.count(), 3)
    (row,) = M.accuracy_of(M.predictions(scores), test).collect()
    assert row.model == model and row.total == test.count() and row.accuracy >= 85.0


def test_accuracy_is_a_registered_query(spark, monkeypatch, blobs):
    from rankmix.plans import catalog
    train, test = blobs
    suite = {"decision_tree": M.default_suite(4, 3)["decision_tree"]}
    monkeypatch.setattr(catalog, "_ml_scores", lambda spark, sf_dir: (M.fit_and_score(train, test, suite), test))
    (row,) = catalog.QUERIES["ml_accuracy"](spark, SF).collect()
    assert row.total == test.count() and row.accuracy == round(100.0 * row.correct / row.total, 6) >= 85.0


def test_score_with_user_model(split):
    _, test = split
    flat = test.select("item_id", *[F.col("embedding")[i].alias(f"f{i}") for i in range(4)])

    def load():
        return np.ones((4, 3))

    def predict(model, pdf):
        z = pdf.to_numpy() @ model
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    s = M.score_with(flat, load, predict, 3, "user", [f"f{i}" for i in range(4)])
    _check(s, test.count(), 3)


# ------------------------------------------------------------- calibration

def _log_loss(scores, test):
    own = scores.join(test.select("item_id", F.col("label").cast("int").alias("cls")), ["item_id", "cls"])
    return own.agg(F.avg(-F.log(F.greatest("score", F.lit(1e-15))))).first()[0]


def _softmax_scores(train, test, reg):
    """The margins' softmax, which the machine had before it was calibrated."""
    from pyspark.ml.functions import vector_to_array
    raw = M._svm(reg, 1000, "label").fit(train).transform(test).select("item_id", vector_to_array("rawPrediction").alias("m"))
    e = F.transform("m", lambda x: F.exp(x - F.array_max("m")))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return raw.select("item_id", F.posexplode(F.transform(e, lambda x: x / total)).alias("cls", "score"))


@pytest.fixture(scope="module")
def noisy(spark):
    """Classes that overlap, so that sure margins are wrong ones."""
    rnd = np.random.default_rng(8)
    rows = [(i, [float(v) for v in rnd.normal(0, 1.0, 4) + 1.3 * np.eye(4)[i % 3]], float(i % 3)) for i in range(900)]
    df = spark.createDataFrame(rows, "item_id long, v array<double>, label double").coalesce(1)
    df = hash_split(M.as_features(df, "v"), "item_id").persist()
    yield df.filter(~F.col("is_test")), df.filter(F.col("is_test"))
    df.unpersist()


def test_calibration_beats_the_softmax_on_held_out_rows(noisy, blobs):
    """Margins whose size says little about how sure they are: classes apart,
    and classes that overlap under a strong regularisation."""
    for (train, test), reg in ((blobs, 0.01), (noisy, 1.0)):
        assert _log_loss(M.svm_scores(train, test, reg=reg), test) < _log_loss(_softmax_scores(train, test, reg), test)


def test_sigmoids_are_the_best_fit(noisy):
    """At the fitted parameters the gradient vanishes and no step lowers the loss."""
    train, _ = noisy
    margins = M.out_of_fold_margins(train, 3).persist()
    rows = [(r.label, r.m) for r in margins.collect()]
    assert len(rows) == train.count()
    for c, (a, b) in enumerate(M.fit_sigmoids(margins, 3)):
        n = sum(label == c for label, _ in rows)
        high, low = (n + 1) / (n + 2), 1 / (len(rows) - n + 2)
        t = np.array([high if label == c else low for label, _ in rows])
        m = np.array([v[c] for _, v in rows])

        def loss(a, b):
            z = a * m + b
            return np.sum(t * z + np.maximum(-z, 0) + np.log1p(np.exp(-np.abs(z))))
        best = loss(a, b)
        assert a < 0 and all(loss(a + da, b + db) >= best - 1e-9 for da in (-1e-3, 0, 1e-3) for db in (-1e-3, 0, 1e-3))
        d = t - 1 / (1 + np.exp(a * m + b))
        assert abs(d.sum()) < 1e-4 and abs((d * m).sum()) < 1e-4
    margins.unpersist()


def test_one_fit_serves_both_queries(spark, monkeypatch):
    from rankmix.plans import catalog
    fits = []
    monkeypatch.setattr(catalog, "_FITTED", {})
    monkeypatch.setattr(M, "default_suite", lambda *a: {})
    monkeypatch.setattr(M, "fit_and_score", lambda train, test, suite: fits.append(1) or test.select(
        "item_id", F.lit("m").alias("model"), F.explode(F.array(F.lit(0), F.lit(1))).alias("cls"), F.lit(0.5).alias("score")))
    for name in ("svm_scores", "adaboost_scores"):
        monkeypatch.setattr(M, name, lambda train, test, *a: test.select(
            "item_id", F.lit("n").alias("model"), F.lit(0).alias("cls"), F.lit(1.0).alias("score")))
    assert catalog.ml_scorers(spark, SF).filter("model = 'm'").first().invalid == 0
    catalog.ml_accuracy(spark, SF).collect()
    assert fits == [1]
