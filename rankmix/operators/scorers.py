"""Base scorers: fit several ``pyspark.ml`` classifiers on the training rows
and export their class probabilities on the test rows as a score table
``(item_id, model, cls, score)`` — the input of a fusion layer.

Training and scoring are distributed by ``pyspark.ml``; the probability
vector becomes an array with ``vector_to_array`` (JVM side).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.ml.classification import DecisionTreeClassifier, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmix.operators import machines as svm
from rankmix.operators.blocks import blocks, matrix, summed
from rankmix.operators.trees import Cuts, RandomForest, sample_rows, tree_class, weighted_tree


def default_suite(n_features: int, n_classes: int, seed: int = 42) -> dict:
    """The example suite: a random forest of 171 trees (depth 30; the original
    asks for 36), a shallow gini tree (depth 3,
    at least 5 rows per leaf) and a perceptron with 50 hidden units and 500
    iterations."""
    return {
        "random_forest": RandomForest(trees=171, max_depth=30, seed=seed),
        "decision_tree": DecisionTreeClassifier(impurity="gini", maxDepth=3, minInstancesPerNode=5,
                                                seed=seed),
        "mlp": MultilayerPerceptronClassifier(layers=[n_features, 50, n_classes], maxIter=500,
                                              seed=seed),
    }


def as_features(df: DataFrame, array_col: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(array_col).cast("array<double>")))


def fit_and_score(train: DataFrame, test: DataFrame, suite: dict, id_col: str = "item_id",
                  label_col: str = "label") -> DataFrame:
    """Long scores of every model on the test rows."""
    out = None
    for name, est in suite.items():
        if isinstance(est, RandomForest):
            rows, p = est.scores(train, test, id_col, label_col), F.col("p")
        else:
            rows, p = est.setFeaturesCol("features").setLabelCol(label_col).fit(train).transform(test), vector_to_array("probability")
        probs = rows.select(F.col(id_col).alias("item_id"), F.lit(name).alias("model"), F.posexplode(p).alias("cls", "score"))
        out = probs if out is None else out.unionByName(probs)
    return out


def predictions(scores_long: DataFrame) -> DataFrame:
    """``(item_id, model, pred)``: argmax class (lowest class on ties)."""
    best = scores_long.groupBy("item_id", "model").agg(
        F.max_by(F.col("cls"), F.struct(F.col("score"), -F.col("cls"))).alias("pred"))
    return best


def accuracy_of(preds: DataFrame, truth: DataFrame) -> DataFrame:
    """``(model, correct, total, accuracy)`` in percent."""
    j = preds.join(truth.select("item_id", "label"), on="item_id")
    return j.groupBy("model").agg(
        F.sum(F.when(F.col("pred") == F.col("label"), 1).otherwise(0)).cast("long").alias("correct"),
        F.count(F.lit(1)).alias("total")).withColumn(
        "accuracy", F.col("correct") / F.col("total") * 100.0)


# ------------------------------------------------------------ AdaBoost (SAMME)

def adaboost_scores(train: DataFrame, test: DataFrame, n_classes: int, rounds: int = 100,
                    learning_rate: float = 0.3845, max_depth: int = 1, seed: int = 42, name: str = "adaboost",
                    id_col: str = "item_id", label_col: str = "label") -> DataFrame:
    """Multi-class AdaBoost (SAMME) built from weighted gini trees.

    Each round is one pass over the training rows a level: a task works out its
    rows' weights from the trees so far and sums them by bin and class, which the new
    tree and its weighted error follow from.  A round's cuts are the weighted
    quantiles of the sampled rows (of all, up to 10,000 rows).  Scores are
    ``sum_t alpha_t [pred_t = k] / sum_t alpha_t`` per class.
    """
    rows = blocks(train, label=label_col)
    n, x, y = sample_rows(rows, seed)
    cuts, w, fitted = Cuts(x, n), np.ones(len(x)), []
    for _ in range(rounds):
        tree, bad, every = weighted_tree(rows, cuts.at(w), n_classes, lambda x, y: _boosted(fitted, x, y), max_depth)
        err = bad / every if every else 1.0
        if err >= 1.0 - 1.0 / n_classes:
            break
        err = max(err, 1e-12)
        fitted.append((tree, learning_rate * (math.log((1.0 - err) / err) + math.log(n_classes - 1))))
        w = w * np.where(tree_class(tree, x) != y, math.exp(fitted[-1][1]), 1.0)
        if err <= 1e-12:
            break
    rows.unpersist()
    if not fitted:
        raise ValueError("no useful AdaBoost round (error too high)")

    def votes(x):
        out, at = np.zeros((len(x), n_classes)), np.arange(len(x))
        for tree, alpha in fitted:
            out[at, tree_class(tree, x)] += alpha
        return out / sum(alpha for _, alpha in fitted)

    return _exploded(_by_row(test, id_col, votes), name)


def _boosted(fitted, x, y) -> np.ndarray:
    """The rows' weights after the rounds so far."""
    w = np.ones(len(x))
    for tree, alpha in fitted:
        w[tree_class(tree, x) != y] *= math.exp(alpha)
    return w


def _by_row(df: DataFrame, id_col: str, score) -> DataFrame:
    """``(item_id, p)``: ``score(x)``'s row of numbers for each of the rows."""
    rows = df.select(F.col(id_col).alias("item_id"), vector_to_array("features").alias("x"))

    def run(batches):
        for b in batches:
            if len(b):
                p = score(matrix(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), _lists(p)], names=["item_id", "p"])

    return rows.mapInArrow(run, f"item_id {rows.schema['item_id'].dataType.simpleString()}, p array<double>")


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), pa.array(rows.ravel()))


def _exploded(rows: DataFrame, name: str) -> DataFrame:
    return rows.select("item_id", F.lit(name).alias("model"), F.posexplode("p").alias("cls", "score"))


# ------------------------------------------------------------ SVM

def _svm(reg: float, max_iter: int, label_col: str, tolerance: float = 1e-6):
    from pyspark.ml.classification import LinearSVC, OneVsRest
    # the per-class fits are independent jobs: run up to 8 at a time
    return OneVsRest(classifier=LinearSVC(regParam=reg, maxIter=max_iter, tol=tolerance), featuresCol="features",
                     labelCol=label_col, parallelism=8)


def fold_of(id_col: str, folds: int, seed: int = 42) -> Column:
    """A row's fold from a hash of its id: the same whatever the partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(folds)).cast("int")


def out_of_fold_margins(train: DataFrame, folds: int = 3, reg: float = 0.01, max_iter: int = 1000,
                        id_col: str = "item_id", label_col: str = "label", tolerance: float = 1e-3) -> DataFrame:
    """``(label, m)``: every training row's margins by class, from the machine
    that was fitted on the other folds (to a looser ``tolerance`` than the final
    one: the margins only place two numbers a class).  A fold whose rest lacks a class has
    margins for the classes below the largest that it saw (the others count as
    far outside)."""
    rows = blocks(train, label=label_col, fold=fold_of(id_col, folds))
    try:
        return _fold_margins(train, rows, folds, reg, max_iter, id_col, label_col, tolerance)
    finally:
        rows.unpersist()


def _fold_margins(train, rows, folds, reg, max_iter, id_col, label_col, tolerance):
    n_classes = _classes(rows)
    counts = summed(rows, lambda b: np.bincount(b[2] * n_classes + b[1], minlength=folds * n_classes)).reshape(folds, n_classes)
    rest = counts.sum(axis=0) - counts
    fitted = [k for k in range(folds) if counts[k].any() and np.count_nonzero(rest[k]) > 1]
    if not fitted:
        raise ValueError("too few rows or classes to leave a fold out")
    own = [svm.Machine(c, k) for k in fitted for c in range(np.flatnonzero(rest[k])[-1] + 1)]
    u, c = svm.fit(rows, own, folds, reg, max_iter, tolerance)
    of, cls = np.array([m.left_out for m in own]), np.array([m.cls for m in own])

    def margins(x, fold):
        out = np.full((len(x), n_classes), -10.0)
        for k in fitted:
            mine = fold == k
            out[np.ix_(mine, cls[of == k])] = x[mine] @ u[:, of == k] + c[of == k]
        return out

    placed = train.select(F.col(label_col).cast("int").alias("label"), fold_of(id_col, folds).alias("fold"), vector_to_array("features").alias("x"))

    def run(batches):
        for b in batches:
            known = pa.compute.is_in(b.column(1), pa.array(fitted, pa.int32()))
            b = b.filter(known)
            if len(b):
                m = margins(matrix(b.column(2)), b.column(1).to_numpy())
                yield pa.RecordBatch.from_arrays([b.column(0), _lists(m)], names=["label", "m"])

    return placed.mapInArrow(run, "label int, m array<double>")


def _classes(rows) -> int:
    return int(rows.map(lambda b: int(b[1].max())).max()) + 1


def fit_sigmoids(margins: DataFrame, n_classes: int, steps: int = 50, tolerance: float = 1e-7) -> list[tuple[float, float]]:
    """Per class the slope and offset of ``1 / (1 + exp(a m + b))`` that fit the
    labels best: Newton steps for all classes at once, each one pass for loss,
    gradient and Hessian over the rows.  Targets are drawn in as by Platt (a class
    with p rows of it and q others aims at (p + 1) / (p + 2) and 1 / (q + 2)), so
    separable classes have a finite fit; a step that raises a class's loss is
    halved."""
    rows = blocks(margins, features="m", label="label")
    counts = summed(rows, lambda b: np.bincount(b[1], minlength=n_classes))
    high, low = (counts + 1.0) / (counts + 2.0), 1.0 / (counts.sum() - counts + 2.0)
    start = [(0.0, math.log((counts.sum() - n + 1.0) / (n + 1.0))) for n in counts.tolist()]

    def measured(params):
        slope, offset = np.array(params).T

        def sums(b):
            m, label, *_ = b
            z = m * slope + offset
            small = np.exp(-np.abs(z))
            t = np.where(label[:, None] == np.arange(n_classes), high, low)
            p = np.where(z >= 0, small, 1.0) / (1 + small)
            d, h = t - p, p * (1 - p)
            loss = t * z + np.maximum(-z, 0.0) + np.log1p(small)
            return np.stack([v.sum(axis=0) for v in (loss, m * d, d, m * m * h, m * h, h)])

        names = ("loss", "ga", "gb", "haa", "hab", "hbb")
        return {c: dict(zip(names, v)) for c, v in enumerate(summed(rows, sums).T.tolist())}

    params, at = start, measured(start)
    move = {}
    for c, r in at.items():
        move[c] = _newton(r)
    for _ in range(steps):
        if all(max(abs(x) for x in m) < tolerance for m in move.values()):
            break
        tried = [(a + move[c][0], b + move[c][1]) if c in move else (a, b) for c, (a, b) in enumerate(params)]
        new = measured(tried)
        for c, r in new.items():
            if r["loss"] <= at[c]["loss"] + 1e-12 * abs(at[c]["loss"]):
                params[c], at[c], move[c] = tried[c], r, _newton(r)
            else:
                move[c] = (move[c][0] / 2, move[c][1] / 2)
    rows.unpersist()
    return params


def _newton(r) -> tuple[float, float]:
    """The step from gradient and Hessian of one class (ridge: 1e-12)."""
    haa, hbb, hab = r["haa"] + 1e-12, r["hbb"] + 1e-12, r["hab"]
    det = haa * hbb - hab * hab
    return -(hbb * r["ga"] - hab * r["gb"]) / det, -(haa * r["gb"] - hab * r["ga"]) / det


def svm_scores(train: DataFrame, test: DataFrame, name: str = "svm", reg: float = 0.01,
               max_iter: int = 1000, folds: int = 3, id_col: str = "item_id", label_col: str = "label") -> DataFrame:
    """Linear SVM, one-vs-rest, with calibrated probabilities: each class's
    margin goes through its sigmoid, fitted on margins of left-out folds, and the
    classes are scaled to sum to 1.  ``max_iter`` is a guard: the solver's
    tolerance (1e-6) ends each fit."""
    from rankmix.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(train.sparkSession)
    margins = out_of_fold_margins(train, folds, reg, max_iter, id_col, label_col).checkpoint(eager=True)
    rows = blocks(train, label=label_col, fold=F.lit(0))
    n_classes = _classes(rows)
    sigmoids = np.array(fit_sigmoids(margins, n_classes))
    u, c = svm.fit(rows, [svm.Machine(k) for k in range(n_classes)], 1, reg, max_iter, 1e-6)
    rows.unpersist()

    def probabilities(x):
        with np.errstate(over="ignore"):
            p = 1 / (1 + np.exp((x @ u + c) * sigmoids[:, 0] + sigmoids[:, 1]))
        return p / p.sum(axis=1, keepdims=True)

    return _exploded(_by_row(test, id_col, probabilities), name)


# ------------------------------------------------------------ user models

def score_with(df: DataFrame, load_model, predict, n_classes: int, name: str,
               feature_cols: list[str], id_col: str = "item_id") -> DataFrame:
    """Score rows with a model the caller brings (any Python library).

    ``load_model()`` runs once per task (not per row); ``predict(model,
    pandas.DataFrame) -> numpy array (rows x classes)``.  Arrow batches in,
    long ``(item_id, model, cls, score)`` rows out (``mapInPandas``).
    """
    import pandas as pd

    def run(batches):
        model = load_model()
        for pdf in batches:
            probs = predict(model, pdf[feature_cols])
            out = pd.DataFrame({"item_id": pdf[id_col].repeat(n_classes).to_numpy(),
                                "cls": list(range(n_classes)) * len(pdf),
                                "score": probs.reshape(-1).astype("float64")})
            out.insert(1, "model", name)
            yield out

    return df.select(id_col, *feature_cols).mapInPandas(
        run, "item_id long, model string, cls int, score double")
