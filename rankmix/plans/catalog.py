"""The registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each reads the driver's tables (through the F-ORD / F-REG score tables
derived from ``orders`` and ``customer``) over whole tables, and rounds
emitted doubles the way ``rankmix.plans.oracle`` does.
"""

from __future__ import annotations

import functools
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankmix.operators import ranks as K
from rankmix.operators import vote as V
from rankmix.operators.combine import RC, SC, fused_specs, layer_of
from rankmix.operators.evaluate import base_accuracy as _base_accuracy, best_outputs, with_base_accuracies
from rankmix.operators.evaluate import performance_series as _series, sorted_accuracies
from rankmix.operators.lattice import item_picks
from rankmix.operators.weights import batch_weights, pairwise, strengths, weights_long
from rankmix.plans import layer as L
from rankmix.plans import regression as R
from rankmix.session import ensure_checkpoint_dir, scratch_dir
from rankmix.sources.fixtures import FORD_MODELS, FREG_MODELS, ford_wide, freg_wide
from rankmix.sources.frames import to_long, with_batch_ids

BATCH = 2048
ALL4 = ("AC", "WC-CDS", "WC-KDS", "WCP")
SEARCH_SCHEMES = ("AC", "WC-CDS", "WCP")
UNSUPERVISED = ("AC", "WC-CDS")


def r6(c):
    return F.round(c, 6)


def round4(c):
    """floor(x * 1e4 + 0.5) / 1e4: plain IEEE steps, so engines agree bit for bit."""
    return F.floor(F.col(c) * F.lit(1e4) + F.lit(0.5)) / F.lit(1e4)


def _ss(spark, sf_dir, schemes=()):
    return L.prepare(ford_wide(spark, sf_dir), BATCH, schemes)


def _first_ss(spark, sf_dir):
    """For what needs the first items of batches only: nothing is written."""
    return with_batch_ids(ford_wide(spark, sf_dir), BATCH)


def ord_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = to_long(ford_wide(spark, sf_dir))
    return long.select("item_id", "model", "cls", r6("score").alias("score"))


def base_accuracy(spark, sf_dir):
    acc = _base_accuracy(ford_wide(spark, sf_dir))
    return acc.select("fusion_model", "correct", "total", r6("accuracy").alias("accuracy"))


def avg_rank(spark, sf_dir):
    return K.item_ranks(ford_wide(spark, sf_dir)).select(
        "item_id", "model", "cls", r6("score").alias("score"), "rank")


def ordinal_rank(spark, sf_dir):
    return K.item_ranks(ford_wide(spark, sf_dir), ordinal=True).select(
        "item_id", "model", "cls", r6("score").alias("score"), "rank")


def rsc_item(spark, sf_dir):
    return K.item_rsc(ford_wide(spark, sf_dir)).select(
        "item_id", "model", "position", "rank", r6("value").alias("value"))


def rsc_mean(spark, sf_dir):
    return K.mean_rsc(ford_wide(spark, sf_dir)).select("model", "position", "rank", r6("value").alias("value"))


def rsc_mean_ranks(spark, sf_dir):
    """K10, rank side: the same of the class means of the average ranks."""
    return K.mean_rsc(ford_wide(spark, sf_dir), of_ranks=True).select(
        "model", "position", "rank", r6("value").alias("value"))


def diversity_pairs(spark, sf_dir):
    return pairwise(_first_ss(spark, sf_dir), "CD").select(
        "batch_id", "model_a", "model_b", r6("value").alias("value"))


def diversity_strength(spark, sf_dir):
    return strengths(_first_ss(spark, sf_dir), "CD").select("batch_id", "model", r6("strength").alias("strength"))


def ksi_strength(spark, sf_dir):
    return strengths(_first_ss(spark, sf_dir), "KSI").select("batch_id", "model", r6("strength").alias("strength"))


def weights_all(spark, sf_dir):
    ss = with_base_accuracies(_first_ss(spark, sf_dir))
    return weights_long(ss, ALL4).select("batch_id", "scheme", "model", r6("weight").alias("weight"))


def _layer_acc(spark, sf_dir, schemes):
    ss = _ss(spark, sf_dir, schemes)
    return L.layer_accuracy(ss, schemes)


def layer_accuracy(spark, sf_dir):
    return _layer_acc(spark, sf_dir, ALL4).select(
        "kind", "fusion_model", "correct", "total", r6("accuracy").alias("accuracy"))


def layer_report(spark, sf_dir):
    rep = L.layer_report(_layer_acc(spark, sf_dir, ALL4))
    return rep.select("fusion_model", r6("sc").alias("sc"), r6("rc").alias("rc"))


def _matrices(spark, sf_dir, kind):
    ss = _ss(spark, sf_dir, ALL4)
    m = L.layer_matrices(ss, ALL4, kinds=(kind,))
    # IEEE rounding (floor(x * 1e6 + 0.5) / 1e6): millions of values, and the
    # same bits in every engine
    return m.select("item_id", "fusion_model",
                    *[(F.floor(F.col("values")[k] * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)).alias(f"c{k}")
                      for k in range(ss.n_classes)])


def score_combination(spark, sf_dir):
    return _matrices(spark, sf_dir, SC)


def rank_combination(spark, sf_dir):
    return _matrices(spark, sf_dir, RC)


def per_class_accuracy(spark, sf_dir):
    ss = _ss(spark, sf_dir, ALL4)
    return L.class_accuracy(ss, ALL4).select(
        "kind", "fusion_model", "cls", "correct", "count", r6("class_accuracy").alias("class_accuracy"))


def mean_class_accuracy(spark, sf_dir):
    ss = _ss(spark, sf_dir, ALL4)
    out = L.mean_class_accuracy(L.class_accuracy(ss, ALL4))
    return out.select("cls", *[r6(c).alias(c) for c in ("base", "sc", "rc", "fused")])


def unsupervised_labels(spark, sf_dir):
    return L.unsupervised_labels(_ss(spark, sf_dir), UNSUPERVISED)


def unsupervised_labels_max(spark, sf_dir):
    """The same with the largest rank picked, as the original script does."""
    return L.unsupervised_labels(_ss(spark, sf_dir), UNSUPERVISED, kinds=(RC,), rank_pick="max")


def _fused_votes(spark, sf_dir):
    return L.fused_votes(_ss(spark, sf_dir, SEARCH_SCHEMES), SEARCH_SCHEMES)


def vote_fused(spark, sf_dir):
    return _fused_votes(spark, sf_dir).select("item_id", "vote")


def vote_fused_accuracy(spark, sf_dir):
    agg = _fused_votes(spark, sf_dir).agg(
        F.sum(F.when(F.col("vote") == F.col("label"), 1).otherwise(0)).cast("long").alias("correct"),
        F.count(F.lit(1)).alias("total"))
    return agg.select("correct", "total", r6(F.col("correct") / F.col("total")).alias("accuracy"))


def base_picks_wide(ss):
    """``item_id, label, p0..`` — each base model's argmax pick."""
    picks = item_picks(layer_of(ss, None, fused_specs(ss.models, []), (SC,)), ["item_id", "label"])
    return picks.select("item_id", "label", *[F.col("picks")[i].alias(f"p{i}") for i in range(ss.n_models)])


def vote_combinations(spark, sf_dir):
    ss = ford_wide(spark, sf_dir)
    wide = base_picks_wide(ss)
    subsets = V.vote_subsets(ss.n_models)
    acc = V.subset_accuracy(wide, ss.n_models, ss.n_classes, subsets, list(ss.models))
    return acc.select("members", "correct", "total", r6("accuracy").alias("accuracy"))


def top_k_pool(spark, sf_dir, k: int = 4):
    ss = _ss(spark, sf_dir, SEARCH_SCHEMES)
    acc = L.layer_accuracy(ss, SEARCH_SCHEMES)
    thr = max(ss.accuracies)
    parts = []
    for src, kind in enumerate((SC, RC)):
        top = (acc.filter((F.col("kind") == kind) & (F.col("accuracy") > F.lit(thr)))
               .orderBy(F.col("accuracy").desc(), F.col("ord")).limit(k)
               .withColumn("src", F.lit(src)))
        parts.append(top)
    pool = parts[0].unionByName(parts[1])
    # at most 2k rows: a global window is harmless here
    w = Window.orderBy(F.col("accuracy").desc(), F.col("src"), F.col("ord"))
    return (pool.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)
            .select("position", "kind", "fusion_model", "correct"))


def rank_invert(spark, sf_dir):
    ranks = K.item_ranks(ford_wide(spark, sf_dir))
    inv = K.rank_invert(ranks, "rank", by=["model"])
    return inv.select("item_id", "model", "cls", r6("inverted").alias("value"))


# ---------------------------------------------------------------- regression

def _reg_long(spark, sf_dir):
    return R.to_long(freg_wide(spark, sf_dir), FREG_MODELS)


def reg_ranks(spark, sf_dir):
    return R.vector_ranks(_reg_long(spark, sf_dir)).select("item_id", "model", "rank")


def reg_rsc(spark, sf_dir):
    long = _reg_long(spark, sf_dir)
    stats = long.groupBy("model").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    j = long.join(F.broadcast(stats), on="model")
    vals = j.select("item_id", "model", "score",
                    F.try_divide(F.col("score") - F.col("lo"), F.col("hi") - F.col("lo")).alias("value"),
                    F.try_divide(F.col("score"), F.col("hi")).alias("value_max"))
    ranked = K.global_rank(vals, "model", [F.col("score").desc(), F.col("item_id").desc()], "rank")
    return ranked.select("model", "rank", r6("value").alias("value"), r6("value_max").alias("value_max"))


def _reg_fused(spark, sf_dir, kinds=("SC", "RC")):
    ensure_checkpoint_dir(spark)
    # derived once (three group means per order) and read by every branch
    wide = freg_wide(spark, sf_dir).checkpoint(eager=True)
    long = R.to_long(wide, FREG_MODELS)
    ranked = R.vector_ranks(long)  # one global ordering for ranks and RSCs
    weights = R.regression_weights(long, FREG_MODELS, R.REGRESSION_SCHEMES, ranked)
    rows = R.with_vector_ranks(wide, FREG_MODELS, ranked) if "RC" in kinds else wide
    return wide, R.fuse(rows, FREG_MODELS, weights, kinds)


def reg_fusion(spark, sf_dir):
    _, fused = _reg_fused(spark, sf_dir)
    return fused.select("item_id", "kind", "fusion_model", round4("value").alias("value"))


def reg_report(spark, sf_dir):
    wide, fused = _reg_fused(spark, sf_dir, ("SC",))
    mean_y = float(wide.agg(F.avg("target")).first()[0])
    rep = R.report(fused, mean_y, FREG_MODELS)
    return rep.select("model", r6("r2").alias("r2"), round4("rmse").alias("rmse"))


QUERIES = {
    "ord_scores": ord_scores, "base_accuracy": base_accuracy, "avg_rank": avg_rank,
    "ordinal_rank": ordinal_rank, "rsc_item": rsc_item, "rsc_mean": rsc_mean,
    "rsc_mean_ranks": rsc_mean_ranks, "unsupervised_labels_max": unsupervised_labels_max,
    "diversity_pairs": diversity_pairs, "diversity_strength": diversity_strength,
    "ksi_strength": ksi_strength, "weights_all": weights_all, "layer_accuracy": layer_accuracy,
    "layer_report": layer_report, "score_combination": score_combination,
    "rank_combination": rank_combination, "per_class_accuracy": per_class_accuracy,
    "mean_class_accuracy": mean_class_accuracy, "unsupervised_labels": unsupervised_labels,
    "vote_fused": vote_fused, "vote_fused_accuracy": vote_fused_accuracy,
    "vote_combinations": vote_combinations, "top_k_pool": top_k_pool, "rank_invert": rank_invert,
    "reg_ranks": reg_ranks, "reg_rsc": reg_rsc, "reg_fusion": reg_fusion, "reg_report": reg_report,
}


# ---------------------------------------------------------------- preparation

def prep_factorize(spark, sf_dir):
    from rankmix.operators.prep import factorize
    from rankmix.sources.fixtures import table
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return factorize(cust, "c_mktsegment", "c_custkey", "segment_code").select("c_custkey", "segment_code")


def prep_onehot(spark, sf_dir):
    from rankmix.operators.prep import one_hot
    from rankmix.sources.fixtures import table
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return one_hot(cust, "c_mktsegment")


def prep_impute(spark, sf_dir):
    """Mean imputation of ``events.value`` after blanking the 'error' events,
    then the constant scaling ``x / 255``."""
    from rankmix.operators.prep import impute_mean, scale
    from rankmix.sources.fixtures import table
    ev = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_type") == "error", F.lit(None)).otherwise(F.col("value")).alias("value"))
    imp = impute_mean(ev, ["value"])
    return imp.select("event_id", r6("value").alias("value"), r6(scale("value", 255.0)).alias("scaled"))


def prep_split(spark, sf_dir):
    from rankmix.operators.prep import hash_split
    from rankmix.sources.fixtures import table
    cust = table(spark, sf_dir, "customer").select("c_custkey")
    return hash_split(cust, "c_custkey").select("c_custkey", "is_test")


QUERIES.update({"prep_factorize": prep_factorize, "prep_onehot": prep_onehot,
                "prep_impute": prep_impute, "prep_split": prep_split})


# ---------------------------------------------------------------- scorers, loops

_FITTED: dict = {}


def _ml_rows(spark, sf_dir):
    """The 80% training share of ``embeddings`` and the test rows."""
    from rankmix.operators import scorers as M
    from rankmix.operators.prep import hash_split
    from rankmix.sources.fixtures import table
    emb = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding",
                                                    F.col("label").cast("double").alias("label"))
    emb = hash_split(M.as_features(emb, "embedding"), "item_id")
    return emb.filter(~F.col("is_test")), emb.filter(F.col("is_test"))


def _ml_scores(spark, sf_dir):
    """Scores of the suite (random forest, tree, perceptron, linear SVM,
    AdaBoost), fitted on the training share of ``embeddings``, on the test rows;
    and these.  The fits of a session and folder are made once: their scores are
    written to the scratch folder."""
    from rankmix.operators import scorers as M
    train, test = _ml_rows(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FITTED:
        n_classes = int(train.agg(F.max("label")).first()[0]) + 1
        # mostly many small jobs one after another: side by side they fill the cores
        with ThreadPoolExecutor(3) as side:
            fits = [side.submit(f, train, test, *more) for f, *more in (
                (M.fit_and_score, M.default_suite(64, n_classes)), (M.svm_scores,), (M.adaboost_scores, n_classes))]
            scores = functools.reduce(DataFrame.unionByName, [f.result() for f in fits])
        path = f"{scratch_dir(spark, 'rankmix_ml')}/{uuid.uuid4().hex[:12]}"
        scores.write.parquet(path)
        _FITTED[key] = path
    return spark.read.parquet(_FITTED[key]), test


def ml_stump(spark, sf_dir):
    """M3 where every step is exact: a gini tree of depth 1 on eight entries of
    ``embeddings``, cut to eighths (so all their midpoints are candidates while
    there are at most 10,000 training rows, beyond which the candidates come from
    a sample); the class shares of the test rows' leaves."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.functions import array_to_vector
    from rankmix.operators import scorers as M
    coarse = array_to_vector(F.transform(F.slice("embedding", 1, 8), lambda x: F.floor(x.cast("double") * 8).cast("double")))
    train, test = (rows.withColumn("features", coarse) for rows in _ml_rows(spark, sf_dir))
    tree = DecisionTreeClassifier(impurity="gini", maxDepth=1, seed=42)
    scores = M.fit_and_score(train, test, {"stump": tree})
    return scores.select("item_id", "model", "cls", r6("score").alias("score"))


def ml_scorers(spark, sf_dir):
    """What holds for any trained model of the suite: scored items and classes,
    probabilities that sum to 1 and lie in [0, 1].  ``ml_accuracy`` has the
    accuracies."""
    scores, _ = _ml_scores(spark, sf_dir)
    per_item = scores.groupBy("model", "item_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"), F.min("score").alias("lo"), F.max("score").alias("hi"))
    ok = (F.abs(F.col("s") - 1) < 1e-6) & (F.col("lo") >= 0) & (F.col("hi") <= 1 + 1e-9)
    return per_item.groupBy("model").agg(
        F.count(F.lit(1)).alias("items"), F.sum("n").alias("scores"),
        F.sum(F.when(ok, 0).otherwise(1)).cast("long").alias("invalid"))


def ml_accuracy(spark, sf_dir):
    """M8: correct, total and accuracy of each model of the suite on the test
    rows (trained models: no SQL, the tests hold bounds)."""
    from rankmix.operators import scorers as M
    scores, test = _ml_scores(spark, sf_dir)
    return M.accuracy_of(M.predictions(scores), test).select("model", "correct", "total", r6("accuracy").alias("accuracy"))


def vote_recursive(spark, sf_dir):
    """Iterated majority voting over the five F-ORD base models' picks."""
    ss = ford_wide(spark, sf_dir)
    hist = V.recursive_vote(base_picks_wide(ss), list(ss.models), ss.n_classes)
    rows = [(h["round"], p + 1, m, int(c)) for h in hist if not h["stopped"]
            for p, (m, c) in enumerate(zip(h["kept"], h["kept_correct"]))]
    return spark.createDataFrame(rows, "round int, position int, members string, correct long")


def search_rounds(spark, sf_dir):
    """Expansion-reduction search (AC, WC-CDS, WCP): pooled models per round."""
    from rankmix.plans.search import search, search_table
    ss = _ss(spark, sf_dir, SEARCH_SCHEMES)
    return search_table(spark, search(ss, SEARCH_SCHEMES)).select(
        "round", "position", "kind", "fusion_model", "correct", r6("accuracy").alias("accuracy"))


def search_two_rounds(spark, sf_dir):
    """The search's first two rounds: the second fuses the first one's pooled
    matrices (scaled scores, inverted ranks) under their own weights."""
    from rankmix.plans.search import search, search_table
    ss = _ss(spark, sf_dir, SEARCH_SCHEMES)
    return search_table(spark, search(ss, SEARCH_SCHEMES, max_rounds=2)).select(
        "round", "position", "kind", "fusion_model", "correct", r6("accuracy").alias("accuracy"))


QUERIES.update({"search_two_rounds": search_two_rounds, "ml_scorers": ml_scorers, "ml_stump": ml_stump, "ml_accuracy": ml_accuracy, "vote_recursive": vote_recursive,
                "search_rounds": search_rounds})


# ---------------------------------------------------------------- reports

def tie_counts(spark, sf_dir):
    return K.tie_counts(ford_wide(spark, sf_dir))


def diversity_log(spark, sf_dir):
    out = L.diversity_log(_first_ss(spark, sf_dir), "CD")
    return out.select("batch_id", *[r6(m).alias(m) for m in FORD_MODELS])


def layer_best(spark, sf_dir):
    """Best SC and RC output, best base model and the improvement (points)."""
    one = best_outputs(_layer_acc(spark, sf_dir, ALL4))
    return one.select("best_sc_model", r6("best_sc").alias("best_sc"), "best_rc_model",
                      r6("best_rc").alias("best_rc"), "best_base_model", r6("best_base").alias("best_base"),
                      r6("improvement").alias("improvement"))


def performance_series(spark, sf_dir):
    """Per scheme the chart series with the best base SC and the axis floor."""
    out = _series(_layer_acc(spark, sf_dir, ALL4), ALL4)
    # F-ORD names have no underscore: the label is the part before the scheme
    label = F.when(F.col("size") == 1, F.col("label")).otherwise(F.split("label", "_").getItem(0))
    return out.select("scheme", "size", "position", label.alias("label"), r6("sc").alias("sc"), r6("rc").alias("rc"),
                      r6("best_base").alias("best_base"), r6("floor").alias("floor"))


def accuracy_sorted(spark, sf_dir):
    """All outputs of the layer by rising accuracy."""
    return sorted_accuracies(_layer_acc(spark, sf_dir, ALL4)).select(
        "kind", "position", "fusion_model", r6("accuracy").alias("accuracy"))


QUERIES.update({"accuracy_sorted": accuracy_sorted})
QUERIES.update({"tie_counts": tie_counts, "diversity_log": diversity_log, "layer_best": layer_best,
                "performance_series": performance_series})


def reg_ksi_strength(spark, sf_dir):
    """xi diversity strength of the F-REG models over their whole vectors."""
    st = R.ksi_strength_frame(_reg_long(spark, sf_dir), FREG_MODELS)
    return st.select("model", r6("strength").alias("strength"))


QUERIES.update({"reg_ksi_strength": reg_ksi_strength})


def vote_unsupervised(spark, sf_dir):
    """V5: without truth, the vote vector of every subset of the five F-ORD
    base models (one pass, no evaluation)."""
    ss = ford_wide(spark, sf_dir)
    wide = base_picks_wide(ss).drop("label")
    subsets = V.vote_subsets(ss.n_models)
    names = [("".join(ss.models[i] for i in s)) for s in subsets]
    from rankmix.functions import json_literal
    votes = V.subset_votes(wide, ss.n_models, ss.n_classes, subsets, keep=("item_id",))
    return votes.select("item_id", json_literal(names, "array<string>")[F.col("combo")].alias("members"), "vote")


QUERIES.update({"vote_unsupervised": vote_unsupervised})


def output_validity(spark, sf_dir):
    """which layer outputs (all four schemes) hold an invalid value."""
    from rankmix.plans.search import output_validity as validity
    ss = _ss(spark, sf_dir, ALL4)
    return validity(ss, batch_weights(ss, ALL4), fused_specs(ss.models, ALL4)).drop("ord")


QUERIES.update({"output_validity": output_validity})


def rsc_item_ranks(spark, sf_dir):
    """K9, rank side: the RSC of every item's average-rank values."""
    return K.item_rsc(ford_wide(spark, sf_dir), of_ranks=True).select(
        "item_id", "model", "position", "rank", r6("value").alias("value"))


QUERIES.update({"rsc_item_ranks": rsc_item_ranks})


def reg_report_rc(spark, sf_dir):
    """C6 with the rank combinations: R^2 / RMSE of the RC outputs (base
    models' rank vectors included, labelled Base_<m>)."""
    wide, fused = _reg_fused(spark, sf_dir, ("RC",))
    mean_y = float(wide.agg(F.avg("target")).first()[0])
    rep = R.report(fused, mean_y, FREG_MODELS, kinds=("RC",))
    return rep.select("model", r6("r2").alias("r2"), round4("rmse").alias("rmse"))


QUERIES.update({"reg_report_rc": reg_report_rc})


def prep_columns(spark, sf_dir):
    """P2, P3, P5, P6, P10 to P14 in one frame over ``part`` and ``events``:
    attach a target, drop rows with nulls (parts without events) and trailing
    columns, cast, shift and one-hot encode labels, rename by position, filter by
    suffix or membership; and both sides of a split by the brand."""
    from rankmix.operators import prep as P
    from rankmix.sources.fixtures import table
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    target = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("p_partkey")).agg(
        F.count(F.lit(1)).alias("n_events"), F.max("event_type").alias("last_type"))
    rows = P.attach_target(P.drop_trailing(part, 1), target.drop("last_type"), "p_partkey")
    rows = P.suffix_or_member(P.drop_null_rows(rows), "p_brand", "3", ["Brand#11", "Brand#22"])
    rows = rows.withColumn("label", P.shift_labels("p_size"))
    rows = rows.withColumn("code", P.cast_labels(F.substring("p_brand", 7, 1)))
    rows = rows.withColumn("hot", F.array_join(P.label_one_hot("code", 6), ""))
    features, y = P.detach_target(rows, "n_events", "p_partkey")
    rows = P.attach_target(features, y, "p_partkey").drop("p_name", "p_size")
    rows = P.rename_positional(rows, ["part", "brand", "label", "code", "hot", "target"])
    same, rest = P.split_by_value(rows, "brand", "Brand#13")
    return same.withColumn("side", F.lit("same")).unionByName(rest.withColumn("side", F.lit("rest")))


QUERIES.update({"prep_columns": prep_columns})


# ---------------------------------------------------------------- files

def _written_dir(spark, name):
    return f"{scratch_dir(spark, 'rankmix_files')}/{name}-{uuid.uuid4().hex[:12]}"


def files_layer(spark, sf_dir):
    """The F-ORD scores and labels as a score directory, read
    back and fused (AC); the performance table written and read again."""
    from rankmix.sources import files
    from rankmix.sources.frames import to_wide
    # read by the matrices and by the truth: made once
    ss, path = ford_wide(spark, sf_dir), _written_dir(spark, "scores")
    ss = ss.with_df(ss.df.checkpoint(eager=True))
    files.write_score_dir(to_long(ss), ss.models, ss.n_classes, path)
    files.write_table(ss.df.select("item_id", F.col("label").alias("0")), f"{path}/ground_truths.csv")
    truth = files.read_truth(spark, f"{path}/ground_truths.csv")
    back = to_wide(files.read_score_folders(spark, path, by_line=True), truth=truth, batch_size=BATCH)
    report = L.layer_report(L.layer_accuracy(L.prepare(back, BATCH, ("AC",)), ("AC",)))
    files.write_table(report.select("fusion_model", "sc", "rc"), f"{path}/performance.csv")
    rows = files.read_delimited(spark, f"{path}/performance.csv", sep=",", schema="fusion_model string, sc double, rc double")
    return rows.select("fusion_model", r6("sc").alias("sc"), r6("rc").alias("rc"))


def files_regression(spark, sf_dir):
    """Regression from a score directory of one-column files: the F-REG vectors
    written, read back with their truth, fused and reported (SC)."""
    from rankmix.sources import files
    wide, path = freg_wide(spark, sf_dir), _written_dir(spark, "vectors")
    ensure_checkpoint_dir(spark)
    wide = wide.checkpoint(eager=True)          # read by the vectors and by the truth
    long = R.to_long(wide, FREG_MODELS).withColumn("cls", F.lit(0))
    files.write_score_dir(long, FREG_MODELS, 1, path)
    files.write_table(wide.select("item_id", F.col("target").alias("0")), f"{path}/ground_truths.csv")
    truth = files.read_truth(spark, f"{path}/ground_truths.csv", value_type="double")
    back, models = R.from_scores(files.read_score_folders(spark, path), truth)
    back = back.checkpoint(eager=True)
    weights = R.regression_weights(R.to_long(back, models), models)
    mean_y = float(back.agg(F.avg("target")).first()[0])
    rep = R.report(R.fuse(back, models, weights, ("SC",)), mean_y, models)
    return rep.select("model", r6("r2").alias("r2"), round4("rmse").alias("rmse"))


def files_tables(spark, sf_dir):
    """A table of several Parquet folders read as one, joined with a
    table in delimited text."""
    from rankmix.sources import files
    from rankmix.sources.fixtures import table
    path = _written_dir(spark, "tables")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    low, high = supplier.filter("s_nationkey < 12"), supplier.filter("s_nationkey >= 12")
    files.write_table(low, f"{path}/low", fmt="parquet")
    files.write_table(high, f"{path}/high", fmt="parquet")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    nation.write.option("header", True).option("sep", ";").csv(f"{path}/nation.csv")
    names = files.read_delimited(spark, f"{path}/nation.csv")
    rows = files.read_parquet_many(spark, f"{path}/low", f"{path}/high")
    return rows.join(names, rows.s_nationkey == names.n_nationkey).groupBy("n_name").agg(
        F.count(F.lit(1)).alias("suppliers"), F.min("s_suppkey").alias("first_key"))


QUERIES.update({"files_layer": files_layer, "files_regression": files_regression, "files_tables": files_tables})
