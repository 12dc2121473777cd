"""Picks, accuracies and report tables.

Tasks count, for their own items, how many of each label every output picks
right (``lattice.label_counts``): item rows never fan out to rows by output, and
the shuffle carries tasks x outputs x labels counters.  Accuracy, recall by class
and its means all come from these counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankmix.model import FusedSpec, ScoreSet
from rankmix.operators.combine import RC, SC, fused_specs, layer_of, layout_frame
from rankmix.operators.lattice import item_picks, label_counts
from rankmix.operators.weights import Weights


def _named(df: DataFrame, layout) -> DataFrame:
    """Attach kind / fusion_model / ord to rows keyed by ``j`` (metadata join)."""
    meta = layout_frame(df.sparkSession, layout).select(
        "j", "kind", "fusion_model", "scheme", "size", "output", F.col("j").alias("ord"))
    return df.join(F.broadcast(meta), on="j", how="inner").drop("j")


def labels_long(ss: ScoreSet, weights: Weights | None, specs: list[FusedSpec],
                kinds=(SC, RC)) -> DataFrame:
    """``(item_id, kind, fusion_model, pred)`` — one row per item and output."""
    layer = layer_of(ss, weights, specs, kinds)
    rows = item_picks(layer, ["item_id"]).select("item_id", F.posexplode("picks").alias("j", "pred"))
    return _named(rows, layer.layout).drop("ord", "scheme", "size", "output")


def accuracy(ss: ScoreSet, weights: Weights | None, specs: list[FusedSpec],
             kinds=(SC, RC)) -> DataFrame:
    """``(kind, fusion_model, scheme, size, output, ord, correct, total,
    accuracy)``; percent of the items that have a label."""
    if not ss.has_label:
        raise ValueError("accuracy needs ground-truth labels")
    layer = layer_of(ss, weights, specs, kinds)
    agg = label_counts(layer).groupBy("j").agg(F.sum("hits").alias("correct"), F.sum("n").alias("total"))
    out = _named(agg, layer.layout)
    return out.select("kind", "fusion_model", "scheme", "size", "output", "ord", "correct", "total",
                      (F.col("correct") / F.col("total") * F.lit(100.0)).alias("accuracy"))


def base_accuracy(ss: ScoreSet) -> DataFrame:
    """Accuracy of the base models (argmax of their scores)."""
    specs = fused_specs(ss.models, [], include_base=True)
    return accuracy(ss, None, specs, kinds=(SC,)).drop("kind")


def with_base_accuracies(ss: ScoreSet) -> ScoreSet:
    """Attach base accuracies (percent) to the score set — one small action."""
    rows = base_accuracy(ss).orderBy("ord").collect()
    return ss.with_df(ss.df, accuracies=tuple(float(r["accuracy"]) for r in rows))


def per_class_accuracy(ss: ScoreSet, weights: Weights | None, specs: list[FusedSpec],
                       kinds=(SC, RC)) -> DataFrame:
    """Recall per class: ``(kind, fusion_model, cls, correct, count, class_accuracy)``.
    Every class 0..C-1 appears; a class absent from the truth gives NULL."""
    layer = layer_of(ss, weights, specs, kinds)
    by = label_counts(layer).withColumnRenamed("hits", "c")
    # fold the (few) labels of each output into maps, then expand 0..C-1
    per_j = by.groupBy("j").agg(F.map_from_entries(F.collect_list(
        F.struct("label", F.struct("c", "n")))).alias("m"))
    cls = F.explode(F.sequence(F.lit(0), F.lit(ss.n_classes - 1))).alias("cls")
    wide = per_j.select("j", "m", cls)
    got = F.col("m")[F.col("cls")]
    long = wide.select("j", "cls", F.coalesce(got.getField("c"), F.lit(0)).alias("correct"),
                       F.coalesce(got.getField("n"), F.lit(0)).alias("count"))
    out = _named(long, layer.layout)
    return out.select("kind", "fusion_model", "scheme", "cls", "correct", "count",
                      F.try_divide(F.col("correct").cast("double"),
                                   F.col("count").cast("double")).alias("class_accuracy"))


def performance_table(acc: DataFrame) -> DataFrame:
    """SC and RC accuracy side by side, joined on members and scheme: neither
    the position nor the display name identifies an output."""
    sc = acc.filter(F.col("kind") == SC).select("fusion_model", "scheme", "size", "output",
                                               F.col("accuracy").alias("sc"), "ord")
    rc = acc.filter(F.col("kind") == RC).select("output", F.col("accuracy").alias("rc"))
    return sc.join(rc, on="output", how="left")


def sorted_accuracies(acc: DataFrame) -> DataFrame:
    """Every output's place in its kind from the least accurate up, ties
    in layer order (the table has a row for each output: metadata)."""
    w = Window.partitionBy("kind").orderBy(F.col("accuracy"), F.col("ord"))
    return acc.withColumn("position", F.row_number().over(w))


def best_outputs(acc: DataFrame) -> DataFrame:
    """Best SC and RC output, best base model and the improvement over
    it in points; the first in layer order wins ties."""
    key = F.struct(F.col("accuracy"), -F.col("ord"))
    is_base = (F.col("kind") == SC) & F.col("scheme").isNull()
    aggs = []
    for name, cond in (("sc", F.col("kind") == SC), ("rc", F.col("kind") == RC), ("base", is_base)):
        aggs.append(F.max_by(F.col("fusion_model"), F.when(cond, key)).alias(f"best_{name}_model"))
        aggs.append(F.max(F.when(cond, F.col("accuracy"))).alias(f"best_{name}"))
    return acc.agg(*aggs).withColumn("improvement", F.greatest("best_sc", "best_rc") - F.col("best_base"))


def short_names(models) -> list[str]:
    """A, B, ... Z, A1, B1, ... for the base models in their order."""
    return [chr(65 + i % 26) + (str(i // 26) if i >= 26 else "") for i in range(len(models))]


def performance_series(acc: DataFrame, schemes, short: dict[int, str] | None = None) -> DataFrame:
    """Per scheme the base models, then the subsets by size and inside
    a size by RC (layer order on ties); base rows take RC := SC; the best base
    SC and the axis floor (least SC - 10) ride along.  ``short`` replaces
    labels by output number.  All tables are metadata: a row for each output."""
    t = performance_table(acc)
    label = F.col("fusion_model")
    if short:
        names = F.create_map(*[x for k, v in short.items() for x in (F.lit(k), F.lit(v))])
        label = F.coalesce(F.try_element_at(names, F.col("output")), label)
    t = t.select("scheme", label.alias("label"), "size", "ord", "sc",
                 F.when(F.col("scheme").isNull(), F.col("sc")).otherwise(F.col("rc")).alias("rc"))
    base = t.filter(F.col("scheme").isNull()).withColumn(
        "scheme", F.explode(F.array(*[F.lit(s) for s in schemes])))
    rows = base.unionByName(t.filter(F.col("scheme").isin(list(schemes))))
    w, everything = Window.partitionBy("scheme").orderBy("size", "rc", "ord"), Window.partitionBy()
    return rows.select("scheme", "size", F.row_number().over(w).alias("position"), "label", "sc", "rc",
                       F.max(F.when(F.col("size") == 1, F.col("sc"))).over(everything).alias("best_base"),
                       (F.min("sc").over(everything) - 10).alias("floor"))


def check_score_set(ss: ScoreSet) -> dict:
    """Input checks (C4) in one job: every score array has C entries, no NULL
    scores, labels inside 0..C-1, unique item ids.  Returns the counts of rows
    and of offending rows; raises ValueError if any.  Layers check arrays, scores
    and labels themselves, in the pass that they make anyway."""
    c = ss.n_classes
    bad = {f"len{i}": F.coalesce(F.size(F.col(f"s{i}")) != c, F.lit(True)) for i in range(ss.n_models)}
    bad |= {f"nul{i}": F.exists(F.col(f"s{i}"), lambda x: x.isNull()) for i in range(ss.n_models)}
    if ss.has_label:
        bad["bad_label"] = (F.col("label") < 0) | (F.col("label") >= c) | F.col("label").isNull()
    flags = [F.when(cond, 1).otherwise(0).alias(k) for k, cond in bad.items()]
    by_id = ss.df.select("item_id", *flags).groupBy("item_id").agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(k).alias(k) for k in bad])
    row = by_id.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("rows", *bad)],
                    F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).alias("duplicate_item_ids")).first().asDict()
    problems = {k: v for k, v in row.items() if k != "rows" and v}
    if problems:
        raise ValueError(f"invalid score set: {problems}")
    return row
