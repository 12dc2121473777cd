"""The fusion layer: base models -> every weighted score / rank combination
-> picks -> accuracies and reports.

Typical use::

    ss = prepare(scores_set, batch_size=2048)            # batches + ranks (+ accuracies)
    acc = layer_accuracy(ss, ["AC", "WC-CDS", "WC-KDS", "WCP"])
    report = layer_report(acc)

Everything is lazy except ``prepare``: it writes the batched rows once (a
table bucketed by ``batch_id``) and, when WCP is asked for, reads back the M
base accuracies that the scheme needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmix.model import ScoreSet
from rankmix.operators.combine import RC, SC, fused_matrices, fused_specs, layer_of
from rankmix.operators.evaluate import (accuracy, labels_long, per_class_accuracy,
                                        performance_table, with_base_accuracies)
from rankmix.operators.lattice import item_picks, item_votes
from rankmix.operators.weights import (WCP, batch_weights, strengths, validate_schemes)
from rankmix.session import ensure_checkpoint_dir, tune_session
from rankmix.sources.frames import materialize as materialize_set, with_batches


def prepare(ss: ScoreSet, batch_size: int = 2048, schemes=(), partitions: int | None = None,
            materialize: bool = True) -> ScoreSet:
    """Batch and (when WCP is asked for) measure the base models.

    With ``materialize`` the batched rows are written once, as a table
    bucketed by ``batch_id`` in the shared checkpoint folder: every later
    branch of a layer (first items, weights, outputs, base accuracies) reads
    it instead of recomputing the input, the bucketed scan keeps the hash
    partitioning on ``batch_id`` (no further exchange of item rows), and a
    lost executor re-reads files instead of replaying lineage.  Average ranks
    are made where outputs need them, beside the scores in the task.
    """
    tune_session(ss.df.sparkSession)
    ss = with_batches(ss, batch_size, partitions)
    if materialize:
        ensure_checkpoint_dir(ss.df.sparkSession)
        ss = materialize_set(ss, partitions)
    if any(s == WCP for s in validate_schemes(schemes, ss.has_label)) and ss.accuracies is None:
        ss = with_base_accuracies(ss)
    return ss


def layer_accuracy(ss: ScoreSet, schemes, kinds=(SC, RC), full_set_only: bool = False,
                   max_size: int | None = None) -> DataFrame:
    """Accuracy of every output; ``max_size`` bounds the subset size (all 2^M
    subsets are enumerated otherwise)."""
    schemes = validate_schemes(schemes, ss.has_label)
    specs = fused_specs(ss.models, schemes, full_set_only=full_set_only, max_size=max_size)
    return accuracy(ss, batch_weights(ss, schemes), specs, kinds)


def layer_report(acc: DataFrame) -> DataFrame:
    """``(fusion_model, sc, rc)``: the performance table, joined by model."""
    return performance_table(acc).select("fusion_model", "sc", "rc", "ord", "output")


def layer_matrices(ss: ScoreSet, schemes, kinds=(SC, RC), normalize: bool = True,
                   max_size: int | None = None) -> DataFrame:
    schemes = validate_schemes(schemes, ss.has_label)
    specs = fused_specs(ss.models, schemes, max_size=max_size)
    return fused_matrices(ss, batch_weights(ss, schemes), specs, kinds, normalize)


def layer_labels(ss: ScoreSet, schemes, kinds=(SC, RC), max_size: int | None = None) -> DataFrame:
    """``(item_id, kind, fusion_model, pred)`` for every output model."""
    schemes = validate_schemes(schemes, ss.has_label)
    specs = fused_specs(ss.models, schemes, max_size=max_size)
    return labels_long(ss, batch_weights(ss, schemes), specs, kinds)


def unsupervised_labels(ss: ScoreSet, schemes, kinds=(SC, RC), max_size: int | None = None,
                        rank_pick: str = "min") -> DataFrame:
    """Wide 1-based labels: ``item_id, SC_<model>..., RC_<model>...``; outputs
    of one display name are told apart by their place, ``name#j``.

    Labels of the rank outputs use the best (least) rank; ``rank_pick="max"``
    takes the largest instead.  All picks of an item are made in its row.
    """
    if rank_pick not in ("min", "max"):
        raise ValueError("rank_pick is 'min' or 'max'")
    schemes = validate_schemes(schemes, supervised=False)
    specs = fused_specs(ss.models, schemes, max_size=max_size)
    layer = layer_of(ss, batch_weights(ss, schemes), specs, kinds)
    names = [f"{k}_{s.name}" for k, s in layer.layout]
    names = [n if names.count(n) == 1 else f"{n}#{j}" for j, n in enumerate(names)]
    picks = item_picks(layer, ["item_id"], largest_rank=rank_pick == "max")
    return picks.select("item_id", *[(F.col("picks")[j] + 1).alias(n) for j, n in enumerate(names)])


def fused_votes(ss: ScoreSet, schemes, kinds=(SC, RC), max_size: int | None = None) -> DataFrame:
    """``(item_id, [label,] vote)``: majority vote over all outputs of a layer,
    counted in the item's row."""
    schemes = validate_schemes(schemes, ss.has_label)
    specs = fused_specs(ss.models, schemes, max_size=max_size)
    layer = layer_of(ss, batch_weights(ss, schemes), specs, kinds)
    return item_votes(layer, ["item_id"] + (["label"] if ss.has_label else []))


def class_accuracy(ss: ScoreSet, schemes, kinds=(SC, RC), max_size: int | None = None) -> DataFrame:
    schemes = validate_schemes(schemes, ss.has_label)
    specs = fused_specs(ss.models, schemes, max_size=max_size)
    return per_class_accuracy(ss, batch_weights(ss, schemes), specs, kinds)


def mean_class_accuracy(pca: DataFrame) -> DataFrame:
    """Mean per-class accuracy over the models of each group:
    ``(cls, base, sc, rc, fused)`` where ``fused = (sc + rc) / 2``; the base
    group is the base models' SC rows, SC / RC the fused ones."""
    is_base = F.col("scheme").isNull()
    grp = (F.when(is_base & (F.col("kind") == SC), F.lit("base"))
           .when(~is_base & (F.col("kind") == SC), F.lit("sc"))
           .when(~is_base & (F.col("kind") == RC), F.lit("rc")))
    tagged = pca.select("cls", grp.alias("grp"), "class_accuracy").filter(F.col("grp").isNotNull())
    wide = tagged.groupBy("cls").pivot("grp", ["base", "sc", "rc"]).agg(F.avg("class_accuracy"))
    return wide.select("cls", "base", "sc", "rc", ((F.col("sc") + F.col("rc")) / 2).alias("fused"))


def diversity_log(ss: ScoreSet, corr: str = "CD") -> DataFrame:
    """One row per batch, one column per model: the diversity strengths."""
    return strengths(ss, corr).groupBy("batch_id").pivot("model", list(ss.models)).agg(
        F.first("strength"))
