"""Iterative expansion-reduction search over fusion layers.

Round r measures every output of the current layer (accuracy, validity and
largest rank, in one job over the items), pools the best K score- and
rank-combination outputs above their running thresholds, turns them into the next round's base models — the min-max
scaled SC matrix, or the inverted RC matrix ``1 - (r-1)/(max r - 1)`` —
ranks them ordinally per item, and fuses them again.  Outputs whose
matrices contain an invalid value (constant batch, no weight) are dropped.

The driver loop only moves metadata (accuracies of at most a few hundred
outputs).  The K selected matrices of each round are written to the shared
checkpoint folder as a table bucketed by ``batch_id``, which cuts the lineage
to one round, keeps the next round free of item exchanges, and lets a lost
executor re-read a single round.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmix.model import FusedSpec, ScoreSet
from rankmix.operators.combine import RC, SC, fused_specs, layer_of, layout_frame
from rankmix.operators.evaluate import with_base_accuracies
from rankmix.operators.lattice import Layer, chosen_scores, round_counts
from rankmix.operators.weights import batch_weights, validate_schemes
from rankmix.plans.layer import fused_votes
from rankmix.session import ensure_checkpoint_dir
from rankmix.sources.frames import materialize

# Pool size and round limit of the search.
POOL_K = 4
MAX_ROUNDS = 15


def output_validity(ss: ScoreSet, weights, specs, kinds=(SC, RC)) -> DataFrame:
    """``(kind, fusion_model, ord, valid)``: an output is invalid (F12) when any of
    its values is missing (no weight, NULL weight) or, for SC, some batch is
    constant (the min-max scaling divides by zero)."""
    layer = layer_of(ss, weights, specs, kinds)
    meta = layout_frame(ss.df.sparkSession, layer.layout).select("j", "kind", "fusion_model")
    return round_counts(layer).join(F.broadcast(meta), on="j").select(
        "kind", "fusion_model", F.col("j").alias("ord"), (F.col("bad") == 0).alias("valid"))


def invalid_outputs(ss: ScoreSet, weights, specs, kinds=(SC, RC)) -> set:
    """Places in the layout of invalid outputs (a small collect of metadata)."""
    rows = output_validity(ss, weights, specs, kinds).filter(~F.col("valid")).collect()
    return {r["ord"] for r in rows}


def _next_base(ss: ScoreSet, layer: Layer, pooled: list[dict]) -> ScoreSet:
    """The pooled outputs as the next round's base models, written once and
    bucketed by batch_id: the next round reads them without an exchange and its
    lineage starts here.  They are made where their batch lies: a task has the rows
    of one bucket and writes them there, without a shuffle."""
    wide = chosen_scores(layer, [(r["j"], r["top"]) for r in pooled])
    names = tuple(f"({r['kind']}_{r['fusion_model']})" for r in pooled)
    nxt = replace(ss, df=wide, models=names, has_ranks=True, ids=None, allow_missing=True,
                  accuracies=tuple(float(r["accuracy"]) for r in pooled))
    return materialize(nxt)


def _measured(layer: Layer) -> list[dict]:
    """One job over the items: every output's correct, total, validity and top."""
    out = []
    for r in round_counts(layer).collect():
        kind, spec = layer.layout[r["j"]]
        out.append(r.asDict() | {"kind": kind, "fusion_model": spec.name,
                                 "accuracy": r["correct"] / r["total"] * 100.0 if r["total"] else None})
    return [r for r in out if r["accuracy"] is not None]


def search(ss: ScoreSet, schemes, k: int = POOL_K, max_rounds: int = MAX_ROUNDS,
           max_size: int | None = None) -> list[dict]:
    """Run the search; returns one record per round with the pooled outputs.
    The last record says how it ended: ``empty`` when nothing beat the
    thresholds, ``limit`` when ``max_rounds`` was reached before that.

    ``ss`` must be prepared (batches, ranks); base accuracies are measured here
    when it has none.  ``max_size`` bounds the first layer's subsets.  Thresholds
    follow the layer's bookkeeping: both start at the best base accuracy;
    the SC threshold then becomes the best of the pooled SC and RC lists,
    the RC threshold the best of the RC list.
    """
    if not ss.has_label:
        raise ValueError("the search needs ground truth")
    ensure_checkpoint_dir(ss.df.sparkSession)
    schemes = validate_schemes(schemes, True)
    if ss.accuracies is None:
        ss = with_base_accuracies(ss)
    best_base = max(ss.accuracies)
    max_s = max_r = best_base
    cur = ss
    layer = layer_of(cur, batch_weights(cur, schemes), fused_specs(cur.models, schemes, max_size=max_size))
    history = []
    for rnd in range(1, max_rounds + 1):
        # the first layer's outputs are taken as they are, later ones only if valid
        acc = [r for r in _measured(layer) if rnd == 1 or not r["bad"]]

        def top(kind, thr):
            rows = [r for r in acc if r["kind"] == kind and r["accuracy"] > thr]
            rows.sort(key=lambda r: (-r["accuracy"], r["j"]))
            return rows[:k]

        top_sc, top_rc = top(SC, max_s), top(RC, max_r)
        pooled = sorted(top_sc + top_rc, key=lambda r: -r["accuracy"])[:k]
        if not pooled:
            history.append({"round": rnd, "pooled": [], "empty": True, "limit": False})
            break
        if top_sc or top_rc:
            max_s = max(r["accuracy"] for r in top_sc + top_rc)
        if top_rc:
            max_r = max(r["accuracy"] for r in top_rc)
        history.append({"round": rnd, "empty": False, "limit": rnd == max_rounds,
                        "pooled": [(r["kind"], r["fusion_model"], r["correct"], r["accuracy"])
                                   for r in pooled],
                        "sc_threshold": max_s, "rc_threshold": max_r})
        if rnd == max_rounds:
            break
        cur = _next_base(cur, layer, pooled)
        layer = layer_of(cur, batch_weights(cur, schemes), fused_specs(cur.models, schemes))
    return history


def search_summary(ss: ScoreSet, history: list[dict]) -> dict:
    """Best model of a search, its accuracy and its gain over the best base
    model in points (the base model itself when nothing beat it)."""
    base = ss.accuracies or with_base_accuracies(ss).accuracies
    best = max(range(len(base)), key=lambda i: (base[i], -i))
    out = {"model": ss.models[best], "accuracy": base[best], "round": 0}
    for h in history:
        for _, name, _, a in h["pooled"]:
            if a > out["accuracy"]:
                out = {"model": name, "accuracy": a, "round": h["round"]}
    return out | {"best_base": base[best], "gain": out["accuracy"] - base[best],
                  "ended_by_limit": bool(history and history[-1]["limit"])}


def select_outputs(ss: ScoreSet, schemes, method: str = "ER-Algorithm", **options):
    """The selection switch.  ``ER-Algorithm`` runs the search and returns
    its history; ``Majority Vote`` votes over all outputs of one layer and
    returns ``(item_id, [label,] vote)``."""
    if method == "ER-Algorithm":
        return search(ss, schemes, **options)
    if method == "Majority Vote":
        return fused_votes(ss, schemes, max_size=options.get("max_size"))
    raise ValueError("method is 'ER-Algorithm' or 'Majority Vote'")


def search_table(spark, history: list[dict]) -> DataFrame:
    """``(round, position, kind, fusion_model, correct, accuracy)`` of a run."""
    rows = [(h["round"], p + 1, kind, name, int(correct), float(a))
            for h in history for p, (kind, name, correct, a) in enumerate(h.get("pooled", []))]
    return spark.createDataFrame(
        rows, "round int, position int, kind string, fusion_model string, correct long, accuracy double")


__all__ = ["search", "search_table", "search_summary", "select_outputs", "invalid_outputs", "FusedSpec"]
