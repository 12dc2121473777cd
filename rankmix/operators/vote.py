"""Majority voting over model predictions.

Predictions are held wide — one row per item with ``p0..p{V-1}``.  In a task,
a block of items becomes one bit set of voters for every label and item; a
subset's votes for a label are then the bits that the label's voters and the
subset share, whatever the number of voters.  Accuracies of all subsets are
counted in the task, so the shuffle carries tasks x subsets counters.  The most
frequent label wins; ties go to the lowest label (``argmax(bincount)``).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmix.functions import json_literal
from rankmix.operators.lattice import schema_of
from rankmix.session import ensure_checkpoint_dir

# Fixed value: number of best subsets kept as voters between rounds, by default.
VOTERS_PER_ROUND = 5


def vote_subsets(n: int, full_set_only: bool = False) -> list[tuple]:
    sizes = [n] if full_set_only else range(2, n + 1)
    return [c for k in sizes for c in combinations(range(n), k)]


class Ballots:
    """Bit sets of the voters of a block of items, by label and item; 64 voters
    to a word."""

    def __init__(self, predictions: list[np.ndarray], n_labels: int):
        n = len(predictions[0]) if predictions else 0
        self.words = np.zeros((-(-len(predictions) // 64), n_labels, n), np.uint64)
        at = np.arange(n)
        for i, p in enumerate(predictions):
            ok = (p >= 0) & (p < n_labels)
            self.words[i // 64, p[ok], at[ok]] |= np.uint64(1 << i % 64)

    def vote(self, members) -> np.ndarray:
        """The label with most votes among ``members``, the lowest on ties."""
        best = out = None
        masks = [np.uint64(sum(1 << i % 64 for i in members if i // 64 == w)) for w in range(len(self.words))]
        for label in range(self.words.shape[1]):
            votes = sum(np.bitwise_count(word[label] & mask).astype(np.int32) for word, mask in zip(self.words, masks))
            if best is None:
                best, out = votes, np.zeros(len(votes), np.int32)
            else:
                out[votes > best] = label
                best = np.maximum(best, votes)
        return out


def _ballots(batch: pa.RecordBatch, first: int, n_voters: int, n_labels: int) -> Ballots:
    """Ballots of a batch whose voters' columns begin at ``first``."""
    cols = [batch.column(first + i).cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False) for i in range(n_voters)]
    return Ballots(cols, n_labels)


def _voters(n: int) -> list[str]:
    return [f"p{i}" for i in range(n)]


def with_votes(wide: DataFrame, n_voters: int, n_labels: int, subsets: list[tuple], names: list[str],
               keep=("item_id",)) -> DataFrame:
    """``keep`` and one column for each subset with its vote."""
    keep = list(keep)
    rows = wide.select(*keep, *_voters(n_voters))

    def run(batches):
        for b in batches:
            ballots = _ballots(b, len(keep), n_voters, n_labels)
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))]
                                             + [pa.array(ballots.vote(s), pa.int32()) for s in subsets], names=[*keep, *names])

    return rows.mapInArrow(run, ", ".join([schema_of(rows, keep), *[f"`{n}` int" for n in names]]))


def majority_vote(wide: DataFrame, n_voters: int, n_labels: int, keep=("item_id",)) -> DataFrame:
    """``(item_id, vote)`` over all voters ``p0..``."""
    return with_votes(wide, n_voters, n_labels, [tuple(range(n_voters))], ["vote"], keep)


def subset_votes(wide: DataFrame, n_voters: int, n_labels: int, subsets: list[tuple],
                 keep=("item_id",)) -> DataFrame:
    """``(item_id, combo, vote)`` for every subset (V5: no truth needed)."""
    keep = list(keep)
    rows = wide.select(*keep, *_voters(n_voters))

    def run(batches):
        for b in batches:
            ballots = _ballots(b, len(keep), n_voters, n_labels)
            for j, s in enumerate(subsets):
                yield pa.RecordBatch.from_arrays(
                    [b.column(i) for i in range(len(keep))]
                    + [pa.array(np.full(len(b), j), pa.int32()), pa.array(ballots.vote(s), pa.int32())],
                    names=[*keep, "combo", "vote"])

    return rows.mapInArrow(run, schema_of(rows, keep) + ", combo int, vote int")


def subset_accuracy(wide: DataFrame, n_voters: int, n_labels: int, subsets: list[tuple],
                    names: list[str]) -> DataFrame:
    """``(combo, members, correct, total, accuracy)``; accuracy is a fraction."""
    def run(batches):
        right, total = np.zeros(len(subsets), np.int64), 0
        for b in batches:
            ballots = _ballots(b, 1, n_voters, n_labels)
            label = b.column(0).cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
            total += len(b)
            right += [np.count_nonzero(ballots.vote(s) == label) for s in subsets]
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(subsets)), pa.int32()), pa.array(right), pa.array(np.full(len(subsets), total))],
                names=["combo", "correct", "total"])

    counts = wide.select("label", *_voters(n_voters)).mapInArrow(run, "combo int, correct long, total long")
    agg = counts.groupBy("combo").agg(F.sum("correct").alias("correct"), F.sum("total").alias("total"))
    labels = json_literal(["".join(names[i] for i in s) for s in subsets], "array<string>")
    return agg.select("combo", labels[F.col("combo")].alias("members"), "correct", "total",
                      (F.col("correct") / F.col("total")).alias("accuracy"))


def wide_predictions(preds_long: DataFrame, voters: list[str], truth: DataFrame | None = None) -> DataFrame:
    """Long ``(item_id, model, pred)`` -> ``item_id[, label], p0..`` (one shuffle on item_id)."""
    aggs = [F.max(F.when(F.col("model") == m, F.col("pred"))).alias(f"p{i}")
            for i, m in enumerate(voters)]
    wide = preds_long.groupBy("item_id").agg(*aggs)
    if truth is not None:
        wide = wide.join(truth.select("item_id", "label"), on="item_id")
    return wide


def recursive_vote(wide: DataFrame, voters: list[str], n_labels: int, full_set_only: bool = False,
                   keep: int = VOTERS_PER_ROUND) -> list[dict]:
    """Iterated voting with ground truth: every round evaluates all subsets of
    the current voters, makes the votes of the best ``keep`` subsets the next
    voters, and stops when the best accuracy does not improve (accuracies are
    finitely many, so it does stop) or no subset is left.

    Returns one dict per evaluated round (best accuracy, best subset, kept).
    Each round's voters are checkpointed to the shared checkpoint folder, so
    lineage stays one round long and a lost executor recomputes one round.
    """
    ensure_checkpoint_dir(wide.sparkSession)
    names = list(voters)
    cur = wide.select("item_id", "label", *[f"p{i}" for i in range(len(names))])
    history, best = [], None
    rnd = 0
    while True:
        rnd += 1
        n = len(names)
        subsets = vote_subsets(n, full_set_only) if n >= 2 else []
        if not subsets:
            break
        acc = subset_accuracy(cur, n, n_labels, subsets, names).orderBy(
            F.col("accuracy").desc(), F.col("combo").asc())
        top = acc.limit(keep).collect()
        if rnd > 1 and top[0]["accuracy"] <= best:
            history.append({"round": rnd, "best_accuracy": top[0]["accuracy"], "stopped": True,
                            "best_members": top[0]["members"], "kept": []})
            break
        best = top[0]["accuracy"]
        kept = [r["members"] for r in top]
        history.append({"round": rnd, "best_accuracy": best, "stopped": False,
                        "best_members": top[0]["members"], "kept": kept,
                        "kept_correct": [r["correct"] for r in top]})
        chosen = [subsets[r["combo"]] for r in top]
        cur = with_votes(cur, n, n_labels, chosen, _voters(len(chosen)), ["item_id", "label"]).checkpoint(eager=True)
        names = [f"C{rnd}({m})" for m in kept]
    return history
