"""Voting on an own sample: 10 items, three labels, four voters, with ties.

The expected counts were computed by hand-written counting (``_votes`` below),
not by the engine."""
from collections import Counter
from itertools import combinations

import pytest

from rankmix.operators.vote import recursive_vote, subset_accuracy, subset_votes, vote_subsets

TRUTH = [0, 1, 2, 0, 1, 2, 0, 1, 2, 0]
PRED = {
    "ash": [0, 1, 2, 0, 2, 2, 1, 1, 0, 2],
    "elm": [0, 1, 1, 2, 1, 2, 0, 0, 2, 1],
    "fir": [1, 1, 2, 0, 1, 0, 0, 2, 2, 0],
    "oak": [2, 0, 2, 0, 1, 2, 2, 1, 1, 0],
}
NAMES = list(PRED)


def _votes(members):
    out = []
    for i in range(len(TRUTH)):
        n = Counter(PRED[NAMES[m]][i] for m in members)
        out.append(min(label for label, c in n.items() if c == max(n.values())))
    return out


@pytest.fixture(scope="module")
def wide(spark):
    rows = [(i, TRUTH[i], *[PRED[m][i] for m in NAMES]) for i in range(len(TRUTH))]
    return spark.createDataFrame(rows, "item_id long, label int, " + ", ".join(f"p{i} int" for i in range(4)))


def test_subset_votes_and_counts(wide):
    subsets = vote_subsets(4)
    assert subsets == [c for k in (2, 3, 4) for c in combinations(range(4), k)]
    got = {}
    for r in subset_votes(wide, 4, 3, subsets).collect():
        got.setdefault(r.combo, {})[r.item_id] = r.vote
    for j, members in enumerate(subsets):
        assert [got[j][i] for i in range(len(TRUTH))] == _votes(members)
    counts = {r.combo: (r.correct, r.total) for r in subset_accuracy(wide, 4, 3, subsets, NAMES).collect()}
    assert counts == {j: (sum(a == b for a, b in zip(_votes(m), TRUTH)), 10) for j, m in enumerate(subsets)}


def _recursive(preds, keep, full_set_only=False):
    """Best accuracy of every round, in plain Python."""
    best, rounds = None, []
    while len(preds) >= 2:
        sizes = [len(preds)] if full_set_only else range(2, len(preds) + 1)
        votes = []
        for members in (c for k in sizes for c in combinations(range(len(preds)), k)):
            row = []
            for i in range(len(TRUTH)):
                n = Counter(preds[m][i] for m in members)
                row.append(min(label for label, c in n.items() if c == max(n.values())))
            votes.append(row)
        votes.sort(key=lambda v: -sum(a == b for a, b in zip(v, TRUTH)))
        top = sum(a == b for a, b in zip(votes[0], TRUTH))
        rounds.append(top)
        if best is not None and top <= best:
            break
        best, preds = top, votes[:keep]
    return rounds


@pytest.mark.parametrize("keep", [3, 5])
def test_recursive(wide, keep):
    history = recursive_vote(wide, NAMES, 3, keep=keep)
    want = _recursive(list(PRED.values()), keep)
    assert [round(h["best_accuracy"] * 10) for h in history] == want
    assert history[-1]["stopped"] and not any(h["stopped"] for h in history[:-1])


def test_full_set_only(wide):
    history = recursive_vote(wide, NAMES, 3, full_set_only=True)
    assert [round(h["best_accuracy"] * 10) for h in history] == _recursive(list(PRED.values()), 5, True)
