"""The subset lattice, votes by bit sets, curves by tie groups: against plain
Python on small random sets, and what their plans hold."""
import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankmix.functions import ordinal_rank_desc
from rankmix.model import FusedSpec, ScoreSet
from rankmix.operators import lattice, vote
from rankmix.operators.combine import RC, SC, fused_specs, layer_of
from rankmix.operators.evaluate import accuracy, check_score_set, per_class_accuracy
from rankmix.operators.weights import batch_weights
from rankmix.plans import layer as L
from rankmix.plans import regression as R
from rankmix.plans import search as S
from rankmix.sources import frames

SCHEMES = ("AC", "WC-CDS", "WCP")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(n_items, n_models, n_classes, seed=1):
    rnd = random.Random(seed)
    return [(i * 2, rnd.randrange(n_classes), *[[rnd.choice([0, 1, 2, 3, 5, 8]) / 8 for _ in range(n_classes)]
                                              for _ in range(n_models)]) for i in range(n_items)]


def _set(spark, rows, models, **options):
    cols = ", ".join(f"s{m} array<double>" for m in range(len(models)))
    return ScoreSet(df=spark.createDataFrame(rows, f"item_id long, label int, {cols}"), models=tuple(models),
                    n_classes=max(len(s) for r in rows for s in r[2:]), **options)


@pytest.fixture(scope="module")
def four(spark):
    rows = _rows(90, 4, 3)
    ss = L.prepare(_set(spark, rows, "ABCD"), 32, SCHEMES)
    yield ss, rows
    frames.release(ss)


def _ranks(row):
    return [1 + sum(x > v for x in row) + (sum(x == v for x in row) - 1) / 2 for v in row]


def _expected(ss, rows):
    """{(kind, output): {item: (values, pick)}} by summing every subset's members."""
    weights = {}
    w = batch_weights(ss, SCHEMES)
    for r in w.frame.collect():
        for sid, s in enumerate(SCHEMES):
            weights[r.batch_id, s] = [w.literal(s, i) if w.literal(s, i) is not None else r[f"w{sid}"][i] for i in range(4)]
    out = {}
    for kind in (SC, RC):
        for spec in fused_specs(ss.models, SCHEMES):
            got = out[kind, spec.name] = {}
            for item, _, *scores in rows:
                x = [s if kind == SC else _ranks(s) for s in scores]
                c = {i: 1.0 for i in spec.members}
                if not spec.is_base:
                    c = {i: weights[item // 32, spec.scheme][i] for i in spec.members}
                    c = {i: (v if kind == SC else 1 / v) for i, v in c.items() if v != 0}
                values = [sum(c[i] * x[i][k] for i in c) / sum(c.values()) for k in range(3)]
                best = max(values) if kind == SC else min(values)
                got[item] = values, next(k for k, v in enumerate(values) if abs(v - best) <= 1e-9)
    return out


def test_every_output_of_a_layer(four):
    ss, rows = four
    want = _expected(ss, rows)
    label = {r[0]: r[1] for r in rows}
    weights, specs = batch_weights(ss, SCHEMES), fused_specs(ss.models, SCHEMES)
    for r in accuracy(ss, weights, specs).collect():
        assert r.correct == sum(p == label[i] for i, (_, p) in want[r.kind, r.fusion_model].items()) and r.total == 90
    for r in per_class_accuracy(ss, weights, specs).collect():
        own = [i for i in label if label[i] == r.cls]
        assert (r.correct, r["count"]) == (sum(want[r.kind, r.fusion_model][i][1] == r.cls for i in own), len(own))
    for r in L.layer_labels(ss, SCHEMES).collect() if "WCP" not in SCHEMES else L.labels_long(ss, weights, specs).collect():
        assert r.pred == want[r.kind, r.fusion_model][r.item_id][1]
    for r in L.layer_matrices(ss, SCHEMES, normalize=False).collect():
        assert np.allclose(r["values"], want[r.kind, r.fusion_model][r.item_id][0], atol=1e-12)
    votes = {r.item_id: r.vote for r in L.fused_votes(ss, SCHEMES).collect()}
    for i in label:
        n = Counter(w[i][1] for w in want.values())
        assert votes[i] == min(k for k, c in n.items() if c == max(n.values()))


def test_no_rows_by_output_and_no_exchange_of_items(four):
    """Neither a Generate nor an Aggregate over item x output rows, nor lambdas."""
    ss, _ = four
    weights, specs = batch_weights(ss, ("AC",)), fused_specs(ss.models, ("AC",))
    for df in (lattice.label_counts(layer_of(ss, weights, specs)), L.fused_votes(ss, ("AC",)),
               L.unsupervised_labels(ss, ("AC",)), L.layer_matrices(ss, ("AC",)), S.output_validity(ss, weights, specs)):
        plan = _plan(df)
        assert "Generate" not in plan and "lambda" not in plan and "Window" not in plan
    for df in (L.fused_votes(ss, ("AC",)), L.unsupervised_labels(ss, ("AC",)), L.layer_matrices(ss, ("AC",))):
        assert "Aggregate" not in _plan(df) and "Exchange" not in _plan(df)


def test_walk_visits_each_prefix_once():
    subsets = {c: [j] for j, c in enumerate(c for k in range(2, 7) for c in combinations(range(6), k))}
    steps = lattice.walk(subsets)
    assert sorted(j for s in steps for j in s.outputs) == list(range(len(subsets)))
    # all 63 subsets but {5}, a prefix of none: one addition each, not one for each member
    assert len(steps) == 62
    assert len(lattice.walk({(0, 3): [0], (0, 3, 5): [1, 2]})) == 3


def test_members_without_weight_or_scores(spark):
    """A member of weight 0 takes no part; a missing score only touches subsets
    with that model."""
    rows = [(0, 1, [.1, .9], [None, .2], [.8, .2]), (1, 0, [.7, .3], [.5, .5], [.4, .6])]
    ss = _set(spark, rows, "ABC", accuracies=(50.0, 25.0, 0.0), allow_missing=True)
    ss = frames.with_batches(ss, 4, partitions=2)
    specs = fused_specs(ss.models, ("WCP",))
    layer = layer_of(ss, batch_weights(ss, ("WCP",)), specs, (SC,))
    got = {(layer.layout[r.j][1].name, r.item_id): r["values"] for r in lattice.matrices(layer, normalize=False).collect()}
    assert got["AC_WCP", 0] == [.1, .9] and got["AB_WCP", 0][0] is None and got["AB_WCP", 0][1] == pytest.approx(2 / 3)
    valid = {r.fusion_model: r.valid for r in S.output_validity(ss, batch_weights(ss, ("WCP",)), specs, (SC,)).collect()}
    assert valid == {"A": True, "B": False, "C": True, "AB_WCP": False, "AC_WCP": True, "BC_WCP": False, "ABC_WCP": False}


@pytest.mark.parametrize("bad,options", [((3, 0, [.1, .9], [.5]), {}), ((3, 2, [.1, .9], [.5, .5]), {}),
                                         ((3, 0, [.1, None], [.5, .5]), {}), ((3, -4, [.1, .9], [.5, .5]), {}),
                                         ((3, 0, None, [.5, .5]), {})])
def test_bad_rows_raise_in_the_layer_s_own_pass(spark, bad, options):
    ss = _set(spark, [(1, 0, [.1, .9], [.2, .8]), (2, 1, [.3, .7], [.6, .4])], "AB", **options)
    bad = ss.with_df(ss.df.union(spark.createDataFrame([bad], ss.df.schema)))
    for s in (ss, bad):
        p = L.prepare(s, 8, ("AC",))
        if s is ss:
            assert L.layer_accuracy(p, ("AC",)).count() == 6
        else:
            with pytest.raises(Exception, match="ValueError"):
                L.layer_accuracy(p, ("AC",)).collect()
            with pytest.raises(ValueError):
                check_score_set(s)
        frames.release(p)


def test_repeated_ids_raise(spark):
    ss = _set(spark, [(1, 0, [.1, .9], [.2, .8]), (1, 1, [.3, .7], [.6, .4])], "AB")
    with pytest.raises(ValueError, match="duplicate_item_ids"):
        check_score_set(ss)
    ss = frames.with_batches(ss, 8, partitions=2)
    with pytest.raises(Exception, match="unique"):
        L.layer_matrices(ss, ("AC",)).collect()


def test_a_search_round_reads_the_items_once(four, monkeypatch):
    ss, rows = four
    calls = []
    real = S.round_counts
    monkeypatch.setattr(S, "round_counts", lambda layer: calls.append(1) or real(layer))
    history = S.search(ss, SCHEMES, max_rounds=2)
    assert len(calls) == len(history)
    want = _expected(ss, rows)
    label = {r[0]: r[1] for r in rows}
    for kind, name, correct, _ in history[0]["pooled"]:
        assert correct == sum(p == label[i] for i, (_, p) in want[kind, name].items())


def test_chosen_outputs_become_models(four):
    """Scaled scores and inverted ranks with ordinal ranks, whole batches at once."""
    ss, rows = four
    specs = fused_specs(ss.models, ("AC",))
    layer = layer_of(ss, batch_weights(ss, ("AC",)), specs)
    want = _expected(ss, rows)
    j, r = specs.index(next(s for s in specs if s.name == "AB_AC")), len(specs)
    got = lattice.chosen_scores(layer, [(j, None), (r + j, 3.0)]).collect()
    for row in got:
        batch = [want[SC, "AB_AC"][i][0] for i, *_ in rows if i // 32 == row.batch_id]
        lo, hi = min(map(min, batch)), max(map(max, batch))
        assert np.allclose(row.s0, [(v - lo) / (hi - lo) for v in want[SC, "AB_AC"][row.item_id][0]])
        assert np.allclose(row.s1, [1 - (v - 1) / 2 for v in want[RC, "AB_AC"][row.item_id][0]])
        s0 = [round(v, 9) for v in row.s0]
        assert row.r0 == [1 + sum(x > v or (x == v and q < k) for q, x in enumerate(s0)) for k, v in enumerate(s0)]


def test_ordinal_ranks_of_a_thousand_classes(spark):
    rnd = random.Random(3)
    scores = [[rnd.choice([None, .1, .2, .3, .4, -0.0, 0.0]) for _ in range(1000)] for _ in range(3)]
    df = spark.createDataFrame([(s,) for s in scores], "s array<double>").select("s", ordinal_rank_desc(F.col("s")).alias("r"))
    for s, r in df.collect():
        order = sorted((k for k in range(1000) if s[k] is not None), key=lambda k: (-s[k], k))
        want = [None] * 1000
        for place, k in enumerate(order):
            want[k] = place + 1.0
        assert r == want


# ------------------------------------------------------------- votes

@pytest.mark.parametrize("n_voters,n_labels", [(15, 4), (70, 3)])
def test_votes_of_many_voters(spark, n_voters, n_labels):
    rnd = random.Random(n_voters)
    rows = [(i, rnd.randrange(n_labels), *[rnd.choice([None, *range(n_labels)]) for _ in range(n_voters)]) for i in range(40)]
    wide = spark.createDataFrame(rows, "item_id long, label int, " + ", ".join(f"p{i} int" for i in range(n_voters)))
    subsets = vote.vote_subsets(n_voters) if n_voters < 20 else [tuple(range(0, n_voters, k)) for k in range(1, 9)]

    def by_hand(row, members):
        n = Counter(row[2 + m] for m in members if row[2 + m] is not None)
        return min((k for k, c in n.items() if c == max(n.values())), default=0)

    acc = {r.combo: (r.correct, r.total) for r in vote.subset_accuracy(
        wide, n_voters, n_labels, subsets, [f"m{i}" for i in range(n_voters)]).collect()}
    assert len(acc) == len(subsets)
    for j in [*range(0, len(subsets), 997), len(subsets) - 1]:
        assert acc[j] == (sum(by_hand(r, subsets[j]) == r[1] for r in rows), 40)
    got = {r.item_id: r.vote for r in vote.majority_vote(wide, n_voters, n_labels).collect()}
    assert got == {r[0]: by_hand(r, range(n_voters)) for r in rows}
    assert "Generate" not in _plan(vote.subset_accuracy(wide, n_voters, n_labels, subsets[:3], list("x" * n_voters)))


# ------------------------------------------------------------- whole vectors

def _xi(a, b):
    """xi of B given A by sorting, as the definition has it."""
    n = len(a)
    order = sorted(range(n), key=lambda p: (a[p], p))
    bs = [b[p] for p in order]
    rank = {t: r + 1 for r, t in enumerate(sorted(range(n), key=lambda t: (bs[t], t)))}
    return 3 * sum(abs(rank[t + 1] - rank[t]) for t in range(n - 1)) / (n * n - 1)


@pytest.mark.parametrize("levels", [1, 2, 5, 40, 10 ** 6])
def test_curves_of_whole_vectors(spark, levels):
    """Strengths from tie groups equal those from sorting every pair."""
    rnd = random.Random(levels)
    names = ["rank", "b.c", "x y", "const"]            # names that are no good column names
    vectors = {m: [rnd.randrange(levels) if k else rnd.randrange(3) for _ in range(61)] for k, m in enumerate(names[:3])}
    vectors["const"] = [4] * 61
    long = spark.createDataFrame([(i, m, float(x)) for m, v in vectors.items() for i, x in enumerate(v)],
                                 "item_id long, model string, score double")
    cd, xi = R.vector_strengths(long, names)
    curve = {}
    for m, v in vectors.items():
        lo, hi = min(v), max(v)
        curve[m] = [(x - lo) / (hi - lo) for x in sorted(v, reverse=True)] if hi > lo else None
    for m in names:
        others = [o for o in names if o != m and curve[o] and curve[m]]
        want = [math.sqrt(sum((x - y) ** 2 for x, y in zip(curve[m], curve[o])) / 61) for o in others]
        assert (cd[m] is None and not want) or cd[m] == pytest.approx(sum(want) / len(want))
        flat = {o: curve[o] or [0.0] * 61 for o in names}
        assert xi[m] == pytest.approx(sum(_xi(flat[o], flat[m]) for o in names if o != m) / 3)


def test_one_model_and_no_rows(spark):
    long = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0)], "item_id long, model string, score double")
    assert R.vector_strengths(long, ["a"]) == ({"a": None}, {"a": None})
    assert R.vector_strengths(long.limit(0), ["a", "b"]) == ({"a": None, "b": None}, {"a": None, "b": None})


def test_specs_of_unsorted_members(spark):
    assert [s.model for s in lattice.Lattice([(SC, FusedSpec("x", (2, 0), "AC"))], ("AC",)).walks[0][2]] == [0, 2]
