"""The trie of conversation prefixes against a tree that is walked."""

import random

import brute
import pytest

from rankmix.llm import conversation_trie as trie

SF = "/root/testdata/sf0.001"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id long, turn long, role string, text string"


def _order(rows):
    return sorted(rows, key=str)


def _nodes(df, shared=True):
    turns = trie.conversation_turns(df)
    out = trie.prefix_trie(trie.shared_heads(turns) if shared else trie.with_starts(turns))
    assert tuple(out.columns) == COLUMNS
    return _order(tuple(r) for r in out.collect())


def _check(spark, rows, shared=True, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema).repartition(3)
    rows = [r[:4] for r in rows]
    assert _nodes(df, shared) == _order(brute.trie(rows) if shared else brute.trie(rows, spread=0))


@pytest.fixture(scope="module")
def conversations():
    rnd = random.Random(9)
    rows = []
    for c in rnd.sample(range(400), 150):
        n = rnd.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 24, 40])
        alike = rnd.random() < .6
        for i in range(n):
            text = rnd.choice(["", "a", "b", "ü"]) if rnd.random() < .3 else f"t{i}"
            rows.append((c, i * rnd.choice([1, 3]) if not alike else i, rnd.choice(["user", "bot"]) if not alike else "user",
                         f"t{i}" if alike and i < 12 else text))
    # the same turn number must not come twice here: equal turns go by their ids, not by their texts
    return list({(c, t): (c, t, r, x) for c, t, r, x in rows}.values())


@pytest.mark.parametrize("shared", [True, False])
def test_against_a_walked_tree(spark, conversations, shared):
    _check(spark, conversations, shared)


def test_stretches_and_pieces(spark, conversations, monkeypatch):
    """Long conversations in many stretches, endings in many pieces."""
    monkeypatch.setattr(trie, "STRETCH", 16)
    monkeypatch.setattr(trie, "PIECE_IDS", 3)
    rows = conversations + [(c, i, "user", f"t{i}") for c in (1000, 1005, 1001) for i in range(130)]
    rows += [(2000 + c, 0, "user", "hello") for c in range(40)]
    _check(spark, rows)


def test_nulls_ties_repeats_and_other_columns(spark):
    rows = [(0, None, None, None), (0, 1, "user", "x"), (1, 1, None, ""), (None, 1, "user", "x"), (5, 0, "user", ""),
            (6, 0, "", "user"), (7, 3, "user", None), (10, 2, "b", "ä"), (10, -1, "a", "z"), (3, 0, "user", "x"), (3, 0, "user", "x")]
    rows = [(*r, 1, "c") for r in rows]
    _check(spark, rows, schema=SCHEMA + ", c int, block string")
    _check(spark, rows, shared=False, schema=SCHEMA + ", c int, block string")
    # the same turns in another order of rows: ties have one result
    tied = [(1, 0, "user", x) for x in "abcab"]
    one, two = (_nodes(spark.createDataFrame(t, SCHEMA), False) for t in (tied, tied[::-1]))
    assert one == two and max(r[1] for r in one) == 5


def test_a_conversation_without_turns_of_its_own(spark):
    # 6 keeps none of its turns and its head's conversation 5 doesn't exist
    rows = [(c, i, "user", f"{c}") for c in (6, 11, 12) for i in range(1)]
    _check(spark, rows)


def test_tables(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    assert _nodes(df) == _order(brute.trie([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]))
    assert _nodes(spark.createDataFrame([], SCHEMA)) == []
