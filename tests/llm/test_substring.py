"""Repeated passages: the FM-index and the operator against brute force."""

import random

import brute
import numpy as np
import pytest
from llm_rows import awkward, awkward_rows, byte_bpe, empty, make, word_bpe  # noqa: F401

from rankmix.llm import fm_index, substring_dedup

SF = "/root/testdata/sf0.001"


def _counts(words, lengths, w):
    cut = np.concatenate([[0], np.cumsum(lengths)])
    return [tuple(words[cut[i] + j:cut[i] + j + w]) for i in range(len(lengths)) for j in range(lengths[i] - w + 1)]


@pytest.mark.parametrize("n_symbols,passages,w", [(3, 40, 4), (20, 200, 5), (2, 30, 13), (500, 300, 3), (1, 5, 2), (7, 1, 6)])
def test_backward_search_counts_every_window(n_symbols, passages, w):
    rng = np.random.default_rng(n_symbols)
    lengths = rng.integers(w, w + 9, passages)
    words = rng.integers(0, n_symbols, lengths.sum())
    index = fm_index.FMIndex(words, lengths, n_symbols, w)
    windows = _counts(words, lengths, w)
    low, high = index.windows(words, lengths)
    assert [windows.count(x) for x in windows] == (high - low).tolist()
    values = rng.permutation(passages)
    of = np.repeat(np.arange(passages), lengths - w + 1)
    least = {}
    for x, i in zip(windows, of):
        least[x] = min(least.get(x, passages), values[i])
    assert [least[x] for x in windows] == index.least(values, low, high).tolist()
    # texts that the index has not seen
    other = rng.integers(0, n_symbols, 40 * (w + 3))
    low, high = index.windows(other, np.full(40, w + 3))
    assert [windows.count(x) for x in _counts(other, np.full(40, w + 3), w)] == (high - low).tolist()


def test_wavelet_tree_is_as_small_as_the_entropy():
    rng = np.random.default_rng(5)
    seq = rng.zipf(1.5, 50_000) % 1000
    tree = fm_index.WaveletTree(seq, 1000)
    freq = np.bincount(seq) / len(seq)
    entropy = -(freq[freq > 0] * np.log2(freq[freq > 0])).sum()
    assert tree.size_in_bits() / len(seq) < entropy + 1.1
    at, sym = rng.integers(0, len(seq) + 1, 300), rng.choice(seq, 300)
    assert tree.rank(sym, at).tolist() == [int(np.count_nonzero(seq[:a] == c)) for a, c in zip(at, sym)]


def _check(spark, rows, window):
    df = make(spark, [(i, t, "en", "s", 1) for i, t in rows])
    out = substring_dedup.substring_dedup(df, window=window).collect()
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(brute.substrings(rows, window), key=key)
    for r in out:
        assert sum(x.length for x in r.removed) == r.n_removed


@pytest.fixture(scope="module")
def shared_passages():
    rnd = random.Random(4)
    vocab = ["a", "b", "the", "of", "É", "日本", "word", "x1", "sea", "sky"]
    text = lambda n: rnd.choice([" ", "\n", " \t "]).join(rnd.choice(vocab) for _ in range(n))
    passages = [text(rnd.randint(4, 40)) for _ in range(8)]
    rows = [(i, " ".join(rnd.choice(passages) if rnd.random() < .4 else text(rnd.randint(1, 12)) for _ in range(rnd.randint(0, 7))))
            for i in range(60)]
    return rows + [(70, "a " * 200), (71, "a " * 90 + "b " * 30), (72, "a b " * 60), (7, rows[7][1]), (8, rows[9][1])]


@pytest.mark.parametrize("window", [13, 6])
def test_against_brute_force(spark, shared_passages, window):
    _check(spark, shared_passages, window)


def test_hot_seeds_and_small_shards(spark, shared_passages, monkeypatch):
    """Seeds with many words are dealt anew, shards end within a task."""
    monkeypatch.setattr(substring_dedup, "HOT_WORDS", 60)
    _check(spark, shared_passages, 13)


def test_shards_end_where_a_seed_ends(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 50)
    rng = np.random.default_rng(3)
    seed = np.sort(rng.integers(0, 30, 400))
    names = ["digest", "seed", "lo", "hi", "n", "words"]
    rows = pa.table([np.arange(400), seed, seed, seed, rng.integers(1, 9, 400).astype(np.int32), seed], names=names)
    parts = list(substring_dedup._shards(rows.to_batches(max_chunksize=23), 13))
    assert pa.concat_tables(parts).column("digest").to_pylist() == list(range(400))
    seen = [set(p.column("seed").to_pylist()) for p in parts]
    assert len(parts) > 5 and all(not a & b for a, b in zip(seen, seen[1:]))


def test_documents_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    _check(spark, rows, 13)


def test_awkward_and_empty(spark, awkward, awkward_rows, empty):
    got = substring_dedup.substring_dedup(awkward).collect()
    want = brute.substrings([r[:2] for r in awkward_rows], 13)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in got) == sorted(
        (str(i), *rest) for i, *rest in want)
    assert substring_dedup.substring_dedup(empty).collect() == []
    texts = [("b", "x " * 20), ("a", "x " * 14), (None, "x " * 14)]
    rows = spark.createDataFrame(texts, "doc_id string, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(rows).collect()} == {"a": 0, "b": 20, None: 0}
