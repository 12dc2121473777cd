"""Words that cancel out in a polynomial hash: two letters in the order of the
Thue-Morse sequence, and the same with the letters exchanged."""

import numpy as np
import pytest
import zlib
from llm_rows import byte_bpe, make, word_bpe  # noqa: F401
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rankmix.llm import near_dedup, packing, quality, token_counts, token_files
from rankmix.llm.pretoken import span_hashes


def _pair(a, b, power):
    word = a
    for _ in range(power):
        word += word.translate(str.maketrans(a + b, b + a))
    return word, word.translate(str.maketrans(a + b, b + a))


PAIRS = [_pair("a", "d", 11), _pair("a", "x", 10), _pair("e", "t", 12)]


@pytest.mark.parametrize("power", [6, 10, 14])
def test_spans(power):
    one, two = _pair("a", "d", power)
    values = np.frombuffer((one + two).encode("utf-32-le"), np.uint32)
    n = len(one)
    h = span_hashes(values, np.array([0, n]), np.array([n, 2 * n]))
    assert h[0] != h[1]
    # a span's hash does not depend on what lies around it
    alone = span_hashes(values[n:], np.array([0]), np.array([n]))
    gap = span_hashes(np.concatenate([values[:3], values[n:]]), np.array([1, 3]), np.array([2, n + 3]))
    assert alone[0] == h[1] == gap[1]


@pytest.fixture
def frame(spark):
    words = [w for p in PAIRS for w in p]
    return make(spark, [(i, w, "en", "src0", 0) for i, w in enumerate(words)]), words


def test_token_counts_and_ids(spark, frame, byte_bpe, word_bpe, tmp_path):
    df, words = frame
    lib = Tokenizer.from_file(byte_bpe)
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(df, byte_bpe, limit=512).collect()}
    assert got == {i: len(lib.encode(w, add_special_tokens=False).ids) for i, w in enumerate(words)}
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    pieces = {(r.doc_id, r.start): r.ids_crc32 for r in packing.pack_documents(df, byte_bpe, end_id=2, capacity=1024).collect()}
    for i, w in enumerate(words):
        ids = lib.encode(w, add_special_tokens=False).ids + [2]
        assert all(crc(ids[s:e]) == pieces[i, s] for s, e in _cuts([s for k, s in pieces if k == i], len(ids)))
    lib = Tokenizer.from_file(word_bpe)
    token_files.write_token_files(df, str(tmp_path / "t"), word_bpe, end_id=1)
    for r in token_files.read_documents(spark, str(tmp_path / "t")).collect():
        assert r.ids_crc32 == crc(lib.encode(words[r.doc_id], add_special_tokens=False).ids + [1])


def _cuts(starts, n):
    starts = sorted(starts)
    return list(zip(starts, starts[1:] + [n]))


def test_components_and_repeats(spark, frame):
    df, words = frame
    assert all(r.component_id == r.doc_id for r in near_dedup.near_duplicates(df).collect())
    lines = make(spark, [(i, f"{a} {b}\n{b} {a}\n{a}\n{b}", "en", "src0", 0) for i, (a, b) in enumerate(PAIRS)])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(3)], "doc_id long, quality int, toxic int")
    rows = quality.quality_rules(lines, labels, alpha=0.05, delta=0.05).collect()
    assert len(rows) == 3 and all(r.n_dup_lines == 0 and r.n_repeat_words == 0 for r in rows)
    assert df.select(F.countDistinct("text")).first()[0] == len(words)
