"""Token counts, packing and token files against the tokenizers library."""

import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_rows import awkward, awkward_rows, byte_bpe, empty, make, word_bpe  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rankmix.llm import packing, pretoken, rangecoder, token_counts, token_files
from rankmix.llm.pretoken import CachedTokenizer


@pytest.mark.parametrize("name", ["byte_bpe", "word_bpe"])
def test_cached_ids_equal_the_library(name, request):
    path = request.getfixturevalue(name)
    tok, lib = CachedTokenizer(path, max_entries=3000), Tokenizer.from_file(path)
    assert tok.kind == name[:4]
    rnd = random.Random(1)
    bits = ([chr(i) for i in range(0x300)] + list(" '' \n\n\tstmdrevl sl aZ09.,!") * 12
            + ["é", "日", "́", "<|endoftext|>", "  ", "'ll", "'re", "'s"])
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40))) for _ in range(4000)] + ["", "a b\n c " * 90_000]
    ids, n = tok.encode(texts)
    pos = 0
    for t, m in zip(texts, n):
        assert ids[pos:pos + m].tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)[:200]
        pos += m
    assert (tok.count(texts) == n).all()
    assert tok.cache.n <= 3000 + pretoken.CHUNK_CHARS        # started anew when full


def _library(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def test_token_counts(awkward, awkward_rows, empty, byte_bpe):
    got = Counter(tuple(r) for r in token_counts.token_counts(awkward, byte_bpe, limit=5).collect())
    lib = Tokenizer.from_file(byte_bpe)
    want = Counter()
    for i, t, *_ in awkward_rows:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 5] += 1
    assert got == want
    assert token_counts.token_counts(empty, byte_bpe).collect() == []
    few = token_counts.token_counts(awkward, byte_bpe, limit=5, table_size=3).collect()
    assert Counter(tuple(r) for r in few) == want


def test_token_counts_with_an_unknown_splitting_rule(awkward, byte_bpe, tmp_path):
    lib = Tokenizer.from_file(byte_bpe)
    from tokenizers import pre_tokenizers
    lib.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    lib.save(str(tmp_path / "t.json"))
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(awkward, str(tmp_path / "t.json")).collect()}
    assert got[4] == len(lib.encode("One and the same text, twice over.\nWith two lines.").ids)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_local_search_packs_everything(lengths):
    start, end = packing.best_fit(lengths, 40), packing.pack_lengths(lengths, 40)
    assert sorted(i for b in end for i in b) == list(range(len(lengths)))
    fill = lambda bins: [sum(lengths[i] for i in b) for b in bins]
    assert max(fill(end), default=0) <= 40 and len(end) <= len(start)
    assert sum(f * f for f in fill(end)) >= sum(f * f for f in fill(start))


def test_local_search_beats_best_fit():
    rng = np.random.default_rng(0)
    lengths = rng.integers(200, 600, 4000)
    assert len(packing.pack_lengths(lengths, 1024)) < len(packing.best_fit(lengths, 1024))


def _check_packing(rows, texts, path, capacity):
    lib, by_doc, bins = Tokenizer.from_file(path), {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= capacity
    for i, copies in texts.items():
        ids = lib.encode(copies[0] or "", add_special_tokens=False).ids + [2]
        assert len(by_doc[i]) == len(copies) * (1 if len(ids) <= capacity else -(-len(ids) // capacity))
        for r in by_doc[i]:
            own = ids[r.start:r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
            assert r.length == capacity or r.piece == 0
    return len(bins)


def test_packing_awkward(awkward, awkward_rows, empty, byte_bpe):
    texts = {}
    for i, t, *_ in awkward_rows:
        if i is not None:
            texts.setdefault(i, []).append(t)
    rows = packing.pack_documents(awkward, byte_bpe, capacity=16, group_size=5).collect()
    _check_packing(rows, texts, byte_bpe, 16)
    assert sum(r.doc_id is None for r in rows) >= 2
    assert packing.pack_documents(empty, byte_bpe).collect() == []


def test_packed_sequences_hold_the_ids(spark, byte_bpe):
    rows = [(i, "word " * (i % 40), "en", "s", 0) for i in range(200)]
    frame = make(spark, rows)
    seqs = packing.sequences(frame, byte_bpe, capacity=64).collect()
    assert all(len(s.ids) == s.n_tokens <= 64 for s in seqs)
    lib = Tokenizer.from_file(byte_bpe)
    want = Counter()
    for _, t, *_ in rows:
        want.update(lib.encode(t, add_special_tokens=False).ids + [2])
    assert Counter(x for s in seqs for x in s.ids) == want
    bound = -(-sum(want.values()) // 64)
    assert len(seqs) <= bound + 1


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.integers(0, 65535), max_size=600), max_size=4), st.integers(0, 3))
def test_range_coder_round_trip(seqs, shift):
    seqs = [np.array([x >> (4 * shift) for x in s] * 3, np.uint32) for s in seqs]
    back = rangecoder.decode_frames(rangecoder.encode_frames(seqs))
    assert len(back) == len(seqs) and all((a == b).all() and len(a) == len(b) for a, b in zip(seqs, back))


def test_range_coder_blocks():
    rng = np.random.default_rng(2)
    seqs = [rng.integers(0, 65536, 20_000).astype(np.uint32), np.zeros(9000, np.uint32),
            np.tile(np.arange(50, dtype=np.uint32), 500), rng.zipf(1.3, 30_000).clip(0, 65535).astype(np.uint32)]
    frames = rangecoder.encode_frames(seqs)
    assert all((a == b).all() for a, b in zip(seqs, rangecoder.decode_frames(frames)))
    bits = [8 * len(f) / len(s) for f, s in zip(frames, seqs)]
    assert bits[0] < 16.3 and bits[1] < 0.2 and bits[2] < 0.5 and bits[3] < 9
    wide = [rng.integers(0, 1 << 20, 9000).astype(np.uint32)]
    assert (rangecoder.decode_frames(rangecoder.encode_frames(wide, 20))[0] == wide[0]).all()
    with pytest.raises(ValueError):
        rangecoder.encode_frames(wide, 16)
    broken = bytearray(frames[0])
    broken[-4000] ^= 1
    with pytest.raises(ValueError):
        rangecoder.decode_frames([bytes(broken)])


def test_token_files(spark, awkward, awkward_rows, empty, word_bpe, tmp_path, monkeypatch):
    token_files.write_token_files(awkward, f"{tmp_path}/f", word_bpe)
    rows = sorted(token_files.read_documents(spark, f"{tmp_path}/f", with_ids=True).collect(), key=lambda r: r.start)
    lib, pos = Tokenizer.from_file(word_bpe), 0
    order = sorted(awkward_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for r, (i, t, *_) in zip(rows, order, strict=True):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, pos, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        pos += len(ids)
    token_files.write_token_files(empty, f"{tmp_path}/e", word_bpe)
    assert token_files.read_documents(spark, f"{tmp_path}/e").collect() == []


def test_worker_holds_one_stage_table(byte_bpe):
    """A worker that went on to packing kept the language automata until it ended."""
    import gc
    import weakref

    from rankmix.llm import langid
    parser = weakref.ref(langid._parser((("de", b"und das "), ("en", b"and the "))))
    assert parser() is langid._parser((("de", b"und das "), ("en", b"and the ")))
    tok = pretoken.load(byte_bpe, packing.CACHED)
    gc.collect()
    assert parser() is None and tok is pretoken.load(byte_bpe, packing.CACHED)
    assert tok.cache.max_entries == packing.CACHED < pretoken.load(byte_bpe).cache.max_entries


@pytest.mark.parametrize("bits", [16, 24])
def test_range_coder_places(bits):
    """Places in a block's sorted history, by a table and by search."""
    rng = np.random.default_rng(5)
    history = rng.integers(0, 40, (3, 256)).astype(np.uint32)
    window = rng.integers(0, 50, (3, 300)).astype(np.uint32)
    history[1], history[2, :128] = 7, 65535
    window[2, ::3] = 65535
    got = rangecoder._places(history, window, bits)
    for r in range(3):
        ordered = sorted(history[r].tolist())
        for x, p in zip(window[r].tolist(), got[r].tolist()):
            assert p == (ordered.index(x) << 16 | ordered.count(x) if x in ordered else 0)


def test_range_coder_gives_a_word_an_id_at_most():
    """The least and the most likely ids, blocks of unlike lengths: whole words,
    one an id at most besides the state."""
    rng = np.random.default_rng(6)
    rare = np.concatenate([np.tile(np.arange(3, dtype=np.uint32), 2000), rng.integers(0, 65536, 3000).astype(np.uint32)])
    for ids in (rare, rare[::-1].copy(), rng.permutation(65536).astype(np.uint32)[:9001], np.array([65535], np.uint32)):
        frame, = rangecoder.encode_frames([ids])
        n = -(-len(ids) // rangecoder.BLOCK)
        table = np.frombuffer(frame, rangecoder.ENTRY, n, rangecoder.HEAD.size)
        assert (table["bytes"] % 4 == 0).all() and (table["bytes"] <= 8 + 4 * table["ids"]).all()
        assert (rangecoder.decode_frames([frame])[0] == ids).all()


def test_range_coder_models_whole_stretches(monkeypatch):
    """op2: the encoder's array steps grow with the most visits of a slot, not with
    the ids of a block; the decoder still meets every id that the encoder met."""
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 5000, 3 * rangecoder.BLOCK + 700).astype(np.uint32)
    ids[9000:9400] = 7
    steps, predict = [], rangecoder._Model.predict
    monkeypatch.setattr(rangecoder._Model, "predict", lambda self, *a: steps.append(1) or predict(self, *a))
    frame, = rangecoder.encode_frames([ids])
    assert not steps
    assert (rangecoder.decode_frames([frame])[0] == ids).all()
    assert len(steps) == rangecoder.BLOCK


def test_token_files_read_in_few_calls(spark, word_bpe, tmp_path):
    """op2: frames of small files are read together."""
    docs = spark.createDataFrame([(i, f"word {i} of a text") for i in range(40)], "doc_id long, text string")
    for i in range(8):
        part = docs.where(f"doc_id div 5 = {i}")
        token_files._frames(part, word_bpe, 1, 16, "doc_id", "text").withColumn("part", F.lit(i)).write.mode(
            "append").parquet(str(tmp_path / "files"))
    rows = token_files.read_documents(spark, str(tmp_path / "files"), with_ids=True)
    assert "Coalesce" in rows._jdf.queryExecution().executedPlan().toString()
    got = {r.doc_id: r.ids for r in rows.collect()}
    want = pretoken.load(word_bpe)
    for i in range(40):
        assert got[i] == want.encode([f"word {i} of a text"])[0].tolist() + [1]
