"""Repeated passages: compressed FM-indexes of shards, searched backward.

A window is ``window`` consecutive words of one document.  A document loses
every word that is covered by a window whose words also start in a document
with a smaller id.

* Seeds.  Every window has a seed, the least hash among its five-word pieces, so
  equal windows have equal seeds.  Neighbouring windows of one seed make a
  passage (at most ``2 * window - 5`` words).  Seeds that only one document has
  can't lie in a repeated window; the others say which passages go on.
* Shards.  Equal passages collapse to one with its least and greatest document,
  and all passages of a seed go to one shard, a run of seeds of about
  ``SHARD_WORDS`` words.  A seed with more words than ``HOT_WORDS`` (a very common
  phrase in ever new surroundings) is dealt anew by whole windows first.
* Search.  A shard's passages become an FM-index (``fm_index``: the
  Burrows-Wheeler transform in a wavelet tree); then they are streamed through
  it, backward search giving the matching statistics up to the window length:
  for every window the range of its occurrences, and so the least document that
  has it.
* Windows whose least document is smaller than their own are marked, and each
  document's marks join its text again.

Words are told apart by their bytes, windows by their words; hashes only route.
A null or empty text has no words.  A row without an id neither takes words from
others nor loses any (no id is smaller or greater).  Rows of one id don't take
words from each other; repeated rows repeat.  An empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmix.llm.common import removed, session_setting, slices, string_buffers, written
from rankmix.llm.fm_index import FMIndex
from rankmix.llm.pretoken import mix64
from rankmix.llm.words import IS_SPACE, word_hashes, word_spans

WINDOW = 13
SEED_WORDS = 5
CHUNK_BYTES = 1 << 20
SHARD_WORDS = 400_000
HOT_WORDS = 100_000
FACTORS = np.random.default_rng(11).integers(0, 1 << 63, SEED_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _kind(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()


# ------------------------------------------------------------- seeds

def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    out, done = h, 1
    while done < width:
        by = min(done, width - done)
        out = np.minimum(out[:-by], out[by:])
        done += by
    return out


def passages_of(raw: np.ndarray, offsets: np.ndarray, window: int):
    """Cut texts into passages: (text, first word, windows, seed) of each."""
    starts, ends, per = word_spans(raw, offsets)
    none = np.empty(0, np.int64)
    if len(starts) < window:
        return none, none, none, none
    h = word_hashes(raw, starts, ends, lower=False)
    n = len(h) - SEED_WORDS + 1
    piece = np.zeros(n, np.uint64)
    for j in range(SEED_WORDS):
        piece += h[j:n + j] * FACTORS[j]
    seed = _sliding_min(mix64(piece), window - SEED_WORDS + 1).view(np.int64)
    bounds = np.cumsum(per) - per
    text = np.repeat(np.arange(len(per)), per)[:len(seed)]
    place = np.arange(len(seed)) - bounds[text]
    at = np.flatnonzero(place + window <= per[text])            # windows inside one text
    if not len(at):
        return none, none, none, none
    seed, text, place = seed[at], text[at], place[at]
    new = np.ones(len(at), bool)
    new[1:] = (seed[1:] != seed[:-1]) | (text[1:] != text[:-1])
    run = np.flatnonzero(new)
    new |= (np.arange(len(at)) - run[np.cumsum(new) - 1]) % (window - SEED_WORDS + 1) == 0
    first = np.flatnonzero(new)
    return text[first], place[first], np.diff(np.append(first, len(at))), seed[first]


def _seeds(docs: DataFrame, window: int) -> DataFrame:
    """``(id, th, seed, start, n)`` of every passage."""
    def run(batches):
        for b in batches:
            raw, off = string_buffers(b.column(2))
            for a, z in slices(np.diff(off), CHUNK_BYTES):
                text, start, n, seed = passages_of(raw[off[a]:off[z]], off[a:z + 1] - off[a], window)
                of = pa.array(text + a)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(of), b.column(1).take(of), pa.array(seed, pa.int64()),
                     pa.array(start, pa.int32()), pa.array(n, pa.int32())], names=["id", "th", "seed", "start", "n"])

    return docs.filter("id is not null").mapInArrow(run, f"id {_kind(docs, 'id')}, th long, seed long, start int, n int")


# ------------------------------------------------------------- passages

def _word_cuts(raw, offsets):
    """Texts with every white space a blank, word bounds and the first word of each text."""
    starts, ends, per = word_spans(raw, offsets)
    return np.where(IS_SPACE[raw], 32, raw).astype(np.uint8), starts, ends, np.cumsum(per) - per


def _joined(raw, starts, ends, first, count) -> list[bytes]:
    """``count`` words from word ``first`` on, joined by one blank."""
    out = []
    whole = raw.tobytes()
    gap = np.ones(len(starts), np.int64)
    gap[:-1] = starts[1:] - ends[:-1]
    wide = np.concatenate([[0], np.cumsum(gap > 1)])
    for i, k in zip(first.tolist(), count.tolist()):
        part = whole[starts[i]:ends[i + k - 1]]
        out.append(part if wide[i + k - 1] == wide[i] else b" ".join(part.split()))
    return out


def _extract(rows: DataFrame, window: int) -> DataFrame:
    """``(digest, seed, id, th, start, n, words)`` of the passages listed with
    each text (``rows``: id, th, text, list)."""
    def run(batches):
        for b in batches:
            raw, off = string_buffers(b.column(2))
            lists = b.column(3)
            at, items = np.asarray(lists.offsets), lists.values
            start, n = (np.asarray(items.field(k)) for k in ("start", "n"))
            seed = items.field("seed")
            for a, z in slices(np.diff(off), CHUNK_BYTES):
                clean, ws, we, first = _word_cuts(raw[off[a]:off[z]], off[a:z + 1] - off[a])
                i = np.arange(at[a], at[z])
                of = np.repeat(np.arange(z - a), np.diff(at[a:z + 1]))
                words = _joined(clean, ws, we, first[of] + start[i], n[i] + window - 1)
                of = pa.array(of + a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([xxhash.xxh3_128_digest(w) for w in words], pa.binary()), seed.slice(at[a], len(i)),
                     b.column(0).take(of), b.column(1).take(of), pa.array(start[i], pa.int32()), pa.array(n[i], pa.int32()),
                     pa.array(words, pa.binary())], names=["digest", "seed", "id", "th", "start", "n", "words"])

    return rows.mapInArrow(run, f"digest binary, seed long, id {_kind(rows, 'id')}, th long, start int, n int, words binary")


def _single_windows(passages: DataFrame, window: int) -> DataFrame:
    """The same windows, each as a passage of its own with a seed of its own."""
    def run(batches):
        for b in batches:
            of, start, words = [], [], []
            for i, (s, n, text) in enumerate(zip(b.column(4).to_pylist(), b.column(5).to_pylist(), b.column(6).to_pylist())):
                parts = text.split(b" ")
                for j in range(n):
                    of.append(i)
                    start.append(s + j)
                    words.append(b" ".join(parts[j:j + window]))
            digest = [xxhash.xxh3_128_digest(w) for w in words]
            seed = np.frombuffer(b"".join(digest), np.int64)[::2]
            take = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(digest, pa.binary()), pa.array(seed, pa.int64()), b.column(2).take(take), b.column(3).take(take),
                 pa.array(start, pa.int32()), pa.array(np.ones(len(of), np.int32)), pa.array(words, pa.binary())],
                names=b.schema.names)

    return passages.mapInArrow(run, passages.schema)


# ------------------------------------------------------------- shards

def _values(col: pa.Array) -> np.ndarray:
    """Ids as an array that keeps their order."""
    if pa.types.is_integer(col.type):
        return col.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.array(col.to_pylist(), object)


def search_shard(rows: pa.Table, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Least document of every window of these passages, and the windows of
    each passage."""
    raw, off = string_buffers(rows.column("words").combine_chunks().cast(pa.large_binary()).cast(pa.large_string()))
    starts, ends, per = word_spans(raw, off)
    plain = raw[~IS_SPACE[raw]]
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts),
        [None, pa.py_buffer(np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)), pa.py_buffer(plain)])
    coded = words.dictionary_encode()
    symbols = coded.indices.to_numpy().astype(np.int64)
    index = FMIndex(symbols, per, len(coded.dictionary), window)
    low, high = index.windows(symbols, per)
    return index.least(_values(rows.column("lo").combine_chunks()), low, high), per - window + 1


def _shards(batches, window: int):
    """Tables of about SHARD_WORDS words from rows that come by seed: one ends
    where a seed ends."""
    held, words, last = [], 0, None
    for b in batches:
        if not len(b):
            continue
        seed = b.column(1).to_numpy()
        size = np.cumsum(b.column(4).to_numpy().astype(np.int64) + window)
        before = np.concatenate([[0], size[:-1]])
        new = np.flatnonzero(np.concatenate([[seed[0] != last], seed[1:] != seed[:-1]]))
        at = begun = 0
        while (k := int(np.searchsorted(before[new], SHARD_WORDS - words + begun))) < len(new):
            j = int(new[k])
            held.append(b.slice(at, j - at))
            yield pa.Table.from_batches(held)
            held, words, at, begun = [], 0, j, int(before[j])
        held.append(b.slice(at))
        words, last = words + int(size[-1]) - begun, seed[-1]
    if held:
        yield pa.Table.from_batches(held)


def _search(distinct: DataFrame, window: int) -> DataFrame:
    """``(digest, least)`` of passages with a window of which some document
    that has the passage is not the first; ``least`` by window."""
    kind = _kind(distinct, "lo")

    def answer(rows: pa.Table):
        least, per = search_shard(rows, window)
        cut = np.concatenate([[0], np.cumsum(per)])
        late = least < np.repeat(_values(rows.column("hi").combine_chunks()), per)
        hit = np.add.reduceat(late.astype(np.int64), cut[:-1]) > 0
        of = np.flatnonzero(hit)
        flat = np.concatenate([np.arange(cut[i], cut[i + 1]) for i in of.tolist()]) if len(of) else np.empty(0, np.int64)
        values = pa.array(least[flat], rows.schema.field("lo").type)
        offsets = np.concatenate([[0], np.cumsum(per[of])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [rows.column("digest").combine_chunks().take(pa.array(of)),
             pa.ListArray.from_arrays(pa.array(offsets), values)], names=["digest", "least"])

    def run(batches):
        for shard in _shards(batches, window):
            yield from answer(shard)

    rows = distinct.select("digest", "seed", "lo", "hi", "n", "words").repartition("seed").sortWithinPartitions("seed")
    return rows.mapInArrow(run, f"digest binary, least array<{kind}>")


def _collapsed(passages: DataFrame) -> DataFrame:
    return passages.groupBy("digest").agg(
        F.first("seed").alias("seed"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.first("n").alias("n"),
        F.first("words").alias("words"))


def _dealt_anew(passages: DataFrame, distinct: DataFrame, hot: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Both tables with the passages of hot seeds cut into single windows,
    whose seeds are hashes of all their words."""
    single = written(_single_windows(passages.join(hot, "seed", "left_semi").select(passages.columns), window),
                     "substring-windows")
    cold, few = (t.join(hot, "seed", "left_anti").select(t.columns) for t in (passages, distinct))
    both = written(cold.union(single), "substring-passages"), written(
        few.union(_collapsed(single).select(few.columns)), "substring-distinct")
    removed(single, passages, distinct)
    return both


# ------------------------------------------------------------- the operator

def _cover(rows: DataFrame, window: int) -> DataFrame:
    """``(id, n_words, n_removed, removed, kept_text)`` of the rows ``(id,
    text, marks)``; ``marks`` has (start, bits) of passages with bit i for a
    window that begins i words after the start."""
    def run(batches):
        for b in batches:
            raw, off = string_buffers(b.column(1))
            marks = b.column(2)
            sizes = np.diff(np.asarray(marks.offsets))
            if marks.null_count:
                sizes = np.where(np.asarray(marks.is_null()), 0, sizes)
            at = np.asarray(marks.offsets)
            start, bits = (np.asarray(marks.values.field(k)) for k in ("start", "bits"))
            for a, z in slices(np.diff(off), CHUNK_BYTES):
                clean, ws, we, first = _word_cuts(raw[off[a]:off[z]], off[a:z + 1] - off[a])
                n = len(ws)
                per = np.diff(np.append(first, n))
                of = np.repeat(np.arange(z - a), sizes[a:z])
                i = np.concatenate([np.arange(at[t], at[t] + sizes[t]) for t in range(a, z) if sizes[t]] or [at[:0]])
                edge = np.zeros(n + 1, np.int64)
                for w in range(int(bits[i].max(initial=0)).bit_length()):
                    on = (bits[i] >> w) & 1 == 1
                    s = first[of[on]] + start[i[on]] + w
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + window, -1)
                keep = np.cumsum(edge[:-1]) == 0
                text_of = np.repeat(np.arange(z - a), per)
                yield _kept(b, a, z, clean, ws, we, per, text_of, keep)

    kind = _kind(rows, "id")
    return rows.mapInArrow(run, f"id {kind}, n_words long, n_removed long, "
                                "removed array<struct<start:int,length:int>>, kept_text string")


def _kept(b, a, z, clean, ws, we, per, text_of, keep) -> pa.RecordBatch:
    """Kept words with one blank between them, and the removed runs of words."""
    n, texts = len(ws), z - a
    use = np.zeros(len(clean) + 1, np.int8)
    np.add.at(use, ws[keep], 1)
    np.add.at(use, we[keep], -1)
    mask = np.cumsum(use[:-1]) > 0
    kept = np.flatnonzero(keep)
    more = kept[:-1][text_of[kept[1:]] == text_of[kept[:-1]]] if len(kept) else kept
    mask[we[more]] = True                                # the white space after a word stands for the blank
    data = clean[mask]
    size = np.bincount(text_of[keep], weights=(we - ws)[keep], minlength=texts).astype(np.int64)
    size += np.bincount(text_of[more], minlength=texts)
    text_at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    kept_text = pa.LargeStringArray.from_buffers(texts, pa.py_buffer(text_at), pa.py_buffer(np.ascontiguousarray(data)))
    gone = ~keep
    begins = gone.copy()
    if n:
        begins[1:] &= keep[:-1] | (text_of[1:] != text_of[:-1])
    stops = gone.copy()
    if n:
        stops[:-1] &= keep[1:] | (text_of[1:] != text_of[:-1])
    s, e = np.flatnonzero(begins), np.flatnonzero(stops)
    first = np.cumsum(per) - per
    runs = pa.StructArray.from_arrays([pa.array(s - first[text_of[s]], pa.int32()), pa.array(e - s + 1, pa.int32())],
                                      names=["start", "length"])
    run_at = np.concatenate([[0], np.cumsum(np.bincount(text_of[s], minlength=texts))]).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [b.column(0).slice(a, texts), pa.array(per, pa.int64()),
         pa.array(np.bincount(text_of[gone], minlength=texts), pa.int64()),
         pa.ListArray.from_arrays(pa.array(run_at), runs), kept_text.cast(pa.string())],
        names=["id", "n_words", "n_removed", "removed", "kept_text"])


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_removed, removed, kept_text)`` of every row:
    ``removed`` lists the runs of words (start, length) that go, ``kept_text``
    has the others joined by one blank."""
    if not SEED_WORDS <= window <= SEED_WORDS + 61:
        raise ValueError(f"windows of {SEED_WORDS} to {SEED_WORDS + 61} words")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    seeds = written(_seeds(rows, window), "substring-seeds")
    shared = seeds.groupBy("seed").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("seed")
    # no sort of the seeds where a shuffled part of the shared ones is seen to be small
    with session_setting(rows.sparkSession, "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m"):
        lists = written(seeds.join(shared, "seed", "left_semi").groupBy("id", "th").agg(
            F.collect_set(F.struct("start", "n", "seed")).alias("list")), "substring-lists")
    removed(seeds)
    passages = written(_extract(rows.join(lists, ["id", "th"]).select("id", "th", "text", "list"), window), "substring-passages")
    removed(lists)
    distinct = written(_collapsed(passages), "substring-distinct")
    words = distinct.groupBy("seed").agg(F.sum(F.col("n") + window).alias("w"))
    hot = written(words.filter(F.col("w") > HOT_WORDS).select("seed"), "substring-hot")
    if not hot.isEmpty():
        passages, distinct = _dealt_anew(passages, distinct, hot, window)
    found = written(_search(distinct, window), "substring-found")
    removed(distinct, hot)
    powers = F.array(*[F.lit(1 << i).cast("long") for i in range(window - SEED_WORDS + 1)])
    late = F.transform("least", lambda v, i: F.when(v < F.col("id"), F.get(powers, i)).otherwise(F.lit(0).cast("long")))
    bits = F.aggregate(late, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))
    marks = written(passages.select("digest", "id", "th", "start").join(found, "digest")
                    .select("id", "th", "start", bits.alias("bits")).filter("bits != 0")
                    .groupBy("id", "th").agg(F.collect_set(F.struct("start", "bits")).alias("marks")), "substring-marks")
    removed(passages, found)
    out = _cover(rows.join(marks, ["id", "th"], "left").select("id", "text", "marks"), window)
    return out.withColumnRenamed("id", id_col)
