"""Near-duplicates: MinHash signatures, a multi-index Hamming join, exact check.

* Every document gets its set of 5-word shingles and from it a signature of
  symbols of b = 16 bits (bits of as many MinHashes).  Symbols of two documents
  agree with the probability of their sets' similarity.
* Documents with equal sets form a class; one of each joins.
* Signatures are split into chunks.  By the pigeonhole principle two signatures
  that differ in at most 2 * chunks - 1 symbols have a chunk with at most one
  differing symbol.  Enumerating that error -- leaving out each symbol of a chunk
  in turn -- gives as many keys as symbols, and all pairs under the distance share
  one.  ``Shape`` chooses chunks so that even a pair right at the similarity
  shares no key only once in 100,000 (at 0.85: 8 chunks of 6; at 0.8: 9 of 5).
* Within a key's bucket not all pairs are made.  A bucket's first member is the
  one that meets most others in all its buckets, so the middle of a group rather
  than its edge.  Each member is held against it first; pairs that are confirmed
  make components, and only members of *different* components are then paired, so
  thousands of near copies of one text cost few comparisons each.  What is left
  are buckets of texts that resemble each other without being near.  There the
  shingles that no other text of these buckets has are counted, and every
  text's shingles in bins by hash -- exact, and linear in the texts.  A pair is
  made only where sizes, shared shingles and bins leave room for the similarity,
  once, at the first key that it shares.
* Candidates are confirmed on their full shingle sets.

Nulls and texts without words have an empty set and are linked with nothing;
one to four words count as one shingle.  A row without an id is linked by a key
made of its text, like any other; it represents its component only where no row
has an id (one of them is kept then, the component is null).  Rows of one id are one node;
repeated rows repeat.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankmix.llm.common import slices, string_buffers, written
from rankmix.llm.words import window_hashes, word_hashes, word_spans

MAX_SYMBOLS = 50
MISSED = 1e-5
BINS = 256
CHUNK_BYTES = 1 << 20
TILE = 1024
PAIRS = 1 << 20
PERCENT = 85
ROW_KEY = "__near_key"
BROADCAST_IDS = 1_000_000      # ids of at most 16 bytes: 16 MB
_RNG = np.random.default_rng(20240607)
MULT = _RNG.integers(0, 1 << 63, MAX_SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLUS = _RNG.integers(0, 1 << 63, MAX_SYMBOLS, dtype=np.uint64)


@dataclass(frozen=True)
class Shape:
    """How signatures are cut, and the distance beyond which pairs are left."""

    chunk: int          # symbols of a chunk
    chunks: int
    far: int            # a pair at the similarity differs in more symbols once in 10^7 times

    @property
    def symbols(self) -> int:
        return self.chunk * self.chunks

    @staticmethod
    def of(percent: int) -> "Shape":
        """The longest chunks, so the rarest chance keys, that miss few pairs."""
        j = percent / 100
        for chunk in range(8, 1, -1):
            found = j ** chunk + chunk * j ** (chunk - 1) * (1 - j)
            chunks = math.ceil(math.log(MISSED) / math.log(1 - found)) if found < 1 else 1
            if chunk * chunks <= MAX_SYMBOLS:
                n, tail, far = chunk * chunks, 0.0, chunk * chunks
                while far and tail + math.comb(n, far) * (1 - j) ** far * j ** (n - far) <= 1e-7:
                    tail += math.comb(n, far) * (1 - j) ** far * j ** (n - far)
                    far -= 1
                return Shape(chunk, chunks, far)
        raise ValueError(f"no signature of {MAX_SYMBOLS} symbols finds pairs of similarity {percent} %")


# ------------------------------------------------------------- sets and signatures

def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and their numbers."""
    starts, ends, per = word_spans(raw, offsets)
    h, n = window_hashes(word_hashes(raw, starts, ends, lower=True), per)
    bounds = np.concatenate([[0], np.cumsum(n)])
    sets = [np.unique(h[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    return (np.concatenate(sets) if sets else h), np.fromiter(map(len, sets), np.int64, len(sets))


def signatures(h: np.ndarray, n: np.ndarray, symbols: int) -> np.ndarray:
    """(texts with shingles) x symbols of 16 bits."""
    at = (np.cumsum(n) - n)[n > 0]
    out = np.empty((len(at), symbols), np.uint16)
    for i in range(symbols):
        low = np.minimum.reduceat(h * MULT[i] + PLUS[i], at)
        out[:, i] = (low >> np.uint64(17)).astype(np.uint16)
    return out


def _chunks(batch, col):
    raw, off = string_buffers(batch.column(col))
    for a, z in slices(np.diff(off), CHUNK_BYTES):
        yield a, z, *shingle_sets(raw[off[a]:off[z]], off[a:z + 1] - off[a])


def document_signatures(docs: DataFrame, shape: Shape, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n, fp, sig)``: set size, 128-bit fingerprint of the whole set,
    signature; both null for empty sets."""
    def run(batches):
        for b in batches:
            sizes, fps, sigs = [], [], []
            for _, _, h, n in _chunks(b, 1):
                sizes.append(n)
                if h.size:
                    sig = iter(signatures(h, n, shape.symbols))
                cut = np.concatenate([[0], np.cumsum(n)]).tolist()
                for x, y in zip(cut[:-1], cut[1:]):
                    fps.append(hashlib.blake2b(h[x:y].tobytes(), digest_size=16).digest() if y > x else None)
                    sigs.append(next(sig).tobytes() if y > x else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.concatenate(sizes) if sizes else [], pa.int64()),
                 pa.array(fps, pa.binary()), pa.array(sigs, pa.binary())], names=["id", "n", "fp", "sig"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {id_type}, n long, fp binary, sig binary")


# ------------------------------------------------------------- candidates

def _keys(reps: DataFrame, shape: Shape) -> DataFrame:
    """``(key, k, id, n)``: key number ``k`` for each symbol left out of its chunk."""
    return reps.select(F.posexplode(_key_array(shape)).alias("k", "key"), "id", "n")


def _key_array(shape: Shape) -> Column:
    keys = []
    for c in range(shape.chunks):
        for v in range(shape.chunk):
            at = 2 * c * shape.chunk
            rest = F.concat(F.substring("sig", at + 1, 2 * v),
                            F.substring("sig", at + 2 * v + 3, 2 * (shape.chunk - 1 - v)))
            keys.append(F.xxhash64(F.lit(c * shape.chunk + v), rest))
    return F.array(*keys)


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _near_enough(pairs: DataFrame, reps: DataFrame, shape: Shape) -> DataFrame:
    """Pairs whose signatures differ in at most ``shape.far`` symbols."""
    s = reps.select("id", "sig")
    both = (pairs.join(s.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a")
            .join(s.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b"))

    def run(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(-1, shape.symbols) for i in (2, 3))
            close = pa.array(np.count_nonzero(x != y, axis=1) <= shape.far)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(close), b.column(1).filter(close)], names=["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return both.select("a", "b", "sa", "sb").mapInArrow(run, f"a {kind}, b {kind}")


def rows_of(docs: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """Semi or anti join of wide rows on a list of distinct ids: the ids are
    broadcast when a count shows that they are few, else both sides shuffle."""
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, key, how)


def _texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    return rows_of(docs, ids, "id", "left_semi").select("id", "text")


def _sets_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """``(id, s)``: the sorted shingle hashes of the documents with these ids."""
    def sets(batches):
        for b in batches:
            for a, z, h, n in _chunks(b, 1):
                cut = np.concatenate([[0], np.cumsum(n)]).tolist()
                packed = [h[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), pa.array(packed, pa.binary())],
                                                 names=["id", "s"])

    kind = ids.schema["id"].dataType.simpleString()
    return _texts_of(ids, docs).mapInArrow(sets, f"id {kind}, s binary")


def _own_shingles(sets: DataFrame) -> DataFrame:
    """``(id, own)``: how many shingles of each of these documents no other
    one of them has (documents without any are left out).  A shingle that many
    share is counted map-side."""
    def spread(batches):
        for b in batches:
            for key, s in zip(b.column(0), b.column(1)):
                h = np.frombuffer(s.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.repeat(key, len(h))], names=["h", "id"])

    kind = sets.schema["id"].dataType.simpleString()
    rows = sets.select("id", "s").mapInArrow(spread, f"h long, id {kind}")
    one = rows.groupBy("h").agg(F.min("id").alias("id"), F.max("id").alias("last")).filter("id = last")
    return one.groupBy("id").agg(F.count(F.lit(1)).alias("own"))


def _bins(sets: DataFrame) -> DataFrame:
    """``(id, bins)``: a document's shingles counted by hash in BINS bins, as
    16-bit numbers (empty where a count passes what they hold)."""
    def count(batches):
        for b in batches:
            rows = []
            for s in b.column(1):
                n = np.bincount((np.frombuffer(s.as_buffer(), np.uint64) % np.uint64(BINS)).astype(np.int64),
                                minlength=BINS)
                rows.append(n.astype(np.int16).tobytes() if n.max() < 1 << 15 else b"")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=["id", "bins"])

    kind = sets.schema["id"].dataType.simpleString()
    return sets.select("id", "s").mapInArrow(count, f"id {kind}, bins binary")


def _tiles(named: DataFrame) -> DataFrame:
    """Rows of mixed buckets dealt into tiles of pairs: a bucket of more than
    TILE members is cut into T parts by the ids' hashes, and each member goes to
    the T tiles that pair its part with another or itself.  So no task gets more
    than two parts of a bucket at once, however large it is."""
    large = named.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > TILE)
    parts = F.coalesce(F.ceil(F.col("m") / TILE), F.lit(1)).cast("int")
    rows = named.join(large, "key", "left").withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return rows.withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other")})


def _groups(batches, columns: int):
    """Record batches that hold whole tiles, from rows that come by tile; the
    squares of their sizes add up to about PAIRS at most."""
    held, last = [], None
    for b in batches:
        if not len(b):
            continue
        tile = [b.column(i).to_numpy(zero_copy_only=False) for i in range(columns)]
        new = np.zeros(len(b), bool)
        new[0] = last is None or any(t[0] != x for t, x in zip(tile, last))
        for t in tile:
            new[1:] |= t[1:] != t[:-1]
        cuts, last = np.flatnonzero(new), [t[-1] for t in tile]
        if not len(cuts):
            held.append(b)
            continue
        before = held + ([b.slice(0, int(cuts[0]))] if cuts[0] else [])
        if before:
            yield pa.Table.from_batches(before).combine_chunks().to_batches()[0]
        sizes = np.diff(cuts)
        for x, y in slices(sizes * sizes, PAIRS):
            yield b.slice(int(cuts[x]), int(cuts[y] - cuts[x]))
        held = [b.slice(int(cuts[-1]))]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _pairs_by_tile(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of rows within consecutive groups of these sizes."""
    ends = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(len(ends))
    more = ends - at - 1
    a = np.repeat(at, more)
    return a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(more) - more, more)


def _cross_pairs(named: DataFrame, shape: Shape, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of members of one bucket and different components that
    nothing rules out: sizes, shared shingles ``u`` (the intersection has at most
    ``least(u)``), signatures (at most ``shape.far`` symbols differ) and bins (two
    sets share at most the lesser count of every bin) leave room for the
    similarity.  Each is made once, at the first key that both have; those with a
    bucket's first member were held against it before."""
    def test(b):
        key, lo, hi, k, n, u, part = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1, 2, 3, 5, 7, 10))
        component = b.column(6).dictionary_encode().indices.to_numpy()
        first = np.asarray(b.column(11).to_numpy(zero_copy_only=False), bool)
        edge = np.flatnonzero((np.diff(key) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)) + 1
        x, y = _pairs_by_tile(np.diff(np.concatenate([[0], edge, [len(b)]])))
        most = np.minimum(u[x], u[y])
        on = ((component[x] != component[y]) & ~first[x] & ~first[y] & ((lo[x] == hi[x]) | (part[x] != part[y]))
              & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
              & (100 * most >= percent * (n[x] + n[y] - most)))
        x, y = x[on], y[on]
        sig = np.frombuffer(b"".join(b.column(8).to_pylist()), np.uint16).reshape(-1, shape.symbols)
        out = []
        for at in range(0, len(x), 1 << 16):
            i, j = x[at:at + (1 << 16)], y[at:at + (1 << 16)]
            differ = sig[i] != sig[j]
            near = np.count_nonzero(differ, axis=1) <= shape.far
            i, j, differ = i[near], j[near], differ[near].reshape(-1, shape.chunks, shape.chunk)
            wrong, each = np.count_nonzero(differ, axis=2), np.arange(len(i))
            c = np.argmax(wrong <= 1, axis=1)              # they share a key here, so some chunk has it
            v = np.where(wrong[each, c] == 0, 0, np.argmax(differ[each, c], axis=1))
            mine = c * shape.chunk + v == k[i]
            out.append((i[mine], j[mine]))
        if out:
            x, y = (np.concatenate(z) for z in zip(*out))
        raw, keep = b.column(9), np.ones(len(x), bool)
        for p, (i, j) in enumerate(zip(x.tolist(), y.tolist())):
            s, t = raw[i].as_buffer(), raw[j].as_buffer()
            if s.size and t.size:
                most = int(np.minimum(np.frombuffer(s, np.int16), np.frombuffer(t, np.int16)).sum(dtype=np.int64))
                keep[p] = 100 * most >= percent * (n[i] + n[j] - most)
        return x[keep], y[keep]

    def run(batches):
        for b in _groups(batches, 3):
            x, y = test(b)
            yield pa.RecordBatch.from_arrays([b.column(4).take(pa.array(x)), b.column(4).take(pa.array(y))], names=["a", "b"])

    kind = named.schema["id"].dataType.simpleString()
    rows = _tiles(named).select("key", "lo", "hi", "k", "id", "n", "c", "u", "sig", "bins", "part", "first")
    return rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "id").mapInArrow(run, f"a {kind}, b {kind}")


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets reach the similarity; ``docs`` has
    ``id`` and ``text``."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    rows = written(_sets_of(written(ids, "near-ids"), docs), "near-sets")
    kind = pairs.schema["a"].dataType.simpleString()
    both = (pairs.join(rows.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
            .join(rows.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b"))

    def check(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                same = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(same > 0 and 100 * same >= percent * (len(x) + len(y) - same))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["a", "b"])

    return both.select("a", "b", "sa", "sb").mapInArrow(check, f"a {kind}, b {kind}")


# ------------------------------------------------------------- components

def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` of linked nodes, the component being its smallest
    id: each round takes the least label among neighbours and then that label's
    own label, so labels travel twice as far in every round."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = written(both.distinct(), "near-edges")
    labels = written(edges.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("component")),
                     "near-labels")
    while True:
        near = edges.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("component").alias("c"))
        step = (labels.join(near, F.col("id") == F.col("a"))
                .select("id", F.col("component").alias("old"), F.least("component", "c").alias("mid")))
        jump = labels.select(F.col("id").alias("j"), F.col("component").alias("jc"))
        new = written(step.join(jump, F.col("mid") == F.col("j"), "left").select(
            "id", "old", F.least("mid", F.coalesce("jc", "mid")).alias("component")), "near-labels")
        labels = new.select("id", "component")
        if new.filter("component != old").isEmpty():
            return labels


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found`` (components of all linked nodes so far) after more links: these
    are taken between components, so nothing that is joined grows with the
    members of a component."""
    end = lambda e: found.select(F.col("id").alias(e), F.col("component").alias(f"c{e}"))
    ends = links.join(end("a"), "a", "left").join(end("b"), "b", "left").select(
        F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    over = components(ends.filter("a != b").distinct())
    top = over.select(F.col("id").alias("of"), F.col("component").alias("top"))
    old = found.join(top, F.col("component") == F.col("of"), "left").select(
        "id", F.coalesce("top", "component").alias("component"))
    new = over.join(found.select("id"), "id", "left_anti")
    return written(old.unionByName(new), "near-labels")


# ------------------------------------------------------------- the operator

def _row_key(docs: DataFrame, id_col: str, text_col: str) -> Column | None:
    """A key for every row with words, if some of them have no id (else None:
    the ids serve)."""
    c, text = F.col(id_col), F.col(text_col)
    words = text.rlike(r"[^\x20\x09-\x0D]")
    if docs.filter(c.isNull() & words).isEmpty():
        return None
    return F.when(c.isNull(), F.when(words, F.concat(F.lit("n"), F.sha2(text.cast("binary"), 256)))).otherwise(
        F.concat(F.lit("i"), c.cast("string")))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every row."""
    key = _row_key(docs, id_col, text_col)
    return _near_duplicates(docs, percent, id_col, text_col, key).drop("key")


def _near_duplicates(docs: DataFrame, percent: int, id_col: str, text_col: str, key: Column | None) -> DataFrame:
    """The rows of ``near_duplicates``; those found by a key have it too."""
    if key is None:
        texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        return _grouped(texts, texts, percent).select(
            F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
            F.col("id").eqNullSafe(F.col("component")).alias("kept"))
    texts = docs.select(key.alias("id"), F.col(text_col).alias("text"))
    named = F.col("id").startswith("i")
    # equal texts without ids have one key: one row of them is enough where texts are compared
    nodes = texts.filter(named).union(texts.filter(F.col("id").startswith("n")).dropDuplicates(["id"]))
    own = F.when(named, F.substr("id", F.lit(2)).cast(docs.schema[id_col].dataType))
    rows = written(_grouped(texts, nodes, percent).select(
        "id", "n", "component", own.alias("own"), F.monotonically_increasing_id().alias("row")), "near-rows")
    least = rows.groupBy("component").agg(F.min("own").alias("least"), F.min("row").alias("first"))
    kept = F.when(F.col("n") == 0, True).when(F.col("least").isNull(), F.col("row") == F.col("first")).otherwise(
        F.col("own").eqNullSafe(F.col("least")))
    return rows.join(least, "component", "left").select(
        F.col("own").alias(id_col), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"),
        kept.alias("kept"), F.col("id").alias("key"))


def _mixed(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members of the buckets in which components meet, with their component
    ``c`` (an unlinked text is its own) and their bucket's ``first`` member."""
    named = members.join(found, "id", "left").select("key", "k", "id", "n", "meets", F.coalesce("component", "id").alias("c"))
    first = F.max(F.struct("meets", "id", "n", "c"))
    mixed = (named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), first.alias("first"))
             .filter("lo != hi").select("key", "first"))
    return written(named.join(written(mixed, "near-buckets"), "key"), "near-mixed")


def _grouped(docs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """``(id, n, component)`` of the rows ``(id, text)``; ``texts`` has the same
    ids and serves where the texts of some are compared."""
    id_col, text_col = "id", "text"
    shape = Shape.of(percent)
    sigs = written(document_signatures(docs, shape, id_col, text_col), "near-signatures")
    some = sigs.filter("n > 0")
    # equal fingerprints have equal signatures: any of them serves
    classes = written(some.groupBy("fp", "n").agg(F.min("id").alias("id"), F.first("sig").alias("sig")),
                      "near-classes")
    reps = classes.filter(F.col("id").isNotNull()).select("id", "n", "sig")
    keys = _keys(reps, shape)
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    # the member that meets most others: few of its symbols differ from what its group has
    meets = F.sum("m").over(Window.partitionBy("id"))
    # written, so that the joins' sides are plain exchanges and a hot bucket can be split
    members = written(keys.join(written(shared, "near-buckets"), "key").select("key", "k", "id", "n", meets.alias("meets")),
                      "near-members")
    buckets = written(members.groupBy("key").agg(F.max(F.struct("meets", "id", "n")).alias("first")), "near-buckets")
    fits = (F.col("id") != F.col("first.id")) & _sizes_fit(F.col("n"), F.col("first.n"), percent)
    star = members.join(buckets, "key").filter(fits).select(F.col("first.id").alias("a"), F.col("id").alias("b")).distinct()
    star = written(_near_enough(star, reps, shape), "near-star")
    found = components(written(confirmed(star, texts, percent), "near-links"))

    # pairs between the components that meet in buckets, but those held against each other above
    named = _mixed(members, found).withColumn("first", F.col("id") == F.col("first.id"))
    sets = written(_sets_of(written(named.select("id").distinct(), "near-ids"), texts), "near-sets")
    own, bins = _own_shingles(sets), _bins(sets)
    able = (reps.join(own, "id", "left").join(bins, "id").withColumn("u", F.col("n") - F.coalesce("own", F.lit(0)))
            .filter(100 * F.col("u") >= percent * F.col("n")))
    named = written(named.join(able.select("id", "u", "sig", "bins"), "id"), "near-able")
    rest = written(_cross_pairs(named, shape, percent), "near-rest")
    more = written(confirmed(rest, texts, percent), "near-links")
    if not more.isEmpty():
        found = merged(found, more)

    of_class = (classes.join(found, "id", "left")
                .select("fp", F.col("n").alias("class_n"), F.coalesce("component", "id").alias("class_component")))
    rows = sigs.join(of_class, (sigs["fp"] == of_class["fp"]) & (sigs["n"] == of_class["class_n"]), "left")
    component = F.when(F.col("n") > 0, F.col("class_component")).otherwise(F.col("id"))
    return rows.select("id", "n", component.alias("component"))


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that represent their component, with all columns."""
    key = _row_key(docs, id_col, text_col)
    rows = _near_duplicates(docs, percent, id_col, text_col, key)
    if key is None:
        gone = rows.filter("not kept").select(id_col).distinct()
        return rows_of(docs, written(gone, "near-gone"), id_col, "left_anti")
    gone = rows.filter("key is not null").groupBy("key").agg(F.max("kept").alias("kept")).filter("not kept")
    left = rows_of(docs.withColumn(ROW_KEY, key), written(gone.select(F.col("key").alias(ROW_KEY)), "near-gone"),
                   ROW_KEY, "left_anti")
    equal = F.coalesce(F.col(ROW_KEY).startswith("n"), F.lit(False))
    return left.filter(~equal).unionByName(left.filter(equal).dropDuplicates([ROW_KEY])).select(
        *[F.col(f"`{c}`") for c in docs.columns])
