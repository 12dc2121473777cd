"""Best-fit packing of token sequences with a swap-based local search.

1. Every document is tokenized where it lies; documents longer than the
   capacity are cut into full pieces (the remainder comes first).  Only piece
   descriptions, no texts or ids, move on; they are written once.
2. Full pieces are sequences of their own.  The others are dealt by a hash of
   their row number into groups of about ``group_size`` pieces.  The number of
   groups grows with the data, a hot document length or source spreads over all
   of them, and each group loses at most about one sequence to the split.
3. A group is packed by best fit, longest first.  Then underfull bins exchange
   pieces -- one moves, one goes for one, one for two or two for one -- so that
   the fuller bin gains; each exchange raises the sum of squared fills, and the
   search ends when none does.  Bins that run empty disappear.

Null or empty texts become one piece holding the end id alone; a null id is
kept; repeated rows are packed as often as they occur; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmix.llm import pretoken
from rankmix.llm.common import written

CAPACITY = 1024
GROUP_SIZE = 20_000
TEXTS = 512             # encoded at once
CACHED = 1 << 17        # pre-tokens that a worker keeps


# ------------------------------------------------------------- one group

def best_fit(lengths, capacity: int) -> list[list[int]]:
    """Longest first, each piece to the fullest bin that it fits."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0                                   # bit r is set while a bin has room r
    for i in np.argsort(-np.asarray(lengths), kind="stable").tolist():
        s = int(lengths[i])
        fits = rooms >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        room -= s
        if room:
            by_room[room].append(b)
            rooms |= 1 << room
    return bins


class LocalSearch:
    """Exchanges between underfull bins that raise the sum of squared fills.

    ``d`` is what the target bin gains.  With fills ``t`` and ``s`` of target
    and source an exchange changes the sum by ``2 d (t - s + d)``, so any
    ``d > 0`` from a bin with ``s < t + d`` raises it.  The largest possible
    gain comes first.
    """

    def __init__(self, bins: list[list[int]], lengths, capacity: int):
        self.cap, self.len = capacity, [int(x) for x in lengths]
        self.bins = bins
        self.fill = [sum(self.len[i] for i in b) for b in bins]
        self.open = {b for b, f in enumerate(self.fill) if 0 < f < capacity}
        self.holds: dict[int, dict[int, int]] = {}      # size -> {open bin: pieces of that size}
        self.pairs: dict[int, dict[int, tuple]] = {}    # sum of two -> {open bin: the two sizes}
        self.sizes = self.sums = 0                      # the same keys as bit sets
        for b in self.open:
            self._index(b)

    def _own(self, b):
        count: dict[int, int] = {}
        for i in self.bins[b]:
            count[self.len[i]] = count.get(self.len[i], 0) + 1
        own = sorted(count)
        twos = {}
        for x, p in enumerate(own):
            for q in own[x if count[p] > 1 else x + 1:]:
                twos.setdefault(p + q, (p, q))
        return count, twos

    def _index(self, b):
        count, twos = self._own(b)
        for s, n in count.items():
            self.holds.setdefault(s, {})[b] = n
            self.sizes |= 1 << s
        for s, two in twos.items():
            self.pairs.setdefault(s, {})[b] = two
            self.sums |= 1 << s

    def _unindex(self, b):
        count, twos = self._own(b)
        for keys, table, name in ((count, self.holds, "sizes"), (twos, self.pairs, "sums")):
            for s in keys:
                del table[s][b]
                if not table[s]:
                    del table[s]
                    setattr(self, name, getattr(self, name) & ~(1 << s))

    def _find(self, table, bits, give, t, room):
        """Largest size in (give, give + room] held by another, emptier bin."""
        window = (bits & ((1 << (give + room + 1)) - 1)) >> (give + 1)
        while window:
            top = window.bit_length() - 1
            size = give + 1 + top
            d = size - give
            for b in table[size]:
                if b != t and self.fill[b] < self.fill[t] + d:
                    return d, size, b
            window &= ~(1 << top)
        return None

    def _best(self, t):
        """(gain, sizes given, sizes taken, source) of the best exchange."""
        room = self.cap - self.fill[t]
        best = None
        got = self._find(self.holds, self.sizes, 0, t, room)
        if got:
            best = (got[0], (), (got[1],), got[2])
        count, twos = self._own(t)
        for table, bits, gives in ((self.holds, self.sizes, [(s, (s,)) for s in count]),
                                   (self.pairs, self.sums, [(s, (s,)) for s in count]),
                                   (self.holds, self.sizes, list(twos.items()))):
            for give, parts in gives:
                if best and best[0] == room:
                    return best
                got = self._find(table, bits, give, t, room)
                if got and (best is None or got[0] > best[0]):
                    taken = (got[1],) if table is self.holds else table[got[1]][got[2]]
                    best = (got[0], parts, taken, got[2])
        return best

    def _take(self, b, sizes):
        out = []
        for s in sizes:
            k = next(k for k, i in enumerate(self.bins[b]) if self.len[i] == s)
            out.append(self.bins[b].pop(k))
        return out

    def run(self) -> list[list[int]]:
        changed = True
        while changed:
            changed = False
            for t in sorted(self.open, key=lambda b: (-self.fill[b], b)):
                while t in self.open:
                    move = self._best(t)
                    if move is None:
                        break
                    d, gives, takes, s = move
                    self._unindex(t)
                    self._unindex(s)
                    given, taken = self._take(t, gives), self._take(s, takes)
                    self.bins[t] += taken
                    self.bins[s] += given
                    self.fill[t] += d
                    self.fill[s] -= d
                    changed = True
                    for b in (t, s):
                        if 0 < self.fill[b] < self.cap:
                            self._index(b)
                        else:
                            self.open.discard(b)
        return [b for b in self.bins if b]


def pack_lengths(lengths, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins (lists of positions) for pieces of the given lengths."""
    return LocalSearch(best_fit(lengths, capacity), lengths, capacity).run()


# ------------------------------------------------------------- Spark side

def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; the first may be shorter."""
    if length <= capacity:
        return [(0, length)]
    head = length % capacity
    starts = ([0] if head else []) + list(range(head, length, capacity))
    return [(s, (head if head and s == 0 else capacity)) for s in starts]


def pieces(docs: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY,
           id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])`` of every document."""
    def run(batches):
        tok = pretoken.load(path, CACHED)
        for b in (b.slice(a, TEXTS) for b in batches for a in range(0, len(b), TEXTS)):
            ids, n = tok.encode(b.column(1).to_pylist())
            where, rows, payload, pos = [], [], [], 0
            for k, m in enumerate(n.tolist()):
                own = np.append(ids[pos:pos + m], np.uint32(end_id)).astype("<u4")
                pos += m
                for p, (s, ln) in enumerate(cut(m + 1, capacity)):
                    raw = own[s:s + ln].tobytes()
                    where.append(k)
                    rows.append((p, s, ln, zlib.crc32(raw)))
                    if with_ids:
                        payload.append(raw)
            cols = list(zip(*rows)) or [(), (), (), ()]
            out = [b.column(0).take(pa.array(where, pa.int64())), pa.array(cols[0], pa.int32()),
                   *[pa.array(c, pa.int64()) for c in cols[1:]]]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                out, names = out + [pa.array(payload, pa.binary())], names + ["ids"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {id_type}, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(
        run, schema + (", ids binary" if with_ids else ""))


def assign(piece_rows: DataFrame, capacity: int = CAPACITY, group_size: int = GROUP_SIZE) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length``.

    ``piece_rows`` is written once, which also fixes the row numbers that name
    the sequences: a sequence is called by its first piece's number.
    """
    rows = written(piece_rows.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    part = rows.filter(F.col("length") < capacity)
    groups = max(1, -(-part.count() // group_size))
    fields = piece_rows.schema.names
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in piece_rows.schema.fields)

    def pack(batches):
        t = pa.Table.from_batches(batches)
        t = t.sort_by("_row")
        lengths, number = t["length"].to_numpy(), t["_row"].to_numpy()
        seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for b in pack_lengths(lengths, capacity):
            b.sort()
            seq[b] = number[b[0]]
            off[b] = np.cumsum(lengths[b]) - lengths[b]
        t = t.select(fields).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))
        yield from t.to_batches()

    packed = (part.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
              .groupBy("_group").applyInArrow(lambda t: pa.Table.from_batches(pack(t.to_batches())),
                                              f"{out}, sequence_id long, offset long"))
    full = rows.filter(F.col("length") >= capacity).select(
        *fields, F.col("_row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY,
                   group_size: int = GROUP_SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where every piece of every document goes: ``(doc_id, piece, start,
    length, ids_crc32, sequence_id, offset)``."""
    return assign(pieces(docs, path, end_id, capacity, id_col, text_col), capacity, group_size)


def sequences(docs: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY,
              group_size: int = GROUP_SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed training sequences ``(sequence_id, n_tokens, ids)``; a group
    holds at most ``capacity`` ids."""
    placed = assign(pieces(docs, path, end_id, capacity, id_col, text_col, with_ids=True), capacity, group_size)
    parts = placed.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))

    def run(batches):
        for b in batches:
            ids = [np.frombuffer(b"".join(x["ids"] for x in p), "<u4").tolist() for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int64()))],
                                             names=["sequence_id", "n_tokens", "ids"])
    return parts.select("sequence_id", "n_tokens", "p").mapInArrow(
        run, "sequence_id long, n_tokens long, ids array<long>")
