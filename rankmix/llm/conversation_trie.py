"""The trie of all conversations' prefixes, by ROLLUP over turn columns.

A turn's id is the MD5 of its role and text with the text's length.  Each
conversation becomes rows of ``BLOCK`` positional id columns ``t1 .. t8``; a row
also has the key of what comes before it (``p1, p2``: the earlier blocks' hashes
combined), so ``GROUP BY block, prefix, ROLLUP (t1, .., t8)`` aggregates the
prefixes of all lengths of all conversations at once, and ``grouping_id`` tells
their depth.  A conversation of any length is just more rows.

Sums over subtrees need no walk of the tree.  Let a node's owner be its smallest
member.  A conversation owns the nodes of its path from some depth on, and every
other member's turns above that depth are the repeated ones.  So a first ROLLUP
gives, for every conversation, the bytes ``u`` before its first own node and
whether it owns a leaf; a second one adds those up:

    n_leaves     = sum over members of (owns a leaf)
    saved_tokens = sum over members but the owner of (u - bytes above the node)

* ``turn`` orders a conversation (null first), equal turns go by their ids; null
  role or text is empty.  Rows without a conversation id are left out.
* A third of all rows may be one conversation: its turns are numbered, and its
  blocks' keys combined, in stretches of ``STRETCH`` turns with offsets.
* The hash over a node's ending conversations is taken over pieces of text that
  sorted ranges prepare, streamed one after another.
* An empty table has no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from rankmix.llm.common import written

BLOCK = 8
STRETCH = 4096
PIECE_IDS = 8192
LEAST = -(1 << 63)
T = [f"t{i}" for i in range(1, BLOCK + 1)]
KEY = ["depth", "k1", "k2"]


def turn_id(role: Column, text: Column) -> Column:
    """20 bytes: MD5 of the role's length, role and text; the text's length."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    return F.unhex(F.concat(digest, F.lpad(F.hex(F.octet_length(text)), 8, "0")))


def id_bytes(t) -> Column:
    """The text's length in an id; 0 for none."""
    return F.coalesce(F.conv(F.hex(F.substring(t, 17, 4)), 16, 10).cast("long"), F.lit(0).cast("long"))


def numbered_turns(rows: DataFrame) -> DataFrame:
    """``(c, pos, t)`` of rows ``(c, turn, t)``: places from 1 in each conversation."""
    numeric = isinstance(rows.schema["turn"].dataType, NumericType)
    stretch = F.floor(F.col("turn") / STRETCH).cast("long") if numeric else F.when(F.col("turn").isNotNull(), F.lit(0).cast("long"))
    rows = rows.withColumn("stretch", F.coalesce(stretch, F.lit(LEAST)))
    before = Window.partitionBy("c").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("c", "stretch").agg(F.count(F.lit(1)).alias("n")).select(
        "c", "stretch", F.sum("n").over(before).alias("offset")).filter("offset > 0")
    place = F.row_number().over(Window.partitionBy("c", "stretch").orderBy(F.col("turn").asc_nulls_first(), "t"))
    return rows.select("c", "stretch", place.alias("rn"), "t").join(offsets, ["c", "stretch"], "left").select(
        "c", (F.col("rn") + F.coalesce("offset", F.lit(0))).alias("pos"), "t")


def shared_heads(turns: DataFrame, group: int = 5, spread: int = 9) -> DataFrame:
    """Every conversation c begins with the first h turns of conversation
    c - c % group (h = crc32 of c's digits % spread), then its own from its h-th
    on.  Rows ``(c, pos, t)``, and one ``(c, 0, null)`` for each conversation."""
    h = (F.crc32(F.col("c").cast("string").cast("binary")) % spread).cast("int")
    heads = turns.filter((F.col("pos") < spread) & (F.pmod("c", F.lit(group)) == 0)).groupBy(F.col("c").alias("base")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]).alias("head"))
    ids = turns.select("c").distinct().withColumn("base", F.try_subtract("c", F.pmod("c", F.lit(group))))
    taken = ids.join(heads, "base", "left").select(
        "c", F.slice(F.coalesce("head", F.array().cast("array<binary>")), F.lit(1), h).alias("take"))
    taken = written(taken, "trie-heads")
    short = taken.filter(F.size("take") < h).select("c", F.size("take").alias("k"))
    own = turns.filter(F.col("pos") > h).join(short, "c", "left").select(
        "c", (F.col("pos") - h + F.coalesce("k", h)).cast("long").alias("pos"), "t")
    head = taken.select("c", F.posexplode("take").alias("i", "t")).select("c", (F.col("i") + 1).cast("long").alias("pos"), "t")
    return own.unionByName(head).unionByName(
        taken.select("c", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("t")))


def blocks_of(turns: DataFrame) -> DataFrame:
    """``(c, block, p1, p2, pb, len, total, t1 ..)``: rows of BLOCK turns with the
    key and bytes of what comes before them, and the conversation's turns and
    bytes.  ``turns`` has a row of place 0 for every conversation."""
    at = F.greatest(F.col("pos") - 1, F.lit(0))
    rows = turns.select("c", "pos", "t", F.floor(at / BLOCK).cast("long").alias("block")).groupBy("c", "block").agg(
        *[F.max(F.when(F.col("pos") == F.col("block") * BLOCK + i + 1, F.col("t"))).alias(t) for i, t in enumerate(T)])
    size = sum((id_bytes(t) for t in T[1:]), id_bytes(T[0]))
    count = sum((F.col(t).isNotNull().cast("long") for t in T[1:]), F.col(T[0]).isNotNull().cast("long"))
    rows = rows.select("c", "block", *T, size.alias("nb"), count.alias("m"), *_block_hash(),
                       F.floor(F.col("block") / (STRETCH // BLOCK)).alias("stretch"))
    rows = written(rows, "trie-rows")
    every = Window.partitionBy("c")
    before = every.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("c", "stretch").agg(
        F.bit_xor("x1").alias("s1"), F.bit_xor("x2").alias("s2"), F.sum("nb").alias("sb"), F.sum("m").alias("sm"))
    parts = parts.select("c", "stretch", F.bit_xor("s1").over(before).alias("o1"), F.bit_xor("s2").over(before).alias("o2"),
                         F.sum("sb").over(before).alias("ob"), F.sum("sm").over(every).alias("len"),
                         F.sum("sb").over(every).alias("total"))
    inner = Window.partitionBy("c", "stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    rows = rows.select("c", "block", "stretch", *T, *[F.coalesce(f(x).over(inner), none).alias(a) for f, x, a in (
        (F.bit_xor, "x1", "i1"), (F.bit_xor, "x2", "i2"), (F.sum, "nb", "ib"))])
    return rows.join(parts, ["c", "stretch"]).select(
        "c", "block", F.coalesce("o1", none).bitwiseXOR(F.col("i1")).alias("p1"),
        F.coalesce("o2", none).bitwiseXOR(F.col("i2")).alias("p2"),
        (F.coalesce("ob", none) + F.col("ib")).alias("pb"), "len", "total", *T)


def _block_hash() -> tuple[Column, Column]:
    return (F.xxhash64("block", *T).alias("x1"), F.xxhash64(*reversed(T), F.lit(1), "block").alias("x2"))


def _node_key(turns: Column) -> tuple[Column, Column]:
    """Key of the prefix that ends ``turns`` ids into this block: after none of
    them the block's own prefix, after all of them the next block's."""
    t = [F.when(turns >= i + 1, F.col(c)) for i, c in enumerate(T)]
    part = (F.xxhash64("p1", "p2", *t), F.xxhash64(*reversed(t), F.lit(1), "p2", "p1"))
    return tuple(F.when(turns == 0, F.col(p)).when(turns == BLOCK, F.col(p).bitwiseXOR(x)).otherwise(y)
                 for p, x, y in zip(("p1", "p2"), _block_hash(), part))


def _rollup(blocks: DataFrame, measures: str) -> DataFrame:
    """One row for every distinct prefix: ``depth``, ``k`` (ids of its block that
    it has), ``before`` (bytes above its last turn) and the measures."""
    t = ", ".join(T)
    nodes = blocks.sparkSession.sql(
        f"SELECT block, p1, p2, pb, {t}, {BLOCK} - bit_count(grouping_id()) AS k, {measures} "
        f"FROM {{blocks}} GROUP BY block, p1, p2, pb, ROLLUP ({t})", blocks=blocks)
    # sets of columns beyond a conversation's end, and prefixes that the block before has
    last = F.coalesce(*[F.when(F.col("k") == i + 1, F.col(c).isNotNull()) for i, c in enumerate(T)], F.col("block") == 0)
    above = sum((F.when(F.col("k") > i + 1, id_bytes(c)).otherwise(F.lit(0).cast("long")) for i, c in enumerate(T)), F.col("pb"))
    return nodes.filter(last).withColumns({"depth": F.col("block") * BLOCK + F.col("k"), "before": above})


def _first_own(blocks: DataFrame) -> DataFrame:
    """``(c, u, leaf)``: bytes before the conversation's first own node, and 1
    if it owns a leaf; conversations without a node of their own are left out."""
    nodes = _rollup(blocks, "min(c) AS c, max(len) AS longest")
    return nodes.groupBy("c").agg(F.min("before").alias("u"), F.max((F.col("longest") == F.col("depth")).cast("long")).alias("leaf"))


def _endings(blocks: DataFrame) -> DataFrame:
    """``(depth, k1, k2, ends_sha256)`` of nodes at which conversations end."""
    last = F.col("block") == F.floor(F.greatest(F.col("len") - 1, F.lit(0)) / BLOCK)
    k1, k2 = _node_key(F.col("len") - F.col("block") * BLOCK)
    ends = blocks.filter(last).select(F.col("len").alias("depth"), k1.alias("k1"), k2.alias("k2"), "c")

    def pieces(batches):
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(4)]
            out, at = [], 0
            for i in range(1, len(b) + 1):
                if i == len(b) or i - at == PIECE_IDS or any(x[i] != x[at] for x in cols[:3]):
                    out.append((*(x[at] for x in cols), ",".join(map(str, cols[3][at:i]))))
                    at = i
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in list(zip(*out))[:4] or [[]] * 4]
                + [pa.array([r[4] for r in out], pa.string())], names=[*KEY, "c", "ids"])

    def hashes(batches):
        node, h = None, None
        for b in batches:
            out = []
            for *key, ids in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if key == node:
                    h.update(b",")
                else:
                    if h:
                        out.append((*node, h.hexdigest()))
                    node, h = key, hashlib.sha256()
                h.update(ids.encode())
            yield _ended(out)
        if h:
            yield _ended([(*node, h.hexdigest())])

    parts = ends.repartitionByRange("k1", "k2", "depth", "c").sortWithinPartitions("k1", "k2", "depth", "c").mapInArrow(
        pieces, "depth long, k1 long, k2 long, c long, ids string")
    return parts.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "depth", "c").mapInArrow(
        hashes, "depth long, k1 long, k2 long, ends_sha256 string")


def _ended(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:3]] + [pa.array(cols[3], pa.string())],
                                      names=[*KEY, "ends_sha256"])


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The nodes of the trie of ``turns`` (c, pos, t, with a row of place 0 for
    every conversation): ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256``."""
    blocks = written(blocks_of(turns), "trie-blocks")
    own = blocks.join(_first_own(blocks), "c", "left").withColumns(
        {"u": F.coalesce("u", "total"), "leaf": F.coalesce("leaf", F.lit(0).cast("long"))})
    nodes = _rollup(own, "count(*) AS n, min(c) AS c, sum(u) AS su, min(u) AS mu, sum(leaf) AS n_leaves")
    # the owner is the member with the fewest bytes before its first own node
    saved = F.col("su") - F.col("mu") - (F.col("n") - 1) * F.col("before")
    (k1, k2), (a1, a2) = _node_key(F.col("k")), _node_key(F.greatest(F.col("k") - 1, F.lit(0)))
    nodes = written(nodes.select("depth", k1.alias("k1"), k2.alias("k2"), a1.alias("a1"), a2.alias("a2"), "c", "n", "n_leaves",
                                 saved.alias("saved_tokens")), "trie-nodes")
    below = nodes.filter("depth > 0")
    children = below.groupBy((F.col("depth") - 1).alias("depth"), F.col("a1").alias("k1"), F.col("a2").alias("k2")).agg(
        F.count(F.lit(1)).alias("n_children"))
    parents = nodes.filter("depth > 0 and n > 1").select(
        (F.col("depth") + 1).alias("depth"), F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("c").alias("parent"))
    # a node with one member has that member's node above it, and the root is everyone's
    root = nodes.filter("depth = 0").select("c").first()
    root = F.lit(root["c"] if root else None).cast("long")
    parent = F.when(F.col("depth") == 1, root).when(F.col("depth") > 1, F.coalesce("parent", "c"))
    return (nodes.join(children, KEY, "left").join(_endings(blocks), KEY, "left").join(parents, ["depth", "a1", "a2"], "left")
            .select(F.col("c").cast("long").alias("conv_id"), "depth", parent.alias("parent_conv_id"), F.col("n").alias("n_convs"),
                    F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256")))


def conversation_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                       text_col: str = "text") -> DataFrame:
    """``(c, pos, t)`` of a table of turns."""
    turns = rows.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("turn"), turn_id(F.col(role_col), F.col(text_col)).alias("t"))
    return written(numbered_turns(turns), "trie-turns")


def with_starts(turns: DataFrame) -> DataFrame:
    """The turns as they are, with the row of place 0 for every conversation."""
    return turns.unionByName(turns.select("c").distinct().select(
        "c", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("t")))
