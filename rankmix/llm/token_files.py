"""Files of token ids: write, read back, and where each document lies.

Documents are range-partitioned and sorted by id, so the files hold them in
ascending order.  Each partition tokenizes its texts and codes them into frames
(``rangecoder``) of whole documents, about ``FRAME_IDS`` ids each; a frame is a
row with its partition and number, the documents' ids and lengths, and the
code.  Spark's writer commits the rows, so a lost executor only repeats its
tasks.  A reader decodes frames independently; positions in the whole corpus
come from the frames' sizes -- summed by partition first, then over partitions.

A null text has no ids but the end id; null document ids come first; rows of
one id are ordered by text; an empty table gives no rows; other columns are
ignored.  A document longer than a frame has a frame of its own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankmix.llm import pretoken, rangecoder

FRAME_IDS = 1 << 20
FRAMES_AT_ONCE = 8
READ_FRAMES = 12                # frames that a reading task gets, about: the wider its array steps, the quicker
READ_AT_ONCE = 16


def _frames(docs: DataFrame, path: str, end_id: int, id_bits: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        tok = pretoken.load(path)
        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple] = []               # (keys, lengths, ids) of full frames
        keys, sizes, parts, total = [], [], [], 0

        def flush():
            nonlocal held, seq
            codes = rangecoder.encode_frames([ids for *_, ids in held], id_bits)
            rows = [(part, seq + i, int(len(ids)), k, n, c) for i, ((k, n, ids), c) in enumerate(zip(held, codes))]
            seq, held = seq + len(held), []
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()),
                 pa.array(cols[3], pa.list_(key_type)), pa.array(cols[4], pa.list_(pa.int64())),
                 pa.array(cols[5], pa.binary())], names=["part", "frame_no", "n_ids", "doc_ids", "lengths", "frame"])

        key_type = None
        for b in batches:
            key_type = b.column(0).type
            texts, ids_of = b.column(1).to_pylist(), b.column(0).to_pylist()
            for a in range(0, len(texts), 512):
                ids, n = tok.encode(texts[a:a + 512])
                cut = np.concatenate([[0], np.cumsum(n)])
                for j in range(len(n)):
                    own = np.append(ids[cut[j]:cut[j + 1]], np.uint32(end_id))
                    if total and total + len(own) > FRAME_IDS:
                        held.append((keys, sizes, np.concatenate(parts)))
                        keys, sizes, parts, total = [], [], [], 0
                    keys.append(ids_of[a + j])
                    sizes.append(len(own))
                    parts.append(own)
                    total += len(own)
                if len(held) >= FRAMES_AT_ONCE:
                    yield flush()
        if total:
            held.append((keys, sizes, np.concatenate(parts)))
        if held:
            yield flush()

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    return dealt.mapInArrow(run, f"part int, frame_no int, n_ids long, doc_ids array<{id_type}>, "
                                 "lengths array<long>, frame binary")


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_bits: int = 16,
                      id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every document, each followed by ``end_id``."""
    _frames(docs, tokenizer, end_id, id_bits, id_col, text_col).write.parquet(path)


def frame_starts(spark: SparkSession, path: str) -> DataFrame:
    """``(part, frame_no, frame_start)``: ids in all frames before."""
    f = spark.read.parquet(path).select("part", "frame_no", "n_ids")
    parts = f.groupBy("part").agg(F.sum("n_ids").alias("n"))     # a row for each partition written
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("frame_no").rowsBetween(Window.unboundedPreceding, -1)
    return f.withColumn("s", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(parts, "part").select(
        "part", "frame_no", (F.col("s") + F.col("part_start")).alias("frame_start"))


def read_documents(spark: SparkSession, path: str, with_ids: bool = False, id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32[, ids])`` decoded from the files."""
    frames = spark.read.parquet(path)
    tasks = max(spark.sparkContext.defaultParallelism, -(-frames.count() // READ_FRAMES))

    def run(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            calls = -(-t.num_rows // READ_AT_ONCE)
            cuts = [t.num_rows * i // max(calls, 1) for i in range(calls + 1)]
            for a, end in zip(cuts, cuts[1:]):
                s = t.slice(a, end - a).combine_chunks()
                decoded = rangecoder.decode_frames(s["frame"].to_pylist())
                keys, part, no, at, n, crc, raw = [], [], [], [], [], [], []
                for i, ids in enumerate(decoded):
                    ids, pos = ids.astype("<u4"), 0
                    lengths = s["lengths"][i].as_py()
                    for m in lengths:
                        own = ids[pos:pos + m]
                        crc.append(zlib.crc32(own))
                        if with_ids:
                            raw.append(own.tolist())
                        at.append(pos)
                        pos += m
                    keys += s["doc_ids"][i].as_py()
                    n += lengths
                    part += [s["part"][i].as_py()] * len(lengths)
                    no += [s["frame_no"][i].as_py()] * len(lengths)
                cols = [pa.array(keys, s.schema.field("doc_ids").type.value_type), pa.array(part, pa.int32()),
                        pa.array(no, pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64()),
                        pa.array(crc, pa.int64())]
                names = ["id", "part", "frame_no", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols, names = cols + [pa.array(raw, pa.list_(pa.int64()))], names + ["ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    id_type = frames.schema["doc_ids"].dataType.elementType.simpleString()
    rows = frames.coalesce(tasks).mapInArrow(run, f"id {id_type}, part int, frame_no int, at long, n_tokens long, ids_crc32 long"
                                  + (", ids array<long>" if with_ids else ""))
    more = ["ids"] if with_ids else []
    return rows.join(frame_starts(spark, path), ["part", "frame_no"]).select(
        F.col("id").alias(id_col), (F.col("frame_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *more)
