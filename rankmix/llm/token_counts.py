"""Token counts by a map-side two-tier lookup.

The length in tokens of a pre-token does not depend on its surroundings, so a
text's token count is a sum of looked-up lengths.  Tier one is a compact hash
table of the lengths of frequent pre-tokens, learned from a bounded sample and
broadcast (at most ``table_size`` entries of 12 bytes); tier two is each
worker's bounded cache, which encodes a pre-token once when it first misses.
No pre-token is ever shuffled and every text is counted whole.

Nulls and empty texts have 0 bytes and 0 tokens; a null id stays null; repeated
rows give repeated results; an empty table gives no rows; other columns are
ignored.  Texts of any length are counted in parts cut where a pre-token
starts.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmix.llm import pretoken

TABLE_SIZE = 65_536
SAMPLE_DOCS = 2_000
SAMPLE_BYTES = 20_000


def frequent_lengths(docs: DataFrame, path: str, text_col: str = "text", table_size: int = TABLE_SIZE,
                     sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES):
    """Hashes and token lengths of the commonest pre-tokens in a sample of at
    most ``sample_docs`` texts of at most ``sample_bytes`` bytes each.  The
    sample only decides what the broadcast table holds: every other pre-token
    is looked up in the worker's cache, so no count depends on it."""
    rows = (docs.select(F.col(text_col).alias("t")).filter(F.octet_length("t") <= sample_bytes)
            .limit(sample_docs).collect())
    tok = pretoken.load(path)
    if tok.kind is None:
        return np.empty(0, np.uint64), np.empty(0, np.int32)
    seen: Counter = Counter()
    for chunk in tok._parts([r["t"] for r in rows]):
        fast = [t for _, t, f in chunk if f]
        if fast:
            cp, at, ends, _ = tok.split(fast)
            h, n = np.unique(pretoken.span_hashes(cp, at, ends), return_counts=True)
            seen.update(dict(zip(h.tolist(), n.tolist())))
            tok.entries(fast)
    h = np.array([k for k, _ in seen.most_common(table_size)], np.uint64)
    return h, tok.cache.length[tok.cache.index.find(h)] if len(h) else np.empty(0, np.int32)


class TieredCounter:
    """Counts tokens with the broadcast table first, the worker's cache next."""

    def __init__(self, path: str, hashes: np.ndarray, lengths: np.ndarray):
        self.tok = pretoken.load(path)
        self.table = pretoken.HashIndex(max(4, int(2 * len(hashes) + 1).bit_length()))
        if len(hashes):
            self.table.add(hashes, lengths.astype(np.int32))

    def count(self, texts: list[str | None]) -> np.ndarray:
        tok, out = self.tok, np.zeros(len(texts), np.int64)
        for chunk in tok._parts(texts):
            fast = [(i, t) for i, t, f in chunk if f]
            if fast:
                cp, at, ends, per = tok.split([t for _, t in fast])
                h = pretoken.span_hashes(cp, at, ends)
                length = self.table.find(h)
                miss = np.flatnonzero(length < 0)
                if len(miss):
                    length[miss] = tok.lengths_of(h[miss], cp, at[miss], ends[miss])
                total = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
                cut = np.concatenate([[0], np.cumsum(per)])
                np.add.at(out, [i for i, _ in fast], total[cut[1:]] - total[cut[:-1]])
            for i, t, f in chunk:
                if not f:
                    out[i] += len(tok.lib.encode(t, add_special_tokens=False).ids)
        return out


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 512, table_size: int = TABLE_SIZE) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every row; ``path`` is a
    tokenizers file that executors can read."""
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(frequent_lengths(docs, path, text_col, table_size))

    def run(batches):
        counter = TieredCounter(path, *table.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            n = counter.count(texts)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(n > limit)],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"),
                       F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"))
    id_type = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"{id_col} {id_type}, n_bytes long, n_tokens long, over_limit boolean")
