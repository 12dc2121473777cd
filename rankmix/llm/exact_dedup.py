"""Exact dedup: group by a 128-bit content hash, compare bytes in the groups.

Texts are equal when they agree after lower-casing A-Z.  ``groups`` groups on
the pair (MD5 of the text, the text itself): rows meet by hash and Spark's
aggregate compares their bytes, so two texts with one hash stay two groups.
Copies collapse before the shuffle -- a text that a third of all rows share
costs one row per map task.  Each document finds its group by hash and SHA-256
through a join of narrow rows, which adaptive execution splits when one group
is large.

Nulls count as empty texts, and all empty texts are equal.  A null id is never
the one that stays unless its group has no other.  Rows with the same id and
text are one document: the digest marks them alike, ``drop_copies`` leaves one.
An empty table gives no rows; other columns do not matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankmix.llm.common import ascii_lower


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).alias("id"), norm.alias("norm")).withColumn("h", F.unhex(F.md5("norm")))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """``(h, text_sha256, keep_id, group_size)``, one row per distinct text."""
    pick = F.min("id") if keep == "smallest" else F.max("id")
    return (_hashed(docs, id_col, text_col).groupBy("h", "norm")
            .agg(pick.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
            .select("h", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 keep: str = "smallest") -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` of every row."""
    rows = _hashed(docs, id_col, text_col).select("id", "h", F.sha2("norm", 256).alias("text_sha256"))
    return rows.join(groups(docs, id_col, text_col, keep), ["h", "text_sha256"]).select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    key = "__copy_of"
    name = lambda sha, i: F.concat_ws(":", sha, F.coalesce(i.cast("string"), F.lit("null")))
    stay = groups(docs, id_col, text_col, keep).select(name(F.col("text_sha256"), F.col("keep_id")).alias(key))
    sha = F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256)
    rows = docs.withColumn(key, name(sha, F.col(id_col))).join(stay, key, "left_semi")
    # the join leaves rows clustered and sorted by the key: no other exchange
    first = F.row_number().over(Window.partitionBy(key).orderBy(key))
    return rows.withColumn("__n", first).filter("__n = 1").drop(key, "__n")
