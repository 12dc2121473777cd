"""Line dedup across documents, answered with keep bitmaps instead of texts.

Lines become (document, position, 128-bit key hash) rows, written once.  They
are range-partitioned by hash and a salt of the document, sorted within the
partitions by document and position, and streamed: a row whose predecessor has
the same hash but another document is a new occurrence.  The counts of a
hash's salts are then summed, so a line that a third of all rows share is read
by many tasks.  Lines found in ``min_docs`` documents are looked up among the
rows and each document gets the runs of lines that it keeps -- a run-length
coded bitmap; the text is only touched again by ``kept_text``.

A null text is one empty line.  Keys shorter than ``min_chars`` code points
never count.  Rows of one id count as one document; null ids are one document
too, but keep bitmaps of their own, as rows of one id with different texts do.
An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankmix.llm.common import SPACES, ascii_lower, written

SALTS = 64


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("t", F.xxhash64("text"))


def line_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """``(id, t, pos, h)`` of every line whose key counts; ``t`` tells texts
    of one id apart."""
    lines = _texts(docs, id_col, text_col).select("id", "t", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    key = ascii_lower(F.btrim("line", F.lit(SPACES)))
    return (lines.select("id", "t", "pos", key.alias("key")).filter(F.char_length("key") >= min_chars)
            .select("id", "t", "pos", F.unhex(F.md5("key")).alias("h")))


def frequent_lines(rows: DataFrame, min_docs: int, salts: int = SALTS) -> DataFrame:
    """``(h, first_id, first_pos)`` of keys found in ``min_docs`` documents."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts))).repartitionByRange(parts, "h", "salt")
    w = Window.partitionBy("h", "salt").orderBy("id", "pos")
    # lag over (id) alone cannot tell a null id from no row: the row number does
    new = (F.row_number().over(w) == 1) | ~F.lag("id").over(w).eqNullSafe(F.col("id"))
    firsts = dealt.select("h", "id", "pos", new.alias("new")).filter("new")
    return (firsts.groupBy("h").agg(F.count(F.lit(1)).alias("n_docs"),
                                    F.min(F.struct("id", "pos")).alias("first"))
            .filter(F.col("n_docs") >= min_docs)
            .select("h", F.col("first.id").alias("first_id"), F.col("first.pos").alias("first_pos")))


def _runs(n_lines: Column, drops: Column) -> Column:
    """Kept runs (start, length) between dropped positions (sorted)."""
    starts = F.concat(F.array(F.lit(0)), F.transform(drops, lambda d: d + 1))
    ends = F.concat(drops, F.array(n_lines))
    runs = F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e - s).alias("length")))
    return F.filter(runs, lambda r: r["length"] > 0)


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False,
                 id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """``(id, t, drops)``: sorted dropped positions of documents that lose
    lines; with ``keep_first`` a line's first occurrence stays."""
    rows = written(line_rows(docs, id_col, text_col, min_chars), "lines")
    # written, so that the optimizer knows its size, and can split a hot line's rows if it must shuffle
    hit = rows.join(written(frequent_lines(rows, min_docs, salts), "frequent-lines"), "h")
    if keep_first:
        hit = hit.filter(~(F.col("id").eqNullSafe(F.col("first_id")) & (F.col("pos") == F.col("first_pos"))))
    return hit.groupBy("id", "t").agg(F.sort_array(F.collect_set("pos")).alias("drops"))


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False,
               id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, keep_runs, kept_text)`` of every row."""
    maps = keep_bitmaps(docs, min_docs, min_chars, keep_first, id_col, text_col, salts)
    rows = _texts(docs, id_col, text_col)
    on = rows["id"].eqNullSafe(maps["id"]) & (rows["t"] == maps["t"])
    both = rows.join(maps, on, "left").select(rows["id"].alias(id_col), "text", "drops")
    lines, n = F.split("text", "\n"), F.size(F.split("text", "\n"))
    no_drops = F.array().cast("array<int>")
    out = both.select(id_col, "text", "drops", n.alias("n"),
                      _runs(n, F.coalesce("drops", no_drops)).alias("keep_runs"))
    kept = F.array_join(F.flatten(F.transform("keep_runs", lambda r: F.slice(lines, r["start"] + 1, r["length"]))), "\n")
    return out.select(id_col, F.col("n").cast("long").alias("n_lines"),
                      F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"), "keep_runs",
                      F.when(F.col("drops").isNull(), F.col("text")).otherwise(kept).alias("kept_text"))
