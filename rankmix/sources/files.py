"""File sources and sinks.

Score directories hold one CSV per model, ``<model>_scores.csv``: a leading
index column (the item position) and one column per class.  All files are
read by ONE scan (``pathGlobFilter``), the model comes from the file name,
and the result is the long ``(item_id, model, cls, score)`` table, so any
number of models and items is read in parallel.
"""

from __future__ import annotations

import re
import uuid
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankmix.functions import json_literal
from rankmix.session import remove_folder, scratch_dir

SCORES_SUFFIX = "_scores.csv"


def read_score_dir(spark: SparkSession, path: str, prefix_only: bool = False) -> DataFrame:
    """``(item_id, model, cls, score)`` from every ``*_scores.csv`` in ``path``.

    The model name is the file name without ``_scores.csv``; with
    ``prefix_only`` it is the text before the first ``_`` (the original
    naming, where ``random_forest`` becomes ``random``).
    """
    raw = spark.read.option("pathGlobFilter", f"*{SCORES_SUFFIX}").option("recursiveFileLookup", True).text(path)
    return _score_rows(_score_lines(raw, r"([^/]+)_scores\.csv$", prefix_only))


def read_score_folders(spark: SparkSession, path: str, prefix_only: bool = False, by_line: bool = False) -> DataFrame:
    """The same from folders ``<model>_scores.csv`` with any number of files
    each, as ``write_score_dir`` leaves them (plain files of that name too).
    ``by_line`` keeps a line's scores together: ``(item_id, model, scores)``."""
    lines = _score_lines(spark.read.text(f"{path}/*{SCORES_SUFFIX}"), r"([^/]+)_scores\.csv(?:/[^/]+)?$", prefix_only)
    return lines if by_line else _score_rows(lines)


def _score_rows(lines: DataFrame) -> DataFrame:
    return lines.select("item_id", "model", F.posexplode("scores").alias("cls", "score"))


def _score_lines(raw: DataFrame, name: str, prefix_only: bool) -> DataFrame:
    """``(item_id, model, scores)``: each file has as many classes as its own lines
    have cells; an empty cell is NULL.  A batch of lines is split at once, and its
    files' names are read once each."""
    def model_of(file: str) -> str:
        # a file's name comes back as a URL
        found = re.search(name, unquote(file))
        model = found[1] if found else ""
        return re.match("[^_]*", model)[0] if prefix_only else model

    def split(batches):
        for b in batches:
            file = b.column(1).dictionary_encode()
            models = pa.array([model_of(f) for f in file.dictionary.to_pylist()], pa.string())
            cells = pc.split_pattern(pc.replace_substring_regex(b.column(0), '[\r"]', ""), ",")
            flat, ends = cells.flatten(), cells.offsets.to_numpy()
            rest = np.ones(len(flat), bool)
            rest[ends[:-1]] = False                   # a line has one cell at least, its item
            item, own = flat.take(pa.array(ends[:-1])), flat.filter(pa.array(rest))
            offsets = (ends - np.arange(len(ends))).astype(np.int32)
            # lines like the header: the class positions after the index column's name
            positions = np.zeros(len(b), bool)
            for i in np.flatnonzero(~pc.match_substring_regex(item, "^[0-9]+$").to_numpy(zero_copy_only=False)):
                got = own.slice(offsets[i], offsets[i + 1] - offsets[i]).to_pylist()
                positions[i] = got == [str(k) for k in range(len(got))]
            blank = pc.match_substring_regex(own, "^ *$")
            if pc.any(blank).as_py():
                own = pc.if_else(blank, None, own)
            try:
                scores, cells = pa.ListArray.from_arrays(pa.array(offsets), pc.cast(own, pa.float64())), pa.nulls(len(b), pa.list_(pa.string()))
            except pa.ArrowInvalid:                   # numbers that only Spark reads, or none
                scores, cells = pa.nulls(len(b), pa.list_(pa.float64())), pa.ListArray.from_arrays(pa.array(offsets), own)
            yield pa.RecordBatch.from_arrays([models.take(file.indices), item, pa.array(positions), scores, cells],
                                             names=["model", "item", "positions", "scores", "cells"])

    lines = raw.select("value", F.input_file_name().alias("file")).mapInArrow(
        split, "model string, item string, positions boolean, scores array<double>, cells array<string>")
    # the index column's name is no number (a data row of whole scores may read 5,0,1)
    header = F.col("positions") & F.trim("item").try_cast("double").isNull()
    rows = lines.filter(~header).select(
        F.col("item").cast("long").alias("item_id"), "model", F.coalesce("scores", F.col("cells").cast("array<double>")).alias("scores"))
    return rows.filter(F.size("scores") > 0)


def read_truth(spark: SparkSession, path: str, by_position: bool = False,
               value_type: str = "int") -> DataFrame:
    """Ground truth ``(item_id, label)`` from a CSV with an index column and
    column ``0``.  ``by_position`` numbers the rows in file order instead of
    trusting the index (a shuffled index written by a split)."""
    raw = spark.read.option("header", True).csv(path)
    value = F.col(f"`{raw.columns[1]}`").cast(value_type).alias("label")
    if not by_position:
        return raw.select(F.col(f"`{raw.columns[0]}`").cast("long").alias("item_id"), value)
    if len(raw.inputFiles()) != 1:
        raise ValueError("positions are defined within one file")
    # place in the file: splits are dealt by size, so their order comes from
    # the blocks' offsets; ids within a split rise with the lines
    at = F.monotonically_increasing_id()
    numbered = raw.select(F.col("_metadata.file_block_start").alias("block"), at.alias("at"), value)
    blocks = numbered.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)   # a row for each split
    blocks = blocks.select("block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    return numbered.join(F.broadcast(blocks), "block").select(
        (F.col("ahead") + F.col("at") - F.col("first")).alias("item_id"), "label")


def read_parquet_many(spark: SparkSession, *paths: str) -> DataFrame:
    """Several parquet files as one table (one scan, schema merged by name)."""
    return spark.read.option("mergeSchema", True).parquet(*paths)


def read_delimited(spark: SparkSession, path: str, sep: str = ";", header: bool = True,
                   schema: str | None = None) -> DataFrame:
    reader = spark.read.option("sep", sep).option("header", header)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(path)


# ------------------------------------------------------------------ sinks

def write_scores(scores_long: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """One folder per model (``model=<name>``); readers prune models by path."""
    scores_long.write.mode(mode).partitionBy("model").format(fmt).option("header", True).save(path)


def write_wide_scores_csv(scores_long: DataFrame, n_classes: int, path: str, mode: str = "overwrite") -> None:
    """Score matrices in the per-model CSV layout (index, 0..C-1), one folder
    ``model=<name>`` per model; ``read_written_scores`` reads them back."""
    wide = scores_long.groupBy("item_id", "model").agg(*[
        F.max(F.when(F.col("cls") == k, F.col("score"))).alias(str(k)) for k in range(n_classes)])
    wide.write.mode(mode).partitionBy("model").option("header", True).csv(path)


def write_score_dir(scores_long: DataFrame, models, n_classes: int, path: str, mode: str = "overwrite") -> None:
    """A score directory: for each of the models a folder ``<model>_scores.csv``
    of CSV files (index, 0..C-1), written in parallel.  The matrices of all
    models come from one grouping, written once by model; so the rows are made
    and shuffled once, whatever the number of models."""
    spark, models = scores_long.sparkSession, list(models)
    index = F.array_position(json_literal(models, "array<string>"), F.col("model")).cast("int")
    wide = scores_long.filter(F.col("model").isin(models)).groupBy("item_id", "model").agg(*[
        F.max(F.when(F.col("cls") == k, F.col("score"))).alias(str(k)) for k in range(n_classes)])
    wide = wide.select(index.alias("_model"), "item_id", *[F.col(f"`{k}`") for k in range(n_classes)])
    staged = scratch_dir(spark, f"rankmix_score_dir_{uuid.uuid4().hex[:12]}")
    wide.write.partitionBy("_model").parquet(staged)
    rows = spark.read.schema(wide.schema).parquet(staged)
    for m in models:
        own = rows.filter(F.col("_model") == models.index(m) + 1).drop("_model")
        own.write.mode(mode).option("header", True).csv(f"{path}/{m}{SCORES_SUFFIX}")
    remove_folder(spark, staged)


def read_written_scores(spark: SparkSession, path: str) -> DataFrame:
    """``(item_id, model, cls, score)`` from what ``write_wide_scores_csv`` wrote."""
    raw = spark.read.option("header", True).csv(path)
    names = [c for c in raw.columns if c not in ("item_id", "model")]
    cells = F.posexplode(F.array(*[F.col(f"`{c}`").cast("double") for c in sorted(names, key=int)]))
    return raw.select(F.col("item_id").cast("long"), F.col("model").cast("string"), cells.alias("cls", "score"))


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Reports (performance table, diversity log, labels, truth)."""
    df.write.mode(mode).format(fmt).option("header", True).save(path)
