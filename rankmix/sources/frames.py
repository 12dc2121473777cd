"""Conversions between long score tables and per-item score sets."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmix.functions import avg_rank_desc, json_literal
from rankmix.model import ScoreSet, r_col, s_col
from rankmix.session import default_partitions, scratch_dir


# Items grouped at once where a score set has no batches.
BLOCK_ITEMS = 2048


def to_wide(scores: DataFrame, models: list[str] | tuple[str, ...] | None = None,
            n_classes: int | None = None, truth: DataFrame | None = None,
            batch_size: int | None = None, partitions: int | None = None) -> ScoreSet:
    """Long ``(item_id, model, cls, score)``, or ``(item_id, model, scores)`` with the
    classes' scores in order, -> one row per item.

    One shuffle: rows (and the truth, as a pseudo-model) are clustered by
    ``batch_id`` (blocks of ids when no ``batch_size`` is given); the per-item
    grouping is made in the tasks, a batch at a time, without other exchange or join.  ``models``/``n_classes`` are metadata; when omitted they are
    read with one small aggregate (distinct models, max class).
    """
    spark = scores.sparkSession
    by_line = "scores" in scores.columns
    if models is None or n_classes is None:
        top = F.max(F.size("scores") - 1 if by_line else "cls").alias("c")
        meta = scores.groupBy("model").agg(top).collect()      # a row for each model
        models = models or tuple(sorted(r["model"] for r in meta if r["model"] is not None))
        n_classes = n_classes or max(r["c"] for r in meta if r["c"] is not None) + 1
    models = tuple(models)
    mi = _model_index(models).alias("mi")
    if by_line:
        places = F.sequence(F.lit(0), F.size("scores") - 1)
        packed = scores.filter(F.size("scores") > 0).select("item_id", mi, places.alias("cls"), F.col("scores").cast("array<double>").alias("score"))
    else:
        packed = _packed(scores.select("item_id", mi, F.col("cls").cast("int").alias("cls"), F.col("score").cast("double").alias("score")))
    has_label = truth is not None
    if has_label:
        # the truth rides along as model -1 through the same shuffle: the
        # label is picked up by the grouping below, no join on item_id
        packed = packed.unionByName(truth.select("item_id", F.lit(-1).alias("mi"), F.array(F.lit(-1)).alias("cls"),
                                                 F.array(F.col("label").cast("double")).alias("score")))
    keys = ["item_id"] if batch_size is None else ["batch_id", "item_id"]
    block = F.floor(F.col("item_id") / F.lit(batch_size or BLOCK_ITEMS))
    packed = packed.select(block.alias("batch_id"), "item_id", "mi", "cls", "score")
    packed = packed.repartition(partitions or default_partitions(spark), "batch_id")
    names = [*keys, *[s_col(i) for i in range(len(models))], *(["label"] if has_label else [])]
    id_type = packed.schema["item_id"].dataType.simpleString()
    schema = ", ".join([f"batch_id {packed.schema['batch_id'].dataType.simpleString()}"] * (batch_size is not None)
                       + [f"item_id {id_type}"] + [f"{s_col(i)} array<double>" for i in range(len(models))]
                       + ["label int"] * has_label)
    m, c = len(models), n_classes
    wide = packed.groupBy("batch_id").applyInArrow(lambda t: _item_rows(t, m, c, has_label).select(names), schema)
    # no item is dropped: without scores its arrays hold NULLs, without truth
    # its label is NULL (check_score_set counts both)
    return ScoreSet(df=wide, models=models, n_classes=n_classes, has_label=has_label,
                    batch_size=batch_size)


def _model_index(models) -> Column:
    return F.array_position(json_literal(list(models), "array<string>"), F.col("model")).cast("int") - 1


def _packed(rows: DataFrame) -> DataFrame:
    """``(item_id, mi, cls, score)`` rows that follow each other with one item and
    model as one row with the lists ``cls`` and ``score``: a matrix read from lines
    is shuffled by lines, not by cells."""
    def run(batches):
        for b in batches:
            if not len(b):
                continue
            item, mi = (b.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy() for i in (0, 1))
            starts = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (mi[1:] != mi[:-1])]))
            offsets = pa.array(np.append(starts, len(b)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(starts)), b.column(1).take(pa.array(starts)),
                 pa.ListArray.from_arrays(offsets, b.column(2)), pa.ListArray.from_arrays(offsets, b.column(3))],
                names=["item_id", "mi", "cls", "score"])

    id_type = rows.schema["item_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"item_id {id_type}, mi int, cls array<int>, score array<double>")


def _item_rows(table: pa.Table, m: int, c: int, has_label: bool) -> pa.Table:
    """One row for every item of the packed rows: position k of a model's array
    is class k, whichever rows are there -- a missing score is NULL in its place,
    a class that comes twice raises -- and the label is the largest one."""
    table = table.combine_chunks()
    ids = table.column("item_id").combine_chunks().dictionary_encode(null_encoding="encode")
    ids = ids if isinstance(ids, pa.DictionaryArray) else ids.combine_chunks()
    n, row = len(ids.dictionary), ids.indices.to_numpy()
    sizes = table.column("cls").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    at = np.repeat(row, sizes)
    mi = np.repeat(table.column("mi").combine_chunks().fill_null(-2).to_numpy(zero_copy_only=False), sizes)
    cls = table.column("cls").combine_chunks().flatten()
    scores = table.column("score").combine_chunks().flatten()
    valid = np.asarray(scores.is_valid())
    values = scores.fill_null(0.0).to_numpy(zero_copy_only=False)
    if np.asarray(cls.is_null())[mi >= 0].any():
        raise ValueError("a score has no class")
    k = cls.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    batch = table.column("batch_id").combine_chunks()
    cols = [batch.take(pa.array(np.zeros(n, np.int64))), ids.dictionary]
    names = ["batch_id", "item_id"]
    for i in range(m):
        own = mi == i
        place = at[own].astype(np.int64) * (k.max(initial=0) - min(k.min(initial=0), 0) + 1) + k[own]
        if len(np.unique(place)) < len(place):
            raise ValueError("DUPLICATED_MAP_KEY: an item has two scores of one model and class")
        inside = own & (k >= 0) & (k < c)
        out, known = np.zeros(n * c), np.zeros(n * c, bool)
        to = at[inside].astype(np.int64) * c + k[inside]
        out[to], known[to] = values[inside], valid[inside]
        data = pa.array(out, mask=~known, from_pandas=False)
        cols.append(pa.ListArray.from_arrays(pa.array(np.arange(0, n * c + 1, c, dtype=np.int32)), data))
        names.append(s_col(i))
    if has_label:
        own = (mi == -1) & valid
        label = np.full(n, -np.inf)
        np.maximum.at(label, at[own], values[own])
        known = np.isfinite(label)
        cols.append(pa.array(np.where(known, label, 0).astype(np.int32), mask=~known))
        names.append("label")
    return pa.table(cols, names=names)


def to_long(ss: ScoreSet, ranks: bool = False) -> DataFrame:
    """Score set -> ``(item_id, model, cls, score[, rank])``."""
    cols = []
    for i, m in enumerate(ss.models):
        fields = [F.lit(m).alias("model"), F.col(s_col(i)).alias("v")]
        if ranks:
            fields.append(F.col(r_col(i)).alias("r"))
        cols.append(F.struct(*fields))
    df = ss.df.select("item_id", F.explode(F.array(*cols)).alias("m"))
    df = df.select("item_id", F.col("m.model").alias("model"),
                   F.posexplode(F.arrays_zip(*(["m.v", "m.r"] if ranks else ["m.v"]))))
    out = [F.col("item_id"), F.col("model"), F.col("pos").alias("cls"),
           F.col("col").getField("v").alias("score")]
    if ranks:
        out.append(F.col("col").getField("r").alias("rank"))
    return df.select(*out)


def with_batches(ss: ScoreSet, batch_size: int, partitions: int | None = None) -> ScoreSet:
    """Add ``batch_id = floor(item_id / batch_size)`` and cluster rows by it.

    A batch holds at most ``batch_size`` items, so the key is never skewed;
    per-batch weights, first items and min/max then need no further shuffle.
    """
    if ss.batch_size == batch_size:
        return ss
    n = partitions or default_partitions(ss.df.sparkSession)
    df = ss.df.withColumn("batch_id", F.floor(F.col("item_id") / F.lit(batch_size)))
    df = df.repartition(n, "batch_id")
    return ss.with_df(df, batch_size=batch_size)


def with_batch_ids(ss: ScoreSet, batch_size: int) -> ScoreSet:
    """``with_batches`` without clustering the rows: enough for what needs the
    first items of batches only."""
    if ss.batch_size == batch_size:
        return ss
    return ss.with_df(ss.df.withColumn("batch_id", F.floor(F.col("item_id") / F.lit(batch_size))), batch_size=batch_size)


def with_ranks(ss: ScoreSet) -> ScoreSet:
    """Average ranks (1 = best, ties averaged) next to every score array."""
    if ss.has_ranks:
        return ss
    df = ss.df.select("*", *[avg_rank_desc(F.col(s_col(i))).alias(r_col(i))
                             for i in range(ss.n_models)])
    return ss.with_df(df, has_ranks=True)


def materialize(ss: ScoreSet, partitions: int | None = None, name: str | None = None) -> ScoreSet:
    """Write the batched rows once as a table bucketed by ``batch_id`` in the
    shared checkpoint folder and read it back.

    The bucketed scan reports hash partitioning on ``batch_id``, so every
    later join or aggregate on ``batch_id`` runs without an exchange, all
    branches read the same files (no recomputation of the input), and a lost
    executor re-reads files instead of replaying the lineage.
    """
    spark = ss.df.sparkSession
    n = partitions or default_partitions(spark)
    tag = name or uuid.uuid4().hex[:12]
    table = f"rankmix_scores_{tag}"
    (ss.df.write.mode("overwrite").bucketBy(n, "batch_id").format("parquet")
     .option("path", scratch_dir(spark, table)).saveAsTable(table))
    return ss.with_df(spark.table(table), table=table)


def release(ss: ScoreSet) -> None:
    """Drop the table that ``materialize`` wrote for this score set, and its
    files; frames derived from it cannot be executed any more."""
    if ss.table is None:
        return
    spark = ss.df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {ss.table} PURGE")
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark, ss.table))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
