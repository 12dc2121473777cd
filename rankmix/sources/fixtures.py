"""Score tables derived from the driver's TPC-H-like tables.

F-ORD: five frequency scorers on ``orders`` (5 classes = order priority).
Each model scores an order by the in-sample class shares of the orders that
share its feature value.  F-REG: three mean-target regressors on ``orders``.

The per-feature lookup tables are aggregates with partial (map-side)
aggregation; they are broadcast only where the feature domain is bounded by
the TPC-H definitions (segments, nations, months, status x year, price
buckets), never for customer keys.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmix.model import ScoreSet, s_col
from rankmix.session import ensure_checkpoint_dir

# Names of the F-ORD scorers and their number of classes.
FORD_MODELS = ("A", "B", "C", "D", "E")
FORD_CLASSES = 5
# Names of the F-REG regressors.
FREG_MODELS = ("P", "Q", "R")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ford_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: item_id, label and the five feature values."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
        "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment",
                                                       "c_nationkey")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    return joined.select(
        F.col("o_orderkey").alias("item_id"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("label"),
        F.col("c_mktsegment").cast("string").alias("f0"),
        F.col("c_nationkey").cast("string").alias("f1"),
        F.month("o_orderdate").cast("string").alias("f2"),
        F.concat(F.col("o_orderstatus"), F.year("o_orderdate").cast("string")).alias("f3"),
        F.floor(F.col("o_totalprice") / 10000).cast("int").cast("string").alias("f4"),
    )


def _share_lookups(items: DataFrame, n_models: int, n_classes: int) -> DataFrame:
    """``(mi, f, shares)``: for every model's feature value the ARRAY of class
    shares (count of class / count) — all models in one pass and one
    partially aggregated shuffle."""
    feats = F.explode(F.array(*[F.struct(F.lit(i).alias("mi"), F.col(f"f{i}").alias("f"))
                                for i in range(n_models)]))
    long = items.select("label", feats.alias("x")).select("x.mi", "x.f", "label")
    counts = [F.sum(F.when(F.col("label") == k, 1).otherwise(0)).alias(f"n{k}")
              for k in range(n_classes)]
    agg = long.groupBy("mi", "f").agg(F.count(F.lit(1)).alias("t"), *counts)
    shares = F.array(*[F.col(f"n{k}").cast("double") / F.col("t").cast("double")
                       for k in range(n_classes)])
    return agg.select("mi", "f", shares.alias("shares"))


def ford_wide(spark: SparkSession, sf_dir: str) -> ScoreSet:
    """F-ORD as a score set: one row per order with s0..s4 score arrays."""
    items = ford_items(spark, sf_dir)
    # one row per (model, feature value): bounded by the TPC-H feature domains.
    # Checkpointed so the five per-model broadcasts read one aggregate (a
    # per-model filter would otherwise be pushed below it, five times).
    ensure_checkpoint_dir(spark)
    lookups = _share_lookups(items, len(FORD_MODELS), FORD_CLASSES).checkpoint(eager=True)
    df = items
    for i in range(len(FORD_MODELS)):
        # bounded feature domains (see module doc) -> broadcast is safe; the
        # five filters read the same aggregate, whose exchange is reused
        lookup = F.broadcast(lookups.filter(F.col("mi") == i).select(
            F.col("f").alias(f"f{i}"), F.col("shares").alias(s_col(i))))
        df = df.join(lookup, on=f"f{i}", how="inner")
    df = df.select("item_id", "label", *[s_col(i) for i in range(len(FORD_MODELS))])
    return ScoreSet(df=df, models=FORD_MODELS, n_classes=FORD_CLASSES, ids=items.select("item_id"))


def freg_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: item_id, target and the three grouping features."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus",
        "o_orderpriority")
    return orders.select(
        F.col("o_orderkey").alias("item_id"),
        F.col("o_totalprice").alias("target"),
        F.col("o_custkey").cast("string").alias("f0"),
        F.col("o_orderdate").cast("date").cast("string").alias("f1"),
        F.concat(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("f2"),
    )


def freg_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-REG: item_id, target, v0..v2 (mean target of the item's group)."""
    items = freg_items(spark, sf_dir)
    df = items
    for i in range(len(FREG_MODELS)):
        f = f"f{i}"
        # mean of 2-decimal prices from an exact integer sum of cents: the
        # value is the same whatever the partitioning or summation order
        cents = F.round(F.col("target") * 100).cast("bigint")
        lookup = items.groupBy(f).agg(
            ((F.sum(cents).cast("double") / F.count(F.lit(1)).cast("double")) / F.lit(100.0)).alias(f"v{i}"))
        if i > 0:
            # dates and status x priority: bounded domains -> broadcast
            lookup = F.broadcast(lookup)
        # customer keys grow with the data: shuffle join (AQE splits skew)
        df = df.join(lookup, on=f, how="inner")
    return df.select("item_id", "target", *[f"v{i}" for i in range(len(FREG_MODELS))])

