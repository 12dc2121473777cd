"""Data preparation before scoring (the examples' pandas / scikit-learn steps).

All are DataFrame expressions; the only driver round-trips are for
metadata that shapes the plan (the distinct categories of a column to
one-hot encode, the fitted imputation means) — bounded by the column's
cardinality, never by the row count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmix.operators.ranks import global_rank


def factorize(df: DataFrame, col: str, order_by: str, out: str | None = None) -> DataFrame:
    """Integer codes by first appearance (the row order is ``order_by``).

    Distinct values with their first position come from a grouped aggregate
    (partial aggregation); the code is that position's place among them, a
    global rank (range partitions and offsets, no single task).  The optimizer
    broadcasts the codes when they are small; else the join shuffles.  A NULL
    is no category and gets -1.
    """
    out = out or f"{col}_code"
    firsts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.min(order_by).alias("_first"))
    ranked = global_rank(firsts.withColumn("_all", F.lit(0)), "_all", ["_first", col], out)
    codes = ranked.select(col, (F.col(out) - 1).cast("int").alias(out))
    return df.join(codes, on=col, how="left").withColumn(out, F.coalesce(out, F.lit(-1)))


def categories(df: DataFrame, col: str, at_most: int = 1000) -> list:
    """Sorted distinct non-null values.  They become columns, so a column of
    more than ``at_most`` values raises instead of being collected."""
    rows = df.select(col).where(F.col(col).isNotNull()).distinct().limit(at_most + 1).collect()
    if len(rows) > at_most:
        raise ValueError(f"{col} has more than {at_most} values; pass those to encode")
    return sorted(r[0] for r in rows)


def one_hot(df: DataFrame, col: str, values: list | None = None, drop_first: bool = True,
            drop_source: bool = True) -> DataFrame:
    """``col_<value>`` 0/1 columns; the first (sorted) category is dropped; a
    NULL gives all zeros."""
    values = values if values is not None else categories(df, col)
    keep = values[1:] if drop_first else values
    cols = [F.when(F.col(col) == v, 1).otherwise(0).alias(f"{col}_{v}") for v in keep]
    out = df.select("*", *cols)
    return out.drop(col) if drop_source else out


def impute_mean(df: DataFrame, cols: list[str], suffix: str = "") -> DataFrame:
    """Replace NULLs with the column mean (``pyspark.ml.feature.Imputer``)."""
    from pyspark.ml.feature import Imputer
    outs = [c + suffix for c in cols] if suffix else cols
    casted = df.select(*[F.col(c).cast("double").alias(c) if c in cols else F.col(c) for c in df.columns])
    model = Imputer(inputCols=cols, outputCols=outs, strategy="mean").fit(casted)
    return model.transform(casted)


def hash_split(df: DataFrame, key: str, test_percent: int = 20, seed: int = 42,
               out: str = "is_test") -> DataFrame:
    """Deterministic train/test flag from a hash of the key: the same rows
    whatever the partitioning and the engine (a random split depends on it)."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8)
    return df.withColumn(out, F.conv(digits, 16, 10).cast("long") % 100 < test_percent)


def drop_null_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def scale(col: str, factor: float) -> Column:
    return F.col(col) / F.lit(float(factor))


def label_one_hot(col: str, n_classes: int) -> Column:
    """``to_categorical``: an int array with a 1 at the label's position."""
    return F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)),
                       lambda k: F.when(k == F.col(col), 1).otherwise(0))


def shift_labels(col: str, by: int = -1) -> Column:
    return (F.col(col) + F.lit(by)).cast("int")


def drop_trailing(df: DataFrame, n: int) -> DataFrame:
    return df.select(*df.columns[:-n])


def rename_positional(df: DataFrame, names: list[str]) -> DataFrame:
    return df.toDF(*names)


def attach_target(df: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Join a target by key; rows without one get NULL."""
    return df.join(target, on=key, how="left")


def detach_target(df: DataFrame, target: str, key: str) -> tuple[DataFrame, DataFrame]:
    """The features without the target, and ``(key, target)``."""
    return df.drop(target), df.select(key, target)


def cast_labels(col) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("int")


def suffix_or_member(df: DataFrame, col: str, suffix: str, members: list) -> DataFrame:
    return df.filter(F.col(col).endswith(suffix) | F.col(col).isin(members))


def split_by_value(df: DataFrame, col: str, value) -> tuple[DataFrame, DataFrame]:
    """The rows with that value and all others (NULL among them)."""
    same = F.col(col).eqNullSafe(F.lit(value))
    return df.filter(same), df.filter(~same)
