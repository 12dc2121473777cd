"""Training rows as numpy blocks: what the solvers that pass over the rows many
times read.  A pass is one job without any query planning; its sums come back
as arrays."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

SUM_AT_ONCE = 64               # partial sums that the driver takes at once


def matrix(column: pa.Array) -> np.ndarray:
    """Equally long lists as rows of one array."""
    n = len(column)
    sizes = column.value_lengths()
    if column.null_count or column.flatten().null_count or len(sizes.unique()) > 1:
        raise ValueError("every row needs a feature vector, all of one size")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(n, -1)


def blocks(df: DataFrame, features: str = "features", label: str | None = None, item: str | None = None,
           fold: Column | None = None) -> RDD:
    """``(x, label, fold, ids)`` blocks, kept for the passes: x by row and feature,
    what was not asked for None.  ``unpersist`` them at the end."""
    none = F.lit(0)
    x = F.col(features) if isinstance(df.schema[features].dataType, ArrayType) else vector_to_array(features)
    rows = df.select(x.alias("x"), (F.col(label) if label else none).cast("double").alias("y"),
                     (none if fold is None else fold).cast("int").alias("fold"), F.col(item) if item else none.alias("id"))

    folded = fold is not None

    def pack(batches):
        for b in batches:
            if len(b):
                if b.column(1).null_count:
                    raise ValueError("a training row has no label")
                ids = pickle.dumps(b.column(3).to_pylist()) if item else b""
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], pa.binary()) for v in (pickle.dumps(matrix(b.column(0))), pickle.dumps(
                        b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)), pickle.dumps(
                        b.column(2).to_numpy(zero_copy_only=False)), ids)], names=["x", "y", "fold", "ids"])

    def load(r):
        return (pickle.loads(r.x), pickle.loads(r.y) if label else None, pickle.loads(r.fold) if folded else None,
                pickle.loads(r.ids) if item else None)

    packed = rows.mapInArrow(pack, "x binary, y binary, fold binary, ids binary")
    return packed.rdd.map(load).persist(StorageLevel.MEMORY_AND_DISK)


def summed(rdd: RDD, measure):
    """The sum of ``measure(block)`` (an array, or a tuple of them) over all blocks."""
    def part(items):
        out = None
        for b in items:
            got = measure(b)
            out = got if out is None else added(out, got)
        return [] if out is None else [out]

    parts = rdd.mapPartitions(part)
    if rdd.getNumPartitions() > SUM_AT_ONCE:
        return parts.treeReduce(added)
    got = parts.collect()
    if not got:
        raise ValueError("no rows to learn from")
    out = got[0]
    for x in got[1:]:
        out = added(out, x)
    return out


def added(a, b):
    return tuple(x + y for x, y in zip(a, b)) if isinstance(a, tuple) else a + b
