"""Whitened leading components of embeddings.

* A vector's entries become integers, ``floor(scale * c)`` (beyond 64 bits: the
  nearest 64-bit integer).  Rows whose vector is null, empty or holds a null or
  non-finite entry are left out, and so are vectors of another length than most
  rows have (ties: the longer one).
* Statistics are over each distinct vector once.  Sums are exact integers; each
  vector is centred (``(n * x - S) / n``, the numerator exact while it fits 64
  bits) before products are made, summed in tasks and added up by Spark, so only
  a matrix of the dimensions' size reaches the driver.
* The eigenpairs come from contour integration with inertia counts
  (``spectrum``).  Components whose eigenvalue is zero up to rounding have no
  whitened values; constant or single vectors so give no rows.
* ``deviation`` is exact; null where it does not fit 64 bits.

Repeated rows and ids repeat; a null id stays null.  An empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmix.llm.common import removed, written
from rankmix.llm.spectrum import leading_components

MOST = (1 << 63) - 1
BATCH_ENTRIES = 1 << 20


def integer_vectors(rows: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """``(id, x)`` of the rows that have a usable vector."""
    whole = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter(
        (F.size("v") > 0) & whole).select("id", F.transform("v", lambda c: F.floor(c * float(scale))).alias("x"))


def _matrix(col: pa.Array, dims: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _parts(batch: pa.RecordBatch, dims: int):
    step = max(1, BATCH_ENTRIES // dims)
    for at in range(0, len(batch), step):
        yield batch.slice(at, step)


def centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, bool]:
    """``n * x - S``, as 64-bit integers if they fit (and True), else as
    extended floats."""
    most = max(abs(s) for s in sums) + n * max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
    if most <= MOST:
        return n * x - np.array(sums, np.int64), True
    return np.longdouble(n) * x - np.array([np.longdouble(str(s)) for s in sums]), False


def deviations(x: np.ndarray, y: np.ndarray, exact: bool, n: int, sums: list[int]) -> pa.Array:
    """Exact ``sum((n * x - S)^2)`` of every vector; null beyond 64 bits."""
    if exact and y.size and int(np.abs(y).max()) ** 2 * y.shape[1] <= MOST:
        return pa.array((y * y).sum(axis=1), pa.int64())
    out = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return pa.array([v if v <= MOST else None for v in out], pa.int64())


def _sums(distinct: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of each dimension."""
    def run(batches):
        n, total = 0, [0] * dims
        for b in batches:
            for part in _parts(b, dims):
                x = _matrix(part.column(0), dims)
                n += len(x)
                if x.size and max(abs(int(x.min())), abs(int(x.max()))) * len(x) > MOST:
                    x = x.astype(object)
                total = [t + int(s) for t, s in zip(total, x.sum(axis=0))] if len(x) else total
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()),
             pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], names=["j", "n", "s"])

    rows = distinct.mapInArrow(run, "j int, n long, s decimal(38,0)").groupBy("j").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("j").collect()
    return (int(rows[0]["n"]), [int(r["s"]) for r in rows]) if rows else (0, [0] * dims)


def _products(distinct: DataFrame, dims: int, width: int, vectors_of) -> np.ndarray:
    """``sum(y y')`` over all vectors, with ``y = vectors_of(x)`` of that width:
    the sums of tasks are added up by Spark."""
    rows, cols = np.triu_indices(width)

    def run(batches):
        total = np.zeros((width, width))
        for b in batches:
            for part in _parts(b, dims):
                y = vectors_of(_matrix(part.column(0), dims))
                total += y.T @ y
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.int32()), pa.array(cols, pa.int32()), pa.array(total[rows, cols], pa.float64())],
            names=["i", "j", "v"])

    out = np.zeros((width, width))
    for r in distinct.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def whitened_components(rows: DataFrame, components: int = 4, scale: int = 256, id_col: str = "vec_id",
                        vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``
    of every usable row and component, from 1 by falling eigenvalue."""
    vectors = integer_vectors(rows, id_col, vec_col, scale)
    kind = vectors.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    distinct = written(vectors.select("x").distinct(), "whitening-distinct")
    sizes = vectors.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dims = int(sizes["d"]) if sizes else 1
    usable = F.size("x") == dims
    n, sums = _sums(distinct.filter(usable), dims)

    def centred_rows(x):
        y, _ = centred(x, n, sums)
        return (y / n).astype(np.float64)

    covariance = _products(distinct.filter(usable), dims, dims, centred_rows) / max(n, 1)
    values, axes = leading_components(covariance, components)
    k, trace = len(values), float(np.trace(covariance))
    project = axes / np.sqrt(values)
    # the whitened values' own covariance, measured over the same vectors (column 0: ones, for the means)
    spread = _products(distinct.filter(usable), dims, k + 1, lambda x: np.column_stack([np.ones(len(x)), centred_rows(x) @ project]))
    mean = spread[0, 1:] / max(n, 1)
    error = float(np.abs(spread[1:, 1:] / max(n, 1) - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))
    removed(distinct)

    def run(batches):
        for b in batches:
            for part in _parts(b, dims):
                m = len(part)
                x = _matrix(part.column(1), dims)
                y, exact = centred(x, n, sums)
                of = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(of), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                     pa.array(np.full(m * k, n), pa.int64()), deviations(x, y, exact, n, sums).take(of),
                     pa.array(((y / n).astype(np.float64) @ project).ravel(), pa.float64()),
                     pa.array(np.tile(values / trace if trace else values, m), pa.float64()),
                     pa.array(np.full(m * k, error), pa.float64())],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.filter(usable).mapInArrow(run, schema).withColumnRenamed("id", id_col)
