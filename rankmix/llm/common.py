"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmix.session import scratch_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
# The white space of the contracts, [\x20\x09-\x0D].
SPACES = " \t\n\x0b\f\r"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


@contextmanager
def session_setting(spark: SparkSession, key: str, value: str):
    """A session setting for the time of an action; the caller's comes back."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` once to the shared checkpoint folder and read
    it back, so later stages re-read files after a lost executor.  The write's
    shuffle files, which nothing reads again, go when it ends; texts reach Python
    workers in batches of BATCH_ROWS at most, which bounds their memory."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark, 'rankmix_llm')}/{name}-{uuid.uuid4().hex[:12]}"
    rows = int(spark.conf.get(_BATCH))
    with session_setting(spark, _CLEANUP, "true"), session_setting(spark, _BATCH, str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS)):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def removed(*tables: DataFrame) -> None:
    """Delete the files of tables that ``written`` made and nothing reads any more."""
    for t in tables:
        path = _PATHS.pop(t, None)
        if path:
            spark = t.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


_HELD: dict = {}


def per_worker(key, make):
    """What ``make`` builds, kept in this worker process for its next tasks.  Only
    the last key's stays: a worker goes from stage to stage and would otherwise
    hold the tables of all of them."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of an Arrow string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset:col.offset + n + 1]
    size = int(offsets[-1] - offsets[0])
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if size else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(sizes, limit: int):
    """Consecutive (start, end) index ranges whose sizes sum to about ``limit``;
    a single larger item forms a range of its own."""
    start, total = 0, 0
    for i, s in enumerate(sizes):
        if i > start and total + s > limit:
            yield start, i
            start, total = i, 0
        total += int(s)
    if len(sizes) > start:
        yield start, len(sizes)
