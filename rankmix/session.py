"""Session helpers: a configured SparkSession and the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "rankmix") -> SparkSession:
    """Return a session tuned for fusion workloads.

    On a cluster the builder simply attaches to the existing session; the
    settings below only fill in what is unset.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (builder
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC")
               # keep generated methods under the JIT's 8 KB bytecode limit:
               # larger ones would run interpreted, several times slower
               .config("spark.sql.codegen.hugeMethodLimit", "8000")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; when it is unset a local
    session gets a private folder, and a cluster an error: executors on other
    machines could not read such a folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not configured:
        configured = tempfile.mkdtemp(prefix="rankmix-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def default_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint directory for written tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, name)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def tune_session(spark: SparkSession) -> None:
    """Runtime SQL settings the fusion plans rely on, applied only where the
    session still has Spark's defaults (a caller's explicit choice wins)."""
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit", "65535") == "65535":
        # generated methods above the JIT's 8 KB bytecode limit run interpreted
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
