"""Session settings and the shared folder for staged tables."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Runtime SQL settings the jobs count on. They are all adaptive-execution switches, so partition
# counts and join strategies follow the sizes measured at run time rather than numbers fixed here.
RUNTIME_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even when that costs one more shuffle after the join
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}

# Raw input per shuffle partition. Scans keep few columns and aggregates are combined before a shuffle,
# so a partition holds a small part of this.
INPUT_PER_PARTITION = 4 * 1024**3


def tune(spark: SparkSession, input_bytes: int = 0) -> SparkSession:
    """Apply ``RUNTIME_DEFAULTS`` to a session built elsewhere, where they are not in force yet."""
    for key, value in RUNTIME_DEFAULTS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    size_shuffles(spark, input_bytes)
    return spark


def size_shuffles(spark: SparkSession, input_bytes: int) -> None:
    """Let shuffles start from enough partitions for an input of this size; adaptive execution merges those
    that turn out small. 100 TB gives about 25,000."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    partitions = str(max(least, math.ceil(input_bytes / INPUT_PER_PARTITION)))
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if spark.conf.get(key, None) != partitions:
        spark.conf.set(key, partitions)


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Total size of the files below a path, from the file system's own summary."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(folder).getLength())


def local_session(cpus: str = "*", app: str = "fathomline", memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
    )
    spark = tune(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def staging_root(spark: SparkSession) -> str:
    """The folder staged tables are written to; driver and executors must all reach it.

    ``spark.checkpoint.dir`` names it, else the context's own checkpoint folder, else it lies in the
    warehouse, which every session shares with its executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/staged"


_scopes: list[list[str]] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the staging root that no earlier call returned."""
    path = f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder this library has written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def staged_until_done(spark: SparkSession) -> Iterator[None]:
    """Remove the tables staged inside the block when it ends: their results must have been used by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)
