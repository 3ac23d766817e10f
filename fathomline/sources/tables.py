"""Table scans and sinks: headered CSV, Parquet, staging and versioned overwrite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from fathomline.session import fresh_path
from fathomline.sources import versions

NULL_TEXT = "NA"


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType) -> DataFrame:
    """Scan headered CSV files under a declared schema; ``NA`` is null."""
    return spark.read.schema(schema).option("header", True).option("nullValue", NULL_TEXT).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Write headered CSV with null as ``NA``; an existing folder is replaced."""
    df.write.mode("overwrite").option("header", True).option("nullValue", NULL_TEXT).csv(path)


def read_dimension(
    spark: SparkSession, path: str, schema: StructType, renames: dict[str, str], keep: list[str]
) -> DataFrame:
    """Scan a code list, rename headers (old to new) and keep some columns."""
    return read_csv(spark, path, schema).withColumnsRenamed(renames).select(*keep)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new Parquet folder and return the scan of it.

    The stored table cuts the lineage (a lost executor costs a re-read and not a recomputation), lets
    several jobs share one result, and gives the planner the true size for its broadcast decision.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SCAN_NODES = {"Project", "Filter", "Relation", "LocalRelation"}


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` itself if it only scans stored data, else the staged result.

    For operators that read their input more than once and compare what they read: a sum of doubles may
    come out differently in its last digits when it is computed again.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    lines = plan.toString().splitlines()
    nodes = {line.lstrip(" :+-").split(" ")[0].split("[")[0] for line in lines if line.strip()}
    return df if plan.deterministic() and nodes <= _SCAN_NODES else stage(df, name)


def tee_csv(df: DataFrame, path: str, name: str = "tee") -> DataFrame:
    """Export ``df`` as CSV and hand it on: computed once, staged, exported from the stage."""
    staged = stage(df, name)
    write_csv(staged, path)
    return staged


def replace_table(df: DataFrame, base: str, after: int | None = None) -> DataFrame:
    """Store ``df`` as the next version of the table at ``base`` and return it.

    ``df`` may read the current version: a version is a folder of its own, so nothing that is being read is
    overwritten. With ``after``, the version that ``df`` was made from, the write is refused if another one
    has come since (``versions.Conflict``).
    """
    folder = versions.new_folder(base)
    df.write.mode("error").parquet(folder)
    versions.publish(df.sparkSession, base, folder, after)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def current_table(spark: SparkSession, base: str, schema: StructType) -> DataFrame:
    """Scan the latest version of a table stored by ``replace_table``, under a declared schema."""
    return spark.read.schema(schema).parquet(versions.current_folder(spark, base))
