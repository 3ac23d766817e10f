"""Rows that come from elsewhere than a scan: keyed enrichment and inline constants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def enrich(keys: DataFrame, table: DataFrame, on: str | list[str], drop_missing: bool = False) -> DataFrame:
    """Attach the records a trait table holds for each key.

    A key with several records gives several rows; one with none gives a row of nulls, or no row with
    ``drop_missing``. The table's size decides the join strategy (broadcast below Spark's threshold).
    """
    return keys.join(table, on, "inner" if drop_missing else "left")


def constant_rows(spark: SparkSession, fixed: dict[str, str], column: str, values: list[str]) -> DataFrame:
    """One row per value, with the ``fixed`` columns repeated on each."""
    scalars = [F.lit(v).alias(name) for name, v in fixed.items()]
    listed = F.explode(F.array(*[F.lit(v) for v in values])).alias(column)
    return spark.range(1).select(*scalars, listed)
