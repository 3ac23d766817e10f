"""The queries of the driver contract: Spark callables and, where SQL can say it, their oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fathomline.plans.oracle_views import with_views
from fathomline.plans.star_tables import StarTables
from fathomline.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None, views: dict[str, str] | None = None):
    """Register a function from ``StarTables`` to a DataFrame under ``name``; ``views`` stand in for others in its SQL."""

    def add(build: Callable[[StarTables], DataFrame]):
        def run(spark: SparkSession, path: str) -> DataFrame:
            return build(StarTables(tune(spark), path))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = with_views(sql, views)
        return build

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round doubles: their last digits depend on the order of summation."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def rounded_sql(*columns: str, digits: int = 6) -> str:
    """The same in SQL, as a select list."""
    quoted = [f'"{c}"' for c in columns]
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in quoted)
