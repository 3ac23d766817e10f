"""Exact quantiles and positions in a sort order, without sorting a table in one task.

Rows are dealt into ranges by sampled bounds and stored with the number of their range. Range sizes are few
and give the offset of each range, so only the rows of one range have to be ordered in one task. The
number of ranges follows the shuffle settings; the results are exact for any bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fathomline.sources.tables import stage, stored

_QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
SUMMARY = ["min", "q1", "median", "mean", "q3", "max"]


def _ranges(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` stored in ranges of the given order, with the number of each row's range as ``_range``."""
    return stage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), name)


def six_number_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Minimum, quartiles, mean and maximum of each column, and its number of nulls: one row per column.

    Quartiles interpolate linearly between the two nearest values. A column without values has nulls.
    Equal values are counted before they are dealt into ranges, so that a frequent one is one row.
    """
    names = ", ".join(f"({c!r})" for c in columns)
    listed = df.sparkSession.sql(f"SELECT * FROM VALUES {names} AS t(measure)")
    numbers = stored(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), "summary-input")
    # all columns in one row of aggregates: nothing is multiplied before they are combined
    figures = {"total": F.count, "min": F.min, "max": F.max, "mean": F.avg}
    one = numbers.agg(
        *[of(c).alias(f"{k}{i}") for i, c in enumerate(columns) for k, of in figures.items()],
        *[F.count_if(F.col(c).isNull()).alias(f"nulls{i}") for i, c in enumerate(columns)],
    )
    each = [
        F.struct(F.lit(c).alias("measure"), F.col(f"nulls{i}").alias("n_null"), *[F.col(f"{k}{i}").alias(k) for k in figures])
        for i, c in enumerate(columns)
    ]
    basics = stage(one.select(F.inline(F.array(*each))), "summary-basics")
    values = numbers.unpivot([], columns, "measure", "value").where(F.col("value").isNotNull())
    counted = values.groupBy("measure", "value").agg(F.count(F.lit(1)).alias("n"))
    ranged = _ranges(counted, [F.col("measure"), F.col("value")], "summary-ranges")
    # a row for each range and column: as many as there are ranges, and a few more
    running = W.partitionBy("measure").orderBy("_range")
    offsets = (
        ranged.groupBy("measure", "_range")
        .agg(F.sum("n").alias("size"))
        .withColumn("start", F.sum("size").over(running) - F.col("size"))
    )
    # the ranks (from 0) of the two values each quartile lies between
    position = lambda p: F.lit(p) * (F.col("total") - 1)
    wanted = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.lit(side).alias("side"),
                rounding(position(p)).cast("bigint").alias("rank"),
                (position(p) - F.floor(position(p))).alias("part"),
            )
            for name, p in _QUARTILES.items()
            for side, rounding in (("low", F.floor), ("high", F.ceil))
        ]
    )
    ranks = basics.where("total > 0").select("measure", F.inline(wanted))
    holds = (F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + F.col("size"))
    # six rows for each summarised column
    hits = stage(ranks.join(offsets, "measure").where(holds).drop("size"), "summary-hits")
    needed = hits.select("measure", "_range", "start").distinct()
    within = W.partitionBy("measure", "_range").orderBy("value")
    ordered = (
        ranged.join(F.broadcast(needed), ["measure", "_range"])
        .withColumn("upto", F.col("start") + F.sum("n").over(within))
        .select("measure", "_range", "value", (F.col("upto") - F.col("n")).alias("from"), "upto")
    )
    found = ordered.join(F.broadcast(hits.drop("start")), ["measure", "_range"]).where(
        (F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("upto"))
    )
    picked = lambda name, side, x: F.max(F.when((F.col("name") == name) & (F.col("side") == side), F.col(x)))
    low, high, part = (
        {name: picked(name, side, x) for name in _QUARTILES}
        for side, x in (("low", "value"), ("high", "value"), ("low", "part"))
    )
    quartiles = found.groupBy("measure").agg(
        *[(low[name] + part[name] * (high[name] - low[name])).alias(name) for name in _QUARTILES]
    )
    return listed.join(basics, "measure").join(quartiles, "measure", "left").select("measure", *SUMMARY, "n_null")


def ordinal(df: DataFrame, by: str, ties: list[str], out: str = "ord") -> DataFrame:
    """Add the position (from 1) of each row in ascending order of ``by``, nulls last; ``ties`` decide
    between equal values and spread them over ranges."""
    order = [F.asc_nulls_last(by), *[F.asc_nulls_last(c) for c in ties]]
    ranged = _ranges(df, order, "ordinal")
    # a row for each range
    running = W.partitionBy(F.lit(0)).orderBy("_range")
    offsets = (
        ranged.groupBy("_range")
        .agg(F.count(F.lit(1)).alias("_size"))
        .select("_range", (F.sum("_size").over(running) - F.col("_size")).alias("_start"))
    )
    within = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    placed = ranged.withColumn("_within", within).join(offsets, "_range")
    return placed.withColumn(out, F.col("_start") + F.col("_within")).drop("_range", "_within", "_start")


def positions(ordered: DataFrame, out: str = "position") -> DataFrame:
    """Add to a sorted DataFrame the place (from 1) at which each row comes."""
    return ordinal(ordered.withColumn("_id", F.monotonically_increasing_id()), "_id", [], out).drop("_id")
