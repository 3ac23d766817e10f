"""Reports on the scores: totals, summaries, intervals, rankings and breakdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fathomline.functions.aggregates import mean_strict, percent_of, sum_strict
from fathomline.functions.student_t import t_quantile
from fathomline.operators.order import ordinal, six_number_summary
from fathomline.operators.relational import top_ties

__all__ = [
    "mean_ci",
    "province_means",
    "province_ranking",
    "six_number_summary",
    "species_breakdown",
    "status_totals",
    "top_zones",
]


def province_means(risk: DataFrame, by: list[str]) -> DataFrame:
    """Mean overall score per province, highest first."""
    means = risk.groupBy(*by).agg(mean_strict("Overall").alias("Overall"))
    return means.orderBy(F.desc_nulls_last("Overall"))


def province_ranking(risk: DataFrame) -> DataFrame:
    """Mean overall score per province and realm, lowest first, with the place in that order."""
    means = risk.groupBy("province", "realm").agg(mean_strict("Overall").alias("Overall"))
    return ordinal(means, "Overall", ["province", "realm"]).orderBy("ord")


def status_totals(risk: DataFrame) -> DataFrame:
    """Total production, by status, and the percentages of the total."""
    return risk.agg(
        sum_strict("prod_total").alias("total"),
        sum_strict("prod_native").alias("native"),
        sum_strict("prod_introduced").alias("introduced"),
        percent_of("prod_native", "prod_total").alias("percent_native"),
        percent_of("prod_introduced", "prod_total").alias("percent_introduced"),
    )


def mean_ci(df: DataFrame, columns: list[str], confidence: float = 0.95) -> DataFrame:
    """Mean, confidence limits (Student's t) and standard error of each column, one row per column; null
    if the column holds a null."""
    # all columns in one row of aggregates, then a row for each: nothing is multiplied before it is combined
    figures = {"n": F.count, "mean": F.avg, "sd": F.stddev_samp}
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    one = numbers.agg(
        *[of(c).alias(f"{k}{i}") for i, c in enumerate(columns) for k, of in figures.items()],
        *[F.count_if(F.col(c).isNull()).alias(f"nulls{i}") for i, c in enumerate(columns)],
    )
    each = [
        F.struct(F.lit(c).alias("measure"), F.col(f"nulls{i}").alias("nulls"), *[F.col(f"{k}{i}").alias(k) for k in figures])
        for i, c in enumerate(columns)
    ]
    stats = one.select(F.inline(F.array(*each)))
    complete = F.col("nulls") == 0
    error = F.when(complete, F.try_divide(F.col("sd"), F.sqrt(F.col("n").cast("double"))))
    margin = F.col("std_error") * t_quantile(F.col("n") - 1, confidence)
    return stats.withColumn("std_error", error).select(
        "measure",
        F.when(complete, F.col("mean")).alias("estimate"),
        (F.col("mean") - margin).alias("ci_lower"),
        (F.col("mean") + margin).alias("ci_upper"),
        "std_error",
    )


def top_zones(risk: DataFrame, group: str, score: str, n: int) -> DataFrame:
    """The ``n`` highest zones per group with ties, highest first."""
    best = top_ties(risk.select(group, "zone", score), [group], score, n)
    return best.orderBy(F.desc_nulls_last(score))


def species_breakdown(status: DataFrame, condition: Column, by: list[str]) -> DataFrame:
    """Production per species (and zone) over the rows meeting a condition, highest first."""
    sums = status.where(condition).groupBy(*by).agg(sum_strict("zone_prod").alias("production"))
    return sums.orderBy(F.desc_nulls_last("production"))
