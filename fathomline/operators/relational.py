"""Joins, presence labels, repeated rows and top-n with ties."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fathomline.sources.tables import stored

_COPIES_PER_TASK_ROW = 100_000


def _keys(on: str | list[str]) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


def join_on(
    left: DataFrame, right: DataFrame, on: str | list[str], how: str = "left", null_safe: bool = False
) -> DataFrame:
    """Equi-join with one copy of the keys.

    With ``null_safe`` a null key matches a null key; the condition still hashes, so the physical join
    stays a hash or sort-merge join.
    """
    keys = _keys(on)
    if not null_safe:
        return left.join(right, keys, how)
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    joined = left.join(renamed, same, how)
    if how in ("full", "right"):
        joined = joined.withColumns({k: F.coalesce(k, f"_right_{k}") for k in keys})
    return joined.drop(*[f"_right_{k}" for k in keys])


def keep_members(rows: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key occurs in ``keys``; a null key is found if ``keys`` has one."""
    return join_on(rows, keys.select(*_keys(on)), on, "left_semi", null_safe=True)


def label_presence(
    rows: DataFrame,
    presence: DataFrame,
    on: str | list[str],
    label: str,
    present: str,
    absent: str,
) -> DataFrame:
    """Label each row by whether its key occurs in ``presence``.

    ``presence`` is made distinct first, so that rows are never multiplied. Rows are the preserved side,
    so a key that holds many of them is split by the adaptive skew join. (Plain keys would let the join
    reuse the partitioning of the distinct, and a side without a shuffle of its own cannot be split; the
    null-safe condition shuffles the distinct keys once more.)
    """
    marks = presence.select(*_keys(on)).distinct().withColumn("_present", F.lit(True))
    labelled = F.when(F.col("_present"), present).otherwise(absent)
    return join_on(rows, marks, on, "left", null_safe=True).withColumn(label, labelled).drop("_present")


def group_distinct(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Attach to each row the number of distinct ``value`` in its group (null counts as a value).

    Aggregate and join back: a window would hold a whole group in one task, while distinct pairs and
    their counts are partially aggregated before each shuffle.
    """
    counts = df.select(*by, value).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias(out))
    return join_on(df, counts, by, "left", null_safe=True)


def group_share(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Attach to each row its share of the group's sum of ``value`` (null when the sum is 0)."""
    totals = df.groupBy(*by).agg(F.sum(value).alias("_total"))
    joined = join_on(df, totals, by, "left", null_safe=True)
    return joined.withColumn(out, F.try_divide(F.col(value), F.col("_total"))).drop("_total")


def top_ties(df: DataFrame, by: list[str], weight: str, n: int) -> DataFrame:
    """The ``n`` heaviest rows per group and all rows tied with the last of them; null weights never.

    The weight of the n-th row is found on (group, weight) counts, of which at most ``n`` per group are
    looked at and pruned to that before the shuffle. Rows are then filtered against that limit, so no
    task ever holds the rows of a group or of a tie.
    """
    df = stored(df, "top")
    down = W.partitionBy(*by).orderBy(F.desc(weight))
    before = F.coalesce(F.sum("_n").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = df.where(F.col(weight).isNotNull()).groupBy(*by, weight).agg(F.count(F.lit(1)).alias("_n"))
    limits = (
        counts.withColumn("_k", F.row_number().over(down))
        .where(F.col("_k") <= n)
        .withColumn("_before", before)
        .where(F.col("_before") < n)
        .groupBy(*by)
        .agg(F.min(weight).alias("_limit"))
    )
    return join_on(df, limits, by, "inner", null_safe=True).where(F.col(weight) >= F.col("_limit")).drop("_limit")


def repeated_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Second and later occurrences of each combination of ``columns`` (only these columns).

    Occurrences of a combination are alike, so they are counted and emitted again from the count, spread
    over tasks in blocks when there are many.
    """
    extra = df.groupBy(*columns).agg((F.count(F.lit(1)) - 1).alias("_extra")).where(F.col("_extra") > 0)
    block = F.lit(_COPIES_PER_TASK_ROW)
    last = F.floor((F.col("_extra") - 1) / block)
    blocks = extra.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    size = F.least(block.cast("bigint"), F.col("_extra") - F.col("_block") * block)
    # a fixed number of partitions: a few bytes of counts become many rows, which sizes do not tell
    conf = df.sparkSession.conf
    tasks = int(
        conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
        or conf.get("spark.sql.shuffle.partitions")
    )
    spread = blocks.withColumn("_size", size).repartition(tasks, *columns, "_block")
    return spread.select(*columns, F.explode(F.sequence(F.lit(1).cast("bigint"), "_size"))).select(*columns)


def union_all(*frames: DataFrame) -> DataFrame:
    """Union by column name; a column some input lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def lead_columns(df: DataFrame, lead: list[str], drop: list[str] | None = None) -> DataFrame:
    """Put ``lead`` first, keep the other columns in order, leave out ``drop``."""
    out = set(lead) | set(drop or [])
    return df.select(*lead, *[c for c in df.columns if c not in out])


def column_range(df: DataFrame, first: str, last: str, *more: str) -> DataFrame:
    """Columns from ``first`` to ``last`` in table order, then ``more``."""
    names = df.columns
    return df.select(*names[names.index(first) : names.index(last) + 1], *more)
