"""Aggregate expressions with explicit null rules.

SQL aggregates skip nulls. Several jobs need the other rule (one null makes the result null), count
null as a value of its own, or want 0 instead of null for an empty selection. Jobs use these functions
and not the bare SQL aggregates, so that the rule can be read at the call.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sum_strict(x: Column | str) -> Column:
    """Sum that is null as soon as one value is null, and 0 over no rows."""
    x = _col(x)
    return F.when(F.count_if(x.isNull()) == 0, F.coalesce(F.sum(x), F.lit(0.0)))


def mean_strict(x: Column | str) -> Column:
    """Mean that is null as soon as one value is null."""
    x = _col(x)
    return F.when(F.count_if(x.isNull()) == 0, F.avg(x))


def mean_present(x: Column | str) -> Column:
    """Mean of the values that are present."""
    return F.avg(_col(x))


def sum_where(cond: Column, x: Column | str) -> Column:
    """Sum over the rows where ``cond`` holds: 0 for no such row, null if one of them is null."""
    x = _col(x)
    total = F.coalesce(F.sum(F.when(cond, x)), F.lit(0.0))
    return F.when(F.count_if(cond & x.isNull()) == 0, total)


def n_distinct(x: Column | str, count_null: bool = True) -> Column:
    """Number of distinct values; null counts as one more value unless ``count_null`` is off."""
    x = _col(x)
    known = F.count_distinct(x)
    if not count_null:
        return known
    return known + F.coalesce(F.max(x.isNull().cast("bigint")), F.lit(0).cast("bigint"))


def n_distinct_where(cond: Column, x: Column | str) -> Column:
    """Number of distinct values among the rows where ``cond`` holds, null counted as a value."""
    x = _col(x)
    null_seen = F.max(F.coalesce(cond & x.isNull(), F.lit(False)).cast("bigint"))
    return F.count_distinct(F.when(cond, x)) + F.coalesce(null_seen, F.lit(0).cast("bigint"))


def first_by(x: Column | str, order: Column | str) -> Column:
    """The value of the row that comes first under ``order`` (an order makes the result repeatable)."""
    return F.min_by(_col(x), _col(order))


def the_value(x: Column | str) -> Column:
    """The value of a column that is constant within the group."""
    return F.any_value(_col(x))


def standard_error(x: Column | str) -> Column:
    """Standard error of the mean over the values that are present."""
    x = _col(x)
    return F.try_divide(F.stddev_samp(x), F.sqrt(F.count(x).cast("double")))


def percent_of(part: Column | str, whole: Column | str, digits: int = 2) -> Column:
    """``sum(part)`` as a percentage of ``sum(whole)``, rounded half to even."""
    share = F.try_divide(sum_strict(part), sum_strict(whole)) * 100
    return F.bround(share, digits)
