"""Whole-table rescaling and imputation.

The table statistics enter as a scalar subquery: one aggregate row, computed with partial aggregation
and inlined as a literal. There is no join and no window over the whole table. The input is read twice,
so stage it when it is expensive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def table_value(df: DataFrame, aggregate: Column) -> Column:
    """One aggregate over ``df`` as a scalar column."""
    return df.agg(aggregate.alias("v")).scalar()


def minmax(
    df: DataFrame, columns: dict[str, Column | str], low: float = 0.0, high: float = 1.0, skip_null: bool = True
) -> DataFrame:
    """Add, for each output name, its expression rescaled linearly to ``low`` .. ``high``.

    With ``skip_null`` nulls are left out of the range and stay null; otherwise one null makes the whole
    column null. A constant column has no range and becomes null.
    """
    values = {out: F.col(x) if isinstance(x, str) else x for out, x in columns.items()}
    bounds = {}
    for out, x in values.items():
        usable = F.lit(True) if skip_null else F.count_if(x.isNull()) == 0
        bounds[f"lo_{out}"] = F.when(usable, F.min(x))
        bounds[f"hi_{out}"] = F.when(usable, F.max(x))
    row = F.struct(*[x.alias(name) for name, x in bounds.items()])
    with_bounds = df.withColumn("_b", table_value(df, row))
    scaled = {}
    for out, x in values.items():
        lo, hi = F.col(f"_b.lo_{out}"), F.col(f"_b.hi_{out}")
        scaled[out] = F.try_divide(x - lo, hi - lo) * (high - low) + low
    return with_bounds.withColumns(scaled).drop("_b")


def impute_mean(df: DataFrame, column: str) -> DataFrame:
    """Fill nulls of a column with the mean of its values."""
    return df.withColumn(column, F.coalesce(F.col(column), table_value(df, F.avg(column))))
