"""Corrections of a table by hand, as a table of their own, with an account of what became of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fathomline.operators.relational import join_on
from fathomline.sources.tables import stored

SET, ADD, REMOVE = "set", "add", "remove"
APPLIED, NO_ROW, PRESENT, AMBIGUOUS, UNKNOWN = "applied", "no row", "already there", "ambiguous", "unknown operation"


def apply_corrections(table: DataFrame, patches: DataFrame, on: list[str], op: str = "op") -> tuple[DataFrame, DataFrame]:
    """The corrected table, and an account (keys, op, outcome, n_rows) with a row per key and operation.

    ``patches`` has the keys, the operation (set, add, remove) and any of the table's columns. ``set`` gives
    the columns that are not null to all rows of the key, ``add`` makes a row of a key that has none, ``remove``
    takes all rows of a key away. Keys match null-safely. A key with several patches is ambiguous and left
    alone, and so is one with another operation. The account shows patches that met no row, that would have
    added a present key, and how many rows each of the others changed.
    """
    table, patches = stored(table, "corrected"), stored(patches, "patches")
    values = [c for c in patches.columns if c not in (*on, op)]
    strange = [c for c in values if c not in table.columns]
    if strange:
        raise ValueError(f"patches have columns that the table lacks: {strange}")
    alone = patches.groupBy(*on).agg(
        F.count(F.lit(1)).alias("_patches"), F.min(F.struct(F.col(op).alias("op"), *values)).alias("_p")
    )
    usable = alone.where((F.col("_patches") == 1) & F.col("_p.op").isin(SET, ADD, REMOVE)).select(*on, "_p")
    # one column that is never null tells rows of the table from those that only a patch has
    marked = table.withColumn("_row", F.lit(True))
    joined = join_on(marked, usable, on, "full", null_safe=True)
    present, kind = F.col("_row").isNotNull(), F.col("_p.op")
    keep = F.when(present, ~F.coalesce(kind == REMOVE, F.lit(False))).otherwise(kind == ADD)
    changed = {
        c: F.when(present & kind.eqNullSafe(F.lit(SET)), F.coalesce(F.col(f"_p.`{c}`"), F.col(f"`{c}`")))
        .when(~present, F.col(f"_p.`{c}`"))
        .otherwise(F.col(f"`{c}`"))
        for c in values
    }
    corrected = joined.where(keep).withColumns(changed).select(*[f"`{c}`" for c in table.columns])
    met = join_on(table.select(*on), alone.select(*on), on, "left_semi", null_safe=True).groupBy(*on).agg(F.count(F.lit(1)).alias("_met"))
    each = patches.select(*on, F.col(op).alias("op")).groupBy(*on, "op").agg(F.count(F.lit(1)).alias("_same"))
    looked = join_on(join_on(each, alone.select(*on, "_patches"), on, "left", null_safe=True), met, on, "left", null_safe=True)
    n = F.coalesce("_met", F.lit(0).cast("bigint"))
    outcome = (
        F.when(F.col("_patches") > 1, AMBIGUOUS)
        .when(~F.coalesce(F.col("op").isin(SET, ADD, REMOVE), F.lit(False)), UNKNOWN)
        .when((F.col("op") == ADD) & (n > 0), PRESENT)
        .when((F.col("op") != ADD) & (n == 0), NO_ROW)
        .otherwise(APPLIED)
    )
    account = looked.withColumn("outcome", outcome).select(
        *on,
        "op",
        "outcome",
        F.when(F.col("outcome") != APPLIED, 0).when(F.col("op") == ADD, 1).otherwise(n).cast("bigint").alias("n_rows"),
    )
    return corrected, account
