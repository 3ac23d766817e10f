"""CSV files with prose before a header row, whose columns stand in any order."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fathomline.operators.relational import join_on
from fathomline.sources.schemas import fields
from fathomline.sources.tables import stage

# Columns that are looked at in each row; a header beyond them is not found.
MOST_COLUMNS = 64


@dataclass
class HeaderScan:
    """``rows`` (file, place, one text column for each name) stand below the header of their file;
    ``headless`` (file) are the files in which no row holds all required names."""

    rows: DataFrame
    headless: DataFrame


def scan_by_header(
    spark: SparkSession,
    paths: str | list[str],
    names: dict[str, str],
    optional: dict[str, str] | None = None,
    most_columns: int = MOST_COLUMNS,
) -> HeaderScan:
    """Scan any number of files by the names in their headers (output name to header name).

    The header of a file is its first row that holds all ``names``; ``optional`` columns are null in files
    that lack them. All files are read in one scan and stored with the place of each row (start of its split,
    number within), so that large files may be split and rows before the header are told from those below it.
    The header positions are one row a file. Rows without any text are left out.
    """
    columns = [f"c{i}" for i in range(most_columns)]
    text = spark.read.schema(fields(", ".join(f"{c}:s" for c in columns))).csv(paths)
    cells = F.transform(F.array(*columns), lambda c: F.trim(c))
    located = text.select(
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_name").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("place"),
        F.slice(cells, 1, _used(cells)).alias("cells"),
    )
    stored = stage(located, "header-scan")
    wanted = {**names, **(optional or {})}
    is_header = reduce(Column.__and__, [F.array_contains("cells", F.lit(h)) for h in names.values()])
    # the place of each name counts from 1; 0 if the file has no such column
    position = {out: F.array_position("cells", F.lit(header)).cast("int").alias(f"_at_{out}") for out, header in wanted.items()}
    headers = (
        stored.where(is_header)
        .groupBy("_path")
        .agg(F.min_by(F.struct(F.col("place").alias("_header"), *position.values()), "place").alias("h"))
        .select("_path", "h.*")
    )
    headers = stage(headers, "headers")
    below = join_on(stored, headers, "_path", "inner").where((F.col("place") > F.col("_header")) & (F.size("cells") > 0))
    value = lambda out: F.when(F.col(f"_at_{out}") > 0, F.get("cells", F.col(f"_at_{out}") - 1)).alias(out)
    rows = below.select("file", "place", *[value(out) for out in wanted])
    headless = join_on(stored.select("_path", "file").distinct(), headers.select("_path"), "_path", "left_anti")
    return HeaderScan(rows, headless.select("file"))


def _used(cells: Column) -> Column:
    """Number of cells up to the last one that holds text."""
    numbered = F.transform(cells, lambda c, i: F.when(F.coalesce(F.length(c), F.lit(0)) > 0, i + 1).otherwise(0))
    return F.array_max(numbered)
