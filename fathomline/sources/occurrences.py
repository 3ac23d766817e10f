"""Occurrence files: CSV with lines of prose and a header before the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fathomline.functions.fixed_values import OCCURRENCE_COLUMNS, OCCURRENCE_SYNONYMS, PROBABILITY_COLUMN
from fathomline.functions.scalars import recode
from fathomline.sources.headers import scan_by_header

BAD_COORDINATES, NO_HEADER = "bad coordinates", "no header"


def read_occurrences(
    spark: SparkSession, paths: str | list[str], synonyms: dict[str, str] = OCCURRENCE_SYNONYMS
) -> tuple[DataFrame, DataFrame]:
    """Points and problems of any number of occurrence files, whatever the order of their columns.

    Points are (species, lat, lon, probability, file), names recoded by ``synonyms``; a layout without a
    probability has nulls. Problems are (file, species, problem): rows below a header whose coordinates are no
    numbers, and files in which no header was found.
    """
    scan = scan_by_header(spark, paths, OCCURRENCE_COLUMNS, PROBABILITY_COLUMN)
    number = {c: F.col(c).try_cast("double") for c in ("lat", "lon", "probability")}
    rows = scan.rows.withColumns(number).withColumn("species", recode(F.concat_ws(" ", "genus", "epithet"), synonyms))
    good = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    problems = rows.where(~good).select("file", "species", F.lit(BAD_COORDINATES).alias("problem"))
    headless = scan.headless.select("file", F.lit(None).cast("string").alias("species"), F.lit(NO_HEADER).alias("problem"))
    return rows.where(good).select("species", "lat", "lon", "probability", "file"), problems.unionByName(headless)


def load_occurrences(
    spark: SparkSession, paths: str | list[str], synonyms: dict[str, str] = OCCURRENCE_SYNONYMS
) -> DataFrame:
    """Points (species, lat, lon, file) from any number of occurrence files, names recoded by ``synonyms``."""
    return read_occurrences(spark, paths, synonyms)[0].drop("probability")


def load_probabilities(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Points with a probability (species, lat, lon, probability, file), names as they are."""
    return read_occurrences(spark, paths, {})[0]


def as_points(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Mark two columns as a position on WGS84. No row is dropped; ``off_globe`` lists bad ones."""
    return df.withMetadata(lon, {"crs": 4326}).withMetadata(lat, {"crs": 4326})


def off_globe(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Rows whose coordinates are missing or outside the range of degrees."""
    on_globe = F.col(lon).between(-180, 180) & F.col(lat).between(-90, 90)
    return df.where(~F.coalesce(on_globe, F.lit(False)))
