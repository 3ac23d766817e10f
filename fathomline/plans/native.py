"""Where species are native, and the status of their production in each zone."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fathomline.functions import fixed_values as fixed
from fathomline.operators.relational import join_on, label_presence, lead_columns, union_all
from fathomline.operators.spatial import points_in_cover
from fathomline.sources.enrich import constant_rows

NATIVE, INTRODUCED = "Native", "Introduced"


def native_presence(points: DataFrame, cover: DataFrame, cell: float = 1.0) -> DataFrame:
    """Zones in which a species occurs, from occurrence points and a stored zone cover.

    The rows of one (zone, species) all carry the same polygon, so its union over them is the zone
    itself and the distinct pairs are the result.
    """
    hits = points_in_cover(points.where(F.col("species").isNotNull()), cover, cell)
    return (
        hits.select("zone", "species")
        .distinct()
        .withColumns({"status": F.lit(NATIVE), "introductions": F.lit(None).cast("boolean")})
    )


def manual_native(spark, zone: str = fixed.MANUAL_NATIVE_ZONE, species: list[str] | None = None) -> DataFrame:
    """Native records that are not in the occurrence data."""
    names = fixed.MANUAL_NATIVE_SPECIES if species is None else species
    return constant_rows(spark, {"zone": zone}, "species", names)


def native_table(presence: DataFrame, manual: DataFrame, excluded: str = fixed.EXCLUDED_SPECIES) -> DataFrame:
    """Presence and manual records, without one species, labelled native."""
    both = union_all(presence.select("zone", "species"), manual.select("zone", "species"))
    return both.where(F.col("species") != excluded).withColumn("status", F.lit(NATIVE))


def status_label(unit_zone: DataFrame, native: DataFrame) -> DataFrame:
    """Label each unit in each zone native or introduced, with 0/1 flags."""
    known = unit_zone.where(F.col("mean_prod").isNotNull())
    labelled = label_presence(known, native, ["species", "zone"], "status", NATIVE, INTRODUCED)
    flag = lambda value: (F.col("status") == value).cast("int")
    return labelled.withColumn("introduced", flag(INTRODUCED)).withColumn("native", flag(NATIVE))


def status_with_hierarchy(status: DataFrame, zones: DataFrame, drop: list[str] | None = None) -> DataFrame:
    """Add realm and province of the zone in front and drop what later steps do not use."""
    hierarchy = zones.select("zone", "province", "realm")
    joined = join_on(status, hierarchy, "zone", "left")
    return lead_columns(joined, ["realm", "province", "zone"], drop or ["introduced", "native"])
