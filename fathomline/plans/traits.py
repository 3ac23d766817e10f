"""Species traits: invasiveness index and score, and summaries of nested trait records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fathomline.functions.aggregates import first_by, mean_present, mean_strict, sum_strict
from fathomline.functions.scalars import log10_plus1, mean_of, reciprocal
from fathomline.operators.components import principal_components
from fathomline.operators.relational import join_on
from fathomline.operators.rescale import table_value
from fathomline.plans.native import INTRODUCED
from fathomline.sources.enrich import enrich


def trait_index(traits: DataFrame) -> DataFrame:
    """Mean of growth rate, trophic level and maximum length, each rescaled to 0 .. 1; a missing growth
    rate takes the mean of the others. One row per species."""
    # the mean of k lies between its least and largest value, so filling it in does not change its range, and
    # one row of aggregates serves for both; a null in one of the others leaves that column without a range
    ranged = {"k": F.lit(True), "troph": F.count_if(F.col("troph").isNull()) == 0, "max_length": F.count_if(F.col("max_length").isNull()) == 0}
    figures = [F.avg("k").alias("mean_k")]
    for c, usable in ranged.items():
        figures += [F.when(usable, F.min(c)).alias(f"lo_{c}"), F.when(usable, F.max(c)).alias(f"hi_{c}")]
    with_figures = traits.withColumn("_f", table_value(traits, F.struct(*figures)))
    filled = with_figures.withColumn("k", F.coalesce("k", "_f.mean_k"))
    scaled = [F.try_divide(F.col(c) - F.col(f"_f.lo_{c}"), F.col(f"_f.hi_{c}") - F.col(f"_f.lo_{c}")) for c in ranged]
    return filled.withColumn("eco_ind", mean_of(*scaled)).drop("_f")


def trait_production(index: DataFrame, unit_zone: DataFrame) -> DataFrame:
    """Production per unit and zone with the traits of its species."""
    return join_on(unit_zone, index, "species", "left")


def ecological_score_mean(with_traits: DataFrame, zones: DataFrame) -> DataFrame:
    """Earlier score: mean trait index per zone (null if a species lacks one), for all zones."""
    means = with_traits.groupBy("zone").agg(mean_strict("eco_ind").alias("ecol_total"))
    return join_on(zones, means, "zone", "left")


def invasive_score(status: DataFrame, index: DataFrame, scored_zones: DataFrame) -> DataFrame:
    """Sum over introduced species of trait index times log10 of production, 0 for the other zones.

    A zone with an introduced species that lacks an index also gets 0. Production is summed per
    (zone, species) before the index (one row per species) is looked up.
    """
    per_species = (
        status.where(F.col("status") == INTRODUCED)
        .groupBy("zone", "species")
        .agg(sum_strict("zone_prod").alias("zone_prod"))
    )
    weighted = F.col("eco_ind") * log10_plus1("zone_prod")
    scores = (
        join_on(per_species, index.select("species", "eco_ind"), "species", "left")
        .groupBy("zone")
        .agg(sum_strict(weighted).alias("invasive_score"))
    )
    filled = F.coalesce("invasive_score", F.lit(0.0))
    return join_on(scores, scored_zones.select("zone"), "zone", "full").withColumn("invasive_score", filled)


def trait_means(records: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Mean of trait columns (output name to column) per species over the records present."""
    return records.groupBy("species").agg(*[mean_present(x).alias(out) for out, x in columns.items()])


def food_items(records: DataFrame, order: str, unidentified: str = "unident") -> DataFrame:
    """One food group per (species, food): that of the first record, without unidentified foods."""
    known = records.where(~F.contains("food", F.lit(unidentified)))
    return known.groupBy("species", "food").agg(first_by("food_group", order).alias("food_group"))


def related_records(keys: DataFrame, records: DataFrame, on: str) -> DataFrame:
    """The records filed under each key, one row each; keys without records drop out."""
    return enrich(keys, records, on, drop_missing=True)


def trait_pca(index: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Principal components of the traits, with the growth rate inverted."""
    inverted = index.withColumn("k_inv", reciprocal("k"))
    return principal_components(inverted, columns or ["max_length", "troph", "k_inv"])
