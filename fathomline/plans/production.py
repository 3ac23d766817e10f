"""Production: star join, species screening, mean production per unit, apportionment over zones.

A unit is what one country produces of one species in one area; it is spread over one or more zones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fathomline.functions import fixed_values as fixed
from fathomline.functions.aggregates import mean_present
from fathomline.functions.scalars import is_binomial, recode
from fathomline.operators.relational import group_distinct, group_share, join_on, keep_members


def star_production(
    fact: DataFrame, dimensions: list[tuple[DataFrame, str]], synonyms: dict[str, str] | None = None
) -> DataFrame:
    """The production fact with its dimensions, and species names in one spelling.

    Names are recoded here, before anything is selected by name.
    """
    for table, key in dimensions:
        fact = join_on(fact, table, key, "left")
    names = fixed.PRODUCTION_SYNONYMS if synonyms is None else synonyms
    return fact.withColumn("sci_name", recode("sci_name", names))


def top_species(
    star: DataFrame,
    environment: object = fixed.MARINE,
    major_group: str = fixed.FISH_GROUP,
    year_after: int = fixed.SCREEN_YEAR_AFTER,
    min_quantity: float = fixed.SCREEN_MIN_QUANTITY,
    min_countries: int = 0,
    country: str = "iso3",
    several: str = "spp",
) -> DataFrame:
    """Species of a group in an environment with more than ``min_quantity`` mean production.

    Two steps of grouping give the number of countries (a null country counts as one) without spreading
    the fact over distinct sets: (name, country) first, then name.
    """
    rows = star.where(
        (F.col("environment") == environment)
        & (F.col("major_group") == major_group)
        & (F.col("yr") > year_after)
        & is_binomial("sci_name", several)
    )
    totals = rows.groupBy("sci_name", "spp_name", country).agg(
        F.sum("quantity").alias("total"), F.count("quantity").alias("n")
    )
    return _screened(totals, min_quantity, min_countries, country)


def _screened(totals: DataFrame, min_quantity: float, min_countries: int, country: str) -> DataFrame:
    """Names whose mean over ``totals`` (sums and counts of any finer groups) is large enough."""
    per_country = totals.groupBy("sci_name", "spp_name", country).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    per_name = per_country.groupBy("sci_name", "spp_name").agg(
        F.try_divide(F.sum("total"), F.sum("n")).alias("mean_quantity"),
        F.count(F.lit(1)).alias("n_countries"),
    )
    return (
        per_name.where((F.col("n_countries") > min_countries) & (F.col("mean_quantity") > min_quantity))
        .withColumnRenamed("sci_name", "species")
        .orderBy(F.desc_nulls_last("mean_quantity"))
    )


def production_profile(star: DataFrame, by: list[str], environment: object, year_after: int) -> DataFrame:
    """Sums and counts of the quantity of an environment's later years: one pass for screening and means."""
    rows = star.where((F.col("environment") == environment) & (F.col("yr") > year_after))
    return rows.groupBy(*by).agg(F.sum("quantity").alias("total"), F.count("quantity").alias("n"))


def top_of_profile(
    profile: DataFrame, major_group: str, min_quantity: float, min_countries: int = 0, country: str = "iso3",
    several: str = "spp",
) -> DataFrame:
    """``top_species`` from a stored profile."""
    rows = profile.where((F.col("major_group") == major_group) & is_binomial("sci_name", several))
    return _screened(rows, min_quantity, min_countries, country)


def mean_of_profile(profile: DataFrame, species: DataFrame, by: list[str]) -> DataFrame:
    """``mean_production`` of the selected species from a stored profile."""
    named = profile.withColumnRenamed("sci_name", "study_species")
    kept = keep_members(named, species.withColumnRenamed("species", "study_species"), "study_species")
    means = kept.groupBy("study_species", *by).agg(F.try_divide(F.sum("total"), F.sum("n")).alias("mean_prod"))
    return means.where(F.col("mean_prod") > 0)


def study_production(star: DataFrame, species: DataFrame, environment: object = fixed.MARINE) -> DataFrame:
    """The fact rows of the selected species in an environment."""
    rows = star.where(F.col("environment") == environment).withColumnRenamed("sci_name", "study_species")
    return keep_members(rows, species.withColumnRenamed("species", "study_species"), "study_species")


def study_of_profile(
    fact: DataFrame,
    dimensions: list[tuple[DataFrame, str]],
    species: DataFrame,
    environment: object = fixed.MARINE,
    synonyms: dict[str, str] | None = None,
) -> DataFrame:
    """``study_production`` for a short list of species, the first dimension being that of the species.

    The species table is cut down to the list first, so the fact loses the other rows at its first join and
    not after the whole star.
    """
    (named, key), *others = dimensions
    names = fixed.PRODUCTION_SYNONYMS if synonyms is None else synonyms
    recoded = named.withColumn("study_species", recode("sci_name", names)).drop("sci_name")
    chosen = keep_members(recoded, species.withColumnRenamed("species", "study_species"), "study_species")
    rows = join_on(fact.where(F.col("environment") == environment), chosen, key, "inner")
    for table, other in others:
        rows = join_on(rows, table, other, "left")
    return rows


def mean_production(
    production: DataFrame, by: list[str], year_after: int = fixed.MEAN_YEAR_AFTER, quantity: str = "quantity"
) -> DataFrame:
    """Mean yearly production per unit over the years after ``year_after``; units without any are left
    out."""
    means = production.where(F.col("yr") > year_after).groupBy(*by).agg(mean_present(quantity).alias("mean_prod"))
    return means.where(F.col("mean_prod") > 0)


def numeric_code(df: DataFrame, code: str, out: str) -> DataFrame:
    """Add a code as a number; text that is no number becomes null."""
    return df.withColumn(out, F.col(code).try_cast("int"))


def apportion_zones(unit_zone: DataFrame, by: list[str]) -> DataFrame:
    """Split the production of each unit evenly over its zones."""
    counted = group_distinct(unit_zone, by, "zone", "n_zones")
    return counted.withColumn("zone_prod", F.col("mean_prod") / F.col("n_zones"))


def apportion_by_ratio(zone_weight: DataFrame, unit: DataFrame, by: list[str], weight: str = "weight") -> DataFrame:
    """Split the production of each unit over its zones in proportion to a weight per zone."""
    shares = group_share(zone_weight, by, weight, "ratio")
    return join_on(shares, unit, by, "inner").withColumn("zone_prod", F.col("mean_prod") * F.col("ratio"))
