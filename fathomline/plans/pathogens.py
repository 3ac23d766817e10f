"""Pathogens: taxon groups, pathogens per zone and the pathogenic score."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fathomline.functions import fixed_values as fixed
from fathomline.functions.aggregates import sum_strict
from fathomline.functions.scalars import collapse, log10_plus1
from fathomline.operators.relational import join_on
from fathomline.operators.rescale import table_value


def pathogen_types(associations: DataFrame, groups: dict[str, list[str]] | None = None) -> DataFrame:
    """Add the group each taxon belongs to."""
    return associations.withColumn("type", collapse("taxon", fixed.PATHOGEN_GROUPS if groups is None else groups))


def zone_agents(unit_zone: DataFrame, associations: DataFrame) -> DataFrame:
    """Distinct (zone, agent) over the species produced in each zone.

    A species without known pathogens contributes a null agent. Both sides are made distinct before the
    many-to-many join, so the fan-out is over species and agents and not over production rows.
    """
    produced = unit_zone.select("zone", "species").distinct()
    carried = associations.select("species", "agent").distinct()
    return join_on(produced, carried, "species", "left").select("zone", "agent").distinct()


def pathogens_by_zone(unit_zone: DataFrame, associations: DataFrame, count_null: bool = True) -> DataFrame:
    """Number of distinct pathogens per zone; the null agent counts as one unless ``count_null`` is off."""
    counted = F.count(F.lit(1)) if count_null else F.count("agent")
    return zone_agents(unit_zone, associations).groupBy("zone").agg(counted.alias("n_pathogen"))


def pathogen_map_table(per_zone: DataFrame, zones: DataFrame) -> DataFrame:
    """Pathogens per zone for all zones, null where nothing is produced."""
    return join_on(zones, per_zone, "zone", "left")


def pathogenic_score(per_zone: DataFrame, scores: DataFrame) -> DataFrame:
    """Number of pathogens times log10 of total production."""
    joined = join_on(per_zone, scores.select("zone", "prod_total"), "zone", "left")
    return joined.select("zone", (F.col("n_pathogen") * log10_plus1("prod_total")).alias("pathogenic_score"))


def pathogenic_score_sqrt(unit_zone: DataFrame, associations: DataFrame) -> DataFrame:
    """Earlier score per (species, zone): sum over production rows and associations of the number of
    agents times the square root of production, over 10,000.

    Each production row counts once per association of its species (once if there is none), and the
    number of agents depends on the species alone. So both sides are aggregated first and meet as one row
    per (species, zone); the fan-out itself is never built.
    """
    per_agent = associations.groupBy("species", "agent").agg(F.count(F.lit(1)).alias("_rows"))
    carried = per_agent.groupBy("species").agg(
        F.sum("_rows").alias("_n_rows"), F.count(F.lit(1)).alias("_n_agents")
    )
    produced = unit_zone.groupBy("species", "zone").agg(sum_strict(F.sqrt("mean_prod")).alias("_root"))
    one = F.lit(1).cast("bigint")
    weight = F.coalesce("_n_rows", one) * F.coalesce("_n_agents", one)
    joined = join_on(produced, carried, "species", "left")
    return joined.select("species", "zone", (weight * F.col("_root") / 1e4).alias("pathogenic_total"))


def score_on_all_zones(zones: DataFrame, score: DataFrame) -> DataFrame:
    """A score table for display: every zone, with nulls where there is no score."""
    return join_on(zones, score, "zone", "left")


def type_shares(associations: DataFrame) -> DataFrame:
    """Share (whole percent) of all distinct agents that belong to each type."""
    agents = associations.select("type", "agent").distinct()
    total = table_value(associations.select("agent").distinct(), F.count(F.lit(1)))
    share = F.bround(F.col("n_agents") / F.col("_total") * 100)
    counted = agents.groupBy("type").agg(F.count(F.lit(1)).alias("n_agents")).withColumn("_total", total)
    return counted.select("type", share.alias("share"))


def agents_per_species(associations: DataFrame) -> DataFrame:
    """Number of distinct agents per species (null counts as one)."""
    agents = associations.select("species", "agent").distinct()
    return agents.groupBy("species").agg(F.count(F.lit(1)).alias("n_agents"))
