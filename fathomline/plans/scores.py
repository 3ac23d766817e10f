"""Scores per zone and the overall risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fathomline.functions import fixed_values as fixed
from fathomline.functions.aggregates import first_by
from fathomline.functions.scalars import label_ordinal, log10_plus1, recode
from fathomline.operators.relational import join_on, lead_columns
from fathomline.operators.rescale import minmax
from fathomline.plans.native import INTRODUCED, NATIVE
from fathomline.sources.tables import stage


def zone_species_profile(status: DataFrame, production: str = "zone_prod", zone: str = "zone") -> DataFrame:
    """All that the scores need of labelled production, one row per (zone, species).

    Sums by status, numbers of null productions by status, and whether the species occurs with the status.
    """
    is_status = {"native": F.col("status") == NATIVE, "introduced": F.col("status") == INTRODUCED}
    x = F.col(production)
    parts = [F.sum(x).alias("sum_total"), F.count_if(x.isNull()).alias("nulls_total")]
    for name, cond in is_status.items():
        parts += [
            F.max(F.when(cond, 1).otherwise(0)).alias(f"has_{name}"),
            F.sum(F.when(cond, x)).alias(f"sum_{name}"),
            F.count_if(cond & x.isNull()).alias(f"nulls_{name}"),
        ]
    return status.groupBy(zone, "species").agg(*parts)


def label_unit_zones(unit_zones: DataFrame, unit: list[str], zone: str = "zone") -> DataFrame:
    """Apportion and label in one pass what has been counted per (unit, zone): (species, zone, zone_prod, status).

    ``unit_zones`` has one row per unit (``species`` and the other columns of ``unit``) and zone: ``total`` and
    ``n`` (sum and number of its yearly quantities), ``farmed`` (it counts as a zone of the unit) and ``native``
    (the species is at home there). The mean of a unit goes evenly to its farmed zones, and a species is
    native in a zone if any of its units is. Windows do for these rows what joins do for larger ones: a unit
    has no more rows than there are zones, a species in a zone no more than there are units of it.
    """
    of_unit, of_place = W.partitionBy(*unit), W.partitionBy("species", zone)
    mean = F.try_divide(F.sum("total").over(of_unit), F.sum("n").over(of_unit))
    shared = unit_zones.withColumns({"_mean": mean, "_zones": F.count_if(F.col("farmed")).over(of_unit)})
    placed = shared.withColumn("_native", F.max("native").over(of_place)).where(F.col("farmed") & (F.col("_mean") > 0))
    status = F.when(F.col("_native"), NATIVE).otherwise(INTRODUCED)
    return placed.select("species", zone, (F.col("_mean") / F.col("_zones")).alias("zone_prod"), status.alias("status"))


def _production_figures() -> list[Column]:
    """Aggregates of a profile per zone. A null production makes the sum it belongs to null; an empty sum is 0."""
    total = lambda name: F.when(F.sum(f"nulls_{name}") == 0, F.coalesce(F.sum(f"sum_{name}"), F.lit(0.0)))
    return [
        F.count(F.lit(1)).alias("n_total"),
        F.sum("has_introduced").alias("n_introduced"),
        F.sum("has_native").alias("n_native"),
        total("total").alias("prod_total"),
        total("native").alias("prod_native"),
        total("introduced").alias("prod_introduced"),
    ]


def production_scores_of(profile: DataFrame) -> DataFrame:
    """Species counts, production by status and the genetic score per zone, from a profile."""
    per_zone = profile.groupBy("zone").agg(*_production_figures())
    return per_zone.withColumn("genetic_score", F.col("n_native") * log10_plus1("prod_native"))


def zone_production_scores(status: DataFrame, production: str = "zone_prod") -> DataFrame:
    """Species counts and production by status, and the genetic score, per zone.

    Grouped by (zone, species) first. The second grouping then counts rows where it would have to count
    distinct species three times, and the work for a large zone is spread over its species. A null
    species counts as one.
    """
    return production_scores_of(zone_species_profile(status, production))


def _invasive_figure() -> Column:
    """Aggregate of a profile with ``eco_ind``: sum of index times log10 of introduced production, 0 if one of
    them is missing."""
    produced = F.when(F.col("nulls_introduced") == 0, F.col("sum_introduced"))
    weighted = F.col("eco_ind") * log10_plus1(produced)
    introduced = F.col("has_introduced") == 1
    whole = F.when(F.count_if(introduced & weighted.isNull()) == 0, F.sum(F.when(introduced, weighted)))
    return F.coalesce(whole, F.lit(0.0))


def invasive_score_of(profile: DataFrame, index: DataFrame) -> DataFrame:
    """(zone, invasive_score) of all zones of a profile; the index has one row per species."""
    indexed = join_on(profile, index.select("species", "eco_ind"), "species", "left")
    return indexed.groupBy("zone").agg(_invasive_figure().alias("invasive_score"))


def agents_of(profile: DataFrame, associations: DataFrame) -> DataFrame:
    """(zone, n_pathogen) of all zones of a profile; a species without known pathogens counts as one."""
    carried = associations.select("species", "agent").distinct()
    pairs = join_on(profile.select("zone", "species"), carried, "species", "left")
    return pairs.select("zone", "agent").distinct().groupBy("zone").agg(F.count(F.lit(1)).alias("n_pathogen"))


def zone_scores(profile: DataFrame, index: DataFrame, associations: DataFrame) -> DataFrame:
    """All figures of a zone in one row: production, and the genetic, invasive and pathogenic score.

    Production and invasive score are one aggregate of the stored profile; the distinct agents are another.
    """
    indexed = join_on(profile, index.select("species", "eco_ind"), "species", "left")
    per_zone = indexed.groupBy("zone").agg(*_production_figures(), _invasive_figure().alias("invasive_score"))
    both = join_on(per_zone, agents_of(profile, associations), "zone", "left")
    return both.withColumns(
        {
            "genetic_score": F.col("n_native") * log10_plus1("prod_native"),
            "pathogenic_score": F.col("n_pathogen") * log10_plus1("prod_total"),
        }
    ).drop("n_pathogen")


def production_long(scores: DataFrame, zones: DataFrame) -> DataFrame:
    """Production per zone and status in thousands, one row each, where there is any."""
    ids = [c for c in scores.columns if c not in fixed.STATUS_LABELS]
    long = scores.unpivot(ids, list(fixed.STATUS_LABELS), "key", "value").where(F.col("value") > 0)
    joined = join_on(long, zones, "zone", "left")
    levels = sorted(fixed.STATUS_LABELS)
    return joined.withColumns(
        {
            "key": recode("key", fixed.STATUS_LABELS),
            "key_ord": label_ordinal("key", levels, reverse=True).cast("int"),
            "value": F.col("value") / 1000,
        }
    )


def overall_risk(scores: DataFrame, invasive: DataFrame, pathogenic: DataFrame, zones: DataFrame) -> DataFrame:
    """The three scores on a common scale of 0 .. 100 by square root and min-max, and their sum.

    Zones that only some of the tables have are kept.
    """
    return overall_risk_of(join_on(join_on(scores, invasive, "zone", "full"), pathogenic, "zone", "full"), zones)


def overall_risk_of(scores: DataFrame, zones: DataFrame) -> DataFrame:
    """The same from one table of all scores (``zone_scores``), one row per zone; it is staged, as the rescaling
    reads it twice."""
    staged = stage(scores, "zone-scores")
    roots = {
        "Genetic": F.sqrt("genetic_score"),
        "Invasive": F.sqrt("invasive_score"),
        "Diseases": F.sqrt("pathogenic_score"),
    }
    scaled = minmax(staged, roots, 0, 100).withColumn(
        "Overall", F.col("Genetic") + F.col("Invasive") + F.col("Diseases")
    )
    placed = join_on(scaled, zones.select("zone", "province", "realm"), "zone", "left")
    return lead_columns(
        placed, ["province", "zone", "realm"], ["genetic_score", "invasive_score", "pathogenic_score"]
    )


def score_long(risk: DataFrame) -> DataFrame:
    """The three scores one row each, with display label and its order."""
    ids = [c for c in risk.columns if c not in fixed.SCORE_LABELS]
    long = risk.unpivot(ids, list(fixed.SCORE_LABELS), "key", "value")
    levels = sorted(fixed.SCORE_LABELS)
    return long.withColumns(
        {
            "key": recode("key", fixed.SCORE_LABELS),
            "key_ord": label_ordinal("key", levels, reverse=True).cast("int"),
        }
    )


def zone_status_wide(status: DataFrame, order: list[str]) -> DataFrame:
    """Wide table per zone: counts, production by status and its transforms.

    ``status``, the flags and the transforms of single production are those of the zone's first row
    under ``order``.
    """
    rank = F.struct(*order)
    first = status.groupBy("zone").agg(
        first_by(F.struct("status", "introduced", "native", "zone_prod"), rank).alias("f")
    )
    totals = zone_production_scores(status)
    native, introduced, total = (F.col(f"mean_prod_{s}") for s in ("native", "introduced", "total"))
    wide = join_on(totals, first, "zone", "inner").withColumns(
        {f"mean_prod_{s}": F.col(f"prod_{s}") for s in ("native", "introduced", "total")}
    )
    return wide.select(
        "zone",
        "f.status",
        "f.introduced",
        "f.native",
        (F.col("n_native") + F.col("n_introduced")).alias("n_fish"),
        "n_introduced",
        "n_native",
        "mean_prod_native",
        "mean_prod_introduced",
        "mean_prod_total",
        F.when(total > 0, F.log10(total)).alias("log_mean_prod_total"),
        F.sqrt(total).alias("sqrt_mean_prod_total"),
        F.sqrt("f.zone_prod").alias("sqrt_prod"),
        log10_plus1("f.zone_prod").alias("log_prod"),
        F.sqrt(native).alias("sqrt_prod_native"),
        log10_plus1(native).alias("log_prod_native"),
        F.sqrt(introduced).alias("sqrt_prod_introduced"),
        log10_plus1(introduced).alias("log_prod_introduced"),
        "genetic_score",
    )
