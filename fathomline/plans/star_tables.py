"""The roles of the risk data played by the star-schema test tables, as DataFrames.

``oracle_views`` states the same views as plain SQL. Here they are written for Spark: filters come first,
and a side is made distinct before it is joined.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from fathomline.plans.native import status_label
from fathomline.plans.production import apportion_zones
from fathomline.plans.pathogens import pathogenic_score
from fathomline.plans.scores import (
    agents_of,
    invasive_score_of,
    label_unit_zones,
    overall_risk_of,
    production_scores_of,
    zone_scores,
    zone_species_profile,
)
from fathomline.plans.traits import trait_index
from fathomline.session import folder_bytes, size_shuffles
from fathomline.sources.tables import stage

UNIT = ["species", "country", "area"]
KEYS = ["p_partkey", "s_suppkey", "c_custkey", "s_nationkey", "c_nationkey"]

# Stand-ins for the fixed values of the real data.
SYNONYMS = {"hot ring": "cold ring", "red rod": "new rod"}
TAXON_GROUPS = {"Parasites": ["LARGE", "SMALL"], "Others": ["PROMO", "MEDIUM"]}

# Corner offsets of a zone: a concave outline and a hole, both closed.
OUTLINE = [(0, 0), (50, 0), (30, 10), (50, 24), (0, 24), (0, 0)]
HOLE = [(5, 5), (15, 5), (15, 15), (5, 15), (5, 5)]

# Edges of a small concave and convex pair of zones around the origin.
EDGES = [
    ("Z1", -0.4, -0.4, 0.0, -0.4),
    ("Z1", 0.0, -0.4, 0.0, 0.0),
    ("Z1", 0.0, 0.0, -0.4, 0.0),
    ("Z1", -0.4, 0.0, -0.4, -0.4),
    ("Z2", 0.0, 0.0, 0.4, 0.0),
    ("Z2", 0.4, 0.0, 0.2, 0.1),
    ("Z2", 0.2, 0.1, 0.4, 0.4),
    ("Z2", 0.4, 0.4, 0.0, 0.4),
    ("Z2", 0.0, 0.4, 0.0, 0.0),
]


# Declared, so that no scan has to look into a file to be planned.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,
                 o_orderdate timestamp_ntz, o_orderpriority string""",
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,
                   l_extendedprice double, l_discount double, l_tax double, l_returnflag string,
                   l_linestatus string, l_shipdate timestamp_ntz""",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


class StarTables:
    """The test tables below ``path`` and the views on them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._tables: dict[str, DataFrame] = {}
        self._bytes = 0

    def table(self, name: str) -> DataFrame:
        """A table; shuffles are sized by those that have been asked for."""
        if name not in self._tables:
            file = f"{self.path}/{name}.parquet"
            self._tables[name] = self.spark.read.schema(SCHEMAS[name]).parquet(file)
            self._bytes += folder_bytes(self.spark, file)
            size_shuffles(self.spark, self._bytes)
        return self._tables[name]

    # production -----------------------------------------------------------------------------------

    @cached_property
    def fact(self) -> DataFrame:
        """Lines with the year and customer of their order."""
        orders = self.table("orders").select(
            F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("yr")
        )
        lines = self.table("lineitem").select(
            "l_orderkey",
            F.col("l_partkey").alias("p_partkey"),
            F.col("l_suppkey").alias("s_suppkey"),
            F.col("l_linestatus").alias("environment"),
            F.col("l_quantity").alias("quantity"),
        )
        return lines.join(orders, "l_orderkey").drop("l_orderkey")

    @cached_property
    def dimensions(self) -> list[tuple[DataFrame, str]]:
        """Each table joins on its own, so that the planner sees the size of each file."""
        nation = self.table("nation")
        species = self.table("part").select(
            "p_partkey",
            F.col("p_brand").alias("species"),
            F.col("p_name").alias("sci_name"),
            F.upper("p_name").alias("spp_name"),
            F.col("p_type").alias("major_group"),
        )
        country = nation.select(
            F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("country"), F.col("n_regionkey").alias("area")
        )
        zone = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("zone"))
        return [
            (species, "p_partkey"),
            (self.table("supplier").select("s_suppkey", "s_nationkey"), "s_suppkey"),
            (self.table("customer").select("c_custkey", "c_nationkey"), "c_custkey"),
            (country, "s_nationkey"),
            (zone, "c_nationkey"),
        ]

    @cached_property
    def production(self) -> DataFrame:
        return self._joined(self.fact, self.dimensions)

    def _joined(self, rows: DataFrame, dimensions: list[tuple[DataFrame, str]]) -> DataFrame:
        for dimension, key in dimensions:
            rows = rows.join(dimension, key).drop(key)
        return rows

    @cached_property
    def profile(self) -> DataFrame:
        """All that units, their zones and native ranges need of the fact, per unit and zone.

        One pass over the fact with one partially aggregated shuffle; the three views below read the
        stored result and not the fact. Grouped by nation keys: their names are looked up afterwards, on
        the groups.
        """
        *_, country, zone = self.dimensions
        profile = self._unit_zones()
        return stage(self._joined(profile, [country, zone]), "profile")

    def _unit_zones(self) -> DataFrame:
        marine, year, quantity = F.col("environment") == "O", F.col("yr"), F.col("quantity")
        averaged = marine & (year > 1996)
        *tables, _, _ = self.dimensions
        return self._joined(self.fact, tables).groupBy("species", "s_nationkey", "c_nationkey").agg(
            F.sum(F.when(averaged, quantity)).alias("total"),
            F.count(F.when(averaged, quantity)).alias("n"),
            F.max(marine & (year > 1999) & (quantity >= 45)).alias("farmed"),
            F.max((F.col("environment") == "F") & (year < 1997) & (quantity >= 49)).alias("native"),
        )

    @cached_property
    def unit(self) -> DataFrame:
        mean = F.try_divide(F.sum("total"), F.sum("n"))
        return self.profile.groupBy(*UNIT).agg(mean.alias("mean_prod")).where(F.col("mean_prod") > 0)

    @cached_property
    def unit_zone(self) -> DataFrame:
        """Units in the zones they are farmed in."""
        return self.unit.join(self.profile.where("farmed").select(*UNIT, "zone"), UNIT)

    @cached_property
    def native(self) -> DataFrame:
        return self.profile.where("native").select("species", "zone").distinct()

    @cached_property
    def status(self) -> DataFrame:
        """Apportioned and labelled production, stored as several scores read it."""
        return stage(status_label(apportion_zones(self.unit_zone, UNIT), self.native), "status")

    # zones ----------------------------------------------------------------------------------------

    @cached_property
    def zones(self) -> DataFrame:
        half = F.when(F.col("n_nationkey") < 13, "-A").otherwise("-B")
        return (
            self.table("nation")
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("n_name").alias("zone"),
                F.concat("r_name", half).alias("province"),
                F.col("r_name").alias("realm"),
            )
        )

    @cached_property
    def zone_shapes(self) -> DataFrame:
        """Zones with rings: one block of a 5 x 5 grid per nation."""
        x0 = F.lit(-170.0) + 68 * (F.col("n_nationkey") % 5)
        y0 = F.lit(-70.0) + 28 * F.floor(F.col("n_nationkey") / 5)
        ring = lambda corners: F.array(
            *[F.struct((x0 + dx).cast("double").alias("x"), (y0 + dy).cast("double").alias("y")) for dx, dy in corners]
        )
        return self.table("nation").select(F.col("n_name").alias("zone"), F.array(ring(OUTLINE), ring(HOLE)).alias("rings"))

    @cached_property
    def zone_layer(self) -> DataFrame:
        return self.zones.join(self.zone_shapes, "zone")

    @cached_property
    def origin_zones(self) -> DataFrame:
        """The zones around the origin with their rings."""
        start = {}
        for zone, x1, y1, _, _ in EDGES:
            start.setdefault(zone, []).append((x1, y1))
        point = lambda p: F.struct(F.lit(p[0]).alias("x"), F.lit(p[1]).alias("y"))
        rows = [
            F.struct(F.lit(zone).alias("zone"), F.array(F.array(*[point(p) for p in ring])).alias("rings"))
            for zone, ring in start.items()
        ]
        return self.spark.range(1).select(F.inline(F.array(*rows)))

    @cached_property
    def vector_points(self) -> DataFrame:
        """Points from the first two components of the embeddings."""
        return self.table("embeddings").select(
            "vec_id",
            "label",
            F.element_at("embedding", 1).cast("double").alias("lon"),
            F.element_at("embedding", 2).cast("double").alias("lat"),
        )

    @cached_property
    def occurrences(self) -> DataFrame:
        """One occurrence point per line, spread by its price over a quarter of the globe that its species has."""
        part = self.table("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("species"))
        price = F.col("l_extendedprice")
        west = F.lit(67.5) * (F.replace("species", F.lit("Brand#"), F.lit("")).cast("int") % 5) - 180
        return (
            self.table("lineitem")
            .select("l_partkey", (price % 90).alias("east"), ((price * 7) % 160 - 80).alias("lat"))
            .join(part, "l_partkey")
            .select("species", (F.col("east") + west).alias("lon"), "lat")
        )

    # pathogens and traits -------------------------------------------------------------------------

    @cached_property
    def carriers(self) -> DataFrame:
        """Associations as they come, with repeats."""
        agent = F.concat_ws("-", "p_type", (F.col("p_size") % 10).cast("string"))
        carriers = self.table("part").where(~F.col("p_brand").isin("Brand#1", "Brand#2"))
        return carriers.select(F.col("p_brand").alias("species"), agent.alias("agent"), F.col("p_type").alias("taxon"))

    @cached_property
    def agents(self) -> DataFrame:
        return self.carriers.distinct()

    @cached_property
    def traits(self) -> DataFrame:
        k = F.when(F.col("species") != "Brand#3", F.col("mean_size"))
        return (
            self.table("part")
            .groupBy(F.col("p_brand").alias("species"))
            .agg(
                F.max("p_size").cast("double").alias("max_length"),
                F.avg("p_retailprice").alias("troph"),
                F.avg("p_size").alias("mean_size"),
            )
            .select("species", "max_length", "troph", k.alias("k"))
        )

    @cached_property
    def index(self) -> DataFrame:
        return trait_index(stage(self.traits, "traits"))

    # scores ---------------------------------------------------------------------------------------

    @cached_property
    def zone_profile(self) -> DataFrame:
        """Labelled production per (zone, species), stored: all scores are aggregates of it.

        Straight from the fact, by nation keys; the zones get their names last.
        """
        labelled = label_unit_zones(self._unit_zones(), ["species", "s_nationkey"], "c_nationkey")
        profile = zone_species_profile(labelled, zone="c_nationkey")
        return stage(self._joined(profile, self.dimensions[-1:]), "zone-profile")

    @cached_property
    def scores(self) -> DataFrame:
        return production_scores_of(self.zone_profile)

    @cached_property
    def invasive(self) -> DataFrame:
        return invasive_score_of(self.zone_profile, self.index)

    @cached_property
    def pathogenic(self) -> DataFrame:
        return pathogenic_score(agents_of(self.zone_profile, self.carriers), self.scores)

    @cached_property
    def risk(self) -> DataFrame:
        return overall_risk_of(zone_scores(self.zone_profile, self.index, self.carriers), self.zones)

    @cached_property
    def staged_risk(self) -> DataFrame:
        return stage(self.risk, "risk")
