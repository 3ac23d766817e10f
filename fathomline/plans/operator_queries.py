"""Registered operators, at least one query for each, on the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fathomline.functions import aggregates as agg
from fathomline.functions import scalars
from fathomline.operators.corrections import apply_corrections
from fathomline.operators.dissolve import area, dissolve
from fathomline.operators.lookups import checked_lookup
from fathomline.operators.nested import all_values, nest, nest_tables, only_value, unnest
from fathomline.operators.order import ordinal, positions
from fathomline.operators.relational import (
    column_range,
    group_distinct,
    join_on,
    keep_members,
    label_presence,
    lead_columns,
    repeated_rows,
    top_ties,
    union_all,
)
from fathomline.operators.rescale import impute_mean, minmax, table_value
from fathomline.operators.spatial import join_points, points_in_cover, zone_cover
from fathomline.plans.job_queries import INSIDE_SQL, mean_ci_sql, occurrence_files, summary_sql
from fathomline.plans.layers import save_layer, with_geometry, without_geometry
from fathomline.plans.native import native_presence
from fathomline.plans.production import apportion_zones
from fathomline.plans.registry import register, rounded
from fathomline.plans.reports import mean_ci, six_number_summary
from fathomline.plans.star_tables import UNIT, StarTables
from fathomline.session import fresh_path
from fathomline.sources import schemas, versions
from fathomline.sources.enrich import constant_rows, enrich
from fathomline.sources.geojson import read_layer, write_layer
from fathomline.sources.occurrences import as_points, load_probabilities, off_globe, read_occurrences
from fathomline.sources.tables import (
    current_table,
    read_csv,
    read_dimension,
    replace_table,
    stage,
    tee_csv,
    write_csv,
)

_PART = schemas.fields("p_partkey:l, p_name:s, p_brand:s, p_type:s, p_size:i, p_retailprice:d")


def _sparse_part(t: StarTables) -> DataFrame:
    """Parts with nulls: no type for small parts, no size for promotional ones."""
    p_type = F.when(F.col("p_type") != "SMALL", F.col("p_type"))
    p_size = F.when(F.col("p_type") != "PROMO", F.col("p_size"))
    return t.table("part").withColumns({"p_type": p_type, "p_size": p_size})


_SPARSE = """(SELECT p_partkey, p_name, p_brand, nullif(p_type, 'SMALL') AS p_type,
    CASE WHEN p_type <> 'PROMO' THEN p_size END AS p_size, p_retailprice FROM part)"""


# sources and sinks --------------------------------------------------------------------------------


@register("s01_csv_scan_with_na", f"SELECT * FROM {_SPARSE}")
def _(t):
    path = fresh_path(t.spark, "part-csv")
    write_csv(_sparse_part(t), path)
    return read_csv(t.spark, path, _PART)


@register(
    "s02_star_load",
    """SELECT c_custkey, round(c_acctbal, 2) AS c_acctbal, c_nationkey, n_name AS country_name
       FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
)
def _(t):
    path = fresh_path(t.spark, "nation-csv")
    write_csv(t.table("nation"), path)
    renames = {"n_nationkey": "c_nationkey", "n_name": "country_name"}
    schema = schemas.fields("n_nationkey:i, n_name:s, n_regionkey:i")
    nation = read_dimension(t.spark, path, schema, renames, ["c_nationkey", "country_name"])
    fact = t.table("customer").select("c_custkey", "c_acctbal", "c_nationkey")
    return join_on(fact, nation, "c_nationkey", "left")


@register(
    "s04_probability_scan",
    """SELECT p_type || ' ' || p_brand AS species, p_size * 0.5::DOUBLE AS lat, p_size * 2.0::DOUBLE AS lon,
              round(p_size / 100, 6) AS probability FROM part""",
)
def _(t):
    size = F.col("p_size").cast("double")
    points = t.table("part").select(
        (F.col("p_partkey") % 2).cast("int").alias("file"),
        F.col("p_type").alias("genus"),
        F.col("p_brand").alias("epithet"),
        (size * 0.5).cast("string").alias("lat"),
        (size * 2).cast("string").alias("lon"),
        (size / 100).cast("string").alias("probability"),
    )
    header = ["Genus", "Species", "Center Lat", "Center Long", "C-Square Code", "Overall Probability"]
    path = occurrence_files(t, points, [header, header[::-1]])
    return rounded(load_probabilities(t.spark, path).drop("file"), "probability")


@register(
    "s03_scan_by_header",
    """SELECT p_type || ' ' || p_brand AS species, CASE WHEN p_size <> 13 THEN p_size * 0.5::DOUBLE END AS lat,
              CASE WHEN p_size <> 13 THEN p_size * 2.0::DOUBLE END AS lon,
              CASE WHEN p_size = 13 THEN 'bad coordinates' END AS problem FROM part""",
)
def _(t):
    """Two files whose columns stand in different orders; rows below the headers without a latitude are reported."""
    size = F.col("p_size").cast("double")
    points = t.table("part").select(
        (F.col("p_partkey") % 2).cast("int").alias("file"),
        F.col("p_type").alias("genus"),
        F.col("p_brand").alias("epithet"),
        F.when(size == 13, "unknown").otherwise((size * 0.5).cast("string")).alias("lat"),
        (size * 2).cast("string").alias("lon"),
    )
    layouts = [["Genus", "Species", "Center Lat", "Center Long", "Depth"], ["Depth", "Center Long", "Species", "SST", "Center Lat", "Genus"]]
    found, problems = read_occurrences(t.spark, occurrence_files(t, points, layouts))
    return union_all(found.drop("probability"), problems).drop("file")


@register("s05_nested_parquet", "SELECT conv_id, count(*) AS n_records, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def _(t):
    stored = stage(nest(t.table("conversations"), ["conv_id"], ["turn"], "records"), "nested")
    last = F.array_max(all_values("records", "turn"))
    return stored.groupBy("conv_id").agg(F.sum(F.size("records")).alias("n_records"), F.max(last).alias("last_turn"))


_SHAPE_SQL = """SELECT h.zone, h.realm, h.province, g.n_points, g.min_x, g.max_y
    FROM fx_zone h JOIN fx_geometry g ON h.zone = g.zone"""


def _figures(layer: DataFrame) -> DataFrame:
    points = F.flatten("rings")
    return layer.withColumns(
        {
            "n_points": F.size(points),
            "min_x": F.array_min(F.transform(points, lambda p: p["x"])),
            "max_y": F.array_max(F.transform(points, lambda p: p["y"])),
        }
    ).drop("rings", "parts")


@register("s06_geojson_scan", _SHAPE_SQL)
def _(t):
    path = fresh_path(t.spark, "zone-layer")
    write_layer(t.zone_layer, path)
    return _figures(read_layer(t.spark, path, schemas.fields("zone:s, realm:s, province:s")))


@register(
    "s07_geojson_sink",
    """SELECT c_custkey, n_name AS zone, c_acctbal, n_points, min_x, max_y
       FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN fx_geometry ON n_name = zone""",
)
def _(t):
    placed = t.table("customer").join(t.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    layer = with_geometry(placed.select("c_custkey", F.col("n_name").alias("zone"), "c_acctbal"), t.zone_shapes)
    return _figures(save_layer(layer, fresh_path(t.spark, "customer-layer")))


@register(
    "s07_parts_round_trip",
    "SELECT n_name AS zone, 2 AS n_parts, 2 AS n_rings_first, 1 AS n_rings_second, 3 AS n_rings FROM nation",
)
def _(t):
    """A zone of two parts, the first with a hole, through the layer sink and back."""
    islet = F.transform(F.get("rings", F.lit(0)), lambda p: F.struct((p["x"] + 90).alias("x"), p["y"].alias("y")))
    parted = t.zone_shapes.select("zone", "rings", F.array(F.col("rings"), F.array(islet)).alias("parts"))
    back = save_layer(parted, fresh_path(t.spark, "parts-layer"))
    return back.select(
        "zone",
        F.size("parts").alias("n_parts"),
        F.size(F.get("parts", F.lit(0))).alias("n_rings_first"),
        F.size(F.get("parts", F.lit(1))).alias("n_rings_second"),
        F.size("rings").alias("n_rings"),
    )


@register("s08_zone_layer_scan", _SHAPE_SQL)
def _(t):
    path = fresh_path(t.spark, "zones")
    t.zone_layer.select("zone", "province", "realm", "rings").write.parquet(path)
    return _figures(t.spark.read.schema(schemas.ZONE).parquet(path))


@register("s09_tee", "SELECT p_brand, count(*) AS n, max(p_size) AS top FROM part GROUP BY p_brand")
def _(t):
    per_brand = t.table("part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.max("p_size").alias("top"))
    return tee_csv(per_brand, fresh_path(t.spark, "tee-csv"), "tee")


@register("s10_read_then_replace", "SELECT p_partkey, p_size, p_size * 2 AS doubled FROM part")
def _(t):
    base = fresh_path(t.spark, "versions")
    first = replace_table(t.table("part").select("p_partkey", "p_size"), base)
    doubled = first.withColumn("doubled", F.col("p_size") * 2)
    replace_table(doubled, base)
    return current_table(t.spark, base, doubled.schema)


@register(
    "s10_refused_write",
    """SELECT p_partkey, p_size * 2 AS p_size, 2 AS version FROM part
       UNION ALL SELECT p_partkey, p_size, 1 FROM part""",
)
def _(t):
    """Two versions; a third write that was made from the first one is refused and changes nothing."""
    base = fresh_path(t.spark, "versions")
    first = replace_table(t.table("part").select("p_partkey", "p_size"), base)
    replace_table(first.withColumn("p_size", F.col("p_size") * 2), base, after=1)
    try:
        replace_table(first.withColumn("p_size", F.lit(0)), base, after=1)
    except versions.Conflict:
        pass
    numbers = range(1, versions.last_version(t.spark, base) + 1)
    read = [t.spark.read.schema(first.schema).parquet(versions.folder_of(t.spark, base, n)) for n in numbers]
    return union_all(*[df.withColumn("version", F.lit(n)) for n, df in zip(numbers, read)])


@register("s12_keyed_enrichment", "SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def _(t):
    return enrich(t.table("documents").select("doc_id", "lang"), t.table("labels"), "doc_id")


@register(
    "s13_constant_rows",
    """SELECT v.zone, p_brand, count(*) AS n FROM part
       JOIN (SELECT 'NATION_3' AS zone, unnest(['Brand#4', 'Brand#5', 'Brand#6']) AS p_brand) v USING (p_brand)
       GROUP BY v.zone, p_brand""",
)
def _(t):
    rows = constant_rows(t.spark, {"zone": "NATION_3"}, "p_brand", ["Brand#4", "Brand#5", "Brand#6"])
    return t.table("part").join(rows, "p_brand").groupBy("zone", "p_brand").agg(F.count(F.lit(1)).alias("n"))


@register("s14_preview", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def _(t):
    orders = t.table("orders").select("o_orderkey", "o_totalprice")
    return orders.orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(50)


# projections and filters --------------------------------------------------------------------------


@register("p01_column_pruning", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def _(t):
    return t.table("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")


@register("p02_column_range", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def _(t):
    return column_range(t.table("customer"), "c_custkey", "c_nationkey", "c_mktsegment")


@register("p03_reorder_and_drop", "SELECT p_type, p_brand, p_partkey, p_size, p_retailprice FROM part")
def _(t):
    return lead_columns(t.table("part"), ["p_type", "p_brand"], ["p_name"])


@register("p04_grouped_select", "SELECT n_regionkey, n_name FROM nation")
def _(t):
    return t.table("nation").select("n_regionkey", "n_name")


@register("p05_rename", "SELECT s_suppkey AS unit, s_name AS unit_name, s_nationkey, s_acctbal FROM supplier")
def _(t):
    return t.table("supplier").withColumnsRenamed({"s_suppkey": "unit", "s_name": "unit_name"})


@register("p06_chained_columns", "SELECT p_partkey, p_size, p_size + 1 AS a, (p_size + 1) * 2 AS b FROM part")
def _(t):
    sized = t.table("part").select("p_partkey", "p_size")
    return sized.withColumn("a", F.col("p_size") + 1).withColumn("b", F.col("a") * 2)


@register(
    "p07_computed_only",
    "SELECT CAST(count(*) AS INTEGER) AS n_texts FROM conversations GROUP BY conv_id",
)
def _(t):
    nested = nest(t.table("conversations"), ["conv_id"], ["turn"], "records")
    texts = F.size(F.transform("records", lambda r: r["text"]))
    return nested.groupBy("conv_id").agg(F.sum(texts).cast("int").alias("n_texts")).select("n_texts")


@register("p08_conjunction", f"SELECT * FROM {_SPARSE} WHERE p_type = 'LARGE' AND p_size > 10")
def _(t):
    return _sparse_part(t).where((F.col("p_type") == "LARGE") & (F.col("p_size") > 10))


@register("p09_or_precedence", "SELECT * FROM part WHERE p_type = 'LARGE' AND p_size > 40 OR p_brand = 'Brand#7' OR p_brand = 'Brand#8'")
def _(t):
    return t.table("part").where("p_type = 'LARGE' AND p_size > 40 OR p_brand = 'Brand#7' OR p_brand = 'Brand#8'")


@register("p10_inequality", f"SELECT * FROM {_SPARSE} WHERE p_type <> 'LARGE'")
def _(t):
    return _sparse_part(t).where(F.col("p_type") != "LARGE")


@register("p11_not_null", f"SELECT * FROM {_SPARSE} WHERE p_type IS NOT NULL AND p_size IS NOT NULL")
def _(t):
    return _sparse_part(t).where(F.col("p_type").isNotNull()).dropna(subset=["p_size"])


@register("p12_cast", "SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS code, TRY_CAST(o_orderstatus AS INTEGER) AS bad FROM orders")
def _(t):
    code = F.substring("o_orderpriority", 1, 1).try_cast("int")
    return t.table("orders").select("o_orderkey", code.alias("code"), F.col("o_orderstatus").try_cast("int").alias("bad"))


@register("p13_membership", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def _(t):
    keys = t.table("customer").where(F.col("c_mktsegment") == "MACHINERY").withColumnRenamed("c_custkey", "o_custkey")
    return keep_members(t.table("orders").select("o_orderkey", "o_custkey", "o_totalprice"), keys, "o_custkey")


# joins --------------------------------------------------------------------------------------------

_BRANDS = "(SELECT p_brand AS species, count(*) AS n_parts FROM part WHERE p_brand <> 'Brand#4' GROUP BY 1)"
_AGENTS = "(SELECT species, count(*) AS n_agents FROM fx_agent GROUP BY 1)"


def _brands(t: StarTables) -> DataFrame:
    part = t.table("part").where(F.col("p_brand") != "Brand#4")
    return part.groupBy(F.col("p_brand").alias("species")).agg(F.count(F.lit(1)).alias("n_parts"))


def _agent_counts(t: StarTables) -> DataFrame:
    return t.agents.groupBy("species").agg(F.count(F.lit(1)).alias("n_agents"))


@register(
    "j01_left_to_dimension",
    "SELECT o_orderkey, c_mktsegment, c_nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
)
def _(t):
    orders = t.table("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    customer = t.table("customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return join_on(orders, customer, "c_custkey", "left").drop("c_custkey")


@register(
    "j02_left_to_hierarchy",
    "SELECT c_custkey, n_name AS zone, province, realm FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN fx_zone ON n_name = zone",
)
def _(t):
    placed = t.table("customer").join(t.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return join_on(placed.select("c_custkey", F.col("n_name").alias("zone")), t.zones, "zone", "left")


@register("j03_left_of_aggregates", f"SELECT species, n_parts, n_agents FROM {_BRANDS} LEFT JOIN {_AGENTS} USING (species)")
def _(t):
    return join_on(_brands(t), _agent_counts(t), "species", "left")


@register(
    "j04_fan_out",
    "SELECT p_partkey, p_brand AS species, agent, taxon FROM part p LEFT JOIN fx_agent a ON p.p_brand = a.species",
)
def _(t):
    rows = t.table("part").select("p_partkey", F.col("p_brand").alias("species"))
    return join_on(rows, t.agents, "species", "left")


@register(
    "j05_traits_to_rows",
    "SELECT p_partkey, p.p_brand AS species, max_length, round(troph, 6) AS troph, round(k, 6) AS k FROM part p LEFT JOIN fx_trait t ON p.p_brand = t.species",
)
def _(t):
    rows = t.table("part").select("p_partkey", F.col("p_brand").alias("species"))
    return rounded(join_on(rows, t.traits, "species", "left"), "troph", "k")


@register(
    "j06_all_zones_kept",
    "SELECT z.zone, realm, province, n FROM fx_zone z LEFT JOIN (SELECT n_name AS zone, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9900 GROUP BY 1) c ON z.zone = c.zone",
)
def _(t):
    rich = t.table("customer").where(F.col("c_acctbal") > 9900)
    named = rich.join(t.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return join_on(t.zones, named.groupBy(F.col("n_name").alias("zone")).agg(F.count(F.lit(1)).alias("n")), "zone", "left")


@register("j07_full_join", f"SELECT species, n_parts, n_agents FROM {_BRANDS} FULL JOIN {_AGENTS} USING (species)")
def _(t):
    return join_on(_brands(t), _agent_counts(t), "species", "full")


@register(
    "j07_full_join_null_safe",
    f"""SELECT coalesce(a.p_type, b.p_type) AS p_type, a.n, b.size
        FROM (SELECT p_type, count(*) AS n FROM {_SPARSE} GROUP BY 1) a
        FULL JOIN (SELECT p_type, sum(p_size)::BIGINT AS size FROM {_SPARSE} WHERE p_brand = 'Brand#5' GROUP BY 1) b
          ON a.p_type IS NOT DISTINCT FROM b.p_type""",
)
def _(t):
    part = _sparse_part(t)
    counts = part.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))
    sizes = part.where(F.col("p_brand") == "Brand#5").groupBy("p_type").agg(F.sum("p_size").alias("size"))
    return join_on(counts, sizes, "p_type", "full", null_safe=True)


@register("j08_full_then_filter", f"SELECT species, n_parts, n_agents FROM {_BRANDS} FULL JOIN {_AGENTS} USING (species) WHERE n_parts > 5")
def _(t):
    return join_on(_agent_counts(t), _brands(t), "species", "full").where(F.col("n_parts") > 5)


@register(
    "j09_composite_full_keep_left",
    """SELECT a.p_brand, a.p_type, a.n, b.m FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2) a
       LEFT JOIN (SELECT p_brand, p_type, count(*) AS m FROM part WHERE p_size > 45 GROUP BY 1, 2) b
         ON a.p_brand = b.p_brand AND a.p_type = b.p_type""",
)
def _(t):
    part = t.table("part")
    left = part.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    right = part.where(F.col("p_size") > 45).groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("m"))
    return join_on(left, right, ["p_brand", "p_type"], "full").where(F.col("n").isNotNull())


@register(
    "j10_presence_label",
    """SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
              THEN 'Returned' ELSE 'Kept' END AS label FROM orders""",
)
def _(t):
    returned = t.table("lineitem").where(F.col("l_returnflag") == "R").withColumnRenamed("l_orderkey", "o_orderkey")
    return label_presence(t.table("orders").select("o_orderkey"), returned, "o_orderkey", "label", "Returned", "Kept")


@register(
    "j11_geometry_of_rows",
    "SELECT s_suppkey, n_name AS zone, n_points, min_x, max_y FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN fx_geometry ON n_name = zone",
)
def _(t):
    placed = t.table("supplier").join(t.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = placed.select("s_suppkey", F.col("n_name").alias("zone"))
    return _figures(join_on(rows, t.zone_shapes, "zone", "full").dropna(subset=["s_suppkey"]))


@register("j12_geometry_left", _SHAPE_SQL)
def _(t):
    return _figures(with_geometry(t.zones, t.zone_shapes))


# aggregates ---------------------------------------------------------------------------------------


@register("a01_mean_present", f"SELECT p_brand, round(avg(p_size), 6) AS m FROM {_SPARSE} GROUP BY p_brand")
def _(t):
    return rounded(_sparse_part(t).groupBy("p_brand").agg(agg.mean_present("p_size").alias("m")), "m")


@register("a02_mean_strict", f"SELECT p_name, round(CASE WHEN count(*) = count(p_size) THEN avg(p_size) END, 6) AS m FROM {_SPARSE} GROUP BY p_name, p_brand")
def _(t):
    means = _sparse_part(t).groupBy("p_name", "p_brand").agg(agg.mean_strict("p_size").alias("m"))
    return rounded(means.select("p_name", "m"), "m")


@register(
    "a03_distinct_with_null",
    f"""SELECT p_name, count(DISTINCT p_type) + max(CASE WHEN p_type IS NULL THEN 1 ELSE 0 END) AS n,
               count(DISTINCT p_type) AS n_known FROM {_SPARSE} GROUP BY p_name""",
)
def _(t):
    return _sparse_part(t).groupBy("p_name").agg(
        agg.n_distinct("p_type").alias("n"), agg.n_distinct("p_type", count_null=False).alias("n_known")
    )


@register("a04_conditional_distinct", "SELECT p_brand, count(DISTINCT CASE WHEN p_type = 'LARGE' THEN p_name END) AS n FROM part GROUP BY p_brand")
def _(t):
    return t.table("part").groupBy("p_brand").agg(agg.n_distinct_where(F.col("p_type") == "LARGE", "p_name").alias("n"))


@register("a05_sum_strict", f"SELECT p_name, p_brand, CASE WHEN count(*) = count(p_size) THEN sum(p_size)::DOUBLE END AS s FROM {_SPARSE} GROUP BY p_name, p_brand")
def _(t):
    sizes = _sparse_part(t).withColumn("p_size", F.col("p_size").cast("double"))
    return sizes.groupBy("p_name", "p_brand").agg(agg.sum_strict("p_size").alias("s"))


@register("a06_conditional_sum", "SELECT p_name, p_brand, coalesce(sum(CASE WHEN p_type = 'LARGE' THEN p_size END), 0)::DOUBLE AS s FROM part GROUP BY p_name, p_brand")
def _(t):
    sizes = t.table("part").withColumn("p_size", F.col("p_size").cast("double"))
    return sizes.groupBy("p_name", "p_brand").agg(agg.sum_where(F.col("p_type") == "LARGE", "p_size").alias("s"))


@register("a07_sum_of_expression", "SELECT l_returnflag, round(sum(l_discount * log10(l_quantity + 1)), 4) AS s FROM lineitem GROUP BY l_returnflag")
def _(t):
    weighted = F.col("l_discount") * scalars.log10_plus1("l_quantity")
    return rounded(t.table("lineitem").groupBy("l_returnflag").agg(agg.sum_strict(weighted).alias("s")), "s", digits=4)


@register("a08_first_by_order", "SELECT p_brand, arg_min(p_type, p_partkey) AS first_type, min(p_brand) AS brand FROM part GROUP BY p_brand")
def _(t):
    return t.table("part").groupBy("p_brand").agg(
        agg.first_by("p_type", "p_partkey").alias("first_type"), agg.the_value("p_brand").alias("brand")
    )


@register("a09_sibling_aggregate", "SELECT p_brand, count(*) AS n, round(sum(p_retailprice), 4) AS s, round(count(*) * log10(sum(p_retailprice) + 1), 6) AS score FROM part GROUP BY p_brand")
def _(t):
    sums = t.table("part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), agg.sum_strict("p_retailprice").alias("s"))
    return rounded(rounded(sums.withColumn("score", F.col("n") * scalars.log10_plus1("s")), "score"), "s", digits=4)


@register(
    "a10_two_levels",
    """SELECT l_returnflag, round(sum(log10(q + 1)), 4) AS s FROM (
         SELECT l_returnflag, l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) GROUP BY 1""",
)
def _(t):
    inner = t.table("lineitem").groupBy("l_returnflag", "l_suppkey").agg(agg.sum_strict("l_quantity").alias("q"))
    return rounded(inner.groupBy("l_returnflag").agg(agg.sum_strict(scalars.log10_plus1("q")).alias("s")), "s", digits=4)


@register("a11_total", "SELECT round(sum(l_quantity), 4) AS total FROM lineitem")
def _(t):
    return rounded(t.table("lineitem").agg(agg.sum_strict("l_quantity").alias("total")), "total", digits=4)


@register("a12_percentage", "SELECT CAST(round_even(sum(l_discount * l_quantity) / sum(l_quantity) * 100, 2) AS DOUBLE) AS percent FROM lineitem")
def _(t):
    discounted = F.col("l_discount") * F.col("l_quantity")
    return t.table("lineitem").agg(agg.percent_of(discounted, "l_quantity").alias("percent"))


@register(
    "a13_share_of_distinct",
    "SELECT p_brand, CAST(round_even(count(DISTINCT p_name) / (SELECT count(DISTINCT p_name) FROM part) * 100, 0) AS DOUBLE) AS share FROM part GROUP BY p_brand",
)
def _(t):
    names = t.table("part").select("p_brand", "p_name").distinct()
    total = table_value(t.table("part").select("p_name").distinct(), F.count(F.lit(1)))
    counted = names.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).withColumn("total", total)
    return counted.select("p_brand", F.bround(F.col("n") / F.col("total") * 100).alias("share"))


@register("a14_six_numbers", summary_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount"]))
def _(t):
    return rounded(six_number_summary(t.table("lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]), "min", "q1", "median", "mean", "q3", "max")


@register("a15_standard_error", f"SELECT p_brand, round(stddev_samp(p_size) / sqrt(count(p_size)), 6) AS se FROM {_SPARSE} GROUP BY p_brand")
def _(t):
    return rounded(_sparse_part(t).groupBy("p_brand").agg(agg.standard_error("p_size").alias("se")), "se")


@register("a16_mean_interval", mean_ci_sql("orders", ["o_totalprice", "o_custkey"]))
def _(t):
    return rounded(mean_ci(t.table("orders"), ["o_totalprice", "o_custkey"]), "estimate", "ci_lower", "ci_upper", "std_error")


@register("a17_min_max", f"SELECT p_brand, min(p_size) AS low, max(p_size) AS high FROM {_SPARSE} GROUP BY p_brand")
def _(t):
    return _sparse_part(t).groupBy("p_brand").agg(F.min("p_size").alias("low"), F.max("p_size").alias("high"))


@register(
    "a18_dissolve",
    "SELECT DISTINCT n_name AS zone, c_mktsegment, n_points, min_x, max_y FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN fx_geometry ON n_name = zone",
)
def _(t):
    """The rows of one group share one polygon, so their union is that polygon: distinct keys first."""
    placed = t.table("customer").join(t.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    keys = placed.select(F.col("n_name").alias("zone"), "c_mktsegment").distinct()
    return _figures(with_geometry(keys, t.zone_shapes))


# whole-table and group statistics on rows ---------------------------------------------------------


@register(
    "w01_group_distinct",
    f"""SELECT p_partkey, p.p_brand, n, round(p_retailprice / n, 6) AS part_price FROM {_SPARSE} p JOIN (
          SELECT p_brand, count(DISTINCT p_type) + max(CASE WHEN p_type IS NULL THEN 1 ELSE 0 END) AS n
          FROM {_SPARSE} GROUP BY 1) c ON p.p_brand = c.p_brand""",
)
def _(t):
    counted = group_distinct(_sparse_part(t), ["p_brand"], "p_type", "n")
    split = counted.withColumn("part_price", F.col("p_retailprice") / F.col("n"))
    return rounded(split.select("p_partkey", "p_brand", "n", "part_price"), "part_price")


@register(
    "w02_minmax_100",
    f"SELECT p_partkey, round((p_size - (SELECT min(p_size) FROM {_SPARSE})) / (SELECT max(p_size) - min(p_size) FROM {_SPARSE}) * 100, 6) AS scaled FROM {_SPARSE}",
)
def _(t):
    return rounded(minmax(_sparse_part(t), {"scaled": "p_size"}, 0, 100).select("p_partkey", "scaled"), "scaled")


@register(
    "w03_minmax_strict",
    f"SELECT p_partkey, CAST(NULL AS DOUBLE) AS scaled, round((p_retailprice - (SELECT min(p_retailprice) FROM part)) / (SELECT max(p_retailprice) - min(p_retailprice) FROM part), 6) AS price FROM {_SPARSE}",
)
def _(t):
    scaled = minmax(_sparse_part(t), {"scaled": "p_size", "price": "p_retailprice"}, skip_null=False)
    return rounded(scaled.select("p_partkey", "scaled", "price"), "scaled", "price")


@register("w04_impute_mean", f"SELECT p_partkey, round(coalesce(p_size, (SELECT avg(p_size) FROM {_SPARSE})), 6) AS p_size FROM {_SPARSE}")
def _(t):
    return rounded(impute_mean(_sparse_part(t), "p_size").select("p_partkey", "p_size"), "p_size")


@register("w05_top_ties", "SELECT p_brand, p_partkey, p_size FROM (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS k FROM part) WHERE k <= 3")
def _(t):
    return top_ties(t.table("part").select("p_brand", "p_partkey", "p_size"), ["p_brand"], "p_size", 3)


@register("w06_repeated_rows", "SELECT l_suppkey, l_quantity FROM (SELECT l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_suppkey, l_quantity) AS k FROM lineitem) WHERE k > 1")
def _(t):
    return repeated_rows(t.table("lineitem"), ["l_suppkey", "l_quantity"])


@register("w07_table_distinct", "SELECT n_name, (SELECT count(DISTINCT p_name) FROM part) AS total FROM nation")
def _(t):
    total = table_value(t.table("part").select("p_name").distinct(), F.count(F.lit(1)))
    return t.table("nation").select("n_name").withColumn("total", total)


@register(
    "w08_distinct_times_value",
    """SELECT p_brand, p_type, round(sum(n * sqrt(p_size)) / 1e4, 6) AS total FROM part JOIN (
         SELECT p_brand, p_type, count(DISTINCT p_name) AS n FROM part GROUP BY 1, 2) USING (p_brand, p_type)
       GROUP BY p_brand, p_type""",
)
def _(t):
    counted = group_distinct(t.table("part"), ["p_brand", "p_type"], "p_name", "n")
    total = agg.sum_strict(F.col("n") * F.sqrt("p_size")) / 1e4
    return rounded(counted.groupBy("p_brand", "p_type").agg(total.alias("total")), "total")


@register("w09_ordinal", "SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS ord FROM customer")
def _(t):
    return ordinal(t.table("customer").select("c_custkey", "c_acctbal"), "c_acctbal", ["c_custkey"])


# sorting ------------------------------------------------------------------------------------------


@register(
    "o01_sort_ascending",
    f"""SELECT p_type, p_size, p_partkey, row_number() OVER (
          ORDER BY p_type NULLS LAST, p_size NULLS LAST, p_partkey) AS position FROM {_SPARSE}""",
)
def _(t):
    rows = _sparse_part(t).select("p_type", "p_size", "p_partkey")
    return positions(rows.orderBy(F.asc_nulls_last("p_type"), F.asc_nulls_last("p_size"), "p_partkey"))


@register(
    "o02_sort_descending",
    f"""SELECT p_type, p_size, p_partkey, row_number() OVER (
          ORDER BY p_size DESC NULLS LAST, p_partkey) AS position FROM {_SPARSE}""",
)
def _(t):
    rows = _sparse_part(t).select("p_type", "p_size", "p_partkey")
    return positions(rows.orderBy(F.desc_nulls_last("p_size"), "p_partkey"))


@register(
    "o03_sort_aggregate",
    """SELECT p_brand, m, row_number() OVER (ORDER BY m, p_brand) AS position FROM (
         SELECT p_brand, round(avg(p_retailprice), 6) AS m FROM part GROUP BY p_brand)""",
)
def _(t):
    means = t.table("part").groupBy("p_brand").agg(agg.mean_strict("p_retailprice").alias("m"))
    return positions(rounded(means, "m").orderBy(F.asc_nulls_last("m"), "p_brand"))


@register("o04_top_per_group", "SELECT c_mktsegment, c_custkey, c_acctbal FROM (SELECT *, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC) AS k FROM customer) WHERE k <= 2")
def _(t):
    return top_ties(t.table("customer").select("c_mktsegment", "c_custkey", "c_acctbal"), ["c_mktsegment"], "c_acctbal", 2)


# sets and reshaping -------------------------------------------------------------------------------


@register("u01_union_fill", "SELECT s_name AS name, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_name, c_acctbal, c_mktsegment FROM customer")
def _(t):
    suppliers = t.table("supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    customers = t.table("customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return union_all(suppliers, customers)


@register("u02_union_strict", "SELECT p_partkey, p_size FROM part WHERE p_size > 25 UNION ALL SELECT p_partkey, p_size FROM part WHERE p_size <= 30")
def _(t):
    part = t.table("part").select("p_partkey", "p_size")
    return part.where(F.col("p_size") > 25).unionByName(part.where(F.col("p_size") <= 30).select("p_size", "p_partkey"))


@register("u03_distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_discount FROM lineitem")
def _(t):
    return t.table("lineitem").select("l_returnflag", "l_linestatus", "l_discount").distinct()


@register("u04_distinct_columns", "SELECT DISTINCT p_brand, p_type FROM part")
def _(t):
    return t.table("part").select("p_brand", "p_type").distinct()


@register("u05_long_two", "SELECT l_orderkey, l_linenumber, 'l_discount' AS key, l_discount AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem")
def _(t):
    lines = t.table("lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return lines.unpivot(["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"], "key", "value")


@register(
    "u06_long_three",
    """SELECT l_orderkey, 'l_discount' AS key, l_discount AS value FROM lineitem UNION ALL
       SELECT l_orderkey, 'l_quantity', l_quantity FROM lineitem UNION ALL SELECT l_orderkey, 'l_tax', l_tax FROM lineitem""",
)
def _(t):
    columns = ["l_discount", "l_quantity", "l_tax"]
    return t.table("lineitem").select("l_orderkey", *columns).unpivot(["l_orderkey"], columns, "key", "value")


def _nested_turns(t: StarTables) -> DataFrame:
    return nest(t.table("conversations"), ["conv_id"], ["turn"], "records")


@register("u07_nest_tables", "SELECT conv_id, CAST(count(*) FILTER (role = 'user') AS BIGINT) AS n_user, CAST(count(*) FILTER (role = 'system') AS BIGINT) AS n_system, CAST(count(*) FILTER (role = 'assistant') AS BIGINT) AS n_assistant FROM conversations GROUP BY conv_id")
def _(t):
    turns = t.table("conversations")
    tables = {role: (turns.where(F.col("role") == role).drop("role"), ["turn"]) for role in ("user", "system", "assistant")}
    wide = nest_tables(turns, tables, ["conv_id"])
    present = {role: F.when(F.col(role).isNotNull(), F.size(role)).otherwise(0) for role in tables}
    return wide.groupBy("conv_id").agg(*[F.sum(n).alias(f"n_{role}") for role, n in present.items()])


@register("u08_unnest", "SELECT conv_id, turn, role, length(text) AS n FROM conversations")
def _(t):
    rows = unnest(_nested_turns(t), "records")
    return rows.select("conv_id", "turn", "role", F.length("text").cast("bigint").alias("n"))


@register("u09_flatten", "SELECT turn, role FROM conversations")
def _(t):
    return _nested_turns(t).select(F.inline("records")).select("turn", "role")


@register("u10_single_field", "SELECT doc_id, CAST(quality AS DOUBLE) AS quality FROM labels")
def _(t):
    labels = t.table("labels").withColumns({"quality": F.col("quality").cast("double"), "id": F.col("doc_id")})
    nested = nest(labels, ["doc_id"], ["id"], "records")
    return only_value(nested, ["doc_id"], "records", "quality")


@register("u11_field_vector", "SELECT conv_id, count(*)::INTEGER AS n, max(turn) AS last FROM conversations GROUP BY conv_id")
def _(t):
    vectors = _nested_turns(t).select("conv_id", all_values("records", "turn").alias("turns"))
    return vectors.groupBy("conv_id").agg(
        F.sum(F.size("turns")).cast("int").alias("n"), F.max(F.array_max("turns")).alias("last")
    )


# checked look-ups and corrections -----------------------------------------------------------------

# nations as a look-up table in which the first three keys repeat and the last five lack
_LOOSE_NATION = """(SELECT n_nationkey AS c_nationkey, n_name FROM nation WHERE n_nationkey < 20
    UNION ALL SELECT n_nationkey, 'other ' || n_name FROM nation WHERE n_nationkey < 3)"""


def _loose_nation(t: StarTables) -> DataFrame:
    nation = t.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    again = nation.where("c_nationkey < 3").withColumn("n_name", F.concat(F.lit("other "), "n_name"))
    return nation.where("c_nationkey < 20").unionByName(again)


@register(
    "j01_checked_lookup",
    f"""SELECT c_custkey, c_nationkey, n_name FROM customer LEFT JOIN (
          SELECT c_nationkey, min(n_name) AS n_name FROM {_LOOSE_NATION} GROUP BY c_nationkey) USING (c_nationkey)""",
)
def _(t):
    customers = t.table("customer").select("c_custkey", "c_nationkey")
    return checked_lookup(customers, _loose_nation(t), ["c_nationkey"], repeated="report").rows


@register(
    "j05_lookup_report",
    f"""SELECT (SELECT count(DISTINCT c_nationkey) FROM {_LOOSE_NATION}) AS keys,
               (SELECT count(*) FROM (SELECT c_nationkey FROM {_LOOSE_NATION} GROUP BY 1 HAVING count(*) > 1)) AS repeated_keys,
               count(*) AS rows, count(*) FILTER (c_nationkey < 20) AS matched, count(*) FILTER (c_nationkey >= 20) AS unmatched
        FROM customer""",
)
def _(t):
    """What the look-up has told by the pass that wrote its result."""
    customers = t.table("customer").select("c_custkey", "c_nationkey")
    looked = checked_lookup(customers, _loose_nation(t), ["c_nationkey"], repeated="report")
    stage(looked.rows, "looked-up")
    return t.spark.createDataFrame([looked.report()], "keys long, repeated_keys long, rows long, matched long, unmatched long")


_CORRECTED = """
    WITH base AS (SELECT species, zone, sum(zone_prod) AS prod FROM fx_apportioned GROUP BY species, zone),
    patch AS (
      SELECT 'Brand#' || (1 + n_nationkey) AS species, n_name AS zone, n_nationkey * 1.5::DOUBLE AS prod,
             CASE n_nationkey % 3 WHEN 0 THEN 'set' WHEN 1 THEN 'add' ELSE 'remove' END AS op FROM nation),
    both_ AS (
      SELECT species, zone, op, b.prod AS old, p.prod AS new, b.prod IS NOT NULL AS present
      FROM base b FULL JOIN patch p USING (species, zone))"""


def _corrections(t: StarTables) -> tuple[DataFrame, DataFrame]:
    """Production per species and zone, and corrections of all three kinds."""
    apportioned = apportion_zones(t.unit_zone, UNIT)
    base = apportioned.groupBy("species", "zone").agg(F.sum("zone_prod").alias("prod"))
    key = F.col("n_nationkey")
    patches = t.table("nation").select(
        F.concat(F.lit("Brand#"), (key + 1).cast("string")).alias("species"),
        F.col("n_name").alias("zone"),
        (key * 1.5).cast("double").alias("prod"),
        F.get(F.array(F.lit("set"), F.lit("add"), F.lit("remove")), key % 3).alias("op"),
    )
    return apply_corrections(base, patches, ["species", "zone"])


@register(
    "x05_corrected",
    f"""SELECT * FROM ({_CORRECTED}
        SELECT species, zone, round(CASE WHEN op = 'set' AND present THEN new ELSE coalesce(old, new) END, 6) AS prod
        FROM both_ WHERE CASE WHEN present THEN op IS NULL OR op <> 'remove' ELSE op = 'add' END)""",
)
def _(t):
    return rounded(_corrections(t)[0], "prod")


@register(
    "x05_corrections_account",
    f"""SELECT * FROM ({_CORRECTED}
        SELECT species, zone, op, CASE WHEN op = 'add' AND present THEN 'already there' WHEN op <> 'add' AND NOT present THEN 'no row'
               ELSE 'applied' END AS outcome, CAST((op = 'add') <> present AS BIGINT) AS n_rows FROM both_ WHERE op IS NOT NULL)""",
)
def _(t):
    return _corrections(t)[1]


# spatial ------------------------------------------------------------------------------------------


@register("g01_points", "SELECT vec_id, label, lon, lat FROM fx_point")
def _(t):
    return as_points(t.vector_points)


@register("g01_off_globe", "SELECT vec_id, lon * 900 AS lon, lat FROM fx_point WHERE lon * 900 NOT BETWEEN -180 AND 180")
def _(t):
    stretched = t.vector_points.select("vec_id", (F.col("lon") * 900).alias("lon"), "lat")
    return off_globe(as_points(stretched))


@register("g02_points_in_zones", INSIDE_SQL.format(id="vec_id", points="fx_point", edges="fx_edge"))
def _(t):
    cover = stage(zone_cover(t.origin_zones, cell=0.05), "cover")
    return points_in_cover(t.vector_points, cover, 0.05).select("vec_id", "zone")


@register(
    "g02_zones_with_points",
    f"""SELECT n_name AS zone, vec_id FROM nation LEFT JOIN (
          SELECT 'NATION_' || substr(zone, 2, 1) AS zone, vec_id
          FROM ({INSIDE_SQL.format(id='vec_id', points='fx_point', edges='fx_edge')})) h ON n_name = h.zone""",
)
def _(t):
    """All nations, two of which are given the shapes around the origin."""
    named = t.origin_zones.withColumn("zone", F.concat(F.lit("NATION_"), F.substring("zone", 2, 1)))
    cover = stage(zone_cover(named, cell=0.1), "cover")
    zones = t.table("nation").select(F.col("n_name").alias("zone"))
    return join_points(zones, t.vector_points.select("vec_id", "lon", "lat"), cover, 0.1).select("zone", "vec_id")


# blocks that fill a grid without gaps, some with a hole; borders within a province cancel, and each edge is
# followed by the one that keeps most to the left
_DISSOLVED = """
    WITH RECURSIVE block AS (
      SELECT province, -170.0::DOUBLE + 68 * (n_nationkey % 5) AS x0, -70.0::DOUBLE + 28 * (n_nationkey // 5) AS y0,
             n_nationkey % 3 = 0 AS holed FROM nation JOIN fx_zone ON n_name = zone
    ), edge AS (
      SELECT province, x0 + a AS x1, y0 + b AS y1, x0 + c AS x2, y0 + d AS y2, k FROM block,
        (VALUES (0, 0, 68, 0, 0, false), (68, 0, 68, 28, 1, false), (68, 28, 0, 28, 2, false), (0, 28, 0, 0, 3, false),
                (10, 8, 10, 20, 1, true), (10, 20, 30, 20, 0, true), (30, 20, 30, 8, 3, true), (30, 8, 10, 8, 2, true)
        ) v(a, b, c, d, k, hole) WHERE NOT hole OR holed
    ), border AS (
      SELECT *, row_number() OVER (ORDER BY province, x1, y1, x2, y2) AS id FROM edge e WHERE NOT EXISTS (
        SELECT 1 FROM edge o WHERE o.province = e.province AND o.x1 = e.x2 AND o.y1 = e.y2 AND o.x2 = e.x1 AND o.y2 = e.y1)
    ), follow AS (
      SELECT a.id, arg_min(b.id, CASE (b.k - a.k + 4) % 4 WHEN 1 THEN 1 WHEN 0 THEN 2 ELSE 3 END) AS next
      FROM border a JOIN border b ON a.province = b.province AND a.x2 = b.x1 AND a.y2 = b.y1 GROUP BY a.id
    ), reach AS (
      SELECT id AS start, id FROM border UNION SELECT r.start, f.next FROM reach r JOIN follow f ON r.id = f.id
    ), ring AS (SELECT start AS id, min(id) AS ring FROM reach GROUP BY start)
    SELECT province, CAST(count(DISTINCT ring) AS INTEGER) AS n_rings, CAST(count(*) AS INTEGER) AS n_edges,
           sum(x1 * y2 - x2 * y1) / 2 AS area, min(x1) AS min_x, max(y1) AS max_y
    FROM border JOIN ring USING (id) GROUP BY province"""


@register("a18_dissolve_provinces", f"SELECT * FROM ({_DISSOLVED})")
def _(t):
    """Provinces as the union of their zones."""
    x0, y0 = F.lit(-170.0) + 68 * (F.col("n_nationkey") % 5), F.lit(-70.0) + 28 * F.floor(F.col("n_nationkey") / 5)
    ring = lambda corners: F.array(
        *[F.struct((x0 + a).cast("double").alias("x"), (y0 + b).cast("double").alias("y")) for a, b in corners]
    )
    block, hole = ring([(0, 0), (68, 0), (68, 28), (0, 28)]), ring([(10, 8), (30, 8), (30, 20), (10, 20)])
    # turned one way and the other, as layers come
    rings = F.when(F.col("n_nationkey") % 3 == 0, F.array(block, hole)).otherwise(F.array(F.reverse(block)))
    shapes = t.table("nation").select(F.col("n_name").alias("zone"), rings.alias("rings"))
    union = dissolve(shapes.join(t.zones, "zone"), ["province"])
    points = F.flatten(F.transform("rings", lambda r: F.slice(r, 2, F.size(r) - 1)))
    return union.select(
        "province",
        F.size("rings").alias("n_rings"),
        F.size(points).alias("n_edges"),
        area().alias("area"),
        F.array_min(F.transform(points, lambda p: p["x"])).alias("min_x"),
        F.array_max(F.transform(points, lambda p: p["y"])).alias("max_y"),
    )


_LINE_EDGES = "(SELECT zone, x1 + 40 AS x1, y1, x2 + 40 AS x2, y2 FROM fx_shape)"
# one row per species and place, and one more for the same place a turn further east
_LINE_POINTS = """(SELECT DISTINCT species, lon + turn AS lon, lat FROM fx_occurrence, (VALUES (0), (360)) t(turn))"""


@register(
    "g02_across_date_line",
    f"""SELECT zone, species, count(*) AS n_points, count(*) FILTER (lon < 0) AS n_west FROM (
          SELECT zone, species, CASE WHEN lon > 180 THEN lon - 360 ELSE lon END AS lon FROM (
            {INSIDE_SQL.format(id="species", points=_LINE_POINTS, edges=_LINE_EDGES).replace("SELECT p.species, e.zone", "SELECT p.species, p.lon, p.lat, e.zone")}))
        GROUP BY zone, species""",
)
def _(t):
    """Zones moved east by 40 degrees, so that a column of them reaches across the date line, and the places on
    either side of it."""
    moved = F.transform("rings", lambda ring: F.transform(ring, lambda p: F.struct((p["x"] + 40).alias("x"), p["y"].alias("y"))))
    cover = stage(zone_cover(t.zone_shapes.withColumn("rings", moved), cell=2.0), "cover")
    hits = points_in_cover(t.occurrences.distinct(), cover, 2.0)
    return hits.groupBy("zone", "species").agg(F.count(F.lit(1)).alias("n_points"), F.count_if(F.col("lon") < 0).alias("n_west"))


@register("g03_presence", f"""SELECT DISTINCT zone, CAST(label AS VARCHAR) AS species FROM (
    {INSIDE_SQL.format(id='vec_id', points='fx_point', edges='fx_edge')}) JOIN fx_point USING (vec_id)""")
def _(t):
    cover = stage(zone_cover(t.origin_zones, cell=0.05), "cover")
    points = t.vector_points.select(F.col("label").cast("string").alias("species"), "lon", "lat")
    return native_presence(points, cover, 0.05).select("zone", "species")


@register("g04_attach_geometry", _SHAPE_SQL)
def _(t):
    return _figures(join_on(t.zones, t.zone_shapes, "zone", "left"))


@register("g05_drop_geometry", "SELECT zone, realm, province FROM fx_zone")
def _(t):
    return without_geometry(t.zone_layer)


# scalar functions ---------------------------------------------------------------------------------


@register("f01_log10_plus1", "SELECT l_orderkey, l_linenumber, round(log10(l_quantity + 1), 6) AS v FROM lineitem")
def _(t):
    return rounded(t.table("lineitem").select("l_orderkey", "l_linenumber", scalars.log10_plus1("l_quantity").alias("v")), "v")


@register("f02_sqrt", "SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity), 6) AS v FROM lineitem")
def _(t):
    return rounded(t.table("lineitem").select("l_orderkey", "l_linenumber", F.sqrt("l_quantity").alias("v")), "v")


@register("f03_unit_scaling", "SELECT o_orderkey, round(o_totalprice / 1000, 6) AS thousand, round(o_totalprice / 1e4, 6) AS ten_thousand FROM orders")
def _(t):
    price = F.col("o_totalprice")
    return rounded(t.table("orders").select("o_orderkey", (price / 1000).alias("thousand"), (price / 1e4).alias("ten_thousand")), "thousand", "ten_thousand")


@register("f04_reciprocal", "SELECT l_orderkey, l_linenumber, round(1 / nullif(l_discount, 0), 6) AS v FROM lineitem")
def _(t):
    return rounded(t.table("lineitem").select("l_orderkey", "l_linenumber", scalars.reciprocal("l_discount").alias("v")), "v")


@register("f05_mean_of_columns", f"SELECT p_partkey, round((p_size + p_retailprice + p_partkey) / 3, 6) AS m, round(p_size + p_retailprice + p_partkey, 6) AS s FROM {_SPARSE}")
def _(t):
    total = F.col("p_size") + F.col("p_retailprice") + F.col("p_partkey")
    mean = scalars.mean_of("p_size", "p_retailprice", "p_partkey")
    return rounded(_sparse_part(t).select("p_partkey", mean.alias("m"), total.alias("s")), "m", "s")


@register("f06_round_half_even", "SELECT l_orderkey, l_linenumber, CAST(round_even(l_quantity / 2, 0) AS DOUBLE) AS v FROM lineitem")
def _(t):
    return t.table("lineitem").select("l_orderkey", "l_linenumber", F.bround(F.col("l_quantity") / 2).alias("v"))


@register("f07_if_else", f"SELECT p_partkey, CASE WHEN p_size > 25 THEN 'big' WHEN NOT p_size > 25 THEN 'small' END AS v FROM {_SPARSE}")
def _(t):
    return _sparse_part(t).select("p_partkey", scalars.if_else(F.col("p_size") > 25, F.lit("big"), F.lit("small")).alias("v"))


@register("f08_fill", f"SELECT p_partkey, coalesce(p_size, 0) AS v FROM {_SPARSE}")
def _(t):
    return _sparse_part(t).select("p_partkey", F.coalesce("p_size", F.lit(0)).alias("v"))


@register("f09_is_null", f"SELECT p_partkey, p_size IS NULL AS missing FROM {_SPARSE}")
def _(t):
    return _sparse_part(t).select("p_partkey", F.col("p_size").isNull().alias("missing"))


@register("f10_paste", f"SELECT p_partkey, concat_ws(' ', p_brand, p_type) AS v FROM {_SPARSE}")
def _(t):
    return _sparse_part(t).select("p_partkey", F.concat_ws(" ", "p_brand", "p_type").alias("v"))


@register("f11_detect", "SELECT doc_id, contains(text, 'tion') AS has, NOT contains(text, 'xyz') AS lacks, regexp_matches(text, '[0-9]{3}') AS digits FROM documents")
def _(t):
    text = F.col("text")
    return t.table("documents").select(
        "doc_id",
        F.contains(text, F.lit("tion")).alias("has"),
        (~F.contains(text, F.lit("xyz"))).alias("lacks"),
        text.rlike("[0-9]{3}").alias("digits"),
    )


@register("f12_recode", "SELECT p_partkey, CASE p_type WHEN 'LARGE' THEN 'big' WHEN 'SMALL' THEN 'little' ELSE p_type END AS v FROM part")
def _(t):
    return t.table("part").select("p_partkey", scalars.recode("p_type", {"LARGE": "big", "SMALL": "little"}).alias("v"))


@register("f13_collapse", "SELECT p_partkey, CASE WHEN p_type IN ('LARGE', 'MEDIUM') THEN 'A' WHEN p_type IN ('SMALL', 'PROMO') THEN 'B' ELSE p_type END AS v FROM part")
def _(t):
    groups = {"A": ["LARGE", "MEDIUM"], "B": ["SMALL", "PROMO"]}
    return t.table("part").select("p_partkey", scalars.collapse("p_type", groups).alias("v"))


@register("f14_reversed_order", "SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LARGE' THEN 1 END AS v FROM part")
def _(t):
    v = scalars.label_ordinal("p_type", ["SMALL", "MEDIUM", "LARGE"], reverse=True)
    return t.table("part").select("p_partkey", v.cast("int").alias("v"))


@register("f15_conversions", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS text, TRY_CAST(replace(p_brand, 'Brand#', '') AS DOUBLE) AS number, TRY_CAST(p_brand AS DOUBLE) AS bad FROM part")
def _(t):
    number = F.replace("p_brand", F.lit("Brand#"), F.lit("")).try_cast("double")
    return t.table("part").select(
        "p_partkey", F.col("p_size").cast("string").alias("text"), number.alias("number"), F.col("p_brand").try_cast("double").alias("bad")
    )


@register("f16_binomial", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '% %' AND p_name NOT LIKE '%rod%'")
def _(t):
    return t.table("part").where(scalars.is_binomial("p_name", "rod")).select("p_partkey", "p_name")


@register("f17_constants", "SELECT r_name, 'Native' AS status, CAST(NULL AS BOOLEAN) AS introductions FROM region")
def _(t):
    return t.table("region").select("r_name", F.lit("Native").alias("status"), F.lit(None).cast("boolean").alias("introductions"))
