"""Registered jobs, one or more queries each, on the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fathomline.functions.student_t import TABLE_SIZE, expansion_coefficients, t_table
from fathomline.operators.nested import all_values, nest, nest_tables, unnest
from fathomline.operators.relational import repeated_rows, union_all
from fathomline.operators.spatial import points_in_cover, zone_cover
from fathomline.plans import layers, native, pathogens, production, reports, scores, traits
from fathomline.plans.registry import register, rounded, rounded_sql
from fathomline.plans.scores import zone_production_scores
from fathomline.plans.star_tables import KEYS, SYNONYMS, TAXON_GROUPS, UNIT, StarTables
from fathomline.session import fresh_path
from fathomline.sources.geojson import GEOMETRY
from fathomline.sources.occurrences import load_occurrences
from fathomline.sources.tables import stage

CELL = 2.0

# SQL of the synonym recode and of the star after it
_RECODED = "CASE sci_name " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SYNONYMS.items()) + " ELSE sci_name END"
_STAR = f"""SELECT species, {_RECODED} AS sci_name, spp_name, major_group, country, area, zone, yr, environment, quantity
    FROM fx_production"""
_TOP = f"""SELECT sci_name AS species, spp_name, avg(quantity) AS mean_quantity, count(DISTINCT country) AS n_countries
    FROM ({_STAR}) WHERE environment = 'O' AND major_group = 'LARGE' AND yr > 1996
      AND sci_name LIKE '% %' AND sci_name NOT LIKE '%ring%'
    GROUP BY sci_name, spp_name HAVING avg(quantity) > 25.5 AND count(DISTINCT country) > 0"""


def _star(t: StarTables, zones: bool = True) -> DataFrame:
    """The star; without zones it joins neither customers nor their nations."""
    used = [d for d in t.dimensions if zones or d[1] not in ("c_custkey", "c_nationkey")]
    return production.star_production(t.fact, used, SYNONYMS).drop(*KEYS)


def _top(t: StarTables) -> DataFrame:
    return production.top_species(_star(t, zones=False), "O", "LARGE", 1996, 25.5, country="country", several="ring")


@register("x01_star_production", _STAR)
def _(t):
    return _star(t)


@register(
    "x02_top_species",
    f"SELECT species, spp_name, {rounded_sql('mean_quantity')}, n_countries FROM ({_TOP})",
)
def _(t):
    return rounded(_top(t), "mean_quantity")


@register(
    "x03_study_production",
    f"""SELECT species, sci_name AS study_species, spp_name, major_group, country, area, zone, yr, environment, quantity
        FROM ({_STAR}) WHERE environment = 'O' AND sci_name IN (SELECT species FROM ({_TOP}))""",
)
def _(t):
    short = stage(_top_of_profile(t, _species_profile(t)), "top-species")
    return production.study_of_profile(t.fact, t.dimensions, short, "O", SYNONYMS).drop(*KEYS)


def _species_profile(t: StarTables) -> DataFrame:
    """What screening and means need of the fact, stored: one pass over it for both."""
    unit = ["sci_name", "spp_name", "major_group", "country", "area"]
    return stage(production.production_profile(_star(t, zones=False), unit, "O", 1996), "species-profile")


def _top_of_profile(t: StarTables, profile: DataFrame) -> DataFrame:
    return production.top_of_profile(profile, "LARGE", 25.5, country="country", several="ring").select("species")


@register(
    "x04_mean_production",
    f"""SELECT study_species, country, area, {rounded_sql('mean_prod')},
               TRY_CAST(replace(country, 'NATION_', '') AS INTEGER) AS country_num
        FROM (SELECT sci_name AS study_species, country, area, avg(quantity) AS mean_prod FROM ({_STAR})
              WHERE environment = 'O' AND sci_name IN (SELECT species FROM ({_TOP})) AND yr > 1996
              GROUP BY ALL HAVING avg(quantity) > 0)""",
)
def _(t):
    profile = _species_profile(t)
    top = _top_of_profile(t, profile)
    means = production.mean_of_profile(profile, top, ["country", "area"])
    coded = means.withColumn("_code", F.replace("country", F.lit("NATION_"), F.lit("")))
    numbered = production.numeric_code(coded, "_code", "country_num").drop("_code")
    return rounded(numbered, "mean_prod").orderBy(F.asc_nulls_last("study_species"), F.asc_nulls_last("area"))


@register(
    "x05_apportion_zones",
    f"SELECT species, country, area, zone, n_zones, {rounded_sql('mean_prod', 'zone_prod')} FROM fx_apportioned",
)
def _(t):
    return rounded(production.apportion_zones(t.unit_zone, UNIT), "mean_prod", "zone_prod")


_HEADER = [
    "Genus", "Species", "Center Lat", "Center Long", "C-Square", "Depth", "SST", "Salinity", "Primary Production",
    "Sea Ice Conc.", "Distance to Land",
]
_PROSE = [
    '"Mapping parameters, one ""species"" per file",,,,,,,,,,',
    ",,,,,,,,,,",
    '"Cite the maps, and their makers, as given",,,,,,,,,,',
    "Occurrence cells used (n = 1),,,,,,,,,,",
]


def occurrence_files(t: StarTables, points: DataFrame, layouts: list[list[str]]) -> str:
    """Occurrence files made of ``points`` (file and the columns of the header as text): for each layout any number
    of files, in each of them prose, a header in the order of the layout, and a line per point.

    Each task writes the points it has, as they come, to a file of its own, which it begins with the lines above
    them. So nothing is dealt by layout or sorted, and no file holds more than a task has read. The lines above are
    also written once by themselves, for a layout without points.
    """
    path = fresh_path(t.spark, "occurrences")
    rest = F.lit("7101:247:3,66,24.5,35.7,2415,0,19")
    known = {"Genus": "genus", "Species": "epithet", "Center Lat": "lat", "Center Long": "lon", "Overall Probability": "probability"}
    for number, layout in enumerate(layouts):
        above = [F.lit(line) for line in [*_PROSE[number:], ",".join(layout)]]
        cells = [known[c] if c in known else F.get(F.split(rest, ","), F.lit(i % 7)) for i, c in enumerate(layout)]
        line = F.concat_ws(",", *cells)
        own = points.where(F.col("file") == number).select(line.alias("line"), _place_in_task().alias("place"))
        first = F.array(*above, "line")
        lines = own.select(F.explode(F.when(F.col("place") == 0, first).otherwise(F.array("line"))).alias("value"))
        for part in (t.table("region").limit(1).select(F.explode(F.array(*above)).alias("value")), lines):
            part.write.mode("append").option("maxRecordsPerFile", 0).text(f"{path}/{number}")
    return f"{path}/*"


def _place_in_task() -> Column:
    """Number of a row within its partition, from 0: the lower 33 bits of an increasing id."""
    return F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))


@register(
    "x06_load_occurrences",
    """SELECT CASE species WHEN 'Brand#7' THEN 'Brand 8' ELSE replace(species, '#', ' ') END AS species, lat, lon
       FROM fx_occurrence""",
)
def _(t):
    genus = F.split("species", "#")
    points = t.occurrences.select(
        F.pmod(F.hash("lat"), F.lit(3)).alias("file"),
        genus[0].alias("genus"),
        genus[1].alias("epithet"),
        F.col("lat").cast("string").alias("lat"),
        F.col("lon").cast("string").alias("lon"),
    )
    layouts = [_HEADER, [*_HEADER[2:], *_HEADER[:2]], _HEADER[::-1]]
    return load_occurrences(t.spark, occurrence_files(t, points, layouts), {"Brand 7": "Brand 8"}).drop("file")


INSIDE_SQL = """
    SELECT p.{id}, e.zone FROM {points} p JOIN {edges} e ON true GROUP BY p.{id}, p.lon, p.lat, e.zone
    HAVING sum(CASE WHEN (e.y1 > p.lat) <> (e.y2 > p.lat)
                     AND p.lon < (e.x2 - e.x1) * (p.lat - e.y1) / nullif(e.y2 - e.y1, 0) + e.x1 THEN 1 ELSE 0 END) % 2 = 1
        OR bool_or((e.x2 - e.x1) * (p.lat - e.y1) - (e.y2 - e.y1) * (p.lon - e.x1) = 0
               AND p.lon BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2)
               AND p.lat BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2))"""

# each place once: the parity above counts the edges of one point
_POINTS = "(SELECT DISTINCT species, lon, lat FROM fx_occurrence)"
_PRESENCE = f"""SELECT DISTINCT zone, species FROM ({INSIDE_SQL.format(id='species', points=_POINTS, edges='fx_shape')})"""


def _presence(t: StarTables) -> DataFrame:
    cover = stage(zone_cover(t.zone_shapes, cell=CELL), "cover")
    return native.native_presence(t.occurrences, cover, CELL)


@register(
    "x07_native_presence",
    f"""SELECT zone, species, 'Native' AS status, CAST(NULL AS BOOLEAN) AS introductions FROM ({_PRESENCE})""",
)
def _(t):
    return _presence(t)


_PER_PAIR = f"""SELECT zone, species, count(*) AS n_points FROM fx_occurrence o JOIN (
      {INSIDE_SQL.format(id="species", points=_POINTS, edges="fx_shape").replace("SELECT p.species, e.zone", "SELECT p.species, p.lon, p.lat, e.zone")}
    ) i USING (species, lon, lat) GROUP BY zone, species"""


@register("x07_points_per_pair", _PER_PAIR)
def _(t):
    """Points of each species in each zone; each species keeps to a part of the globe, so most pairs are absent."""
    cover = stage(zone_cover(t.zone_shapes, cell=CELL), "cover")
    hits = points_in_cover(t.occurrences, cover, CELL)
    return hits.groupBy("zone", "species").agg(F.count(F.lit(1)).alias("n_points"))


@register(
    "x08_native_table",
    f"""SELECT zone, species, 'Native' AS status FROM (
          SELECT zone, species FROM ({_PRESENCE})
          UNION ALL SELECT 'NATION_3', unnest(['Brand#26', 'Brand#27', 'Brand#28']))
        WHERE species <> 'Brand#9'""",
)
def _(t):
    manual = native.manual_native(t.spark, "NATION_3", ["Brand#26", "Brand#27", "Brand#28"])
    return native.native_table(_presence(t), manual, "Brand#9")


_PROD = ("prod_total", "prod_native", "prod_introduced")
_STATUS_COLUMNS = "species, country, area, zone, status, introduced, native, n_zones"


@register(
    "x09_status_label",
    f"SELECT {_STATUS_COLUMNS}, {rounded_sql('mean_prod', 'zone_prod')} FROM fx_status",
)
def _(t):
    apportioned = production.apportion_zones(t.unit_zone, UNIT)
    return rounded(native.status_label(apportioned, t.native), "mean_prod", "zone_prod")


_CHAIN = f"""
    SELECT a.*, n.zone IS NOT NULL AS is_native FROM fx_apportioned a LEFT JOIN (
      SELECT DISTINCT zone, species FROM (SELECT zone, species FROM ({_PRESENCE})
        UNION ALL SELECT 'NATION_3', unnest(['Brand#26', 'Brand#27', 'Brand#28'])) WHERE species <> 'Brand#9'
    ) n ON a.species = n.species AND a.zone = n.zone"""


def _status_from_points(t: StarTables) -> DataFrame:
    """Points to zones to native table to labelled production, as one chain."""
    manual = native.manual_native(t.spark, "NATION_3", ["Brand#26", "Brand#27", "Brand#28"])
    known = stage(native.native_table(_presence(t), manual, "Brand#9").select("zone", "species").distinct(), "native")
    return stage(native.status_label(production.apportion_zones(t.unit_zone, UNIT), known), "status-points")


@register(
    "x09_status_from_points",
    f"""SELECT species, country, area, zone, CASE WHEN is_native THEN 'Native' ELSE 'Introduced' END AS status,
               CASE WHEN is_native THEN 0 ELSE 1 END AS introduced, CASE WHEN is_native THEN 1 ELSE 0 END AS native,
               n_zones, {rounded_sql("mean_prod", "zone_prod")} FROM ({_CHAIN})""",
)
def _(t):
    return rounded(_status_from_points(t), "mean_prod", "zone_prod")


@register(
    "x11_scores_from_points",
    f"""SELECT zone, count(DISTINCT species) AS n_total,
               count(DISTINCT CASE WHEN NOT is_native THEN species END) AS n_introduced,
               count(DISTINCT CASE WHEN is_native THEN species END) AS n_native,
               round(sum(zone_prod), 6) AS prod_total,
               round(coalesce(sum(CASE WHEN is_native THEN zone_prod END), 0), 6) AS prod_native,
               round(coalesce(sum(CASE WHEN NOT is_native THEN zone_prod END), 0), 6) AS prod_introduced
        FROM ({_CHAIN}) GROUP BY zone""",
)
def _(t):
    scores = zone_production_scores(_status_from_points(t)).drop("genetic_score")
    return rounded(scores, *_PROD)


@register(
    "x10_status_with_hierarchy",
    f"""SELECT h.realm, h.province, s.zone, species, country, {rounded_sql('mean_prod', 'zone_prod')}, n_zones, status
        FROM fx_status s LEFT JOIN fx_zone h ON s.zone = h.zone""",
)
def _(t):
    placed = native.status_with_hierarchy(t.status, t.zones, ["area", "introduced", "native"])
    return rounded(placed, "mean_prod", "zone_prod")




@register(
    "x11_zone_production_scores",
    f"""SELECT zone, n_total, CAST(n_introduced AS BIGINT) AS n_introduced, CAST(n_native AS BIGINT) AS n_native,
               {rounded_sql(*_PROD, 'genetic_score')} FROM fx_scores""",
)
def _(t):
    return rounded(t.scores, *_PROD, "genetic_score")


def _geometry(layer: DataFrame) -> DataFrame:
    """Replace rings and parts by figures that SQL can compute as well."""
    points = F.aggregate("rings", F.lit(0), lambda n, ring: n + F.size(ring))
    xs = F.transform(F.flatten("rings"), lambda p: p["x"])
    ys = F.transform(F.flatten("rings"), lambda p: p["y"])
    figures = {"n_points": points, "min_x": F.array_min(xs), "max_y": F.array_max(ys)}
    return layer.withColumns(figures).drop(*GEOMETRY)


@register(
    "x12_production_long",
    """SELECT zone, n_total, n_introduced, n_native, round(prod_total, 6) AS prod_total,
              round(genetic_score, 6) AS genetic_score, key, round(value / 1000, 6) AS value, key_ord,
              n_points, min_x, max_y
       FROM (SELECT *, 'A. Native' AS key, prod_native AS value, 1 AS key_ord FROM fx_scores
             UNION ALL SELECT *, 'B. Non-native', prod_introduced, 2 FROM fx_scores)
       LEFT JOIN fx_geometry USING (zone) WHERE value > 0""",
)
def _(t):
    long = scores.production_long(t.scores, t.zone_shapes)
    return rounded(_geometry(long), "prod_total", "genetic_score", "value")


_TYPES = """SELECT species, agent, taxon, CASE WHEN taxon IN ('LARGE', 'SMALL') THEN 'Parasites'
    WHEN taxon IN ('PROMO', 'MEDIUM') THEN 'Others' ELSE taxon END AS type FROM fx_agent"""


@register("x13_pathogen_types", _TYPES)
def _(t):
    return pathogens.pathogen_types(t.agents, TAXON_GROUPS)


@register("x13_pathogen_type_pairs", f"SELECT DISTINCT taxon, type FROM ({_TYPES})")
def _(t):
    return pathogens.pathogen_types(t.agents, TAXON_GROUPS).select("taxon", "type").distinct()


@register(
    "x13_pathogen_repeats",
    """SELECT species, taxon FROM (
         SELECT species, taxon, row_number() OVER (PARTITION BY species, taxon) AS k FROM fx_agent) WHERE k > 1""",
)
def _(t):
    return repeated_rows(t.agents, ["species", "taxon"])


@register("x14_pathogens_by_zone", "SELECT * FROM fx_pathogens")
def _(t):
    return pathogens.pathogens_by_zone(t.status, t.agents)


@register(
    "x15_pathogen_map_table",
    "SELECT z.zone, z.realm, z.province, p.n_pathogen FROM fx_zone z LEFT JOIN fx_pathogens p ON z.zone = p.zone",
)
def _(t):
    return pathogens.pathogen_map_table(pathogens.pathogens_by_zone(t.unit_zone, t.agents), t.zones)


@register("x16_pathogenic_score", "SELECT zone, round(pathogenic_score, 6) AS pathogenic_score FROM fx_pathogenic")
def _(t):
    return rounded(t.pathogenic, "pathogenic_score")


@register(
    "x17_pathogenic_score_sqrt",
    """SELECT z.zone, z.realm, z.province, f.species, round(f.total, 6) AS pathogenic_total FROM fx_zone z LEFT JOIN (
         SELECT species, zone, sum(n * sqrt(mean_prod)) / 1e4 AS total FROM (
           SELECT u.species, u.zone, u.mean_prod, a.agent FROM fx_unit_zone u LEFT JOIN fx_agent a ON u.species = a.species)
         JOIN (SELECT u.species, u.zone, count(DISTINCT a.agent) + max(CASE WHEN a.agent IS NULL THEN 1 ELSE 0 END) AS n
               FROM fx_unit_zone u LEFT JOIN fx_agent a ON u.species = a.species GROUP BY u.species, u.zone)
           USING (species, zone)
         GROUP BY species, zone) f ON z.zone = f.zone""",
)
def _(t):
    score = pathogens.pathogenic_score_sqrt(t.unit_zone, t.agents)
    return rounded(pathogens.score_on_all_zones(t.zones, score), "pathogenic_total")


_INDEX = ("max_length", "troph", "k", "eco_ind")


@register("x18_trait_index", f"SELECT species, {rounded_sql(*_INDEX)} FROM fx_index")
def _(t):
    return rounded(t.index, *_INDEX)


@register(
    "x19_trait_production",
    f"""SELECT s.species, country, area, zone, n_zones, {rounded_sql('mean_prod', 'zone_prod', *_INDEX)}
        FROM fx_apportioned s LEFT JOIN fx_index i ON s.species = i.species""",
)
def _(t):
    apportioned = production.apportion_zones(t.unit_zone, UNIT)
    return rounded(traits.trait_production(t.index, apportioned), "mean_prod", "zone_prod", *_INDEX)


@register("x20_invasive_score", "SELECT zone, round(invasive_score, 6) AS invasive_score FROM fx_invasive")
def _(t):
    return rounded(t.invasive, "invasive_score")


@register(
    "x21_ecological_score_mean",
    """SELECT z.zone, z.realm, z.province, round(m.v, 6) AS ecol_total FROM fx_zone z LEFT JOIN (
         SELECT zone, CASE WHEN count(*) = count(eco_ind) THEN avg(eco_ind) END AS v
         FROM fx_unit_zone u LEFT JOIN fx_index i ON u.species = i.species GROUP BY zone) m ON z.zone = m.zone""",
)
def _(t):
    score = traits.ecological_score_mean(traits.trait_production(t.index, t.unit_zone), t.zones)
    return rounded(score, "ecol_total")


_SCORES = ("Genetic", "Invasive", "Diseases", "Overall")


@register(
    "x22_overall_risk",
    f"""SELECT province, zone, realm, n_total, CAST(n_introduced AS BIGINT) AS n_introduced,
               CAST(n_native AS BIGINT) AS n_native, {rounded_sql(*_PROD, *_SCORES)} FROM fx_risk""",
)
def overall_risk_query(t):
    return rounded(t.risk, *_PROD, *_SCORES)


# the native table of the points in place of the flag of the fact
_NATIVE_POINTS = {
    "fx_native": f"""SELECT DISTINCT species, zone FROM (SELECT zone, species FROM ({_PRESENCE})
        UNION ALL SELECT 'NATION_3', unnest(['Brand#26', 'Brand#27', 'Brand#28'])) WHERE species <> 'Brand#9'"""
}


@register(
    "x22_risk_from_points",
    f"""SELECT province, zone, realm, n_total, CAST(n_introduced AS BIGINT) AS n_introduced,
               CAST(n_native AS BIGINT) AS n_native, {rounded_sql(*_PROD, *_SCORES)} FROM fx_risk""",
    _NATIVE_POINTS,
)
def _(t):
    """The whole chain: points to zones to native table to labelled production to the three scores."""
    profile = stage(scores.zone_species_profile(_status_from_points(t)), "points-profile")
    risk = scores.overall_risk_of(scores.zone_scores(profile, t.index, t.carriers), t.zones)
    return rounded(risk, *_PROD, *_SCORES)


@register(
    "x20_invasive_from_points",
    "SELECT zone, round(invasive_score, 6) AS invasive_score FROM fx_invasive",
    _NATIVE_POINTS,
)
def _(t):
    profile = scores.zone_species_profile(_status_from_points(t))
    return rounded(scores.invasive_score_of(profile, t.index), "invasive_score")


@register(
    "x23_score_layer",
    f"""SELECT zone, n_total, n_introduced, n_native, {rounded_sql(*_PROD, *_SCORES)}, province, realm,
               n_points, min_x, max_y FROM fx_risk JOIN fx_geometry USING (zone)""",
)
def _(t):
    layer = scores_layer(t)
    saved = layers.save_layer(layer, fresh_path(t.spark, "score-layer"))
    return rounded(_geometry(saved), *_PROD, *_SCORES)


def scores_layer(t: StarTables) -> DataFrame:
    return layers.score_layer(t.risk, t.zone_layer)


@register(
    "x24_score_long",
    """SELECT zone, round("Overall", 6) AS "Overall", key, key_ord, round(value, 6) AS value FROM (
         SELECT zone, "Overall", 'A. Invasive' AS key, 1 AS key_ord, "Invasive" AS value FROM fx_risk
         UNION ALL SELECT zone, "Overall", 'B. Genetic', 2, "Genetic" FROM fx_risk
         UNION ALL SELECT zone, "Overall", 'C. Pathogenic', 3, "Diseases" FROM fx_risk)""",
)
def _(t):
    long = scores.score_long(t.staged_risk).select("zone", "Overall", "key", "key_ord", "value")
    return rounded(long, "Overall", "value")


@register(
    "x25_province_ranking",
    """SELECT province, realm, round(m, 6) AS "Overall", row_number() OVER (ORDER BY m, province, realm) AS ord
       FROM (SELECT province, realm, avg("Overall") AS m FROM fx_risk GROUP BY province, realm)""",
)
def _(t):
    return rounded(reports.province_ranking(t.staged_risk), "Overall")


@register(
    "x25_province_means",
    'SELECT province, round(avg("Overall"), 6) AS "Overall" FROM fx_risk GROUP BY province',
)
def _(t):
    return rounded(reports.province_means(t.risk, ["province"]), "Overall")


@register(
    "x26_status_totals",
    """SELECT round(sum(prod_total), 4) AS total, round(sum(prod_native), 4) AS native,
              round(sum(prod_introduced), 4) AS introduced,
              CAST(round_even(sum(prod_native) / sum(prod_total) * 100, 2) AS DOUBLE) AS percent_native,
              CAST(round_even(sum(prod_introduced) / sum(prod_total) * 100, 2) AS DOUBLE) AS percent_introduced
       FROM fx_scores""",
)
def _(t):
    return rounded(reports.status_totals(t.scores), "total", "native", "introduced", digits=4)


def summary_sql(source: str, columns: list[str]) -> str:
    parts = [
        f"""SELECT '{c}' AS measure, round(min(CAST("{c}" AS DOUBLE)), 6) AS min,
            round(quantile_cont(CAST("{c}" AS DOUBLE), 0.25), 6) AS q1,
            round(quantile_cont(CAST("{c}" AS DOUBLE), 0.5), 6) AS median,
            round(avg("{c}"), 6) AS mean, round(quantile_cont(CAST("{c}" AS DOUBLE), 0.75), 6) AS q3,
            round(max(CAST("{c}" AS DOUBLE)), 6) AS max, count(*) - count("{c}") AS n_null FROM {source}"""
        for c in columns
    ]
    return "\nUNION ALL ".join(parts)


_SUMMARY = ("min", "q1", "median", "mean", "q3", "max")
_MEASURES = ["prod_total", "n_total", *_SCORES]


@register("x27_six_number_summary", summary_sql("fx_risk", _MEASURES))
def _(t):
    return rounded(reports.six_number_summary(t.staged_risk, _MEASURES), *_SUMMARY)


def mean_ci_sql(source: str, columns: list[str]) -> str:
    table = "[" + ", ".join(repr(t) for t in t_table()) + "]"
    inv = "(1.0::DOUBLE / (n - 1))"
    tail = " + ".join(f"{c!r} * {inv} ** {i}" for i, c in enumerate(expansion_coefficients()))
    quantile = f"CASE WHEN n - 1 BETWEEN 1 AND {TABLE_SIZE} THEN ({table})[n - 1] WHEN n > 1 THEN {tail} END"
    parts = [
        f"""SELECT '{c}' AS measure, count("{c}") AS n, avg("{c}") AS m, stddev_samp("{c}") / sqrt(count("{c}")) AS se
            FROM {source}"""
        for c in columns
    ]
    return f"""SELECT measure, round(m, 6) AS estimate, round(m - se * t, 6) AS ci_lower,
                      round(m + se * t, 6) AS ci_upper, round(se, 6) AS std_error
               FROM (SELECT *, {quantile} AS t FROM ({' UNION ALL '.join(parts)}))"""


_CI = ("estimate", "ci_lower", "ci_upper", "std_error")


@register("x28_mean_ci", mean_ci_sql("fx_scores", ["n_total", "n_native", "prod_total"]))
def _(t):
    return rounded(reports.mean_ci(t.scores, ["n_total", "n_native", "prod_total"]), *_CI)


_PER_SPECIES = "(SELECT species, count(DISTINCT agent) AS agents_per_species FROM fx_agent GROUP BY species)"
_PER_ZONE = "(SELECT zone, n_pathogen AS agents_per_zone FROM fx_pathogens)"


@register("x28_agents_per_species", mean_ci_sql(_PER_SPECIES, ["agents_per_species"]))
def _(t):
    counted = pathogens.agents_per_species(t.agents).withColumnRenamed("n_agents", "agents_per_species")
    return rounded(reports.mean_ci(counted, ["agents_per_species"]), *_CI)


@register("x28_agents_per_zone", mean_ci_sql(_PER_ZONE, ["agents_per_zone"]))
def _(t):
    counted = scores.agents_of(t.zone_profile, t.carriers).withColumnRenamed("n_pathogen", "agents_per_zone")
    return rounded(reports.mean_ci(counted, ["agents_per_zone"]), *_CI)


def _top_sql(group: str, score: str, n: int) -> str:
    return f"""SELECT {group}, zone, round("{score}", 6) AS "{score}" FROM (
        SELECT *, rank() OVER (PARTITION BY {group} ORDER BY "{score}" DESC) AS k FROM fx_risk) WHERE k <= {n}"""


def _register_top(name: str, group: str, score: str, n: int) -> None:
    @register(name, _top_sql(group, score, n))
    def _(t):
        return rounded(reports.top_zones(t.staged_risk, group, score, n), score)


_register_top("x29_top_genetic_per_realm", "realm", "Genetic", 3)
_register_top("x29_top_diseases_per_realm", "realm", "Diseases", 3)
_register_top("x29_top_invasive_per_realm", "realm", "Invasive", 2)
_register_top("x29_top_overall_per_province", "province", "Overall", 1)


@register(
    "x29_top_species_count_ties",
    """SELECT realm, zone, n_total FROM (
         SELECT h.realm, s.zone, n_total, rank() OVER (PARTITION BY h.realm ORDER BY n_total DESC) AS k
         FROM fx_scores s LEFT JOIN fx_zone h ON s.zone = h.zone) WHERE k <= 2""",
)
def _(t):
    placed = stage(t.scores.join(t.zones, "zone", "left"), "placed-scores")
    return reports.top_zones(placed, "realm", "n_total", 2)


@register(
    "x30_native_in_zones",
    """SELECT species, round(sum(zone_prod), 6) AS production FROM fx_status
       WHERE (zone = 'NATION_3' OR zone = 'NATION_7' OR zone = 'NATION_11') AND status = 'Native' GROUP BY species""",
)
def _(t):
    chosen = (F.col("zone") == "NATION_3") | (F.col("zone") == "NATION_7") | (F.col("zone") == "NATION_11")
    breakdown = reports.species_breakdown(t.status, chosen & (F.col("status") == "Native"), ["species"])
    return rounded(breakdown, "production")


@register(
    "x30_precedence",
    """SELECT s.zone, species, round(sum(zone_prod), 6) AS production FROM fx_status s JOIN fx_zone h ON s.zone = h.zone
       WHERE realm = 'ASIA' AND status = 'Native' AND s.zone = 'NATION_2' OR s.zone = 'NATION_4' OR s.zone = 'NATION_8'
       GROUP BY s.zone, species""",
)
def _(t):
    # the condition on realm and status binds to the first zone only
    first = (F.col("realm") == "ASIA") & (F.col("status") == "Native") & (F.col("zone") == "NATION_2")
    condition = first | (F.col("zone") == "NATION_4") | (F.col("zone") == "NATION_8")
    placed = t.status.join(t.zones, "zone", "left")
    return rounded(reports.species_breakdown(placed, condition, ["zone", "species"]), "production")


@register(
    "x30_introduced_by_pattern",
    """SELECT species, round(sum(zone_prod), 6) AS production FROM fx_status
       WHERE regexp_matches(zone, '_1') AND status = 'Introduced' GROUP BY species""",
)
def _(t):
    condition = F.col("zone").rlike("_1") & (F.col("status") == "Introduced")
    return rounded(reports.species_breakdown(t.status, condition, ["species"]), "production")


@register("x31_distinct_agents", "SELECT DISTINCT agent FROM fx_agent")
def _(t):
    return t.agents.select("agent").distinct()


@register(
    "x31_type_shares",
    f"""SELECT type, CAST(round_even(count(DISTINCT agent) / (SELECT count(DISTINCT agent) FROM fx_agent) * 100, 0) AS DOUBLE)
          AS share FROM ({_TYPES}) GROUP BY type""",
)
def _(t):
    return pathogens.type_shares(pathogens.pathogen_types(t.agents, TAXON_GROUPS))


@register("x31_agents_per_species", "SELECT species, count(DISTINCT agent) AS n_agents FROM fx_agent GROUP BY species")
def _(t):
    return pathogens.agents_per_species(t.agents)


@register(
    "x32_nested_traits",
    "SELECT conv_id, role, turn, text FROM conversations",
)
def _(t):
    """Three kinds of records nested side by side per key, stored, and fields taken out again."""
    turns = t.table("conversations")
    roles = ("user", "assistant", "system")
    records = {role: (turns.where(F.col("role") == role).drop("role"), ["turn"]) for role in roles}
    stored = stage(nest_tables(turns, records, ["conv_id"]), "nested")
    fields = lambda role: F.arrays_zip(
        all_values(role, "turn").alias("turn"), all_values(role, "text").alias("text")
    )
    taken = [stored.select("conv_id", F.lit(role).alias("role"), F.inline(fields(role)).alias("turn", "text")) for role in roles]
    return union_all(*taken)


@register(
    "x33_trait_means",
    """SELECT event_type AS species, round(avg(value), 6) AS loo,
              round(avg(CAST(json_extract(props, '$.k') AS DOUBLE)), 6) AS k FROM events GROUP BY event_type""",
)
def _(t):
    """Means over records nested as JSON."""
    records = t.table("events").select(
        F.col("event_type").alias("species"), "value", F.from_json("props", "k double").alias("record")
    )
    flat = records.select("species", "value", "record.k")
    return rounded(traits.trait_means(flat, {"loo": "value", "k": "k"}), "loo", "k")


@register(
    "x33_trait_means_unnested",
    """SELECT CAST(label AS VARCHAR) AS species, round(avg(CAST(v AS DOUBLE)), 6) AS fecundity
       FROM (SELECT label, unnest(embedding) AS v FROM embeddings) GROUP BY label""",
)
def _(t):
    """Means over the elements of an array column, one row per element."""
    rows = t.table("embeddings").select(
        F.col("label").cast("string").alias("species"), F.explode("embedding").alias("v")
    ).withColumn("v", F.col("v").cast("double"))
    return rounded(traits.trait_means(rows, {"fecundity": "v"}), "fecundity")


@register(
    "x34_food_items",
    """SELECT p_brand AS species, p_name AS food, arg_min(p_type, p_partkey) AS food_group FROM part
       WHERE p_name NOT LIKE '%ring%' GROUP BY p_brand, p_name""",
)
def _(t):
    records = t.table("part").select(
        F.col("p_brand").alias("species"), F.col("p_name").alias("food"), F.col("p_type").alias("food_group"), "p_partkey"
    )
    return traits.food_items(records, "p_partkey", "ring")


@register(
    "x35_related_records",
    """SELECT doc_id, lang, source, quality, toxic FROM documents JOIN labels USING (doc_id)""",
)
def _(t):
    keys = t.table("documents").select("doc_id", "lang", "source")
    return traits.related_records(keys, t.table("labels"), "doc_id")


@register(
    "x35_unnested_records",
    "SELECT conv_id, turn, role, text FROM conversations",
)
def _(t):
    nested = nest(t.table("conversations"), ["conv_id"], ["turn"], "records")
    return unnest(nested, "records").select("conv_id", "turn", "role", "text")


# Principal components of three standardised columns in closed form: eigenvalues of the correlation matrix
# by the trigonometric formula, eigenvectors as a cross product of two rows of (matrix - eigenvalue).
_PCA = """
    WITH_PLACEHOLDER
    SELECT component, round(sqrt(e), 6) AS sdev, round(e / 3, 6) AS proportion, round(cumulative / 3, 6) AS cumulative,
           round(sgn * v1 / len, 6) AS max_length, round(sgn * v2 / len, 6) AS troph, round(sgn * v3 / len, 6) AS k_inv
    FROM (
      SELECT *, sum(e) OVER (ORDER BY component) AS cumulative, sqrt(v1 * v1 + v2 * v2 + v3 * v3) AS len,
             CASE WHEN abs(v1) >= abs(v2) AND abs(v1) >= abs(v3) THEN sign(v1)
                  WHEN abs(v2) >= abs(v3) THEN sign(v2) ELSE sign(v3) END AS sgn
      FROM (
        SELECT component, e, a * c - b * (1 - e) AS v1, a * b - c * (1 - e) AS v2, (1 - e) * (1 - e) - a * a AS v3
        FROM (SELECT a, b, c, i AS component, 1 + 2 * q * cos(acos(greatest(-1, least(1, r))) / 3 + 2 * pi() / 3 * shift) AS e
              FROM (SELECT *, sqrt((a * a + b * b + c * c) / 3) AS q,
                           a * b * c / pow(sqrt((a * a + b * b + c * c) / 3), 3) AS r
                    FROM (SELECT corr(max_length, troph) AS a, corr(max_length, 1 / k) AS b, corr(troph, 1 / k) AS c
                          FROM fx_filled)),
                   (VALUES (1, 0), (2, 2), (3, 1)) s(i, shift)))
      )"""


@register("x36_trait_pca", _PCA.replace("WITH_PLACEHOLDER", ""))
def _(t):
    columns = ["max_length", "troph", "k_inv"]
    return rounded(traits.trait_pca(t.index, columns), "sdev", "proportion", "cumulative", *columns)


@register(
    "x37_status_layers",
    f"""SELECT zone, species, status, {rounded_sql('zone_prod')}, n_points, min_x, max_y
        FROM fx_status JOIN fx_geometry USING (zone)""",
)
def _(t):
    labelled = t.status.select("zone", "species", "status", "zone_prod")
    native_only = labelled.where(F.col("status") == "Native")
    introduced_only = labelled.where(F.col("status") == "Introduced")
    saved = [
        layers.save_layer(layers.with_geometry(part, t.zone_shapes), fresh_path(t.spark, name))
        for part, name in ((native_only, "native-layer"), (introduced_only, "introduced-layer"))
    ]
    return rounded(_geometry(layers.status_layers(*saved)), "zone_prod")


@register(
    "x38_zone_production_layer",
    f"""SELECT species, country, area, zone, n_zones, {rounded_sql('mean_prod', 'zone_prod')}, n_points, min_x, max_y
        FROM fx_apportioned JOIN fx_geometry USING (zone)""",
)
def _(t):
    apportioned = production.apportion_zones(t.unit_zone, UNIT)
    layer = layers.zone_production_layer(apportioned, t.zone_shapes)
    saved = layers.save_layer(layer, fresh_path(t.spark, "production-layer"))
    return rounded(_geometry(saved), "mean_prod", "zone_prod")


@register(
    "x39_native_layer",
    "SELECT zone, species, n_points, min_x, max_y FROM fx_native JOIN fx_geometry USING (zone)",
)
def _(t):
    layer = layers.native_layer(t.native, t.zone_shapes)
    return _geometry(layers.save_layer(layer, fresh_path(t.spark, "native-layer")))


@register("x40_layer_attribute_dump", "SELECT zone, realm FROM fx_zone")
def _(t):
    layer = layers.save_layer(t.zone_layer, fresh_path(t.spark, "zone-layer"))
    return layers.layer_attributes(layer, ["zone", "realm"], fresh_path(t.spark, "zone-attributes"))


@register(
    "x41_apportion_by_ratio",
    """SELECT species, country, area, zone, weight, round(ratio, 9) AS ratio, round(mean_prod, 6) AS mean_prod,
              round(mean_prod * ratio, 6) AS zone_prod
       FROM (SELECT species, country, area, zone, weight,
                    weight / nullif(sum(weight) OVER (PARTITION BY species, country, area), 0) AS ratio
             FROM (SELECT species, country, area, zone, sum(quantity) AS weight FROM fx_production
                   WHERE environment = 'O' AND yr > 1996 GROUP BY ALL))
       JOIN fx_unit USING (species, country, area)""",
)
def _(t):
    weights = t.profile.where(F.col("total").isNotNull()).select(*UNIT, "zone", F.col("total").alias("weight"))
    split = production.apportion_by_ratio(weights, t.unit, UNIT)
    return rounded(rounded(split, "ratio", digits=9), "mean_prod", "zone_prod")


_WIDE = [
    "mean_prod_native", "mean_prod_introduced", "mean_prod_total", "log_mean_prod_total", "sqrt_mean_prod_total",
    "sqrt_prod", "log_prod", "sqrt_prod_native", "log_prod_native", "sqrt_prod_introduced", "log_prod_introduced",
    "genetic_score",
]


@register(
    "x42_zone_status_wide",
    f"""SELECT zone, status, introduced, native, CAST(n_native + n_introduced AS BIGINT) AS n_fish,
               CAST(n_introduced AS BIGINT) AS n_introduced, CAST(n_native AS BIGINT) AS n_native, {rounded_sql(*_WIDE)}
        FROM (SELECT *, prod_native AS mean_prod_native, prod_introduced AS mean_prod_introduced,
                     prod_total AS mean_prod_total, log10(prod_total) AS log_mean_prod_total,
                     sqrt(prod_total) AS sqrt_mean_prod_total, sqrt(zone_prod) AS sqrt_prod,
                     log10(zone_prod + 1) AS log_prod, sqrt(prod_native) AS sqrt_prod_native,
                     log10(prod_native + 1) AS log_prod_native, sqrt(prod_introduced) AS sqrt_prod_introduced,
                     log10(prod_introduced + 1) AS log_prod_introduced
              FROM fx_scores JOIN (
                SELECT zone, status, introduced, native, zone_prod FROM (
                  SELECT *, row_number() OVER (PARTITION BY zone ORDER BY country, species, area) AS i FROM fx_status)
                WHERE i = 1) USING (zone))""",
)
def _(t):
    return rounded(scores.zone_status_wide(t.status, ["country", "species", "area"]), *_WIDE)
