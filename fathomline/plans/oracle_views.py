"""The views of ``star_tables`` as plain SQL for DuckDB, put in front of an oracle query as needed."""

from __future__ import annotations

import re

from fathomline.plans.star_tables import EDGES, HOLE, OUTLINE


def _edge_rows() -> str:
    return ", ".join(f"('{z}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for z, a, b, c, d in EDGES)


def _shape_rows() -> str:
    pairs = [pair for ring in (OUTLINE, HOLE) for pair in zip(ring, ring[1:])]
    return ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for a, b in pairs)


def _scaled(column: str) -> str:
    root = f"sqrt({column})"
    return f"({root} - min({root}) OVER ()) / nullif(max({root}) OVER () - min({root}) OVER (), 0) * 100"


VIEWS = {
    "fx_production": """
        SELECT p.p_brand AS species, p.p_name AS sci_name, upper(p.p_name) AS spp_name, p.p_type AS major_group,
               sn.n_name AS country, sn.n_regionkey AS area, cn.n_name AS zone,
               CAST(year(o.o_orderdate) AS INTEGER) AS yr, l.l_linestatus AS environment, l.l_quantity AS quantity
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
        JOIN part p ON l.l_partkey = p.p_partkey
        JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation sn ON s.s_nationkey = sn.n_nationkey
        JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation cn ON c.c_nationkey = cn.n_nationkey""",
    "fx_zone": """
        SELECT n.n_name AS zone, r.r_name AS realm,
               concat(r.r_name, CASE WHEN n.n_nationkey < 13 THEN '-A' ELSE '-B' END) AS province
        FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "fx_shape": f"""
        SELECT n.n_name AS zone,
               -170.0::DOUBLE + 68 * (n_nationkey % 5) + v.a AS x1, -70.0::DOUBLE + 28 * (n_nationkey // 5) + v.b AS y1,
               -170.0::DOUBLE + 68 * (n_nationkey % 5) + v.c AS x2, -70.0::DOUBLE + 28 * (n_nationkey // 5) + v.d AS y2
        FROM nation n CROSS JOIN (VALUES {_shape_rows()}) v(a, b, c, d)""",
    "fx_geometry": """
        SELECT zone, CAST(count(*) + 2 AS INTEGER) AS n_points, min(x1) AS min_x, max(y1) AS max_y
        FROM fx_shape GROUP BY zone""",
    "fx_edge": f"SELECT * FROM (VALUES {_edge_rows()}) t(zone, x1, y1, x2, y2)",
    "fx_point": """
        SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS lon, CAST(embedding[2] AS DOUBLE) AS lat FROM embeddings""",
    "fx_occurrence": """
        SELECT l_linenumber, l_orderkey, p.p_brand AS species,
               l_extendedprice % 90 + (67.5::DOUBLE * (CAST(replace(p.p_brand, 'Brand#', '') AS INTEGER) % 5) - 180) AS lon,
               (l_extendedprice * 7) % 160 - 80 AS lat
        FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey""",
    "fx_unit": """
        SELECT species, country, area, avg(quantity) AS mean_prod
        FROM fx_production WHERE environment = 'O' AND yr > 1996 GROUP BY species, country, area""",
    "fx_unit_zone": """
        SELECT DISTINCT u.species, u.country, u.area, u.mean_prod, f.zone
        FROM fx_unit u JOIN fx_production f
          ON u.species = f.species AND u.country = f.country AND u.area = f.area
        WHERE f.environment = 'O' AND f.yr > 1999 AND f.quantity >= 45""",
    "fx_native": """
        SELECT DISTINCT species, zone FROM fx_production
        WHERE environment = 'F' AND yr < 1997 AND quantity >= 49""",
    "fx_agent": """
        SELECT DISTINCT p_brand AS species, concat(p_type, '-', CAST(p_size % 10 AS VARCHAR)) AS agent, p_type AS taxon
        FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#2')""",
    "fx_trait": """
        SELECT p_brand AS species, CAST(max(p_size) AS DOUBLE) AS max_length, avg(p_retailprice) AS troph,
               CASE WHEN p_brand = 'Brand#3' THEN NULL ELSE avg(p_size) END AS k
        FROM part GROUP BY p_brand""",
    "fx_apportioned": """
        SELECT u.species, u.country, u.area, u.mean_prod, u.zone, n.n_zones, u.mean_prod / n.n_zones AS zone_prod
        FROM fx_unit_zone u JOIN (
            SELECT species, country, area, count(DISTINCT zone) AS n_zones
            FROM fx_unit_zone GROUP BY species, country, area) n
          ON u.species = n.species AND u.country = n.country AND u.area = n.area""",
    "fx_status": """
        SELECT a.*, CASE WHEN n.zone IS NULL THEN 'Introduced' ELSE 'Native' END AS status,
               CASE WHEN n.zone IS NULL THEN 1 ELSE 0 END AS introduced,
               CASE WHEN n.zone IS NULL THEN 0 ELSE 1 END AS native
        FROM fx_apportioned a LEFT JOIN fx_native n ON a.species = n.species AND a.zone = n.zone""",
    "fx_scores": """
        SELECT zone, count(DISTINCT species) AS n_total,
               count(DISTINCT CASE WHEN status = 'Introduced' THEN species END) AS n_introduced,
               count(DISTINCT CASE WHEN status = 'Native' THEN species END) AS n_native,
               sum(zone_prod) AS prod_total,
               coalesce(sum(CASE WHEN status = 'Native' THEN zone_prod END), 0) AS prod_native,
               coalesce(sum(CASE WHEN status = 'Introduced' THEN zone_prod END), 0) AS prod_introduced,
               count(DISTINCT CASE WHEN status = 'Native' THEN species END)
                 * log10(coalesce(sum(CASE WHEN status = 'Native' THEN zone_prod END), 0) + 1) AS genetic_score
        FROM fx_status GROUP BY zone""",
    "fx_filled": """
        SELECT species, max_length, troph, coalesce(k, (SELECT avg(k) FROM fx_trait)) AS k FROM fx_trait""",
    "fx_index": """
        SELECT *, ((k - min(k) OVER ()) / nullif(max(k) OVER () - min(k) OVER (), 0)
                 + (troph - min(troph) OVER ()) / nullif(max(troph) OVER () - min(troph) OVER (), 0)
                 + (max_length - min(max_length) OVER ())
                   / nullif(max(max_length) OVER () - min(max_length) OVER (), 0)) / 3 AS eco_ind
        FROM fx_filled""",
    "fx_introduced": """
        SELECT zone, species, sum(zone_prod) AS zone_prod FROM fx_status
        WHERE status = 'Introduced' GROUP BY zone, species""",
    "fx_invasive": """
        SELECT s.zone, coalesce(i.score, 0) AS invasive_score
        FROM fx_scores s LEFT JOIN (
            SELECT zone, CASE WHEN count(*) = count(eco_ind) THEN sum(eco_ind * log10(zone_prod + 1)) END AS score
            FROM fx_introduced LEFT JOIN fx_index USING (species) GROUP BY zone) i ON s.zone = i.zone""",
    "fx_zone_agent": """
        SELECT z.zone, z.species, a.agent FROM fx_status z LEFT JOIN fx_agent a ON z.species = a.species""",
    "fx_pathogens": """
        SELECT zone, count(DISTINCT agent) + max(CASE WHEN agent IS NULL THEN 1 ELSE 0 END) AS n_pathogen
        FROM fx_zone_agent GROUP BY zone""",
    "fx_pathogenic": """
        SELECT p.zone, n_pathogen * log10(prod_total + 1) AS pathogenic_score
        FROM fx_pathogens p LEFT JOIN fx_scores s ON p.zone = s.zone""",
    "fx_risk": f"""
        SELECT h.province, s.zone, h.realm, n_total, n_introduced, n_native, prod_total, prod_native, prod_introduced,
               {_scaled('genetic_score')} AS "Genetic", {_scaled('invasive_score')} AS "Invasive",
               {_scaled('pathogenic_score')} AS "Diseases",
               {_scaled('genetic_score')} + {_scaled('invasive_score')} + {_scaled('pathogenic_score')} AS "Overall"
        FROM fx_scores s JOIN fx_invasive i ON s.zone = i.zone JOIN fx_pathogenic p ON s.zone = p.zone
        LEFT JOIN fx_zone h ON s.zone = h.zone""",
}


def with_views(select: str, instead: dict[str, str] | None = None) -> str:
    """``select`` with a WITH list of the views it names, directly or through another view.

    ``instead`` gives some of the views another body.
    """
    bodies = VIEWS | (instead or {})
    needed: set[str] = set()
    open_texts = [select]
    while open_texts:
        found = set(re.findall(r"\bfx_\w+", open_texts.pop())) - needed
        needed |= found
        open_texts += [bodies[name] for name in found]
    if not needed:
        return select
    listed = ",\n".join(f"{name} AS ({body})" for name, body in bodies.items() if name in needed)
    return f"WITH {listed}\n{select}"
