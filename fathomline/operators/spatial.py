"""Points in polygons, by grid cells and an exact test on the few edges that matter.

Polygons are planar, in degrees of longitude and latitude. A zone is a list of rings; a point is inside by
even-odd parity over all of them, so holes and several parts need no special case. Points on an edge or a
vertex count as inside. A zone may reach across the date line, with longitudes that run on beyond 180 degrees
or jump by 360; no edge may span more than 180 degrees, and no ring may go around a pole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fathomline.operators.relational import join_on

_EDGE = "struct<x1:double,y1:double,x2:double,y2:double>"


def _closed(ring: Column) -> Column:
    # a ring without points has no first and last one, and no edges
    first, last = F.get(ring, F.lit(0)), F.get(ring, F.size(ring) - 1)
    closed = (first["x"] == last["x"]) & (first["y"] == last["y"])
    return F.when(closed | (F.size(ring) == 0), ring).otherwise(F.concat(ring, F.array(first)))


def _ring_edges(ring: Column) -> Column:
    ring = _closed(ring)
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(
        F.slice(ring, 1, n),
        F.slice(ring, 2, n),
        lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")),
    )


def ring_edges(rings: str = "rings") -> Column:
    """All edges of all rings of a zone."""
    return F.flatten(F.transform(rings, _ring_edges)).cast(f"array<{_EDGE}>")


def edge(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


# The tests below see a point as if it were moved a little to the right and, much less, upwards. So each of
# them has an answer for points on an edge or at a vertex as well, and the answers agree with each other.


def _left_of(e: Column, x: Column, y: Column) -> Column:
    """Whether the point lies to the left of the line through an edge: above it, if the edge is level."""
    at = F.try_divide((e["x2"] - e["x1"]) * (y - e["y1"]), e["y2"] - e["y1"]) + e["x1"]
    return F.when(e["y1"] == e["y2"], y >= e["y1"]).otherwise(x < at)


def _spans_y(e: Column, y: Column) -> Column:
    return (e["y1"] > y) != (e["y2"] > y)


def _spans_x(e: Column, x: Column) -> Column:
    return (e["x1"] > x) != (e["x2"] > x)


def _on_edge(e: Column, lon: Column, lat: Column) -> Column:
    cross = (e["x2"] - e["x1"]) * (lat - e["y1"]) - (e["y2"] - e["y1"]) * (lon - e["x1"])
    return (
        (cross == 0)
        & lon.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        & lat.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
    )


def _odd(edges: Column, test) -> Column:
    return F.aggregate(edges, F.lit(False), lambda odd, e: odd != test(e))


def inside(edges: Column | str, lon: Column | str, lat: Column | str) -> Column:
    """Whether a point lies inside or on the polygon given by all of its edges."""
    edges, lon, lat = (F.col(c) if isinstance(c, str) else c for c in (edges, lon, lat))
    crossed = _odd(edges, lambda e: _spans_y(e, lat) & _left_of(e, lon, lat))
    return crossed | F.exists(edges, lambda e: _on_edge(e, lon, lat))


def on_globe_edges(zones: DataFrame, zone: str = "zone", rings: str = "rings") -> DataFrame:
    """(zone, e): the edges of each zone, cut at the date line into parts between -180 and 180 degrees.

    Each edge is clipped on its own. Where a zone is cut, the cut is closed on both sides of the line: the
    latitudes at which its rings cross the line, in order, are the ends of the stretches inside it.
    """
    edges = zones.select(zone, F.explode(ring_edges(rings)).alias("e"))
    # an edge that seems to span more than half of the globe goes the other way around
    jump = F.col("e.x2") - F.col("e.x1")
    x2 = F.col("e.x2") + F.when(jump > 180, -360.0).when(jump < -180, 360.0).otherwise(0.0)
    edges = edges.withColumn("e", edge(F.col("e.x1"), F.col("e.y1"), x2, F.col("e.y2")))
    e = F.col("e")
    low, high = F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])
    # the part of the globe its right end lies in, 0 for (-180, 180], and the line at the left end of that part
    turn = F.ceil((high - 180) / 360).cast("double")
    seam = turn * 360 - 180
    placed = edges.withColumns({"_turn": turn, "_seam": seam, "_cut": low <= seam})
    at = e["y1"] + (F.col("_seam") - e["x1"]) / (e["x2"] - e["x1"]) * (e["y2"] - e["y1"])
    cut = placed.withColumn("_at", F.when(F.col("_cut"), at))
    shift = F.col("_turn") * 360
    moved = edge(e["x1"] - shift, e["y1"], e["x2"] - shift, e["y2"])
    # both parts keep the end that is theirs; the end at the line is exactly at 180 degrees
    first_left = e["x1"] <= e["x2"]
    left_x = F.least(e["x1"], e["x2"]) - shift + 360
    right_x = F.greatest(e["x1"], e["x2"]) - shift
    left_y, right_y = F.when(first_left, e["y1"]).otherwise(e["y2"]), F.when(first_left, e["y2"]).otherwise(e["y1"])
    line = F.lit(180.0)
    parts = F.array(edge(left_x, left_y, line, F.col("_at")), edge(-line, F.col("_at"), right_x, right_y))
    clipped = cut.select(zone, F.explode(F.when(F.col("_cut"), parts).otherwise(F.array(moved))).alias("e"))
    crossings = cut.where("_cut").groupBy(zone).agg(F.array_sort(F.collect_list("_at")).alias("_ys"))
    pairs = crossings.select(
        zone,
        F.explode(
            F.when(
                F.size("_ys") % 2 == 0, F.expr("transform(sequence(0, size(_ys) - 2, 2), i -> struct(_ys[i] AS a, _ys[i + 1] AS b))")
            ).otherwise(F.raise_error(F.lit("a zone crosses the date line an odd number of times: does it hold a pole?")).cast("array<struct<a:double,b:double>>"))
        ).alias("p"),
    )
    low_y, high_y = F.col("p.a"), F.col("p.b")
    closing = pairs.select(zone, F.explode(F.array(edge(line, low_y, line, high_y), edge(-line, low_y, -line, high_y))).alias("e"))
    whole = clipped.unionByName(closing).where((F.col("e.x1") != F.col("e.x2")) | (F.col("e.y1") != F.col("e.y2")))
    # what lies on the line lies on both sides of it: there once more, twice, so that no side changes by it
    ends = F.filter(F.array(F.struct(e["x1"].alias("x"), e["y1"].alias("y")), F.struct(e["x2"].alias("x"), e["y2"].alias("y"))), lambda p: F.abs(p["x"]) == 180)
    a, b = F.get(ends, F.lit(0)), F.element_at(ends, -1)
    mirrored = F.array_repeat(edge(-a["x"], a["y"], -a["x"], b["y"]), 2)
    return whole.unionByName(whole.where(F.size(ends) > 0).select(zone, F.explode(mirrored).alias("e")))


def zone_cover(zones: DataFrame, zone: str = "zone", rings: str = "rings", cell: float = 1.0) -> DataFrame:
    """The grid cells each zone reaches into: (zone, cx, cy, edges, anchor).

    A cell that no edge touches lies wholly inside or wholly outside; the first gets null ``edges`` and needs
    no test at all, the second is left out. Any other cell keeps the edges that touch it, and whether its
    centre is inside (``anchor``). The cover is built from edges as rows: each goes to the cells it passes,
    so the work and the size of the cover follow the edges and not the area of the zone's box. The centres of
    a row of cells are told from the crossings of its middle latitude to their right.
    """
    size, pad = F.lit(float(cell)), F.lit(cell * 1e-9)
    e = F.col("e")
    cells = lambda a, b, name: F.explode(F.sequence(F.floor((a - pad) / size), F.floor((b + pad) / size))).alias(name)
    bands = on_globe_edges(zones, zone, rings).select(
        zone, "e", cells(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]), "cy")
    )
    # the part of the edge within its band
    bottom, height = F.col("cy") * size, e["y2"] - e["y1"]
    share = lambda y: F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(y - e["y1"], height))), F.lit(0.0))
    x_at = lambda t: e["x1"] + t * (e["x2"] - e["x1"])
    x_low = F.when(height == 0, e["x1"]).otherwise(x_at(share(bottom - pad)))
    x_high = F.when(height == 0, e["x2"]).otherwise(x_at(share(bottom + size + pad)))
    touched = bands.withColumns({"_a": F.least(x_low, x_high), "_b": F.greatest(x_low, x_high)}).select(
        zone, "cy", "e", cells(F.col("_a"), F.col("_b"), "cx")
    )
    middle_x, middle_y = F.col("cx") * size + size / 2, F.col("cy") * size + size / 2
    # the one cell of the row in which the edge crosses the middle latitude
    crossing_x = e["x1"] + F.try_divide(middle_y - e["y1"], height) * (e["x2"] - e["x1"])
    home = _spans_y(e, middle_y) & (F.floor(crossing_x / size) == F.col("cx"))
    border = touched.groupBy(zone, "cx", "cy").agg(
        F.collect_list("e").alias("edges"),
        F.count_if(home).alias("_crossings"),
        F.count_if(home & _left_of(e, middle_x, middle_y)).alias("_own"),
    )
    row = W.partitionBy(zone, "cy").orderBy(F.desc("cx"))
    placed = border.withColumns(
        {
            "_right": F.coalesce(F.sum("_crossings").over(row.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
            "_next": F.lag("cx").over(row),
        }
    )
    odd = lambda n: F.pmod(n, F.lit(2)) == 1
    tested = placed.select(zone, "cx", "cy", "edges", odd(F.col("_right") + F.col("_own")).alias("anchor"))
    gap = (F.col("_next") > F.col("cx") + 1) & odd(F.col("_right"))
    free = placed.where(gap).select(
        zone,
        F.explode(F.sequence(F.col("cx") + 1, F.col("_next") - 1)).alias("cx"),
        "cy",
        F.lit(None).cast(f"array<{_EDGE}>").alias("edges"),
        F.lit(True).alias("anchor"),
    )
    return tested.unionByName(free)


def _in_cell(lon: Column, lat: Column, size: Column) -> Column:
    """Whether a point lies inside or on a zone, from the edges and the centre of its cell.

    The way from the point to the centre goes along the point's latitude first and along the centre's
    longitude then; each edge crossed on it changes sides. Both legs look at the same corner, so an edge
    through the corner is counted once or not at all.
    """
    corner, middle = F.col("cx") * size + size / 2, F.col("cy") * size + size / 2

    def changes(e: Column) -> Column:
        at_corner = _left_of(e, corner, lat)
        level = _spans_y(e, lat) & (_left_of(e, lon, lat) != at_corner)
        upright = _spans_x(e, corner) & (at_corner != _left_of(e, corner, middle))
        return level != upright

    return (F.col("anchor") != _odd(F.col("edges"), changes)) | F.exists("edges", lambda e: _on_edge(e, lon, lat))


def points_in_cover(
    points: DataFrame, cover: DataFrame, cell: float = 1.0, lon: str = "lon", lat: str = "lat"
) -> DataFrame:
    """Each point with each zone it lies in, an equi-join on the cell and a test near the edges.

    A point has one cell, so no pair comes out twice. ``cover`` should be a stored table: the planner
    then knows its true size, and broadcasts it or shuffles both sides by cell accordingly.
    """
    size = F.lit(float(cell))
    located = points.withColumns({"cx": F.floor(F.col(lon) / size), "cy": F.floor(F.col(lat) / size)})
    inner = F.col("edges").isNull() | _in_cell(F.col(lon), F.col(lat), size)
    return located.join(cover, ["cx", "cy"]).where(inner).drop("cx", "cy", "edges", "anchor")


def join_points(
    zones: DataFrame,
    points: DataFrame,
    cover: DataFrame,
    cell: float = 1.0,
    zone: str = "zone",
    lon: str = "lon",
    lat: str = "lat",
) -> DataFrame:
    """All zones with the points inside them; a zone without points has one row of nulls."""
    return join_on(zones, points_in_cover(points, cover, cell, lon, lat), zone, "left")
