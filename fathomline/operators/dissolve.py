"""Union of touching polygons: borders between members of a group cancel, what is left is stitched into rings."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from fathomline.operators.spatial import edge, inside, ring_edges
from fathomline.sources.schemas import RINGS


def _doubled_area(edges: Column) -> Column:
    """Twice the signed area within a closed line: positive if it runs with the area to its left."""
    return F.aggregate(edges, F.lit(0.0), lambda s, e: s + e["x1"] * e["y2"] - e["x2"] * e["y1"])


def border_edges(zones: DataFrame, by: list[str], rings: str = "rings") -> DataFrame:
    """(by, x1, y1, x2, y2): the border of the union of each group's zones, its area to the left of each edge.

    Rings are turned so that the area is to their left, whichever way they were given: outer ones and those
    within a hole one way, holes the other. An edge that two zones of a group share has the area on both
    sides and cancels; edges are counted in either direction, as rows. Zones may touch but must not overlap, and
    must share the vertices of their common border.
    """
    listed = zones.select(
        *by, F.transform(F.filter(rings, lambda r: F.size(r) > 2), lambda r: ring_edges_of(r)).alias("_rings")
    )
    # how many other rings of the zone a ring lies in, by the middle of its first edge
    depth = lambda r, i: F.size(
        F.filter(
            "_rings",
            lambda o, j: (i != j) & inside(o, (r[0]["x1"] + r[0]["x2"]) / 2, (r[0]["y1"] + r[0]["y2"]) / 2),
        )
    )
    turned = F.transform(
        "_rings",
        lambda r, i: F.when((_doubled_area(r) > 0) == (depth(r, i) % 2 == 0), r).otherwise(
            F.transform(r, lambda e: edge(e["x2"], e["y2"], e["x1"], e["y1"]))
        ),
    )
    edges = listed.select(*by, F.explode(F.flatten(turned)).alias("e")).select(*by, "e.*")
    a, b = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    counted = (
        edges.where(a != b)
        .groupBy(*by, F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        .agg(F.count(F.lit(1)).alias("_n"), F.sum(F.when(a < b, 1).otherwise(-1)).alias("_net"))
    )
    forward = F.col("_net") > 0
    ends = [F.when(forward, F.col(p)[c]).otherwise(F.col(q)[c]).alias(f"{c}{k}") for k, p, q in ((1, "a", "b"), (2, "b", "a")) for c in "xy"]
    return counted.where(F.col("_n") % 2 == 1).select(*by, *ends)


def ring_edges_of(ring: Column) -> Column:
    """The edges of one ring."""
    return ring_edges(F.array(ring))


def _stitch(edges: list[tuple[float, float, float, float]]) -> list[list[tuple[float, float]]]:
    """Closed rings of directed edges, each starting at its least vertex.

    Where several rings meet in a vertex, an edge goes on with the one that encloses the same corner of the
    area, so areas that only touch there stay apart.
    """
    edges = sorted(edges)
    leaving: dict[tuple[float, float], list[int]] = {}
    for i, (x1, y1, _, _) in enumerate(edges):
        leaving.setdefault((x1, y1), []).append(i)

    def successor(i: int) -> int:
        x1, y1, x2, y2 = edges[i]
        choices = leaving[x2, y2]
        if len(choices) == 1:
            return choices[0]
        back = math.atan2(y1 - y2, x1 - x2)
        corner = lambda k: (back - math.atan2(edges[k][3] - y2, edges[k][2] - x2)) % (2 * math.pi) or 2 * math.pi
        return min(choices, key=corner)

    rings, seen = [], [False] * len(edges)
    for start in range(len(edges)):
        ring, i = [], start
        while not seen[i]:
            seen[i] = True
            ring.append(edges[i][:2])
            i = successor(i)
        if ring:
            rings.append([*ring, ring[0]])
    return rings


def dissolve(zones: DataFrame, by: list[str], rings: str = "rings") -> DataFrame:
    """(by, rings): the union of the zones of each group as rings, by even-odd parity.

    The output row of a group holds all of its border, so its edges meet in one task; borders inside the group
    have gone before. A group whose zones have no rings is left out.
    """
    border = border_edges(zones, by, rings)

    def stitched(key: tuple, table: pa.Table) -> pa.Table:
        columns = [table.column(c).to_pylist() for c in ("x1", "y1", "x2", "y2")]
        found = [[{"x": x, "y": y} for x, y in ring] for ring in _stitch(list(zip(*columns)))]
        names = {name: pa.array([value.as_py()], type=table.schema.field(name).type) for name, value in zip(by, key)}
        kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
        return pa.table(names | {rings: pa.array([found], type=kind)})

    schema = StructType([*[border.schema[c] for c in by], StructField(rings, RINGS)])
    return border.groupBy(*by).applyInArrow(stitched, schema)


def area(rings: str = "rings") -> Column:
    """The area within rings that have it to their left, as ``dissolve`` gives them."""
    return _doubled_area(ring_edges(rings)) / 2
