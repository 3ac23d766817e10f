import math
import random

from pyspark.sql import functions as F

from fathomline.operators.spatial import inside, join_points, on_globe_edges, points_in_cover, ring_edges, zone_cover
from tests.conftest import rows

ZONE = "zone string, rings array<array<struct<x:double,y:double>>>"
SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
HOLE = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)]
NOTCHED = [(5.3, 0.2), (9.1, 0.4), (7.2, 1.3), (9.4, 3.9), (5.1, 3.7)]
PART = [(-3.5, -3.5), (-2.2, -3.1), (-2.9, -1.7)]


def _brute(rings, x, y):
    odd, on = False, False
    for ring in rings:
        ring = ring if ring[0] == ring[-1] else [*ring, ring[0]]
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
            cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
            if cross == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                on = True
    return odd or on


def _zones(spark, zones):
    return spark.createDataFrame(list(zones.items()), ZONE)


def test_boundary_is_inside(spark):
    zones = _zones(spark, {"a": [SQUARE]})
    points = [(0.0, 2.0), (4.0, 2.0), (2.0, 0.0), (2.0, 4.0), (0.0, 0.0), (4.0, 4.0), (2.0, 2.0), (4.1, 2.0), (-0.1, 0.0)]
    df = spark.createDataFrame(points, "lon double, lat double")
    tested = df.crossJoin(zones).select("lon", "lat", inside(ring_edges("rings"), "lon", "lat").alias("in"))
    assert [r["in"] for r in tested.collect()] == [True] * 7 + [False] * 2
    assert points_in_cover(df, zone_cover(zones, cell=1.0), 1.0).count() == 7


def test_random_points_match_brute_force(spark):
    shapes = {"holed": [SQUARE, HOLE], "notched": [NOTCHED], "parts": [SQUARE, PART]}
    rng = random.Random(1)
    points = [(i, rng.uniform(-5, 10), rng.uniform(-5, 5)) for i in range(1500)]
    points += [(2000 + i, rng.randint(-8, 20) / 2, rng.randint(-8, 8) / 2) for i in range(500)]
    df = spark.createDataFrame(points, "i int, lon double, lat double").repartition(4)
    expected = sorted((i, z) for i, x, y in points for z, rings in shapes.items() if _brute(rings, x, y))
    for cell in (0.1, 0.3, 1.0, 7.0):
        found = points_in_cover(df, zone_cover(_zones(spark, shapes), cell=cell), cell).select("i", "zone")
        assert sorted(tuple(r) for r in found.collect()) == expected, cell


def test_cells_inside_need_no_edges(spark):
    cover = zone_cover(_zones(spark, {"a": [[(0.0, 0.0), (40.0, 0.0), (40.0, 40.0), (0.0, 40.0)]]}), cell=1.0)
    free = cover.where(F.col("edges").isNull()).count()
    assert free > 1000 and cover.where("edges IS NOT NULL").agg(F.max(F.size("edges"))).first()[0] <= 4


def test_zones_without_points_stay(spark):
    zones = _zones(spark, {"a": [SQUARE], "empty": [PART]})
    points = spark.createDataFrame([("s", 1.5, 0.5)], "species string, lon double, lat double")
    out = join_points(zones.select("zone"), points, zone_cover(zones))
    assert rows(out.select("zone", "species")) == [("a", "s"), ("empty", None)]


def test_join_is_on_cells(spark):
    cover = zone_cover(_zones(spark, {"a": [SQUARE]}))
    points = spark.range(10).select(F.col("id").cast("double").alias("lon"), F.lit(1.0).alias("lat"))
    plan = points_in_cover(points, cover)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_cover_follows_the_edges(spark):
    """A wave with 100,000 edges: each edge is kept about once, and nothing else."""
    n = 50_000
    top = [(i * 100 / n, 10 + 3 * math.sin(i / 40)) for i in range(n + 1)]
    ring = top + [(x, y - 5) for x, y in reversed(top)]
    cover = zone_cover(_zones(spark, {"wave": [ring]}), cell=0.5).cache()
    kept = cover.agg(F.sum(F.size("edges"))).first()[0]
    assert len(ring) <= kept <= 1.3 * len(ring)
    rng = random.Random(2)
    points = [(i, rng.uniform(-1, 101), rng.uniform(0, 15)) for i in range(3000)] + [(10_000 + i, *top[i * 37]) for i in range(1000)]
    found = points_in_cover(spark.createDataFrame(points, "i int, lon double, lat double"), cover, 0.5).select("i")
    got = {r["i"] for r in found.collect()}
    assert got >= set(range(10_000, 11_000))

    def within(x, y):
        if not 0 <= x <= 100:
            return None
        at = min(int(x * n / 100), n - 1)
        (x1, y1), (x2, y2) = top[at], top[at + 1]
        edge = y1 + (x - x1) / (x2 - x1) * (y2 - y1)
        return edge - 5 <= y <= edge

    assert {i for i, x, y in points[:3000] if within(x, y)} == {i for i in got if i < 3000}
    cover.unpersist()


def _wrapped(rings, x, y):
    return any(_brute(rings, x + turn, y) for turn in (-360, 0, 360))


ACROSS = {
    "on": [[(170.0, -10.0), (195.0, -12.0), (190.0, 10.0), (175.0, 12.0)]],
    "back": [[(-175.0, 0.0), (-195.0, 5.0), (-185.0, 20.0)]],
    # three tongues that reach over the line, and a hole on it
    "comb": [
        [(170, -60), (190, -60), (190, -50), (175, -50), (175, -45), (185, -45), (185, -40), (175, -40), (175, -35), (200, -35), (200, -20), (170, -20)],
        [(178, -30), (183, -30), (183, -25), (178, -25)],
    ],
    "touching": [[(150.0, 30.0), (180.0, 30.0), (180.0, 40.0), (150.0, 40.0)]],
    "corner": [[(180.0, 50.0), (190.0, 55.0), (180.0, 60.0), (170.0, 55.0)]],
    "aside": [[(-170.0, 65.0), (-160.0, 65.0), (-160.0, 70.0), (-170.0, 70.0)]],
}


def test_zones_across_the_date_line(spark):
    shapes = {z: [[(float(x), float(y)) for x, y in ring] for ring in rings] for z, rings in ACROSS.items()}
    rng = random.Random(3)
    points = [(i, rng.choice([1, -1]) * rng.uniform(145, 180), rng.uniform(-65, 75)) for i in range(3000)]
    points += [(5000 + i, float(rng.choice([180, -180, 175, -175, 170])), rng.randint(-130, 150) / 2) for i in range(500)]
    df = spark.createDataFrame(points, "i int, lon double, lat double")
    expected = sorted((i, z) for i, x, y in points for z, rings in shapes.items() if _wrapped(rings, x, y))
    for cell in (0.7, 2.0, 9.0):
        found = points_in_cover(df, zone_cover(_zones(spark, shapes), cell=cell), cell).select("i", "zone")
        assert sorted(tuple(r) for r in found.collect()) == expected, cell
    # the same rings given with longitudes that jump
    jumping = {z: [[((x + 180) % 360 - 180 if abs(x) != 180 else x, y) for x, y in ring] for ring in rings] for z, rings in shapes.items()}
    found = points_in_cover(df, zone_cover(_zones(spark, jumping), cell=2.0), 2.0).select("i", "zone")
    assert sorted(tuple(r) for r in found.collect()) == expected


def test_edges_stay_on_the_globe_and_poles_are_refused(spark):
    shapes = {z: [[(float(x), float(y)) for x, y in ring] for ring in rings] for z, rings in ACROSS.items()}
    edges = on_globe_edges(_zones(spark, shapes)).select("e.*").collect()
    assert all(-180 <= e[c] <= 180 for e in edges for c in ("x1", "x2"))
    around = _zones(spark, {"pole": [[(-150.0, 60.0), (-30.0, 60.0), (90.0, 60.0), (170.0, 60.0)]]})
    try:
        zone_cover(around).collect()
    except Exception as error:
        assert "pole" in str(error)
    else:
        raise AssertionError("a ring around a pole was taken")
