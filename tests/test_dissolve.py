import random

from pyspark.sql import functions as F

from fathomline.operators.dissolve import area, border_edges, dissolve
from tests.test_spatial import HOLE, SQUARE, ZONE, _brute


def _square(x, y, size=1.0, turn=False):
    ring = [(x, y), (x + size, y), (x + size, y + size), (x, y + size)]
    return ring[::-1] if turn else ring


def _dissolved(spark, rows):
    df = spark.createDataFrame(rows, f"g string, {ZONE}")
    out = dissolve(df, ["g"]).withColumn("area", area())
    return {r["g"]: ([[(p["x"], p["y"]) for p in ring] for ring in r["rings"]], r["area"]) for r in out.collect()}


def test_neighbours_become_one_ring(spark):
    rings, found = _dissolved(spark, [("a", "z1", [_square(0.0, 0.0)]), ("a", "z2", [_square(1.0, 0.0, turn=True)])])["a"]
    assert len(rings) == 1 and found == 2.0
    assert sorted(rings[0][:-1]) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (2, 1)] and rings[0][0] == rings[0][-1]


def test_holes_filled_holes_and_corners(spark):
    frame = [(float(x), float(y)) for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    rows = [("frame", f"{x}{y}", [_square(x, y)]) for x, y in frame]
    rows += [("corner", "a", [_square(0.0, 0.0)]), ("corner", "b", [_square(1.0, 1.0)])]
    rows += [("holed", "a", [SQUARE, HOLE]), ("filled", "a", [SQUARE, HOLE]), ("filled", "b", [HOLE])]
    rows += [("none", "a", []), ("islet", "a", [SQUARE, HOLE, _square(1.25, 1.25, 0.5)]), (None, "a", [SQUARE])]
    got = _dissolved(spark, rows)
    assert {g: (len(r), a) for g, (r, a) in got.items()} == {
        "frame": (2, 8.0), "corner": (2, 2.0), "holed": (2, 15.0), "filled": (1, 16.0), "islet": (3, 15.25), None: (1, 16.0)
    }


def test_random_unions_hold_the_same_points(spark):
    """Any set of cells of a grid, cut along diagonals and turned either way: its union holds what its cells hold."""
    rng = random.Random(4)
    rows, cells = [], []
    for x in range(12):
        for y in range(12):
            low, high = [(x, y), (x + 1, y), (x + 1, y + 1)], [(x, y), (x + 1, y + 1), (x, y + 1)]
            for ring in (low, high):
                if rng.random() < 0.55:
                    ring = [(float(a), float(b)) for a, b in ring]
                    cells.append(ring)
                    rows.append(("g", f"{len(rows)}", [ring[::-1] if rng.random() < 0.5 else ring]))
    rings, found = _dissolved(spark, rows)["g"]
    assert abs(found - 0.5 * len(cells)) < 1e-9
    assert sum(len(r) - 1 for r in rings) < 3 * len(cells)
    for _ in range(2000):
        x, y = rng.uniform(0, 12), rng.uniform(0, 12)
        assert _brute(rings, x, y) == _brute(cells, x, y)


def test_cancelling_is_a_grouped_count(spark):
    df = spark.createDataFrame([("a", "z1", [_square(0.0, 0.0)]), ("a", "z2", [_square(1.0, 0.0)])], f"g string, {ZONE}")
    border = border_edges(df, ["g"])
    assert border.count() == 6
    plan = border._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "Window" not in plan
    assert border.agg(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))).first()[0] == 4.0
