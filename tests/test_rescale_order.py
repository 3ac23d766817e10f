import random
import statistics

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from fathomline.operators import order
from fathomline.operators.rescale import impute_mean, minmax
from tests.conftest import rows


def test_minmax(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 4.0), (3, None), (4, 3.0)], "i int, v double")
    assert rows(minmax(df, {"r": "v"}, 0, 100).select("i", "r")) == [(1, 0.0), (2, 100.0), (3, None), (4, 50.0)]
    assert {r[0] for r in rows(minmax(df, {"r": "v"}, skip_null=False).select("r"))} == {None}


def test_minmax_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(7.0,), (7.0,)], "v double")
    assert rows(minmax(df, {"r": "v"}).select("r")) == [(None,), (None,)]


def test_minmax_has_no_join_and_no_window(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("v"))
    plan = minmax(df, {"r": "v"})._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


def test_impute(spark):
    df = spark.createDataFrame([(1.0,), (None,), (2.0,)], "v double")
    assert rows(impute_mean(df, "v")) == [(1.0,), (1.5,), (2.0,)]


def _summary(values):
    values = sorted(values)
    q = statistics.quantiles(values, n=4, method="inclusive") if len(values) > 1 else values * 3
    return [values[0], q[0], q[1], statistics.fmean(values), q[2], values[-1]]


def test_summary(spark):
    rng = random.Random(3)
    a = [rng.gauss(0, 10) for _ in range(997)]
    b = [float(rng.choice([1, 1, 1, 2, 9])) for _ in range(997)]
    df = spark.createDataFrame([(x, y, None) for x, y in zip(a, b)], "a double, b double, c double").repartition(5)
    found = order.six_number_summary(df, ["a", "b", "c"]).collect()
    out = {r["measure"]: [r[c] for c in order.SUMMARY] for r in found}
    assert out["a"] == pytest.approx(_summary(a)) and out["b"] == pytest.approx(_summary(b))
    assert out["c"] == [None] * 6  # no values, but still a row
    assert {r["measure"]: r["n_null"] for r in found} == {"a": 0, "b": 0, "c": 997}


def test_summary_of_no_rows(spark):
    found = order.six_number_summary(spark.createDataFrame([], "a double"), ["a"]).collect()
    assert [tuple(r) for r in found] == [("a", None, None, None, None, None, None, 0)]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=40))
def test_summary_is_exact(spark, values):
    row = order.six_number_summary(spark.createDataFrame([(v,) for v in values], "m double"), ["m"]).first()
    assert [row[c] for c in order.SUMMARY] == pytest.approx(_summary(values), rel=1e-9, abs=1e-6)


def test_summary_with_a_third_on_one_value(spark):
    values = [7.0] * 2000 + [float(k) for k in range(4000)]
    row = order.six_number_summary(spark.createDataFrame([(v,) for v in values], "m double"), ["m"]).first()
    assert [row[c] for c in order.SUMMARY] == pytest.approx(_summary(values))


def test_ordinal(spark):
    rng = random.Random(11)
    data = [(rng.choice([None, 1.0, 2.0, rng.random()]), i) for i in range(600)]
    df = spark.createDataFrame(data, "v double, i int").repartition(6)
    expected = sorted(data, key=lambda r: (r[0] is None, r[0] or 0.0, r[1]))
    placed = order.ordinal(df, "v", ["i"]).orderBy("ord").collect()
    assert [(r["v"], r["i"]) for r in placed] == expected
    assert [r["ord"] for r in placed] == list(range(1, 601))


def test_positions_follow_the_sorted_rows(spark):
    df = spark.range(200).repartition(7).orderBy(F.desc("id"))
    assert sorted((r.position, r.id) for r in order.positions(df).collect()) == [(k + 1, 199 - k) for k in range(200)]
