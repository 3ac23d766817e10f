import random
from collections import Counter

from pyspark.sql import functions as F

from fathomline.operators import relational as rel
from tests.conftest import rows


def test_null_safe_join(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, a int")
    b = spark.createDataFrame([(None, 10), ("y", 20)], "k string, b int")
    assert rows(rel.join_on(a, b, "k", "left", null_safe=True)) == [("x", 2, None), (None, 1, 10)]
    full = rel.join_on(a, b, "k", "full", null_safe=True).select("k", "a", "b")
    assert rows(full) == [("x", 2, None), ("y", None, 20), (None, 1, 10)]
    assert rows(rel.join_on(a, b, "k", "left")) == [("x", 2, None), (None, 1, None)]


def test_null_safe_join_hashes(spark):
    a = spark.range(10).select(F.col("id").alias("k"), F.lit(1).alias("a"))
    b = spark.range(10).select(F.col("id").alias("k"), F.lit(1).alias("b"))
    plan = rel.join_on(a, b, "k", null_safe=True)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_presence_label_does_not_multiply_rows(spark):
    data = spark.createDataFrame([("s", "z"), ("s", "y")], "species string, zone string")
    native = spark.createDataFrame([("s", "z"), ("s", "z")], "species string, zone string")
    out = rel.label_presence(data, native, ["species", "zone"], "status", "Native", "Introduced")
    assert rows(out.select("zone", "status")) == [("y", "Introduced"), ("z", "Native")]


def test_group_distinct_treats_null_group_and_value_as_values(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), (None, "x"), (None, "x")], "g string, v string")
    assert rows(rel.group_distinct(df, ["g"], "v", "n")) == [("a", "x", 2), ("a", None, 2), (None, "x", 1), (None, "x", 1)]


def test_top_ties(spark):
    df = spark.createDataFrame([("a", 5), ("a", 5), ("a", 4), ("b", None), ("b", 1), (None, 2)], "g string, w int")
    assert rows(rel.top_ties(df, ["g"], "w", 1)) == [("a", 5), ("a", 5), ("b", 1), (None, 2)]
    assert rows(rel.top_ties(df, ["g"], "w", 2)) == [("a", 5), ("a", 5), ("b", 1), (None, 2)]
    assert len(rows(rel.top_ties(df, ["g"], "w", 3))) == 5


def test_top_ties_against_rank(spark):
    rng = random.Random(5)
    data = [(rng.choice("abbbbb"), rng.randint(0, 9), i) for i in range(400)]
    df = spark.createDataFrame(data, "g string, w int, i int").repartition(7)
    for n in (1, 2, 5, 60):
        expected = [(g, w, i) for g, w, i in data if sum(1 for h, v, _ in data if h == g and v > w) < n]
        assert sorted(tuple(r) for r in rel.top_ties(df, ["g"], "w", n).collect()) == sorted(expected)


def test_repeated_rows(spark, monkeypatch):
    data = [("s", "a")] * 3 + [("s", "b")] + [("t", None)] * 26
    df = spark.createDataFrame(data, "s string, a string")
    expected = Counter({("s", "a"): 2, ("t", None): 25})
    assert Counter(rows(rel.repeated_rows(df, ["s", "a"]))) == expected
    monkeypatch.setattr(rel, "_COPIES_PER_TASK_ROW", 4)
    assert Counter(rows(rel.repeated_rows(df, ["s", "a"]))) == expected


def test_share_union_and_columns(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 0.0)], "g string, v double")
    assert rows(rel.group_share(df, ["g"], "v", "r")) == [("a", 1.0, 0.25), ("a", 3.0, 0.75), ("b", 0.0, None)]
    other = spark.createDataFrame([("c",)], "g string")
    assert rows(rel.union_all(df, other)) == [("a", 1.0), ("a", 3.0), ("b", 0.0), ("c", None)]
    wide = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, d int")
    assert rel.lead_columns(wide, ["c"], ["a"]).columns == ["c", "b", "d"]
    assert rel.column_range(wide, "a", "c").columns == ["a", "b", "c"]
    assert rel.column_range(wide, "b", "c", "a").columns == ["b", "c", "a"]


def test_precedence_of_or(spark):
    df = spark.createDataFrame([(False, True, True), (False, True, False), (True, True, False)], "a boolean, b boolean, c boolean")
    assert rows(df.where("a AND b OR c")) == [(False, True, True), (True, True, False)]


def test_membership(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    keys = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert rows(rel.keep_members(df, keys, "k")) == [("a", 1), (None, 3)]
    assert rel.keep_members(df, keys, "k").columns == ["k", "v"]
