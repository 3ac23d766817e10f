import math

from pyspark.sql import functions as F

from fathomline.functions import aggregates as agg
from tests.conftest import rows


def test_null_counts_as_a_value(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", None), ("b", None)], "g string, v string")
    out = df.groupBy("g").agg(agg.n_distinct("v").alias("n"), agg.n_distinct("v", count_null=False).alias("k"))
    assert rows(out) == [("a", 3, 2), ("b", 1, 0)]


def test_distinct_where_counts_null_only_in_the_selection(spark):
    df = spark.createDataFrame(
        [("a", 1, None), ("a", 0, "x"), ("a", 1, "y"), ("b", 0, None), ("b", 1, "x")], "g string, c int, v string"
    )
    out = df.groupBy("g").agg(agg.n_distinct_where(F.col("c") == 1, "v").alias("n"))
    assert rows(out) == [("a", 2), ("b", 1)]


def test_sum_and_mean_strict(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 1.0), ("b", 2.0)], "g string, v double")
    out = df.groupBy("g").agg(agg.sum_strict("v").alias("s"), agg.mean_strict("v").alias("m"), agg.mean_present("v").alias("p"))
    assert rows(out) == [("a", None, None, 1.0), ("b", 3.0, 1.5, 1.5)]


def test_sum_over_no_rows_is_zero(spark):
    empty = spark.createDataFrame([], "v double")
    assert rows(empty.agg(agg.sum_strict("v"), agg.sum_where(F.col("v") > 0, "v"))) == [(0.0, 0.0)]


def test_sum_where(spark):
    df = spark.createDataFrame(
        [("a", "I", 1.0), ("b", "N", None), ("b", "I", 2.0), ("c", "N", 2.5)], "g string, s string, v double"
    )
    out = df.groupBy("g").agg(agg.sum_where(F.col("s") == "N", "v").alias("s"))
    assert rows(out) == [("a", 0.0), ("b", None), ("c", 2.5)]


def test_percentage_rounds_half_to_even(spark):
    df = spark.createDataFrame([(0.125, 100.0), (0.0, 0.0)], "a double, b double")
    assert rows(df.agg(agg.percent_of("a", "b"))) == [(0.12,)]
    zero = spark.createDataFrame([(0.0, 0.0)], "a double, b double")
    assert rows(zero.agg(agg.percent_of("a", "b"))) == [(None,)]


def test_standard_error_and_first(spark):
    df = spark.createDataFrame([(2, 1.0, "b"), (1, 3.0, "a"), (3, None, "c")], "o int, v double, t string")
    (error, first), = rows(df.agg(agg.standard_error("v"), agg.first_by("t", "o")))
    assert math.isclose(error, math.sqrt(2) / math.sqrt(2)) and first == "a"
