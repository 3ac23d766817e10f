import math

import pytest
from pyspark.sql import functions as F

from fathomline.functions import scalars
from fathomline.functions.fixed_values import PATHOGEN_GROUPS
from fathomline.functions.student_t import TABLE_SIZE, central_probability, t_quantile, t_table
from tests.conftest import rows


def test_names_and_labels(spark):
    df = spark.createDataFrame([("Salmo salar",), ("Salmo",), ("Salmo spp",), (None,)], "n string")
    assert rows(df.where(scalars.is_binomial("n"))) == [("Salmo salar",)]
    recoded = df.select(scalars.recode("n", {"Salmo": "Trutta"}).alias("n"))
    assert rows(recoded) == [("Salmo salar",), ("Salmo spp",), ("Trutta",), (None,)]


def test_collapse_keeps_unlisted(spark):
    df = spark.createDataFrame([("Copepoda",), ("Protozoa",), ("Virus",)], "t string")
    out = df.select("t", scalars.collapse("t", PATHOGEN_GROUPS))
    assert rows(out) == [("Copepoda", "Parasites"), ("Protozoa", "Others"), ("Virus", "Virus")]


def test_ordinals(spark):
    df = spark.createDataFrame([("a",), ("b",), ("z",)], "t string")
    out = df.select("t", scalars.label_ordinal("t", ["a", "b"]), scalars.label_ordinal("t", ["a", "b"], reverse=True))
    assert rows(out) == [("a", 1, 2), ("b", 2, 1), ("z", None, None)]


def test_if_else_is_null_for_a_null_condition(spark):
    df = spark.createDataFrame([(1,), (3,), (None,)], "v int")
    out = df.select(scalars.if_else(F.col("v") > 2, F.lit("y"), F.lit("n")).alias("r"))
    assert rows(out) == [("n",), ("y",), (None,)]


def test_numbers(spark):
    df = spark.createDataFrame([(0.0, 2.5), (4.0, 9.0)], "a double, b double")
    out = df.select(scalars.reciprocal("a"), F.bround("b"), scalars.mean_of("a", "b"), scalars.log10_plus1("b"))
    assert rows(out) == [(0.25, 9.0, 6.5, 1.0), (None, 2.0, 1.25, math.log10(3.5))]


def test_t_distribution():
    table = t_table()
    assert len(table) == TABLE_SIZE
    # printed table values, 0.975 quantile
    for df, t in {1: 12.706, 2: 4.303, 5: 2.571, 10: 2.228, 30: 2.042, 120: 1.980}.items():
        assert table[df - 1] == pytest.approx(t, abs=6e-4)
    assert central_probability(table[6], 7) == pytest.approx(0.95, abs=1e-12)
    assert t_table(0.99)[9] == pytest.approx(3.169, abs=6e-4)


def test_t_quantile_column(spark):
    df = spark.range(0, 400, 1, 1).select("id", t_quantile(F.col("id")).alias("t"))
    values = [r["t"] for r in df.orderBy("id").collect()]
    assert values[0] is None and values[1] == pytest.approx(12.7062047)
    assert all(a > b for a, b in zip(values[1:], values[2:]))  # no jump where the table ends
    assert values[300] == pytest.approx(1.967903, abs=1e-5)
    assert central_probability(values[399], 399) == pytest.approx(0.95, abs=1e-10)
