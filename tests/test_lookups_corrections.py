import pytest
from pyspark.sql import functions as F

from fathomline.operators.corrections import apply_corrections
from fathomline.operators.lookups import checked_lookup
from tests.conftest import rows


def test_lookup_counts_in_one_pass(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, v string")
    table = spark.createDataFrame([(1, "one"), (3, "three"), (None, "none")], "k int, name string")
    looked = checked_lookup(left, table, ["k"])
    assert rows(looked.rows) == rows(spark.createDataFrame([(1, "a", "one"), (1, "b", "one"), (2, "c", None), (None, "d", None)], "k int, v string, n string"))
    assert looked.report() == {"keys": 2, "repeated_keys": 0, "rows": 4, "matched": 2, "unmatched": 2}


@pytest.mark.parametrize("threshold", ["-1", "10MB"])
def test_repeated_keys_are_told(spark, threshold):
    left = spark.range(100).select((F.col("id") % 5).alias("k"))
    table = spark.createDataFrame([(1, "x"), (1, "a"), (2, None), (9, "y"), (9, "y")], "k long, name string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        looked = checked_lookup(left, table, ["k"], repeated="report")
        assert rows(looked.rows.where("k IN (1, 2)").distinct()) == [(1, "a"), (2, None)]
        # the filter above is part of the observed pass only below the observation
        again = checked_lookup(left, table, ["k"], repeated="report")
        assert again.rows.count() == 100
        assert again.report() == {"keys": 3, "repeated_keys": 2, "rows": 100, "matched": 40, "unmatched": 60}
        with pytest.raises(Exception, match="repeats the key"):
            checked_lookup(left, table, ["k"]).rows.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_lookup_without_rows_and_bad_choice(spark):
    left, table = spark.createDataFrame([], "k int"), spark.createDataFrame([], "k int, name string")
    looked = checked_lookup(left, table, ["k"])
    assert looked.rows.collect() == [] and looked.report()["rows"] == 0
    with pytest.raises(ValueError):
        checked_lookup(left, table, ["k"], repeated="first")


TABLE = [("a", 1, 1.0, "x"), ("b", 1, 2.0, "x"), ("b", 1, 3.0, None), ("c", None, 4.0, "x"), ("d", 1, 5.0, "x")]


def test_corrections_of_all_kinds(spark):
    table = spark.createDataFrame(TABLE, "s string, z int, prod double, note string")
    patches = spark.createDataFrame(
        [
            ("a", 1, "set", 9.0), ("b", 1, "remove", None), ("c", None, "set", 8.0), ("d", 1, "add", 7.0), ("e", 1, "add", 6.0),
            ("f", 1, "set", 1.0), ("g", 1, "remove", None), ("h", 1, "set", 1.0), ("h", 1, "add", 1.0), ("d", 2, "swap", 1.0),
        ],
        "s string, z int, op string, prod double",
    )
    corrected, account = apply_corrections(table, patches, ["s", "z"])
    assert rows(corrected) == rows(
        spark.createDataFrame([("a", 1, 9.0, "x"), ("c", None, 8.0, "x"), ("d", 1, 5.0, "x"), ("e", 1, 6.0, None)], table.schema)
    )
    assert {(r.s, r.z, r.op): (r.outcome, r.n_rows) for r in account.collect()} == {
        ("a", 1, "set"): ("applied", 1), ("b", 1, "remove"): ("applied", 2), ("c", None, "set"): ("applied", 1),
        ("d", 1, "add"): ("already there", 0), ("e", 1, "add"): ("applied", 1), ("f", 1, "set"): ("no row", 0),
        ("g", 1, "remove"): ("no row", 0), ("h", 1, "set"): ("ambiguous", 0), ("h", 1, "add"): ("ambiguous", 0),
        ("d", 2, "swap"): ("unknown operation", 0),
    }


def test_corrections_of_nothing(spark):
    table = spark.createDataFrame(TABLE, "s string, z int, prod double, note string")
    none = spark.createDataFrame([], "s string, z int, op string, prod double")
    corrected, account = apply_corrections(table, none, ["s", "z"])
    assert rows(corrected) == rows(table) and account.count() == 0
    with pytest.raises(ValueError, match="lacks"):
        apply_corrections(table, none.withColumn("other", F.lit(1)), ["s", "z"])
