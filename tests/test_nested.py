import pytest
from pyspark.sql import functions as F

from fathomline.operators import nested as n
from tests.conftest import rows


def _records(spark, count=50):
    data = [("hot", i, f"t{i}") for i in range(count)] + [("cold", 1, "x")]
    return spark.createDataFrame(data, "k string, i int, t string").repartition(4)


def test_all_keys_have_the_same_form(spark):
    out = n.nest(_records(spark), ["k"], ["i"], "r", n_chunks=1)
    assert rows(out.select("k", "chunk", F.size("r"))) == [("cold", 0, 1), ("hot", 0, 50)]
    hot = out.where("k = 'hot'").select(n.all_values("r", "i")).first()[0]
    assert hot == list(range(50))


def test_a_key_of_many_records_is_spread_and_complete(spark):
    many = _records(spark, 25_000)
    out = n.nest(many, ["k"], ["i"], "r", chunk_records=2_000)
    sizes = [r["s"] for r in out.where("k = 'hot'").select(F.size("r").alias("s")).collect()]
    assert len(sizes) == 13 and max(sizes) < 2 * 2_000 and sum(sizes) == 25_000
    assert rows(n.unnest(out, "r").select("k", "i", "t")) == rows(many)


def test_equal_records_do_not_meet_in_one_array(spark):
    """A third of three million rows on one key, half of them equal."""
    hot = F.col("id") % 3 == 0
    record = F.when(hot & (F.col("id") % 2 == 0), F.lit(-1)).otherwise(F.col("id"))
    df = spark.range(0, 3_000_000, 1, 8).select(F.when(hot, -1).otherwise(F.col("id") % 99_991).alias("k"), record.alias("i"))
    out = n.nest(df, ["k"], ["i"], "r").withColumn("s", F.size("r"))
    found = out.agg(F.max("s"), F.sum("s"), F.sum(F.size(F.filter("r", lambda r: r["i"] == -1)))).first()
    assert found[0] <= 2 * n.CHUNK_RECORDS and found[1] == 3_000_000 and found[2] == 500_000
    assert out.where("k = -1").count() >= 100


def test_null_and_repeated_records_keep_their_number(spark):
    data = [("a", None, None), ("a", None, None), ("a", 1, "x"), (None, 1, "x"), (None, 1, "x")]
    df = spark.createDataFrame(data, "k string, i int, t string")
    for records in (1, 2, 10):
        out = n.nest(df, ["k"], ["i"], "r", chunk_records=records)
        assert rows(n.unnest(out, "r").select("k", "i", "t")) == rows(df)
    assert n.nest(df.limit(0), ["k"], ["i"], "r").count() == 0


def test_tables_side_by_side(spark):
    keys = spark.createDataFrame([("hot",), ("none",)], "k string")
    other = spark.createDataFrame([("hot", 1, 2.5), ("cold", 1, 1.0)], "k string, j int, v double")
    wide = n.nest_tables(keys, {"a": (_records(spark), ["i"]), "b": (other, ["j"])}, ["k"], n_chunks=3)
    assert rows(n.unnest(wide, "b").select("k", "j", "v")) == [("hot", 1, 2.5)]
    assert n.unnest(wide, "a").count() == 50
    kept = n.unnest(wide.where("k = 'none'").select("k", "b"), "b", keep_empty=True)
    assert rows(kept) == [("none", None, None)]


def test_only_value_needs_one_record(spark):
    nested = n.nest(_records(spark).withColumn("v", F.lit(1.5)), ["k"], ["i"], "r")
    assert rows(n.only_value(nested.where("k = 'cold'"), ["k"], "r", "v")) == [("cold", 1.5)]
    with pytest.raises(Exception, match="exactly one record"):
        n.only_value(nested, ["k"], "r", "v").collect()
