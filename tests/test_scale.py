"""What the plans must look like for large and skewed input."""

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from fathomline.operators import relational as rel
from fathomline.plans.job_queries import occurrence_files
from fathomline.plans.scores import zone_production_scores
from fathomline.plans.star_tables import StarTables
from fathomline.session import INPUT_PER_PARTITION, folder_bytes, tune
from fathomline.sources.occurrences import read_occurrences
from fathomline.sources.tables import stage


@contextmanager
def settings(spark, **values):
    values = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows has one key."""
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 997).cast("string")))
    df = spark.range(0, 120_000, 1, 8).select(
        key.alias("species"),
        F.concat(F.lit("z"), (F.col("id") % 41).cast("string")).alias("zone"),
        F.col("id").cast("double").alias("mean_prod"),
        F.sha2(F.col("id").cast("string"), 256).alias("payload"),
    )
    return stage(df, "skewed")


SHUFFLED = {
    "spark__sql__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "200KB",
    "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "2",
    "spark__sql__adaptive__advisoryPartitionSizeInBytes": "100KB",
}


def test_hot_key_is_split_when_a_group_statistic_is_joined_back(spark, skewed):
    with settings(spark, **SHUFFLED):
        out = rel.group_distinct(skewed, ["species"], "zone", "n")
        plan = final_plan(out.select("species", "zone", "n", "payload"))
        assert "skew=true" in plan
        counts = {r["species"]: r["n"] for r in out.select("species", "n").distinct().collect()}
    assert counts["hot"] == 41 and out.count() == 120_000


def test_hot_key_is_split_when_presence_is_looked_up(spark, skewed):
    native = skewed.where("zone = 'z1'").select("species", "zone")
    with settings(spark, **SHUFFLED):
        out = rel.label_presence(skewed, native, ["species"], "status", "Native", "Introduced")
        # grouped by the join key right after the join, which alone would keep the split from happening
        plan = final_plan(out.groupBy("species", "status").agg(F.max("payload"), F.count(F.lit(1))))
    assert "skew=true" in plan and out.count() == 120_000


def test_scores_combine_before_every_shuffle_and_need_no_expand(spark, skewed):
    status = skewed.withColumnRenamed("mean_prod", "zone_prod").withColumn("status", F.lit("Native"))
    plan = final_plan(zone_production_scores(status))
    assert "Expand" not in plan and plan.count("partial_sum") >= 2


def test_top_ties_prunes_before_the_shuffle(spark, skewed):
    plan = final_plan(rel.top_ties(skewed, ["species"], "mean_prod", 3))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_filters_and_columns_reach_the_scan(spark, skewed):
    plan = skewed.where("mean_prod > 5").groupBy("zone").agg(F.avg("mean_prod"))._jdf.queryExecution().toString()
    assert "GreaterThan(mean_prod,5.0)" in plan and "ReadSchema: struct<zone:string,mean_prod:double>" in plan


def test_shuffle_partitions_follow_the_input(spark, tmp_path):
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    (tmp_path / "f").write_bytes(b"x" * 1000)
    assert folder_bytes(spark, str(tmp_path)) == 1000
    tune(spark, 100 * 10**12)
    assert int(spark.conf.get(key)) == -(-100 * 10**12 // INPUT_PER_PARTITION)
    tune(spark, 1000)
    assert spark.conf.get(key) == spark.conf.get("spark.sql.shuffle.partitions")


@pytest.mark.parametrize("most", ["0", "50"])
def test_occurrence_files_are_made_without_a_task_for_a_layout(spark, tmp_path, most):
    """Each task writes its points below a header of its own, also in a session that cuts files at some records."""
    spark.createDataFrame([(0, "AFRICA")], "r_regionkey int, r_name string").write.parquet(str(tmp_path / "region.parquet"))
    points = spark.range(0, 4000, 1, 16).select(
        F.when(F.col("id") % 4 == 0, 1).otherwise(0).alias("file"),
        F.lit("A").alias("genus"),
        F.concat(F.lit("a"), (F.col("id") % 7).cast("string")).alias("epithet"),
        (F.col("id") * 0.25).cast("string").alias("lat"),
        F.lit("2.0").alias("lon"),
    )
    # the third layout has no points
    layouts = [["Genus", "Species", "Center Lat", "Center Long"], ["Center Long", "Depth", "Center Lat", "Species", "Genus"], ["Genus", "Species", "Center Lat", "Center Long"]]
    with settings(spark, spark__sql__files__maxRecordsPerFile=most):
        path = occurrence_files(StarTables(spark, str(tmp_path)), points, layouts)
    found, problems = read_occurrences(spark, path)
    made = points.select(F.concat_ws(" ", "genus", "epithet"), F.col("lat").cast("double"), F.col("lon").cast("double"))
    read = found.select("species", "lat", "lon")
    assert read.count() == 4000 and read.exceptAll(made).count() == 0 and problems.count() == 0
    per_file = {r[0]: r[1] for r in found.groupBy("file").count().collect()}
    assert len(per_file) == 32 and max(per_file.values()) <= 250
