import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from fathomline import session
from fathomline.sources import schemas, versions
from fathomline.sources.enrich import constant_rows, enrich
from fathomline.sources.geojson import convert_collections, read_collection, read_layer, write_layer
from fathomline.sources.occurrences import as_points, load_occurrences, load_probabilities, off_globe, read_occurrences
from fathomline.sources.tables import (
    current_table,
    read_csv,
    read_dimension,
    replace_table,
    stage,
    stored,
    tee_csv,
    write_csv,
)
from tests.conftest import rows

SQUARE = [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]


def test_csv_na_quotes_and_accents(spark, tmp_path):
    (tmp_path / "a.csv").write_text('code,name_en,name_fr,name_es\n01,"Sea, inland",Eau saumâtre,NA\n', encoding="utf-8")
    df = read_csv(spark, str(tmp_path / "a.csv"), schemas.CODE_LIST)
    assert rows(df) == [("01", "Sea, inland", "Eau saumâtre", None)]
    write_csv(df, str(tmp_path / "out"))
    assert rows(read_csv(spark, str(tmp_path / "out"), schemas.CODE_LIST)) == rows(df)


def test_dimension(spark, tmp_path):
    (tmp_path / "d.csv").write_text("UN_Code,Name_En,Other\n008,Albania,x\n")
    schema = schemas.fields("UN_Code:s, Name_En:s, Other:s")
    out = read_dimension(spark, str(tmp_path / "d.csv"), schema, {"UN_Code": "country", "Name_En": "country_name"}, ["country", "country_name"])
    assert out.columns == ["country", "country_name"] and rows(out) == [("008", "Albania")]
    assert out.select(F.col("country").try_cast("int")).first()[0] == 8


def _occurrence_file(path, genus, junk=7, extra=""):
    lines = ["Prose, with commas,,,,,,,,,"] * junk
    lines.append("Genus,Species,Center Lat,Center Long,C-Square,Depth,SST,Salinity,Primary Production,Sea Ice Conc.,Distance to Land")
    lines += [f"{genus},labrax,14.75,-17.25,7101:247:3,66,24.51,35.68,2415,0,19", f"{genus},labrax,18.75,-16.25,7101:486:3,111,22.2,35.9,3781,0,21", extra]
    path.write_text("\n".join(lines) + "\n")


def test_occurrences_of_many_files_in_one_scan(spark, tmp_path):
    _occurrence_file(tmp_path / "a.csv", "Alpha")
    _occurrence_file(tmp_path / "b.csv", "Beta", junk=3, extra=",,,,,,,,,,")
    df = load_occurrences(spark, str(tmp_path / "*.csv"), {"Beta labrax": "Beta bass"})
    assert rows(df.groupBy("species", "file").count()) == [("Alpha labrax", "a.csv", 2), ("Beta bass", "b.csv", 2)]
    assert rows(df.where("file = 'a.csv'").select("lat", "lon")) == [(14.75, -17.25), (18.75, -16.25)]
    points = as_points(df.withColumn("lon", F.col("lon") - 163))
    assert points.schema["lon"].metadata == {"crs": 4326} and points.count() == 4
    assert off_globe(points).count() == 2


def test_columns_are_found_by_name_and_problems_are_told(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Prose about 1,2,3,4\n\nGenus,Species,Center Lat,Center Long\nA,a,1,2\nA,b,x,2\n,,,\nA,c,3,\n")
    (tmp_path / "b.csv").write_text("1,2,3,4,5\nDepth, Center Long ,Center Lat,Genus,Species,Overall Probability\n9,20,10,B,a,0.5\n9,21,11,B,\"a, b\",\n")
    (tmp_path / "c.csv").write_text("Genus,Species,Center Lat\nC,a,1\n")
    (tmp_path / "d.csv").write_text("")
    points, problems = read_occurrences(spark, str(tmp_path / "*.csv"), {"A a": "A new"})
    assert rows(points) == sorted(
        [("A new", 1.0, 2.0, None, "a.csv"), ("B a", 10.0, 20.0, 0.5, "b.csv"), ("B a, b", 11.0, 21.0, None, "b.csv")], key=str
    )
    assert rows(problems) == [("a.csv", "A b", "bad coordinates"), ("a.csv", "A c", "bad coordinates"), ("c.csv", None, "no header")]


def test_rows_of_split_files_stay_below_their_header(spark, tmp_path):
    """Rows that look like data above the header are prose, in whichever split of the file the header lies."""
    above = ["Z,z,1,1"] * 3000
    data = [f"A,a,{i},1" for i in range(3000)]
    (tmp_path / "a.csv").write_text("\n".join([*above, "Genus,Species,Center Lat,Center Long", *data]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        points, _ = read_occurrences(spark, str(tmp_path / "a.csv"))
        assert points.count() == 3000 and {r[0] for r in points.select("species").distinct().collect()} == {"A a"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_probabilities(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Map data,,,,,\n,,,,,\nGenus,Species,Center Lat,Center Long,C-Square Code,Overall Probability\nA,b,1.25,2.75,1104:113:1,0.01\n")
    df = load_probabilities(spark, str(tmp_path / "p.csv"))
    assert rows(df.drop("file")) == [("A b", 1.25, 2.75, 0.01)]


def test_layer_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5, SQUARE), ("b", None, None)], "zone string, v double, rings " + schemas.RINGS.simpleString())
    path = str(tmp_path / "layer")
    write_layer(df, path)
    write_layer(df, path)  # replaces
    assert rows(read_layer(spark, path, schemas.fields("zone:s, v:d")).drop("parts")) == rows(df)


def test_collection_with_multipolygon(spark, tmp_path):
    text = """{"type": "FeatureCollection", "features": [
      {"type": "Feature", "properties": {"zone": "m"}, "geometry": {"type": "MultiPolygon",
       "coordinates": [[[[0,0],[1,0],[1,1],[0,0]]], [[[5,5],[6,5],[6,6],[5,5]], [[5.2,5.1],[5.3,5.1],[5.3,5.2],[5.2,5.1]]]]}},
      {"type": "Feature", "properties": {"zone": "p"}, "geometry": {"type": "Polygon", "coordinates": [[[0,0],[1,0],[1,1],[0,0]]]}}]}"""
    (tmp_path / "c.geojson").write_text(text)
    df = read_collection(spark, str(tmp_path / "c.geojson"), schemas.fields("zone:s"))
    assert rows(df.select("zone", F.size("rings"), F.col("rings")[0][1]["x"])) == [("m", 3, 1.0), ("p", 1, 1.0)]
    again = convert_collections(spark, str(tmp_path / "c.geojson"), schemas.fields("zone:s"), str(tmp_path / "lines"))
    sizes = F.transform("parts", lambda part: F.size(part))
    assert rows(again.select("zone", sizes)) == [("m", [1, 2]), ("p", [1])]


def test_tee_and_stage(spark, tmp_path):
    df = spark.range(5).withColumn("v", F.rand(1))
    out = tee_csv(df, str(tmp_path / "csv"))
    assert rows(out) == rows(read_csv(spark, str(tmp_path / "csv"), out.schema))
    assert "Range" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_stored_stages_only_what_is_computed(spark):
    kept = stage(spark.range(5).withColumn("v", F.lit(1.0)), "t")
    assert stored(kept.where("id > 1").select("id"), "x").inputFiles() == kept.inputFiles()
    again = stored(kept.groupBy("v").count(), "x")
    assert again.inputFiles() and again.inputFiles() != kept.inputFiles()


def test_replace_reads_the_old_version(spark, tmp_path):
    base = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        current_table(spark, base, schemas.fields("a:l"))
    first = replace_table(spark.range(3).toDF("a"), base)
    replace_table(first.withColumn("b", F.col("a") * 2), base)
    os.mkdir(f"{base}/data-of-a-write-that-was-cut-short")
    declared = first.withColumn("b", F.col("a") * 2).schema
    assert rows(current_table(spark, base, declared)) == [(0, 0), (1, 2), (2, 4)]


def test_a_broken_write_changes_nothing(spark, tmp_path):
    base = str(tmp_path / "table")
    replace_table(spark.range(3), base)
    broken = spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("broken off")).cast("bigint")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken off"):
        replace_table(broken, base)
    assert rows(current_table(spark, base, spark.range(1).schema)) == [(0,), (1,), (2,)]
    layer = spark.createDataFrame([("a", SQUARE)], "zone string, rings array<array<struct<x:double,y:double>>>")
    path = str(tmp_path / "layer")
    write_layer(layer, path)
    torn = layer.withColumn("zone", F.raise_error(F.lit("torn")).cast("string"))
    with pytest.raises(Exception, match="torn"):
        write_layer(torn, path)
    assert rows(read_layer(spark, path, schemas.fields("zone:s")).select("zone")) == [("a",)]


def test_writers_at_once_give_a_version_each(spark, tmp_path):
    base = str(tmp_path / "table")
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda k: replace_table(spark.range(k, k + 1), base), range(6)))
    assert versions.last_version(spark, base) == 6
    read = [spark.read.parquet(versions.folder_of(spark, base, n)).first()[0] for n in range(1, 7)]
    assert sorted(read) == list(range(6))
    # a hint that is behind, or gone, costs a longer way up
    (tmp_path / "table" / "_latest").write_text("2")
    assert versions.last_version(spark, base) == 6
    os.remove(tmp_path / "table" / "_latest")
    assert versions.last_version(spark, base) == 6


def test_a_write_based_on_an_old_version_is_refused(spark, tmp_path):
    base = str(tmp_path / "table")
    replace_table(spark.range(1), base)
    replace_table(spark.range(2), base, after=1)
    with pytest.raises(versions.Conflict):
        replace_table(spark.range(3), base, after=1)
    assert current_table(spark, base, spark.range(1).schema).count() == 2
    assert replace_table(spark.range(4), base).count() == 4


def test_enrich_and_constants(spark):
    keys = spark.createDataFrame([("a",), ("b",)], "species string")
    table = spark.createDataFrame([("a", 1), ("a", 2)], "species string, v int")
    assert rows(enrich(keys, table, "species")) == [("a", 1), ("a", 2), ("b", None)]
    assert rows(enrich(keys, table, "species", drop_missing=True)) == [("a", 1), ("a", 2)]
    assert rows(constant_rows(spark, {"zone": "z"}, "species", ["a", "b"])) == [("z", "a"), ("z", "b")]


class _Session:
    """As much of a session as the choice of the folder looks at."""

    def __init__(self, checkpoint=None, **settings):
        self.conf = settings
        self.sparkContext = type("Context", (), {"getCheckpointDir": lambda _: checkpoint})()


def test_staging_root_follows_the_session():
    cluster = _Session(**{"spark.checkpoint.dir": "hdfs://shared/staging/"})
    assert session.staging_root(cluster) == "hdfs://shared/staging"
    assert session.fresh_path(cluster, "t") != session.fresh_path(cluster, "t")


def test_staging_root_without_the_setting():
    warehouse = {"spark.sql.warehouse.dir": "hdfs://shared/warehouse"}
    assert session.staging_root(_Session("hdfs://shared/points", **warehouse)) == "hdfs://shared/points"
    assert session.staging_root(_Session(**warehouse)) == "hdfs://shared/warehouse/staged"


def test_staged_tables_go_with_their_block(spark):
    with session.staged_until_done(spark):
        table = stage(spark.range(3), "gone")
        path = table.inputFiles()[0].removeprefix("file://")
        assert table.count() == 3 and os.path.exists(path)
    assert not os.path.exists(path)
