"""GeoJSON layers, one feature per line, so that files split and write in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from fathomline.sources import versions
from fathomline.sources.schemas import RINGS

_POLYGON = "array<array<array<double>>>"
_MULTIPOLYGON = "array<array<array<array<double>>>>"


GEOMETRY = ("rings", "parts")


def _positions(rings: Column) -> Column:
    return F.transform(rings, lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"])))


def feature(attributes: list[str], rings: str = "rings", parts: str | None = None) -> Column:
    """A feature as a JSON string: the attributes, and the geometry as text of its own type.

    Without ``parts`` the rings are one polygon. With it, a zone of several parts is a MultiPolygon; a zone
    without rings has a null geometry.
    """
    polygon = F.struct(F.lit("Polygon").alias("type"), F.to_json(_positions(F.col(rings))).alias("coordinates"))
    whole = F.when(F.col(rings).isNotNull(), polygon)
    if parts:
        several = F.struct(
            F.lit("MultiPolygon").alias("type"), F.to_json(F.transform(parts, _positions)).alias("coordinates")
        )
        whole = F.when(F.size(parts) > 1, several).otherwise(whole)
    geometry = F.when(
        whole.isNotNull(),
        F.concat(F.lit('{"type":"'), whole["type"], F.lit('","coordinates":'), whole["coordinates"], F.lit("}")),
    ).otherwise("null")
    properties = F.to_json(F.struct(*attributes), {"ignoreNullFields": "false"})
    return F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), properties, F.lit("}"))


def write_layer(df: DataFrame, path: str, rings: str = "rings") -> None:
    """Write a layer as the next version at ``path``; a column ``parts`` keeps the parts of zones apart.

    Until it has been written whole, readers see the version before it.
    """
    attributes = [c for c in df.columns if c not in (rings, "parts")]
    parts = "parts" if "parts" in df.columns else None
    folder = versions.new_folder(path)
    df.select(feature(attributes, rings, parts).alias("value")).write.mode("error").text(folder)
    versions.publish(df.sparkSession, path, folder)


def _parts(geometry: Column) -> Column:
    """The polygons of a geometry, each a list of rings."""
    polygon = F.array(F.from_json(geometry["coordinates"], _POLYGON))
    multi = F.from_json(geometry["coordinates"], _MULTIPOLYGON)
    positions = F.when(geometry["type"] == "MultiPolygon", multi).when(geometry["type"].isNotNull(), polygon)
    as_point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    return F.transform(
        positions, lambda part: F.transform(part, lambda ring: F.transform(ring, as_point)).cast(RINGS)
    )


def _feature_type(properties: StructType) -> StructType:
    # ``coordinates`` nests to a depth that depends on the type: taken as text and parsed by type
    geometry = StructType([StructField("type", StringType()), StructField("coordinates", StringType())])
    return StructType([StructField("geometry", geometry), StructField("properties", properties)])


def _layer(features: DataFrame, properties: StructType) -> DataFrame:
    attributes = [F.col(f"properties.`{name}`").alias(name) for name in properties.names]
    with_parts = features.select(*attributes, _parts(F.col("geometry")).alias("parts"))
    # the inside test works by parity over all rings, so it needs no parts
    return with_parts.select(*[f"`{n}`" for n in properties.names], F.flatten("parts").alias("rings"), "parts")


def read_layer(spark: SparkSession, path: str, properties: StructType) -> DataFrame:
    """Scan a layer of one feature per line: the declared attributes, ``rings`` and ``parts`` (rings by part).

    ``path`` is the latest version of what ``write_layer`` has written there, or plain files of such lines.
    """
    found = versions.current_folder(spark, path) if versions.last_version(spark, path) else path
    return _layer(spark.read.schema(_feature_type(properties)).json(found), properties)


def read_collection(spark: SparkSession, path: str | list[str], properties: StructType) -> DataFrame:
    """Features of files that hold one FeatureCollection each.

    A converter for files as they are published, into the form of ``write_layer``: such a file cannot be
    split, so jobs scan what ``convert_collections`` has written.
    """
    collection = StructType([StructField("features", ArrayType(StringType()))])
    rows = spark.read.schema(collection).option("multiLine", True).json(path)
    text = rows.select(F.explode("features").alias("text"))
    parsed = text.select(F.from_json("text", _feature_type(properties)).alias("f")).select("f.*")
    return _layer(parsed, properties)


def convert_collections(spark: SparkSession, paths: str | list[str], properties: StructType, path: str) -> DataFrame:
    """Turn FeatureCollection files, a task for each, into a layer of one feature per line and scan that."""
    write_layer(read_collection(spark, paths, properties), path)
    return read_layer(spark, path, properties)
