"""Layers: tables with the geometry of their zones, as GeoJSON."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fathomline.operators.relational import join_on
from fathomline.sources.geojson import GEOMETRY, read_layer, write_layer
from fathomline.sources.tables import write_csv


def _geometry(zones: DataFrame) -> list[str]:
    return [c for c in GEOMETRY if c in zones.columns]


def with_geometry(table: DataFrame, zones: DataFrame) -> DataFrame:
    """Attach the rings of the zone, last, when the table is as small as it gets."""
    return join_on(table, zones.select("zone", *_geometry(zones)), "zone", "left")


def without_geometry(layer: DataFrame) -> DataFrame:
    return layer.drop(*GEOMETRY)


def save_layer(layer: DataFrame, path: str) -> DataFrame:
    """Write a layer and return the scan of what was written."""
    write_layer(layer, path)
    return read_layer(layer.sparkSession, path, layer.drop(*GEOMETRY).schema)


def score_layer(risk: DataFrame, zones: DataFrame) -> DataFrame:
    """Scores with geometry, for zones with production."""
    scores = risk.drop("province", "realm").dropna(subset=["prod_total"])
    attributes = zones.select("zone", "province", "realm", *_geometry(zones))
    return join_on(scores, attributes, "zone", "left")


def zone_production_layer(unit_zone: DataFrame, zones: DataFrame) -> DataFrame:
    """Distinct production rows per unit and zone, with geometry."""
    return with_geometry(unit_zone.distinct().dropna(subset=["species"]), zones)


def native_layer(native: DataFrame, zones: DataFrame) -> DataFrame:
    return with_geometry(native, zones)


def status_layers(native: DataFrame, introduced: DataFrame) -> DataFrame:
    """Native and introduced layers in one."""
    return native.unionByName(introduced)


def layer_attributes(layer: DataFrame, columns: list[str], path: str) -> DataFrame:
    """Write some columns of a layer as CSV, for checking; returns them."""
    attributes = without_geometry(layer).select(*columns)
    write_csv(attributes, path)
    return attributes

