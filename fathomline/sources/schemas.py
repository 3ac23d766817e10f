"""Declared schemas of the inputs. Nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

_KINDS = {"s": StringType(), "d": DoubleType(), "i": IntegerType(), "l": LongType()}


def fields(spec: str) -> StructType:
    """A schema from ``"name:kind, ..."`` with kind s(tring), d(ouble), i(nt) or l(ong)."""
    parts = (item.strip().rsplit(":", 1) for item in spec.split(","))
    return StructType([StructField(name.strip(), _KINDS[kind]) for name, kind in parts])


# Codes stay strings: area and country codes are zero-padded. Numbers are derived by a cast.
PRODUCTION = fields("country:s, area:s, species:s, environment:i, yr:i, quantity:d, value:d")
COUNTRY = fields("country:s, iso3:s, country_name:s")
SPECIES = fields("species:s, spp_name:s, sci_name:s, major_group:s")
CODE_LIST = fields("code:s, name_en:s, name_fr:s, name_es:s")
UNIT_PRODUCTION = fields("country_name:s, species:s, area:i, iso3:s, country:i, mean_prod:d, country_num:i")
UNIT_ZONE = fields(
    "country_name:s, species:s, area:i, iso3:s, country:i, mean_prod:d, country_num:i, zone:s, n_zones:i, zone_prod:d"
)
TRAIT = fields("species:s, max_length:d, troph:d, k:d")
ASSOCIATION = fields("species:s, agent:s, taxon:s")
NATIVE = fields("zone:s, species:s, status:s")

POINT = StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])
RINGS = ArrayType(ArrayType(POINT))
ZONE = StructType(fields("zone:s, province:s, realm:s").fields + [StructField("rings", RINGS)])
