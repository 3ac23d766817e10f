"""The chain of jobs on the published tables, against the published results.

``GOLDEN_TABLES`` is a JSON object from the roles in ``LAYOUTS`` to the CSV files that play them; they are read in
place, never copied. Skipped when it is unset.
"""

import json
import os

import pytest
from pyspark.sql import functions as F

from fathomline.plans.native import status_label
from fathomline.plans.pathogens import pathogenic_score
from fathomline.plans.production import apportion_zones
from fathomline.plans.reports import province_means, six_number_summary, status_totals
from fathomline.plans.scores import (
    invasive_score_of,
    overall_risk,
    production_scores_of,
    zone_production_scores,
    zone_species_profile,
)
from fathomline.plans.traits import trait_index
from fathomline.sources.schemas import fields
from fathomline.sources.tables import read_csv, stage

FILES = json.loads(os.environ.get("GOLDEN_TABLES", "{}"))
pytestmark = pytest.mark.skipif(not FILES, reason="GOLDEN_TABLES is not set")

_UNIT = "country_name:s, species:s, area:i, iso3:s, country:i, mean_prod:d, country_num:i, zone:s"
UNIT = ["species", "country_name", "area", "iso3", "country"]
LAYOUTS = {
    "unit_zones": _UNIT,
    "apportioned": f"{_UNIT}, n_zones:i, zone_prod:d",
    "status": f"{_UNIT}, n_zones:i, zone_prod:d, status:s, introduced:i, native:i",
    "traits": "species:s, max_length:d, troph:d, k:d, eco_ind:d",
    "pathogens": "zone:s, n_pathogen:l",
    "zone_scores": "zone:s, n_total:l, n_introduced:l, n_native:l, prod_total:d, prod_native:d, prod_introduced:d, genetic_score:d",
    "risk": "province:s, zone:s, realm:s, n_total:l, n_introduced:l, n_native:l, prod_total:d, prod_native:d, "
    "prod_introduced:d, Genetic:d, Invasive:d, Diseases:d, Overall:d",
}


def _table(spark, name):
    return read_csv(spark, FILES[name], fields(LAYOUTS[name]))


def _same(got, expected, keys, figures, tolerance=1e-6):
    """Rows of both by key, figures alike."""
    ours, theirs = ({tuple(r[k] for k in keys): r for r in df.collect()} for df in (got, expected))
    assert ours.keys() == theirs.keys() and len(theirs) > 20
    for key, row in theirs.items():
        for figure in figures:
            assert ours[key][figure] == pytest.approx(row[figure], rel=tolerance, abs=tolerance), (key, figure)


@pytest.fixture(scope="module")
def status(spark):
    return _table(spark, "status")


@pytest.fixture(scope="module")
def risk(spark, status):
    index = trait_index(stage(_table(spark, "traits").drop("eco_ind"), "golden-traits"))
    profile = stage(zone_species_profile(status), "golden-profile")
    scored = production_scores_of(profile)
    zones = _table(spark, "risk").select("zone", "province", "realm")
    agents = pathogenic_score(_table(spark, "pathogens"), scored)
    return stage(overall_risk(scored, invasive_score_of(profile, index), agents, zones), "golden-risk")


def test_apportioned_production(spark):
    by_hand = _table(spark, "unit_zones")
    expected = _table(spark, "apportioned").distinct()
    _same(apportion_zones(by_hand.distinct(), UNIT), expected, [*UNIT, "zone"], ["n_zones", "zone_prod"])


def test_status_of_units(spark, status):
    native = status.where("native = 1").select("zone", "species").distinct()
    labelled = status_label(status.drop("status", "introduced", "native"), native)
    keys = [*UNIT, "zone"]
    _same(labelled.dropDuplicates(keys), status.dropDuplicates(keys), keys, ["introduced", "native"])
    assert labelled.count() == status.count()


def test_trait_index(spark):
    expected = _table(spark, "traits")
    _same(trait_index(stage(expected.drop("eco_ind"), "golden-traits")), expected, ["species"], ["eco_ind"])


def test_scores_per_zone(spark, status):
    figures = ["n_total", "n_introduced", "n_native", "prod_total", "prod_native", "prod_introduced", "genetic_score"]
    _same(zone_production_scores(status), _table(spark, "zone_scores"), ["zone"], figures)


def test_overall_risk(spark, risk):
    figures = ["prod_total", "prod_native", "prod_introduced", "Genetic", "Invasive", "Diseases", "Overall"]
    _same(risk, _table(spark, "risk"), ["zone", "province", "realm"], figures)


def test_reports(risk):
    totals = status_totals(risk).first()
    assert totals["percent_introduced"] == 26.39 and totals["introduced"] == pytest.approx(1.04e6, rel=0.01)
    top = province_means(risk, ["province"]).first()
    assert "Northwest Pacific" in top["province"] and top["Overall"] == pytest.approx(202.93, abs=0.005)
    row = six_number_summary(risk, ["Overall"]).first()
    expected = [2.443807, 57.845532, 85.744605, 96.722047, 128.299635, 271.275102]
    assert [row[c] for c in ("min", "q1", "median", "mean", "q3", "max")] == pytest.approx(expected, abs=1e-6)
    assert risk.where(F.col("Overall").isNull()).count() == 0
