import math

import pytest
from pyspark.sql import functions as F

from fathomline.plans import layers, native, pathogens, production, reports, scores, traits
from tests.conftest import rows

STATUS = "species string, zone string, zone_prod double, status string"


def test_star_recodes_before_screening(spark):
    fact = spark.createDataFrame([("C1", "S1", 3, 2012, 900.0), ("C1", "S1", 3, 2012, 700.0), ("C9", "S2", 3, 2012, 9.0)], "country string, species string, environment int, yr int, quantity double")
    country = spark.createDataFrame([("C1", "ALB")], "country string, iso3 string")
    species = spark.createDataFrame(
        [("S1", "Croaker", "Larimichthys croceus", "PISCES"), ("S2", "Fish nei", "Osteichthyes spp", "PISCES")],
        "species string, spp_name string, sci_name string, major_group string",
    )
    star = production.star_production(fact, [(country, "country"), (species, "species")])
    assert star.count() == 3
    top = production.top_species(star)
    assert rows(top) == [("Larimichthys crocea", "Croaker", 800.0, 1)]
    study = production.study_production(star, top.select("species"))
    assert study.count() == 2
    means = production.mean_production(study, ["iso3", "study_species"], 2006)
    assert rows(means) == [("ALB", "Larimichthys crocea", 800.0)]


def test_null_country_counts_in_the_screening(spark):
    star = spark.createDataFrame([("A b", "n", "PISCES", 3, 2015, 600.0, None), ("A b", "n", "PISCES", 3, 2015, 800.0, "X")], "sci_name string, spp_name string, major_group string, environment int, yr int, quantity double, iso3 string")
    assert rows(production.top_species(star)) == [("A b", "n", 700.0, 2)]


def test_codes(spark):
    df = spark.createDataFrame([("012",), ("x",)], "country string")
    assert rows(production.numeric_code(df, "country", "n")) == [("012", 12), ("x", None)]


def test_apportioned_parts_sum_to_the_whole(spark):
    df = spark.createDataFrame([("s", "c", 10.0, "z1"), ("s", "c", 10.0, "z2"), ("s", "c", 10.0, "z2"), ("t", "c", 4.0, "z1")], "species string, country string, mean_prod double, zone string").distinct()
    out = production.apportion_zones(df, ["species", "country"])
    sums = out.groupBy("species").agg(F.sum("zone_prod"), F.max("mean_prod"))
    assert all(total == whole for _, total, whole in rows(sums))


def test_apportion_by_ratio(spark):
    weight = spark.createDataFrame([("s", "z1", 1.0), ("s", "z2", 3.0)], "species string, zone string, weight double")
    unit = spark.createDataFrame([("s", 8.0)], "species string, mean_prod double")
    out = production.apportion_by_ratio(weight, unit, ["species"]).select("zone", "ratio", "zone_prod")
    assert rows(out) == [("z1", 0.25, 2.0), ("z2", 0.75, 6.0)]


def test_native_table_and_status(spark):
    presence = spark.createDataFrame([("z", "s"), ("z", "Siganus rivulatus")], "zone string, species string")
    table = native.native_table(presence, native.manual_native(spark))
    assert table.count() == 10 and table.where("species = 'Siganus rivulatus'").count() == 0
    units = spark.createDataFrame([("s", "z", 1.0), ("s", "y", 1.0), ("s", "z", None)], "species string, zone string, mean_prod double")
    out = native.status_label(units, table.unionByName(table))
    assert rows(out.select("zone", "status", "introduced", "native")) == [("y", "Introduced", 1, 0), ("z", "Native", 0, 1)]


def test_zone_scores(spark):
    data = [("a", "z", 9.0, "Native"), ("a", "z", 90.0, "Native"), ("b", "z", 5.0, "Introduced"), ("a", "z", 1.0, "Introduced"), ("b", "y", 2.0, "Introduced"), (None, "x", None, "Native")]
    out = scores.zone_production_scores(spark.createDataFrame(data, STATUS))
    assert rows(out) == [
        ("x", 1, 0, 1, None, None, 0.0, None),
        ("y", 1, 1, 0, 2.0, 0.0, 2.0, 0.0),
        ("z", 2, 2, 1, 105.0, 99.0, 6.0, 2.0),
    ]


def test_native_and_introduced_make_the_total_in_any_order(spark):
    data = [(f"s{i % 7}", f"z{i % 5}", float(i), "Native" if i % 3 else "Introduced") for i in range(200)]
    df = spark.createDataFrame(data, STATUS)
    first = rows(scores.zone_production_scores(df))
    assert all(r[4] == pytest.approx(r[5] + r[6]) for r in first)
    assert rows(scores.zone_production_scores(df.repartition(9).orderBy(F.desc("zone_prod")))) == first


def test_unmatched_species_is_one_pathogen(spark):
    units = spark.createDataFrame([("a", "z"), ("a", "z"), ("b", "z"), ("b", "y")], "species string, zone string")
    agents = spark.createDataFrame([("a", "p"), ("a", "q"), ("a", "q")], "species string, agent string")
    assert rows(pathogens.pathogens_by_zone(units, agents)) == [("y", 1), ("z", 3)]
    assert rows(pathogens.pathogens_by_zone(units, agents, count_null=False)) == [("y", 0), ("z", 2)]


def test_sqrt_score_equals_the_fan_out(spark):
    units = [("a", "z", 4.0), ("a", "z", 9.0), ("b", "z", 16.0), ("c", "y", None)]
    agents = [("a", "p"), ("a", "q"), ("a", "q"), ("a", None), ("c", "p")]
    expected = {}
    for species, zone, prod in units:
        mine = [g for s, g in agents if s == species] or [None]
        part = math.nan if prod is None else len(set(mine)) * math.sqrt(prod) * len(mine) / 1e4
        expected[species, zone] = expected.get((species, zone), 0.0) + part
    out = pathogens.pathogenic_score_sqrt(
        spark.createDataFrame(units, "species string, zone string, mean_prod double"), spark.createDataFrame(agents, "species string, agent string")
    )
    for species, zone, total in rows(out):
        want = expected[species, zone]
        assert total is None if math.isnan(want) else total == pytest.approx(want)


def test_type_shares(spark):
    data = [("a", "p", "Copepoda"), ("b", "p", "Copepoda"), ("a", "q", "Protozoa"), ("a", None, "Virus")]
    typed = pathogens.pathogen_types(spark.createDataFrame(data, "species string, agent string, taxon string"))
    assert rows(pathogens.type_shares(typed)) == [("Others", 33.0), ("Parasites", 33.0), ("Virus", 33.0)]
    assert rows(pathogens.agents_per_species(typed)) == [("a", 3), ("b", 1)]


def test_trait_index_imputes_the_mean(spark):
    df = spark.createDataFrame([("a", 10.0, 2.0, 0.1), ("b", 30.0, 4.0, None), ("c", 20.0, 3.0, 0.3)], "species string, max_length double, troph double, k double")
    out = {r["species"]: r for r in traits.trait_index(df).collect()}
    assert out["b"]["k"] == pytest.approx(0.2)
    assert [out[s]["eco_ind"] for s in "abc"] == pytest.approx([0.0, 2.5 / 3, 2 / 3])


def test_invasive_score_is_zero_without_introduced_or_without_traits(spark):
    data = [("a", "z", 9.0, "Introduced"), ("a", "y", 9.0, "Native"), ("q", "x", 9.0, "Introduced"), ("a", "z", 90.0, "Introduced")]
    index = spark.createDataFrame([("a", 0.5)], "species string, eco_ind double")
    status = spark.createDataFrame(data, STATUS)
    out = traits.invasive_score(status, index, scores.zone_production_scores(status))
    assert rows(out) == [("x", 0.0), ("y", 0.0), ("z", 1.0)]


def test_food_items(spark):
    df = spark.createDataFrame([("a", "krill", "g2", 2), ("a", "krill", "g1", 1), ("a", "unident fish", "g", 3)], "species string, food string, food_group string, i int")
    assert rows(traits.food_items(df, "i")) == [("a", "krill", "g1")]


def test_components_of_correlated_columns(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, float((-1) ** i)) for i in range(20)], "a double, b double, c double")
    out = traits.principal_components(df, ["a", "b", "c"]).orderBy("component").collect()
    assert sum(r["proportion"] for r in out) == pytest.approx(1) and out[2]["proportion"] == pytest.approx(0, abs=1e-9)
    assert all(max((r["a"], r["b"], r["c"]), key=abs) > 0 for r in out)
    assert out[0]["sdev"] ** 2 == pytest.approx(3 * out[0]["proportion"])


def _risk(spark):
    base = spark.createDataFrame([("y", 4, 1, 3, 10.0, 6.0, 4.0, 4.0), ("z", 2, 1, 1, 30.0, 20.0, 10.0, 16.0), ("x", 1, 0, 1, 1.0, 1.0, 0.0, 0.0)], "zone string, n_total long, n_introduced long, n_native long, prod_total double, prod_native double, prod_introduced double, genetic_score double")
    invasive = spark.createDataFrame([("x", 0.0), ("y", 9.0), ("z", 1.0)], "zone string, invasive_score double")
    pathogenic = spark.createDataFrame([("x", 1.0), ("y", 1.0), ("z", 25.0)], "zone string, pathogenic_score double")
    zones = spark.createDataFrame([("x", "P", "R"), ("y", "P", "R"), ("z", "Q", "R"), ("w", "Q", "R")], "zone string, province string, realm string")
    return scores.overall_risk(base, invasive, pathogenic, zones), zones


def test_overall_risk_and_reports(spark):
    risk, _ = _risk(spark)
    assert rows(risk.select("zone", "Genetic", "Invasive", "Diseases", "Overall")) == [
        ("x", 0.0, 0.0, 0.0, 0.0),
        ("y", 50.0, 100.0, 0.0, 150.0),
        ("z", 100.0, pytest.approx(100 / 3), 100.0, pytest.approx(700 / 3)),
    ]
    assert risk.columns[:3] == ["province", "zone", "realm"] and "genetic_score" not in risk.columns
    ranking = reports.province_ranking(risk)
    assert rows(ranking.select("ord", "province", "Overall")) == [(1, "P", 75.0), (2, "Q", pytest.approx(700 / 3))]
    totals = reports.status_totals(risk).first()
    assert (totals["total"], totals["percent_native"], totals["percent_introduced"]) == (41.0, 65.85, 34.15)
    assert rows(reports.top_zones(risk, "province", "Overall", 1).select("province", "zone")) == [("P", "y"), ("Q", "z")]
    long = scores.score_long(risk)
    assert long.count() == 9
    assert rows(long.select("key", "key_ord").distinct()) == [("A. Invasive", 1), ("B. Genetic", 2), ("C. Pathogenic", 3)]


def test_production_long_keeps_sums(spark):
    risk, zones = _risk(spark)
    long = scores.production_long(risk.select("zone", "prod_native", "prod_introduced"), zones)
    assert rows(long.groupBy("key", "key_ord").agg(F.round(F.sum("value") * 1000, 6))) == [("A. Native", 1, 27.0), ("B. Non-native", 2, 14.0)]


def test_mean_interval(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 1.0), (6.0, 2.0)], "a double, b double")
    out = {r["measure"]: r for r in reports.mean_ci(df, ["a", "b"]).collect()}
    sd = math.sqrt(7)
    assert out["a"]["estimate"] == 3.0 and out["a"]["std_error"] == pytest.approx(sd / math.sqrt(3))
    assert out["a"]["ci_upper"] - 3.0 == pytest.approx(4.302652729696 * sd / math.sqrt(3))
    assert out["b"]["estimate"] is None and out["b"]["ci_lower"] is None


def test_layers(spark, tmp_path):
    risk, zones = _risk(spark)
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0))])
    shapes = zones.withColumn("rings", F.array(ring))
    layer = layers.save_layer(layers.score_layer(risk, shapes), str(tmp_path / "scores"))
    assert layer.count() == 3 and layer.where(F.size("rings") == 1).count() == 3
    dump = layers.layer_attributes(layer, ["zone", "Overall"], str(tmp_path / "dump"))
    assert dump.columns == ["zone", "Overall"] and (tmp_path / "dump" / "_SUCCESS").exists()
    both = layers.status_layers(layer, layer)
    assert both.count() == 6
