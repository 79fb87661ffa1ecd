"""Composite plans on hand-made tables, the options, and full dataset runs."""

import random

import pytest
from pyspark.sql import functions as F

from scenara import vocabulary as V
from scenara.operators import local_table, rollup_sum
from scenara.plans import emissions, energy, ensemble, flows
from scenara.plans.marts import MART_NAMES, Options, Workspace, build_mart, write_marts
from scenara.sources import read_store, write_store
from scenara.sources.star import model_tables


def test_traded_flows(spark, rows):
    df = spark.createDataFrame(
        [
            ("EJ", "s", "Global", "traded LNG", "USA traded LNG", "traded LNG,year=2020", "o", 2020, 1.0),
            ("EJ", "s", "Global", "traded LNG", "statistical differences", "traded LNG,year=2020", "o", 2020, 2.0),
            ("EJ", "s", "Global", "other", "USA traded LNG", "x,year=2020", "o", 2020, 4.0),
        ],
        "Units string, scenario string, region string, sector string, subsector string, technology string,"
        " output string, year int, value double",
    )
    assert rows(flows.traded_vintages(df), "region", "vintage", "value") == [("USA", "2020", 1.0)]


def test_imports_and_exports(spark, rows):
    regional = spark.createDataFrame(
        [
            ("EJ", "s", "USA", "domestic natural gas", 2020, 5.0),
            ("EJ", "s", "USA", "imported RUS pipeline gas", 2020, 2.0),
            ("Mt", "s", "USA", "imported LNG", 2020, 9.0),
        ],
        "Units string, scenario string, region string, technology string, year int, value double",
    )
    traded = spark.createDataFrame(
        [("EJ", "s", "x", "traded LNG", "USA traded LNG", "t", "o", 2020, 3.0)],
        "Units string, scenario string, region string, sector string, subsector string, technology string,"
        " output string, year int, value double",
    )
    sold = flows.traded_flows(traded)
    cols = ("trade", "sector", "value")
    assert rows(flows.gross_trade(regional, sold), *cols) == [("exported", "LNG", 3.0), ("imported", "RUS", -2.0)]
    assert rows(flows.gross_production(regional, sold), *cols) == [("domestic", "domestic", 5.0), ("exported", "LNG", 3.0)]
    assert rows(flows.gross_consumption(regional), *cols) == [("domestic", "domestic", -5.0), ("imported", "RUS", -2.0)]
    assert rows(flows.trade_with_net(flows.gross_trade(regional, sold)), "value", "value_net") == [(-2.0, 1.0), (3.0, 1.0)]


PRIMARY = "Units string, scenario string, region string, fuel string, year int, value double"


def test_collapse_takes_traded_gas_in_any_units(spark, rows):
    df = spark.createDataFrame(
        [
            ("EJ", "s", "r", "traded LNG", 2020, 1.0),
            ("Mt", "s", "r", "traded RUS pipeline gas", 2020, 2.0),
            ("EJ", "s", "r", "traded LNG CCS", 2020, 4.0),
            ("EJ", "s", "r", "b natural gas", 2020, 8.0),
            ("EJ", "s", "r", "c coal", 2020, 16.0),
            ("Mt", "s", "r", "c coal", 2020, 32.0),
            ("EJ", "s", "r", "regional gas", 2020, 64.0),
            ("EJ", "s", "r", None, 2020, 128.0),
            (None, "s", "r", "c coal", 2020, 256.0),
        ],
        PRIMARY,
    )
    assert rows(energy.by_region(energy.collapse_gas(df)), "fuel", "value") == [("b natural gas", 11.0), ("c coal", 16.0)]
    assert rows(energy.by_region(energy.collapse_gas_ccs(df)), "fuel", "value") == [
        ("b natural gas", 11.0),
        ("b natural gas CCS", 4.0),
        ("c coal", 16.0),
    ]
    strict = energy.by_region(energy.collapse_gas(df, collapsed_units="EJ"))
    assert rows(strict, "fuel", "value") == [("b natural gas", 9.0), ("c coal", 16.0)]


def test_co2_equivalent_drops_incomplete_rows(spark, rows):
    factors = local_table(spark, {"ghg": ["CO2", "CH4"], "AR5all": [3.7, 28.0]})
    df = spark.createDataFrame(
        [("r", "CO2", 1.0), ("r", "CH4", 1.0), ("r", "XX", 1.0), ("r", "CO2", None), (None, "CO2", 1.0)],
        "region string, ghg string, value double",
    )
    assert rows(emissions.co2_equivalent(df, factors), "GHG", "value", "Units") == [
        ("CH4", 28.0, "MTCO2e"),
        ("CO2", 3.7, "MTCO2e"),
    ]


def test_land_use_survives_its_missing_columns(spark, rows):
    factors = local_table(spark, {"ghg": ["CO2"], "AR5all": [3.7]})
    sector = spark.createDataFrame(
        [("Tg", "s", "r", "cement", "CO2", 2020, 1.0)],
        "Units string, scenario string, region string, sector string, ghg string, year int, value double",
    )
    resource = spark.createDataFrame(
        [("Tg", "s", "r", "coal", "coal 1", "CO2", 2020, 1.0)],
        "Units string, scenario string, region string, resource string, subresource string, ghg string, year int, value double",
    )
    land = spark.createDataFrame([("s", "r", 2020, 12.0)], "scenario string, region string, year int, value double")
    got = rows(emissions.all_emissions(resource, sector, land, factors), "sector", "value")
    assert got == [("LUC", 44.0), ("cement", 3.7), ("coal 1", 3.7)]
    totals = emissions.sector_totals(resource, sector, factors)
    groups = emissions.by_group(emissions.sector_rows(totals, True, land))
    assert rows(groups, "sector", "value") == [
        ("Agriculture and Land Use", 44.0),
        ("Industry", 3.7),
        ("Resource Production", 3.7),
    ]
    assert rows(emissions.fossil_co2(totals), "value") == [(7.4,)]


def test_emission_grains_equal_three_tables(spark):
    """One pass over the base gives what the three tables give, missing keys and amounts included."""
    rng = random.Random(4)
    pick = lambda *of: rng.choice(of)
    data = [
        ("s" + pick("1", "2"), pick("a", "b", None), pick("coal", "gas", None), pick("1", "2"), pick("cement", "coal", "LUC", None),
         pick("CO2", "CH4", "XX", None), pick(2020, 2025, None), None if rng.random() < 0.02 else float(rng.randint(0, 9)))
        for _ in range(400)
    ]
    schema = "scenario string, region string, resource string, n string, sector string, ghg string, year int, value double"
    base = spark.createDataFrame(data, schema).withColumn("subresource", F.concat("resource", "n")).drop("n")
    factors = local_table(spark, {"ghg": ["CO2", "CH4"], "AR5all": [3.7, 28.0]})
    resource, sector, land = (rollup_sum(base, emissions.GRAINS[g]) for g in ("resource", "sector", "land"))
    resource, sector = resource.withColumn("Units", F.lit("Tg")), sector.withColumn("Units", F.lit("Tg"))
    grains = emissions.emission_grains(base)

    def said(df, *cols):
        return sorted(tuple(round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in df.select(*cols).collect())

    cols = ["Units", "scenario", "region", "sector", "GHG", "year", "value"]
    plain = emissions.all_emissions(resource, sector, land, factors)
    as_text = lambda rows: sorted(map(str, rows))
    assert as_text(said(emissions.all_from_grains(grains, factors), *cols)) == as_text(said(plain, *cols))
    totals, one = emissions.sector_totals(resource, sector, factors), emissions.totals_from_grains(grains, factors)
    for co2_only in (True, False):
        want = emissions.by_group(emissions.sector_rows(totals, co2_only, land))
        got = emissions.by_group(emissions.sector_rows(one, co2_only))
        cols = ["scenario", "sector", "year", "value"]
        assert as_text(said(got, *cols)) == as_text(said(want, *cols)) != []


def test_ensemble_extract(spark, rows):
    wide = spark.createDataFrame(
        [
            ("m", "a", "World", V.WARMING_VARIABLE, "K", 1.0, 1.7),
            ("m", "b", "World", V.WARMING_VARIABLE, "K", 1.0, None),
            ("m", "a", "World", V.PRIMARY_GAS_VARIABLE, "EJ", 10.0, None),
            ("m", "b", "World", V.PRIMARY_GAS_VARIABLE, "EJ", 10.0, 20.0),
            ("m", "c", "World", V.PRIMARY_GAS_VARIABLE, "EJ", 10.0, 20.0),
        ],
        "Model string, Scenario string, Region string, Variable string, Unit string, `2020` double, `2100` double",
    )
    got = ensemble.extract_variable(wide, V.PRIMARY_GAS_VARIABLE)
    assert rows(got, "Scenario", "year", "value", "temp_category") == [("a", 2020, 10.0, "B_1.5-2C")]
    own = ensemble.extract_variable(wide, V.WARMING_VARIABLE)
    assert rows(own, "Scenario", "year") == [("a", 2020), ("a", 2100)]


def test_ensemble_extract_equals_look_up(spark):
    """Members with two warming rows or none, missing members and cells."""
    rng = random.Random(5)
    cell = lambda: rng.choice([None, 0.5, 1.5, 2.5, 4.0])
    variables = [V.WARMING_VARIABLE, V.PRIMARY_GAS_VARIABLE, "Population"]
    data = [
        (rng.choice(["m", "n", None]), rng.choice("abcd"), rng.choice(["World", "USA"]), rng.choice(variables), "K", cell(), cell())
        for _ in range(80)
    ]
    names = "Model string, Scenario string, Region string, Variable string, Unit string, `2020` double, `2100` double"
    wide = spark.createDataFrame(data, names)
    got = ensemble.extract_variable(wide, V.PRIMARY_GAS_VARIABLE)
    joined = wide.where(F.col("Variable") == V.PRIMARY_GAS_VARIABLE).join(ensemble.warming_category(wide), ["Model", "Scenario"], "left")
    want = ensemble.ensemble_long(joined).dropna().select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


# --- options ---------------------------------------------------------------


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return model_tables(spark, sf_dir)


def test_domestic_sector_option(tables):
    plain = Workspace(tables)["grouped_production"]
    kept = Workspace(tables, options=Options(sector_levels=tuple(V.DOMESTIC_SECTOR_LEVELS)))["grouped_production"]
    assert plain.where("trade = 'domestic' and sector is not null").count() == 0
    assert kept.where("trade = 'domestic' and sector = 'domestic'").count() > 0
    mart = build_mart("3A", Workspace(tables, options=Options(sector_levels=tuple(V.DOMESTIC_SECTOR_LEVELS))))
    assert mart.where("sector = 'domestic' and sector_ord = 0").count() > 0


def test_power_net_option(tables):
    plain = build_mart("S7B", tables).agg(F.sum("value_net")).first()[0]
    scaled = build_mart("S7B", Workspace(tables, options=Options(power_net_factor=V.EJ_TWH_REPORTED)))
    assert abs(scaled.agg(F.sum("value_net")).first()[0] - plain * V.EJ_TWH_REPORTED) < 1e-6 * abs(plain)


def test_net_equals_sum_of_detail(tables):
    df = Workspace(tables)["production_difference"]
    totals = df.groupBy("scenario_diff", "grouped_region", "year").agg(F.sum("value").alias("s"), F.max("value_net").alias("n"))
    assert totals.where("abs(s - n) > 1e-9").count() == 0


def test_region_roll_up_keeps_the_total(tables):
    ws = Workspace(tables)
    assert ws["final_grouped"].agg(F.sum("value")).first() == ws["final_energy"].agg(F.sum("value")).first()


def test_datasets_out_of_a_store(spark, tables, tmp_path):
    """All thirteen named tables stored once; datasets built on the store are the same."""
    base = str(tmp_path / "store")
    write_store(tables, base)
    stored = {**tables, **read_store(spark, base)}
    for name in ["2A", "3B", "5B", "S4A", "S6A", "S7B", "S8A", "S10", "S16"]:
        got, want = build_mart(name, stored), build_mart(name, tables)
        doubles = [c for c, t in got.dtypes if t == "double"]
        got, want = [df.withColumns({c: F.round(c, 6) for c in doubles}) for df in (got, want)]
        assert got.count() == want.count() > 0
        assert got.exceptAll(want).count() == 0


def test_write_all_datasets(spark, tables, tmp_path):
    """Every dataset in one run, shared tables checkpointed, equal to a single build."""
    assert len(MART_NAMES) == 38
    base = str(tmp_path / "out")
    write_marts(tables, base)
    for name in ["2A", "3B", "4C", "5A", "S4B", "S12"]:
        stored = spark.read.parquet(f"{base}/{name}")
        built = build_mart(name, tables)
        assert stored.count() == built.count() > 0
        assert stored.exceptAll(built.select(*stored.columns)).count() == 0
    for name in MART_NAMES:
        assert spark.read.parquet(f"{base}/{name}").columns


def test_ensemble_years(spark):
    wide = spark.createDataFrame([("m", "s", "v", 1.0, 2.0)], "Model string, Scenario string, Variable string, `1995` double, `2100` double")
    assert {r["year"] for r in ensemble.ensemble_long(wide).collect()} == {1995, 2100}
    assert {r["year"] for r in ensemble.ensemble_long(wide, [2100]).collect()} == {2100}
    with pytest.raises(ValueError, match="2050"):
        ensemble.ensemble_long(wide, [2050, 2100])
