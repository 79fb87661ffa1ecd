"""Readers and writers."""

import pytest
from pyspark.sql import functions as F

from scenara import schemas
from scenara import vocabulary as V
from scenara.plans.marts import MART_NAMES, build_mart
from scenara.session import shuffle_partitions
from scenara.sources import (
    load_tables,
    read_csv_table,
    read_ensemble,
    read_gas_factors,
    read_literature_co2,
    read_literature_region,
    read_literature_world,
    read_named_table,
    read_region_mapping,
    read_technology_mapping,
    star,
    write_mart,
    write_named_table,
    write_store,
)
from scenara.sources.tables import COMPARISON_READERS, MAPPING_READERS, table_name


def csv_file(folder, name, lines, bom=False):
    path = folder / name
    path.write_bytes((b"\xef\xbb\xbf" if bom else b"") + "\r\n".join(lines).encode() + b"\r\n")
    return str(path)


def test_region_mapping_with_bom_and_crlf(spark, rows, tmp_path):
    path = csv_file(tmp_path, "regions.csv", ["id,region,grouped_region", "1,USA,USA", "2,Central Asia,C.Asia+E.Eur"], True)
    assert rows(read_region_mapping(spark, path), "region", "grouped_region") == [
        ("Central Asia", "C.Asia+E.Eur"),
        ("USA", "USA"),
    ]


def test_technology_mapping(spark, rows, tmp_path):
    path = csv_file(tmp_path, "tech.csv", ["sector,technology", "gas,gas (CC)"])
    assert rows(read_technology_mapping(spark, path), "technology", "sector") == [("gas (CC)", "gas")]


def test_gas_factors(spark, rows, tmp_path):
    path = csv_file(tmp_path, "factors.csv", ["ghg,SAR,AR5,AR4,SARall,AR5all,AR4all", "CH4,21,28,25,21,28,25"])
    assert rows(read_gas_factors(spark, path), "ghg", "AR5all") == [("CH4", 28.0)]


def test_literature(spark, rows, tmp_path):
    world = csv_file(tmp_path, "w.csv", ["scenario,year,Bcm,Tcf,EJ", "historical,2021,450,15.9,16.2"], True)
    region = csv_file(tmp_path, "r.csv", ["scenario,grouped_region,year,Bcm,Tcf,EJ", "historical,USA,2010,678,23.9,24.4"], True)
    co2 = csv_file(tmp_path, "c.csv", ["scenario,year,value", "historical,2010,32893"], True)
    assert rows(read_literature_world(spark, world), "scenario", "year", "EJ") == [("historical", 2021, 16.2)]
    assert rows(read_literature_region(spark, region), "grouped_region", "year", "Bcm") == [("USA", 2010, 678.0)]
    assert rows(read_literature_co2(spark, co2), "year", "value") == [(2010, 32893.0)]


def test_ensemble_has_every_year(spark, tmp_path):
    years = [str(y) for y in range(1995, 2101)]
    header = ",".join(["Model", "Scenario", "Region", "Variable", "Unit", *years])
    path = csv_file(tmp_path, "e.csv", [header, "m,s,World,v,u," + ",".join("" if y == "1996" else y for y in years)])
    df = read_ensemble(spark, path)
    assert len(df.columns) == 5 + 106
    row = df.first()
    assert row["1995"] == 1995.0 and row["1996"] is None and row["2100"] == 2100.0


WORLD = ["scenario,year,Bcm,Tcf,EJ", "historical,2021,450,15.9,16.2"]


def test_columns_are_found_by_name(spark, rows, tmp_path):
    path = csv_file(tmp_path, "w.csv", ["EJ,note,year,Tcf,scenario,Bcm", "16.2,x,2021,15.9,historical,450"], True)
    got = read_literature_world(spark, path)
    assert got.columns == ["scenario", "year", "Bcm", "Tcf", "EJ"]
    assert rows(got, *got.columns) == [("historical", 2021, 450.0, 15.9, 16.2)]
    path = csv_file(tmp_path, "t.csv", ["technology,sector", "gas (CC),gas"])
    assert rows(read_technology_mapping(spark, path), "technology", "sector") == [("gas (CC)", "gas")]


def test_missing_column_raises(spark, tmp_path):
    path = csv_file(tmp_path, "w.csv", ["scenario,year,Bcm,EJ", "historical,2021,450,16.2"])
    with pytest.raises(ValueError, match="Tcf"):
        read_literature_world(spark, path)


def test_bad_number_stops_or_is_missing(spark, rows, tmp_path):
    path = csv_file(tmp_path, "w.csv", [WORLD[0], "historical,2021,lots,15.9,16.2"])
    with pytest.raises(Exception, match="lots"):
        read_literature_world(spark, path).collect()
    got = read_csv_table(spark, path, schemas.LITERATURE_WORLD, bad_numbers="null")
    assert rows(got, "Bcm", "EJ") == [(None, 16.2)]
    with pytest.raises(ValueError):
        read_csv_table(spark, path, schemas.LITERATURE_WORLD, bad_numbers="maybe")


def test_empty_and_na_are_missing(spark, rows, tmp_path):
    path = csv_file(tmp_path, "w.csv", [WORLD[0], "NA,2021,NA,,16.2", ",2022,1,2,3", '"",2023,1,2,3'])
    assert rows(read_literature_world(spark, path), "year", "scenario", "Bcm") == [
        (2021, None, None),
        (2022, None, 1.0),
        (2023, None, 1.0),
    ]


def test_all_datasets_from_files(spark, sf_dir, tmp_path):
    """The loader gives every name that some dataset asks for."""
    built = star.model_tables(spark, sf_dir)
    store = str(tmp_path / "store")
    write_store(built, store)
    paths = {}
    for name in [*MAPPING_READERS, *COMPARISON_READERS, "ensemble"]:
        df = built[name]()
        if name == "gas_factors":
            df = df.selectExpr("ghg", "AR5all", *[f"1.0 AS {c}" for c in ["SAR", "AR5", "AR4", "SARall", "AR4all"]])
        paths[name] = str(tmp_path / name)
        write_mart(df.select(*reversed(df.columns)), paths[name], "csv")
    tables = load_tables(
        spark,
        store,
        {n: paths[n] for n in MAPPING_READERS},
        {n: paths[n] for n in COMPARISON_READERS},
        paths["ensemble"],
    )
    for name in MART_NAMES:
        assert build_mart(name, tables).columns == build_mart(name, built).columns
    for name in ["3B", "S10", "S13"]:
        got, want = build_mart(name, tables), build_mart(name, built)
        same = [F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in want.dtypes]
        assert got.count() == want.count() > 0
        assert not got.select(*same).exceptAll(want.select(*same)).count()
    with pytest.raises(KeyError):
        load_tables(spark, store, {"regions": "x"})


def test_tables_by_title():
    assert {table_name(t) for t in V.TABLE_TITLES.values()} == set(schemas.NAMED_TABLES)
    assert table_name("electricity") == "electricity"
    with pytest.raises(KeyError):
        table_name("elec gen")


def test_named_store_reads_one_folder(spark, tmp_path):
    base = str(tmp_path / "store")
    final = spark.createDataFrame([("s", "r", "gas", 2020, 1.0)], schemas.NAMED_TABLES["final_energy"])
    power = spark.createDataFrame([("s", "r", "wind", 2020, 2.0)], schemas.NAMED_TABLES["electricity"])
    write_named_table(final, base, "final_energy")
    write_named_table(power, base, "electricity")
    got = read_named_table(spark, base, "electricity")
    assert got.schema == schemas.NAMED_TABLES["electricity"]
    assert [tuple(r) for r in got.collect()] == [("s", "r", "wind", 2020, 2.0)]
    assert all("query=electricity" in f for f in got.inputFiles())


def test_filters_reach_a_stored_table(spark, tmp_path):
    """Scenario prunes folders; sector and year reach the Parquet reader."""
    base = str(tmp_path / "store")
    schema = schemas.NAMED_TABLES["traded_gas"]
    data = [
        ("EJ", s, "Global", sector, f"USA {sector}", sector, "gas", year, 1.0)
        for s in ["Reference", "Transition", "Other"]
        for sector in ["traded LNG", "traded RUS pipeline gas", "unsold"]
        for year in [2010, 2020]
    ]
    write_named_table(spark.createDataFrame(data, schema), base, "traded_gas")
    mart = build_mart("2C", {"traded_gas": read_named_table(spark, base, "traded_gas")})
    assert sorted((r.scenario, r.year, r.value) for r in mart.collect()) == [
        ("Reference", 2020, 1.0),
        ("Transition", 2020, 1.0),
    ]
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = build_mart("2C", {"traded_gas": read_named_table(spark, base, "traded_gas")})
    plan = plan._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PartitionFilters: [scenario#" in plan
    pushed = plan[plan.index("PushedFilters") :]
    assert "In(sector" in pushed and "GreaterThanOrEqual(year,2015)" in pushed
    assert "technology" not in plan[plan.index("ReadSchema") :]


def test_mart_formats(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0)], "k string, value double")
    for kind in ["parquet", "csv"]:
        path = str(tmp_path / kind)
        write_mart(df, path, kind)
        write_mart(df, path, kind)
        got = spark.read.csv(path, header=True, schema=df.schema) if kind == "csv" else spark.read.parquet(path)
        assert [tuple(r) for r in got.collect()] == [("a", 1.0)]


def test_shuffle_partitions():
    assert shuffle_partitions(1e6, 8) == 8
    assert shuffle_partitions(25e12, 4000) == 93133
