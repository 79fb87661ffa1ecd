"""Every registered query against its SQL equivalent, and the shape of its plan."""

import math
import re

import duckdb
import pytest

import __spark_entry__ as entry_point
from catalog.oracle import ORACLE
from catalog.queries import QUERIES

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(rows):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return (0, "")
        return (1, repr(v))

    return sorted(tuple(cell(v) for v in r) for r in rows)


def check(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    relation = duck.sql(ORACLE[name])
    assert sorted(relation.columns) == cols
    where = [relation.columns.index(c) for c in cols]
    expected = [tuple(r[i] for i in where) for r in relation.fetchall()]
    assert canonical(tuple(r[c] for c in cols) for r in df.collect()) == canonical(expected)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry_point.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    check(spark, sf_dir, duck, name)


@pytest.mark.parametrize("name", ["production_difference", "co2e_by_sector", "ensemble_gas", "gross_trade_signed", "mart_s4a"])
def test_query_without_broadcast(spark, sf_dir, duck, name):
    """The sort-merge way that large tables take, with hot partitions split early."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        check(spark, sf_dir, duck, name)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_plans(spark, sf_dir):
    """No Python in the plan, no cross join, no single-task window, no forced broadcast."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, build in QUERIES.items():
            plan = build(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
            for bad in ["PythonUDF", "EvalPython", "CartesianProduct", "BroadcastNestedLoop", "SinglePartition", "Broadcast"]:
                assert bad not in plan, (name, bad)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_net_of_many_items_has_no_window(spark, sf_dir):
    plan = QUERIES["diff_families_with_net"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


@pytest.mark.parametrize(
    ("name", "scans", "merges"),
    [("ensemble_gas", 1, 1), ("co2_by_sector", 1, 1), ("co2e_by_sector", 1, 1), ("global_emissions", 1, 1), ("grouped_emissions", 1, 1), ("co2_equivalent", 1, 1), ("mart_s13", 2, 2)],
)
def test_lines_are_joined_once(spark, sf_dir, name, scans, merges):
    """Scans of the order lines and merge joins that an executed plan does not reuse."""
    df = QUERIES[name](spark, sf_dir)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"FileScan parquet \[l_orderkey", plan)) <= scans
    assert plan.count("SortMergeJoin") <= merges


def test_emissions_take_one_branch(spark, sf_dir):
    """No union of the three kinds of emissions; land use alone reads no part and no gas."""
    plan = QUERIES["co2e_by_sector"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and "Expand" in plan and plan.count("FileScan parquet [l_orderkey") == 1
    plan = QUERIES["land_use"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "p_partkey" not in plan and "o_orderpriority" not in plan


def test_scan_reads_only_needed_columns(spark, sf_dir):
    plan = QUERIES["global_capacity"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    lines = [s for s in re.findall(r"ReadSchema: struct<([^>]*)>", plan) if "l_orderkey" in s]
    assert lines and all("l_linenumber" not in s for s in lines)
    plan = QUERIES["scenario_labels"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_lookups_are_broadcast_by_size(spark, sf_dir):
    plan = QUERIES["rollup_region"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["scenario", "year", "value"] and df.count() > 0
