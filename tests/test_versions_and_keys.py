"""Single scenarios refreshed under a reader; look-ups with repeated keys."""

import pytest
from pyspark.sql import functions as F

from scenara.operators import LookupAudit, attach_unique, rollup_sum
from scenara.sources import current_versions, drop_unused, read_refreshed, refresh_scenarios
from scenara.sources.tables import table_name

COLUMNS = "scenario string, region string, technology string, year int, value double"


def electricity(spark, *scenarios, value=1.0):
    rows = [(s, r, "gas", y, value) for s in scenarios for r in ("USA", "India") for y in (2020, 2030)]
    return spark.createDataFrame(rows, COLUMNS)


def totals(df):
    return {r["scenario"]: r["value"] for r in rollup_sum(df, ["scenario"]).collect()}


def test_reader_keeps_old_rows_during_a_rewrite(spark, tmp_path):
    base = str(tmp_path)
    refresh_scenarios(electricity(spark, "A", "B, 50% = x", None), base, "electricity")
    before = read_refreshed(spark, base, "electricity")
    assert refresh_scenarios(electricity(spark, "A", "C", value=5.0), base, "electricity") == ["scenario=A", "scenario=C"]
    assert totals(before) == {"A": 4.0, "B, 50% = x": 4.0, None: 4.0}
    after = read_refreshed(spark, base, "electricity")
    assert totals(after) == {"A": 20.0, "B, 50% = x": 4.0, None: 4.0, "C": 20.0}
    # the older version of A goes, what the pointer names stays
    dropped = drop_unused(spark, base, "electricity")
    assert [d.split("/")[1] for d in dropped] == ["scenario=A"]
    assert totals(read_refreshed(spark, base, "electricity")) == totals(after)


def test_failed_write_changes_nothing(spark, tmp_path):
    base = str(tmp_path)
    refresh_scenarios(electricity(spark, "A"), base, "electricity")
    bad = electricity(spark, "A", value=9.0).withColumn("value", F.raise_error(F.lit("stop")).cast("double"))
    with pytest.raises(Exception, match="stop"):
        refresh_scenarios(bad, base, "electricity")
    assert totals(read_refreshed(spark, base, "electricity")) == {"A": 4.0}


def test_scenarios_can_go_and_tables_be_empty(spark, tmp_path):
    base = str(tmp_path)
    assert read_refreshed(spark, base, table_name("electricity")).count() == 0
    refresh_scenarios(electricity(spark, "A", "B"), base, "electricity")
    refresh_scenarios(electricity(spark, "A").where("false"), base, "electricity", gone=["scenario=B"])
    assert list(current_versions(spark, base, "electricity")) == ["scenario=A"]
    assert totals(read_refreshed(spark, base, "electricity")) == {"A": 4.0}


def test_scenario_filter_prunes_folders(spark, tmp_path):
    refresh_scenarios(electricity(spark, "A", "B"), str(tmp_path), "electricity")
    plan = read_refreshed(spark, str(tmp_path), "electricity").where("scenario = 'A'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(scenario" in plan


GROUPS = [("USA", "North America"), ("India", "Asia"), (None, "x"), (None, "y")]


def test_unique_look_up(spark, rows):
    df = spark.createDataFrame([("USA", 1.0), ("Peru", 2.0), (None, 3.0)], "region string, value double")
    groups = spark.createDataFrame(GROUPS, "region string, grouped_region string")
    got = rows(attach_unique(df, groups, "region"), "region", "grouped_region", "value")
    assert got == [(None, None, 3.0), ("Peru", None, 2.0), ("USA", "North America", 1.0)]
    twice = spark.createDataFrame([*GROUPS, ("USA", "America")], "region string, grouped_region string")
    with pytest.raises(Exception, match="the look-up repeats a key of region: USA"):
        attach_unique(df, twice, "region").collect()


def test_audit_counts_while_the_query_runs(spark):
    df = spark.createDataFrame([("USA", 1.0), ("Peru", 2.0), (None, 3.0)], "region string, value double")
    groups = spark.createDataFrame([*GROUPS, ("USA", "America")], "region string, grouped_region string")
    audit = LookupAudit("regions")
    got = rollup_sum(audit.attach(df, groups, "region"), ["grouped_region"])
    assert got.count() == 3
    assert audit.report() == {"rows": 3, "joined": 4, "unmatched": 2, "added": 1}
    with pytest.raises(ValueError, match="regions: repeated keys added 1 rows"):
        audit.require_unique()
    scans = got._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD")
    assert scans <= 2
