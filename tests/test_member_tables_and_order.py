"""Member tables, ordered datasets, many scenarios, exact sums, rejects, resumed runs."""

import math
import os
import random
import re
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from catalog.queries import QUERIES
from scenara import schemas
from scenara.functions import sum_exact
from scenara.operators import compare_pairs, diff_families, diff_from_scenario, drop_members, keep_members
from scenara.plans import marts
from scenara.plans.marts import mart_order, write_marts
from scenara.sources import good_rows, read_csv_checked, read_named_table, read_ordered, rejected_cells, star, write_named_table, write_ordered

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- member tables ---------------------------------------------------------


@pytest.mark.parametrize("nulls", [False, True])
@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_members(spark, rows, nulls, broadcast):
    data = [(a, b, i) for i, (a, b) in enumerate([("x", 1), ("x", None), ("y", 1), (None, 1), (None, None), ("z", 3), ("x", 1)])]
    df = spark.createDataFrame(data, "a string, b int, i int")
    listed = [("x", 1), ("x", 1), (None, None), ("y", None)]
    members = spark.createDataFrame(listed, "a string, b int")
    known = listed if nulls else [m for m in listed if None not in m]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        kept, dropped = keep_members(df, members, ["a", "b"], nulls), drop_members(df, members, ["a", "b"], nulls)
        assert rows(kept, "i") == [(i,) for a, b, i in data if (a, b) in known]
        assert rows(dropped, "i") == [(i,) for a, b, i in data if (a, b) not in known]
        assert kept.columns == dropped.columns == df.columns
        empty = members.where("false")
        assert keep_members(df, empty, "a", nulls).count() == 0 and drop_members(df, empty, "a", nulls).count() == len(data)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_member_table_prunes_store_folders(spark, tmp_path):
    cells = [(s, "wind", r, 2020, 1.0) for s in "ABCDE" for r in ("USA", "China")]
    table = spark.createDataFrame(cells, "scenario string, technology string, region string, year int, value double")
    write_named_table(table, str(tmp_path), "electricity")
    members = spark.createDataFrame([("A",), ("D",), (None,)], "scenario string")
    kept = keep_members(read_named_table(spark, str(tmp_path), "electricity"), members, "scenario")
    assert sorted({r["scenario"] for r in kept.collect()}) == ["A", "D"]
    final = plan_of(kept)
    assert re.search(r"PartitionFilters: \[[^\]]*dynamicpruningexpression\(scenario", final) and "LeftSemi" in final


# --- ordered datasets ------------------------------------------------------


def test_ordered_dataset(spark, tmp_path):
    rng = random.Random(1)
    levels = ["z", "m", "a"]
    data = [(rng.choice(["z", "z", "z", "m", "a", "other", None]), rng.choice([1, 2, None]), float(i)) for i in range(5000)]
    df = spark.createDataFrame(data, "level string, year int, value double").repartition(7)
    write_ordered(df, str(tmp_path / "d"), {"level": levels, "year": None}, 6)
    parts = [f for f in os.listdir(tmp_path / "d") if f.startswith("part-")]
    got = read_ordered(spark, str(tmp_path / "d"))
    last = lambda v: (v is None, v if v is not None else 0)
    key = lambda r: (levels.index(r[0]) if r[0] in levels else 9, (r[0] is None, r[0] or ""), last(r[1]), r[2])
    back = [tuple(r[c] for c in ("level", "year", "value")) for r in sorted(got.collect(), key=lambda r: r["position"])]
    assert back == sorted(data, key=key) and len(parts) == 6
    # a level with most of the rows lies in several files
    by_file = got.select("level", F.col("position")).where("level = 'z'").count()
    held = [spark.read.parquet(str(tmp_path / "d" / f)).where("level = 'z'").count() for f in parts]
    assert sum(held) == by_file and sum(h > 0 for h in held) > 2
    assert sorted(r["position"] for r in got.collect()) == list(range(5000))
    assert "SinglePartition" not in plan_of(got)
    write_ordered(df.where("false"), str(tmp_path / "e"), {"level": levels}, 6)
    assert read_ordered(spark, str(tmp_path / "e")).count() == 0


def test_finished_dataset_in_its_order(spark, sf_dir, tmp_path):
    write_marts(star.model_tables(spark, sf_dir), str(tmp_path), ["2A", "S13"], files=3)
    for name in ["2A", "S13"]:
        got = read_ordered(spark, str(tmp_path / name))
        order = mart_order(name)
        first = next(iter(order))
        placed = [r[first] for r in sorted(got.collect(), key=lambda r: r["position"])]
        levels = order[first] or sorted({p for p in placed if p is not None})
        ranks = [levels.index(p) if p in levels else len(levels) for p in placed]
        assert ranks == sorted(ranks) and len(ranks) > 0


# --- many scenarios --------------------------------------------------------

LONG = "scenario string, k string, value double"


def full_join(data, diffs, ref, fill=None):
    left, right, out = [r for r in data if r[0] in diffs], [r for r in data if r[0] == ref], []
    for s, k, v in left:
        for r in [r for r in right if r[1] == k] or [(None, None, None)]:
            out.append((k, s, r[0], v or 0.0, r[2] or 0.0, (v or 0.0) - (r[2] or 0.0)))
    keys = {r[1] for r in left}
    return out + [(k, fill, s, 0.0, v or 0.0, -(v or 0.0)) for s, k, v in right if k not in keys]


@pytest.mark.parametrize("seed", range(2))
def test_many_scenarios_equal_full_join(spark, rows, seed):
    rng = random.Random(seed)
    names = [f"s{i}" for i in range(30)]
    data = [(s, k, rng.choice([None, float(rng.randint(-5, 9))])) for s in names for k in [None, *"abcdefgh"] if rng.random() < 0.4]
    df = spark.createDataFrame(data, LONG)
    cols = ("k", "scenario_diff", "scenario_ref", "value_diff", "value_ref", "value")
    order = lambda r: [str(v) for v in r]
    families = [(names[1:20], "s0"), (names[20:], "s1"), (["s0", "s3"], "s3")]
    got = rows(diff_families(df, families, ["k"], fill_scenario="none"), "baseline", *cols)
    want = [(ref, *r) for diffs, ref in families for r in full_join(data, diffs, ref, "none")]
    assert sorted(got, key=order) == sorted(want, key=order)
    pairs = [*((s, "s0") for s in names[1:25]), *((s, "s7") for s in names[:5])]
    got = rows(compare_pairs(df, pairs, ["k"]), *cols)
    want = [r for s, ref in pairs for r in full_join(data, [s], ref, s)]
    assert sorted(got, key=order) == sorted(want, key=order)


def test_many_scenarios_stop_at_repeats(spark):
    for repeated in ("s3", "s0"):
        df = spark.createDataFrame([("s0", "a", 1.0), (repeated, "a", 5.0), ("s3", "b", 1.0), (repeated, "a", None)], LONG)
        with pytest.raises(Exception, match="repeats a comparison key"):
            diff_from_scenario(df, [f"s{i}" for i in range(1, 40)], "s0", ["k"]).collect()


def test_five_hundred_scenarios_compile_in_seconds(spark):
    names = [f"s{i}" for i in range(500)]
    df = spark.range(5000).select(F.concat(F.lit("s"), F.col("id") % 500).alias("scenario"), (F.col("id") / 500).cast("int").cast("string").alias("k"), F.lit(1.0).alias("value"))
    start = time.perf_counter()
    got = diff_from_scenario(df, names[1:], "s0", ["k"])
    plan = plan_of(got)
    assert time.perf_counter() - start < 10 and len(plan) < 20_000
    assert got.count() == 499 * 10 and got.where("value != 0").count() == 0
    pairs = compare_pairs(df, list(zip(names, names[1:], strict=False)), ["k"])
    assert pairs.count() == 499 * 10


@pytest.mark.parametrize("families", [1, 5])
def test_repeated_keys_take_two_scans(spark, sf_dir, families):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_returnflag").alias("scenario"), F.col("l_linenumber").alias("k"), F.col("l_quantity").alias("value"))
    got = diff_families(rows.where("value < 2"), [(["A", "R"], "N")] * families, ["k"], unique=False)
    assert plan_of(got).count("FileScan parquet") == 2


# --- sums ------------------------------------------------------------------


def test_exact_sum_has_equal_bits(spark):
    rng = random.Random(3)
    values = [rng.uniform(-1, 1) * 10 ** rng.randint(-6, 11) for _ in range(3000)]
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate(values)], "k int, value double")
    seen = set()
    for n in range(1, 21):
        got = df.orderBy(F.rand(n)).repartition(n).groupBy("k").agg(sum_exact("value").alias("s")).collect()
        seen.add(tuple(sorted((r["k"], r["s"].hex()) for r in got)))
    assert len(seen) == 1
    for k, s in next(iter(seen)):
        assert math.isclose(float.fromhex(s), math.fsum(values[k::3]), rel_tol=1e-12, abs_tol=1e-12)


def test_exact_sum_of_odd_values(spark, rows):
    df = spark.createDataFrame([("a", -0.1), ("a", 0.1), ("b", None), ("b", 1.0), ("c", -2.75), ("d", 1e-30)], "k string, value double")
    assert rows(df.groupBy("k").agg(sum_exact("value").alias("s")), "k", "s") == [("a", 0.0), ("b", None), ("c", -2.75), ("d", 0.0)]
    for bad in (2.0**42, float("nan"), float("-inf")):
        with pytest.raises(Exception, match="too large"):
            spark.createDataFrame([(bad,)], "value double").agg(sum_exact("value")).collect()


# --- rejects and resumed runs ----------------------------------------------


def test_rejects_name_file_column_and_text(spark, rows, tmp_path):
    (tmp_path / "a.csv").write_text("year,scenario,value\n2020,R,1.5\nsoon,R,2\n")
    (tmp_path / "b.csv").write_text("year,scenario,value\n2030,,x\nNA,T,\nx1,,y2\n")
    checked = read_csv_checked(spark, str(tmp_path), schemas.LITERATURE_CO2)
    assert rows(good_rows(checked), "scenario", "year", "value") == [("R", 2020, 1.5), ("T", None, None)]
    assert rows(rejected_cells(checked), "file", "column", "text") == [
        ("a.csv", "year", "soon"), ("b.csv", "value", "x"), ("b.csv", "value", "y2"), ("b.csv", "year", "x1"),
    ]
    with pytest.raises(ValueError, match="lacks"):
        read_csv_checked(spark, str(tmp_path), schemas.LITERATURE_REGION)


def test_run_goes_on_where_it_stopped(spark, sf_dir, tmp_path, monkeypatch):
    tables, base, names = star.model_tables(spark, sf_dir), str(tmp_path / "out"), ["2A", "3A", "S13"]
    write, written = marts.write_mart, []

    def stops(df, path, kind="parquet"):
        written.append(path.rsplit("/", 1)[1])
        if path.endswith("S13"):
            raise RuntimeError("stopped")
        write(df, path, kind)

    monkeypatch.setattr(marts, "write_mart", stops)
    with pytest.raises(RuntimeError, match="stopped"):
        write_marts(tables, base, names, threads=1, resume=True)
    assert written == names
    monkeypatch.setattr(marts, "write_mart", lambda df, path, kind="parquet": (written.append(path.rsplit("/", 1)[1]), write(df, path, kind)))
    shared = {f: os.path.getmtime(f"{base}/_shared/{f}/_SUCCESS") for f in os.listdir(f"{base}/_shared")}
    written.clear()
    write_marts(tables, base, names, threads=1, resume=True)
    assert written == ["S13"]
    assert shared == {f: os.path.getmtime(f"{base}/_shared/{f}/_SUCCESS") for f in shared}
    assert spark.read.parquet(f"{base}/S13").count() == marts.build_mart("S13", tables).count() > 0


def test_entry_without_a_needed_package():
    """The other queries stay if a package of the optional part cannot be imported."""
    code = (
        "import sys, warnings; warnings.simplefilter('ignore'); sys.modules['ahocorasick'] = None; sys.modules['numpy.nothing'] = None\n"
        "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    )
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    n, m = map(int, said.stdout.split())
    assert n >= len(QUERIES) and m >= len(QUERIES)
