"""Reshaping, roll-ups and scenario differences on small fixtures."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from scenara import vocabulary as V
from scenara.operators import (
    as_levels,
    attach_mapping,
    attach_total,
    compare_pairs,
    complete_cases,
    composite_key,
    convert_units,
    diff_families,
    diff_from_scenario,
    local_table,
    relabel,
    rollup_groups,
    rollup_sum,
    split_column,
    union_by_name,
    wide_to_long,
    with_net,
)


@pytest.mark.parametrize(
    "text, into, sep, expected",
    [
        ("domestic natural gas", ["a", "b"], " ", ("domestic", "natural")),
        ("one", ["a", "b"], " ", ("one", None)),
        (None, ["a", "b"], " ", (None, None)),
        ("USA traded LNG", ["a", None], " traded ", ("USA",)),
        ("traded N.Amer pipeline gas", ["a", "b"], " ", ("traded", "N.Amer")),
        ("LNG,year=2020", [None, "b"], ",year=", ("2020",)),
    ],
)
def test_split_column(spark, text, into, sep, expected):
    df = spark.createDataFrame([(text, 1)], "x string, v int")
    got = split_column(df, "x", into, sep)
    assert "x" not in got.columns
    assert tuple(got.first()[n] for n in into if n) == expected


def test_split_column_may_reuse_its_own_name(spark):
    df = spark.createDataFrame([("LNG,year=2020",)], "technology string")
    row = split_column(df, "technology", ["technology", "vintage"], ",year=").first()
    assert (row.technology, row.vintage) == ("LNG", "2020")


def test_split_column_replaces_an_existing_target(spark):
    df = spark.createDataFrame([("old", "USA traded LNG")], "region string, subsector string")
    got = split_column(df, "subsector", ["region", None], " traded ")
    assert got.columns == ["region"] and got.first().region == "USA"


def test_wide_to_long_keeps_nulls(spark, rows):
    df = spark.createDataFrame([("m", 1.0, None)], "model string, `2020` double, `2025` double")
    assert rows(wide_to_long(df, [2020, 2025]), "model", "year", "value") == [("m", 2020, 1.0), ("m", 2025, None)]


def test_as_levels_blanks_undeclared(spark, rows):
    df = spark.createDataFrame([("domestic",), ("LNG",), ("RUS",), (None,)], "sector string")
    got = rows(as_levels(df, "sector", V.TRADE_SECTOR_LEVELS), "sector", "sector_ord")
    assert got == [(None, None), (None, None), ("LNG", 0), ("RUS", 6)]
    got = rows(as_levels(df, "sector", V.DOMESTIC_SECTOR_LEVELS), "sector", "sector_ord")
    assert got == [(None, None), ("LNG", 1), ("RUS", 7), ("domestic", 0)]


def test_relabel(spark, rows):
    df = spark.createDataFrame([("Reference_LT_sshc",), ("other",), (None,)], "scenario string")
    assert rows(relabel(df, "scenario", V.SCENARIO_LABELS), "scenario") == [(None,), ("Reference_LT",), ("other",)]


def test_composite_key(spark, rows):
    df = spark.createDataFrame([("a", 2015), (None, 2020)], "s string, year int")
    assert rows(df.select(composite_key("s", "year").alias("k")), "k") == [(None,), ("a.2015",)]


def test_complete_cases(spark):
    df = spark.createDataFrame([("a", 1.0, "x"), ("a", None, "x"), (None, 1.0, "x")], "a string, `b.c` double, d string")
    assert complete_cases(df).count() == 1
    assert complete_cases(df, ["a"]).count() == 2


def test_union_by_name(spark):
    a, b = spark.createDataFrame([(1, 2)], "k int, v int"), spark.createDataFrame([(1, 3)], "k int, w int")
    got = union_by_name(a, b, a)
    assert got.columns == ["k", "v", "w"] and got.count() == 3
    assert got.where("v is null").first().w == 3


def test_unit_factor(spark):
    df = spark.createDataFrame([(1.0, "EJ")], "value double, Units string")
    row = convert_units(df, V.EJ_MTPA, "MTPA").first()
    assert row.Units == "MTPA" and abs(row.value - 18.949892932) < 1e-9


def test_attach_mapping_fans_out_and_keeps_unmatched(spark, rows):
    df = spark.createDataFrame([("a", 1.0), ("z", 2.0), (None, 3.0)], "region string, value double")
    mapping = spark.createDataFrame([("a", "A"), ("a", "B")], "region string, grouped_region string")
    got = rows(attach_mapping(df, mapping, "region"), "region", "grouped_region", "value")
    assert got == [(None, None, 3.0), ("a", "A", 1.0), ("a", "B", 1.0), ("z", None, 2.0)]


def test_rollup_sum_measures(spark, rows):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 2.0, 1.0)], "k string, x double, y double")
    assert rows(rollup_sum(df, ["k"], ["x", "y"]), "k", "x", "y") == [("a", 3.0, None)]


def test_rollup_groups_overlap_and_drop(spark, rows):
    df = spark.createDataFrame([("s", "p", 1.0), ("s", "q", 2.0), ("s", "r", 4.0)], "scenario string, sector string, value double")
    got = rows(rollup_groups(df, "sector", {"X": ["p", "q"], "Y": ["q"]}, ["scenario"]), "sector", "value")
    assert got == [("X", 3.0), ("Y", 2.0)]
    table = local_table(spark, {"sector": ["r"], "group_name": ["Z"]})
    assert rows(rollup_groups(df, "sector", table, ["scenario"]), "sector", "value") == [("Z", 4.0)]


def test_emission_groups_do_not_overlap():
    members = [m for g in V.EMISSION_GROUPS.values() for m in g]
    assert len(members) == len(set(members)) == 73


@pytest.mark.parametrize("total", [with_net, attach_total])
def test_total_beside_detail(spark, rows, total):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", 2.0), ("b", 1.0), ("b", None), (None, 5.0), (None, 6.0)], "k string, value double"
    )
    got = rows(total(df, ["k"]), "k", "value", "value_net")
    assert got == [
        (None, 5.0, 11.0),
        (None, 6.0, 11.0),
        ("a", 1.0, 3.0),
        ("a", 2.0, 3.0),
        ("b", None, None),
        ("b", 1.0, None),
    ]


# --- differences -----------------------------------------------------------

LONG = "scenario string, k string, value double"


def test_difference_rows(spark, rows):
    df = spark.createDataFrame(
        [("D", "both", 5.0), ("R", "both", 2.0), ("D", "own", 5.0), ("R", "ref", 3.0), ("X", "both", 9.0)], LONG
    )
    cols = ("k", "scenario_diff", "scenario_ref", "value_diff", "value_ref", "value")
    assert rows(diff_from_scenario(df, ["D"], "R", ["k"]), *cols) == [
        ("both", "D", "R", 5.0, 2.0, 3.0),
        ("own", "D", None, 5.0, 0.0, 5.0),
        ("ref", None, "R", 0.0, 3.0, -3.0),
    ]
    filled = rows(diff_from_scenario(df, ["D"], "R", ["k"], fill_scenario="D"), *cols)
    assert filled[2] == ("ref", "D", "R", 0.0, 3.0, -3.0)


def test_difference_null_keys_meet(spark, rows):
    df = spark.createDataFrame([("D", None, 1.0), ("R", None, 2.0)], LONG)
    assert rows(diff_from_scenario(df, ["D"], "R", ["k"]), "k", "scenario_diff", "value") == [(None, "D", -1.0)]


def test_difference_unknown_value_is_zero(spark, rows):
    df = spark.createDataFrame([("D", "a", None), ("R", "a", 2.0)], LONG)
    assert rows(diff_from_scenario(df, ["D"], "R", ["k"]), "scenario_diff", "value_diff", "value") == [("D", 0.0, -2.0)]


def test_difference_of_two_scenarios_has_no_zero_row(spark, rows):
    df = spark.createDataFrame([("D", "a", 1.0), ("R", "a", 2.0)], LONG)
    assert rows(diff_from_scenario(df, ["D", "E"], "R", ["k"]), "scenario_diff", "value") == [("D", -1.0)]
    assert rows(compare_pairs(df, [("D", "R"), ("E", "R")], ["k"]), "scenario_diff", "value") == [
        ("D", -1.0),
        ("E", -2.0),
    ]


def test_difference_with_itself_is_zero(spark):
    df = spark.createDataFrame([("A", "a", 1.5), ("A", "b", None), ("A", None, 4.0)], LONG)
    got = diff_from_scenario(df, ["A"], "A", ["k"]).collect()
    assert len(got) == 3 and all(r.value == 0 for r in got)


def _full_join(data, diffs, ref):
    """Plain nested-loop full outer join of the rows of one family."""
    left = [r for r in data if r[0] in diffs]
    right = [r for r in data if r[0] == ref]
    out = []
    for s, k, v in left:
        match = [r for r in right if r[1] == k]
        for r in match or [(None, None, None)]:
            a, b = v or 0.0, r[2] or 0.0
            out.append((k, s, r[0], a, b, a - b))
    keys = {r[1] for r in left}
    out += [(k, None, s, 0.0, v or 0.0, -(v or 0.0)) for s, k, v in right if k not in keys]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_difference_equals_full_join(spark, rows, seed):
    rng = random.Random(seed)
    keys = [None, *"abcdefgh"]
    data = [
        (s, k, rng.choice([None, float(rng.randint(-5, 9))]))
        for s, k in itertools.product(["R", "D", "E", "T", "X"], keys)
        if rng.random() < 0.6
    ]
    df = spark.createDataFrame(data, LONG)
    cols = ("k", "scenario_diff", "scenario_ref", "value_diff", "value_ref", "value")
    families = [(["D", "E"], "R"), (["X"], "T")]
    order = lambda r: [str(v) for v in r]
    for diffs, ref in families:
        got = rows(diff_from_scenario(df, diffs, ref, ["k"]), *cols)
        assert sorted(got, key=order) == sorted(_full_join(data, diffs, ref), key=order)
    got = rows(diff_families(df, families, ["k"]), "baseline", *cols)
    want = [(ref, *r) for diffs, ref in families for r in _full_join(data, diffs, ref)]
    assert sorted(got, key=order) == sorted(want, key=order)


@pytest.mark.parametrize("seed", range(2))
def test_repeated_keys_equal_full_join(spark, rows, seed):
    """Several rows under one key on both sides, unknown values and keys among them."""
    rng = random.Random(seed)
    data = [
        (rng.choice("RDEXT"), rng.choice([None, *"abcd"]), rng.choice([None, float(rng.randint(-5, 9))]))
        for _ in range(60)
    ]
    df = spark.createDataFrame(data, LONG)
    cols = ("k", "scenario_diff", "scenario_ref", "value_diff", "value_ref", "value")
    families = [(["D", "E"], "R"), (["X"], "T")]
    order = lambda r: [str(v) for v in r]
    for diffs, ref in families:
        got = rows(diff_from_scenario(df, diffs, ref, ["k"], unique=False), *cols)
        assert sorted(got, key=order) == sorted(_full_join(data, diffs, ref), key=order)
    got = rows(diff_families(df, families, ["k"], unique=False), "baseline", *cols)
    want = [(ref, *r) for diffs, ref in families for r in _full_join(data, diffs, ref)]
    assert sorted(got, key=order) == sorted(want, key=order)
    got = rows(compare_pairs(df, [("D", "R"), ("X", "T")], ["k"], unique=False), *cols)
    want = [(r[0], s, *r[2:]) for s, ref in [("D", "R"), ("X", "T")] for r in _full_join(data, [s], ref)]
    assert sorted(got, key=order) == sorted(want, key=order)


def test_one_pass_difference_stops_at_repeats(spark):
    df = spark.createDataFrame([("D", "a", 5.0), ("D", "a", None), ("R", "a", 1.0)], LONG)
    with pytest.raises(Exception, match="repeats a comparison key"):
        diff_from_scenario(df, ["D"], "R", ["k"]).collect()


def test_hot_key_total(spark):
    """A third of all rows under one key."""
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 997).cast("string")).alias("k"),
        F.lit(1.0).alias("value"),
    )
    got = attach_total(df, ["k"])
    assert got.count() == 30_000
    assert got.where("k = 'hot'").agg(F.min("value_net"), F.max("value_net"), F.count("*")).first()[:] == (
        10_000.0,
        10_000.0,
        10_000,
    )
