"""Ageing against a plain step-by-step calculation."""

import math
import random

import pytest

from scenara.plans import capacity

KEYS = capacity.EXPORT_KEYS
SCHEMA = "scenario string, region string, sector string, Units string, vintage int, year int, value double"


def frame(spark, data):
    return spark.createDataFrame([("s", r, "x", "MTPA", v, y, q) for r, v, y, q in data], SCHEMA)


def test_additions_only_in_their_year(spark, rows):
    df = frame(spark, [("r", 2020, 2020, 5.0), ("r", 2020, 2025, 5.0), ("r", 2015, 2015, 9.0)])
    assert rows(capacity.additions(df), "year", "additions") == [(2020, 5.0), (2025, 0.0)]


def test_retirements_are_decreases(spark, rows):
    df = frame(spark, [("r", 2020, 2020, 10.0), ("r", 2020, 2025, 8.0), ("r", 2020, 2030, 9.0)])
    assert rows(capacity.retirements(df, KEYS), "year", "retirements") == [(2020, 0.0), (2025, 2.0), (2030, 0.0)]


def test_natural_retirements_follow_the_curve(spark, rows):
    df = frame(spark, [("r", 2015, y, 10.0) for y in (2015, 2020, 2040, 2060)])
    got = rows(capacity.natural_retirements(df, KEYS), "year", "natural_retire")
    shares = [1, 1 / (1 + math.exp(0.2 * (5 - 23))), 1 / (1 + math.exp(0.2 * (25 - 23))), 0]
    assert got[0] == (2015, 0.0)
    for (_, natural), before, now in zip(got[1:], shares, shares[1:]):
        assert math.isclose(natural, 10 * (before - now), abs_tol=1e-12)


def test_missing_installation_year(spark, rows):
    df = frame(spark, [("r", 2015, 2020, 10.0), ("r", 2015, 2025, 4.0)])
    got = rows(capacity.natural_retirements(df, KEYS), "year", "installed", "natural_retire")
    assert got == [(2020, None, None), (2025, None, None)]


@pytest.mark.parametrize("add, ret, expected", [(5.0, 3.0, (2.0, 0.0)), (3.0, 5.0, (0.0, 2.0)), (4.0, 4.0, (0.0, 0.0))])
def test_netting(spark, add, ret, expected):
    df = spark.createDataFrame([(add, ret)], "additions double, retirements double")
    row = capacity.net_changes(df).first()
    assert (row.add_adj, row.ret_adj) == expected


def test_netting_unknown(spark):
    df = spark.createDataFrame([(None, 1.0)], "additions double, retirements double")
    row = capacity.net_changes(df).first()
    assert (row.add_adj, row.ret_adj) == (None, None)


def test_retirement_only_series_drop_out(spark):
    df = frame(spark, [("old", 2015, 2015, 10.0), ("old", 2015, 2020, 1.0), ("new", 2020, 2020, 1.0)])
    assert {r.region for r in capacity.net_add_ret(df, KEYS).collect()} == {"new"}
    kept = {(r.region, r.year): (r.additions, r.ret_adj) for r in capacity.net_add_ret(df, KEYS, keep_ret_only=True).collect()}
    assert set(kept) == {("old", 2015), ("old", 2020), ("new", 2020)}
    assert kept["old", 2020][0] == 0.0 and kept["old", 2020][1] > 8


def step_by_step(data, half_life=23, steepness=0.2, lifetime=45, base=2015):
    """Additions and early retirements by region and year, one list at a time."""
    vintages = {}
    for r, v, y, q in data:
        if v >= base:
            vintages.setdefault((r, v), []).append((y, q))
    early, added = {}, {}
    for (r, v), series in vintages.items():
        series.sort()
        installed = dict(series).get(v)
        before, expected_before = None, None
        for i, (y, q) in enumerate(series):
            retired = None if q is None else max((before or 0.0) - q, 0.0)
            natural = 0.0
            if v == base and installed is not None:
                age = y - v
                share = 0.0 if age >= lifetime else 1 / (1 + math.exp(steepness * (age - half_life))) if age > 0 else 1.0
                expected = installed * share
                if i and y > v and expected_before > expected:
                    natural = expected_before - expected
                expected_before = expected
            early.setdefault((r, y), []).append(None if retired is None else max(retired - natural, 0.0))
            if v > base:
                added.setdefault((r, y), []).append(q if v == y else 0.0)
            before = q

    def total(xs):
        return None if any(x is None for x in xs) else sum(xs)

    return {k: (total(xs), total(early[k])) for k, xs in added.items()}


@pytest.mark.parametrize("seed", range(4))
def test_net_add_ret_equals_step_by_step(spark, seed):
    rng = random.Random(seed)
    data = []
    for r in "abcde":
        for v in range(2010, 2055, 5):
            for y in range(v, 2065, 5):
                if rng.random() < 0.85:
                    data.append((r, v, y, None if rng.random() < 0.1 else float(rng.randint(0, 40))))
    rng.shuffle(data)
    got = {
        (r.region, r.year): (r.additions, r.retirements) for r in capacity.net_add_ret(frame(spark, data), KEYS).collect()
    }
    want = step_by_step(data)
    assert set(got) == set(want)
    for key, pair in want.items():
        for a, b in zip(got[key], pair):
            assert (a is None) == (b is None)
            assert a is None or math.isclose(a, b, abs_tol=1e-9)


def test_repeated_rows_do_not_depend_on_order(spark):
    """Several rows in a year of a series act as their sum, whatever their order."""
    rng = random.Random(3)
    data = [
        (r, v, y, float(rng.randint(0, 40)))
        for r in "abc"
        for v in (2015, 2020, 2025)
        for y in range(v, 2050, 5)
        for _ in range(3)
    ]
    summed = {}
    for r, v, y, q in data:
        summed[r, v, y] = summed.get((r, v, y), 0.0) + q
    want = step_by_step([(*k, q) for k, q in summed.items()])
    for _ in range(3):
        rng.shuffle(data)
        got = capacity.net_add_ret(frame(spark, data).repartition(5), KEYS).collect()
        assert {(g.region, g.year) for g in got} == set(want) and len(got) == len(want)
        for g in got:
            for a, b in zip((g.additions, g.retirements), want[g.region, g.year]):
                assert math.isclose(a, b, abs_tol=1e-9)


def test_unique_rows_save_a_shuffle(spark):
    df = frame(spark, [("r", 2015, 2015, 1.0)])
    plans = [
        capacity.net_add_ret(df, KEYS, unique=u)._jdf.queryExecution().executedPlan().toString() for u in (False, True)
    ]
    assert [p.count("Exchange hashpartitioning") for p in plans] == [3, 2]


def test_known_years_save_a_shuffle(spark):
    """Sums of repeats in slots by year equal those by row, gaps included, with two shuffles."""
    rng, years = random.Random(5), list(range(2015, 2050, 5))
    data = [
        (r, v, y, None if rng.random() < 0.05 else float(rng.randint(0, 40)))
        for r in ("a", "b", None)
        for v in years
        for y in range(v, 2050, 5)
        for _ in range(rng.randint(0, 3))
    ]
    df = frame(spark, data).repartition(3)
    slots, plain = (capacity.net_add_ret(df, KEYS, years=y) for y in (years, None))
    assert sorted(map(str, slots.collect())) == sorted(map(str, plain.collect())) != []
    plan = slots._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 2
    for year in (2016, None):
        with pytest.raises(Exception, match="not among the years"):
            capacity.retirements(frame(spark, [*data, ("a", 2015, year, 1.0)]), KEYS, years=years).collect()


def test_netted_changes_exclude_each_other(spark):
    rng = random.Random(9)
    data = [(r, v, y, float(rng.randint(0, 40))) for r in "ab" for v in range(2015, 2050, 5) for y in range(v, 2055, 5)]
    cum = capacity.cumulative(capacity.net_add_ret(frame(spark, data), KEYS), KEYS).orderBy("region", "year").collect()
    assert all(r.add_adj >= 0 and r.ret_adj >= 0 and r.add_adj * r.ret_adj == 0 for r in cum)
    for a, b in zip(cum, cum[1:]):
        if a.region == b.region:
            assert b.cum_additions >= a.cum_additions and b.cum_retirements >= a.cum_retirements


def test_cost(spark, rows):
    df = spark.createDataFrame(
        [("traded LNG", 1.0), ("traded RUS pipeline gas", 1.0), (None, 1.0)], "sector string, additions double"
    )
    got = dict(rows(capacity.infra_cost(df), "sector", "cost"))
    per_ej = 1e9 / 18.949892931906295 / 0.13 / 5
    assert set(got) == {"traded LNG", "traded RUS pipeline gas"}
    assert math.isclose(got["traded LNG"], 2.02 * per_ej) and math.isclose(got["traded RUS pipeline gas"], 0.57 * per_ej)
