"""Null-strict expressions, cell by cell."""

import math

import pytest
from pyspark.sql import functions as F

from scenara.functions import (
    cumsum_strict,
    floor_zero,
    if_else_strict,
    not_in,
    s_curve,
    sum_strict,
    to_number,
    warming_band,
)


def test_sum_strict_is_null_with_any_null(spark, rows):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), (None, 3.0), (None, 4.0)], "k string, v double")
    got = rows(df.groupBy("k").agg(sum_strict("v").alias("s")), "k", "s")
    assert got == [(None, 7.0), ("a", None), ("b", 2.0)]


def test_cumsum_strict_stays_null(spark, rows):
    df = spark.createDataFrame([(1, 1.0), (3, 2.0), (2, None)], "year int, v double").withColumn("k", F.lit("a"))
    got = rows(df.withColumn("c", cumsum_strict("v", ["k"])), "year", "c")
    assert got == [(1, 1.0), (2, None), (3, None)]


def test_cumsum_strict_ignores_row_order(spark, rows):
    df = spark.createDataFrame([(y, float(y)) for y in (5, 1, 4, 2, 3)], "year int, v double")
    got = rows(df.withColumn("k", F.lit(1)).withColumn("c", cumsum_strict("v", ["k"])), "year", "c")
    assert got == [(1, 1.0), (2, 3.0), (3, 6.0), (4, 10.0), (5, 15.0)]


def test_if_else_strict_unknown_condition(spark, rows):
    df = spark.createDataFrame([(1, 5.0), (2, -5.0), (3, None)], "i int, v double")
    got = rows(df.withColumn("r", if_else_strict(F.col("v") > 0, F.lit("y"), F.lit("n"))), "i", "r")
    assert got == [(1, "y"), (2, "n"), (3, None)]


def test_not_in_keeps_null(spark, rows):
    df = spark.createDataFrame([(None,), ("z",), ("a",)], "k string")
    assert rows(df.where(not_in("k", ["a"])), "k") == [(None,), ("z",)]


def test_floor_zero_keeps_null(spark, rows):
    df = spark.createDataFrame([(1, -1.0), (2, None), (3, 2.0)], "i int, v double")
    assert rows(df.withColumn("r", floor_zero("v")), "i", "r") == [(1, 0.0), (2, None), (3, 2.0)]


def test_to_number_tolerates_text(spark, rows):
    df = spark.createDataFrame([("x",), ("12",), (None,)], "s string")
    assert rows(df.select(to_number("s", "int").alias("n")), "n") == [(None,), (None,), (12,)]


@pytest.mark.parametrize(
    "year, expected",
    [(2015, 1.0), (2020, 0.973403006), (2040, 0.401312340), (2055, 0.032295465), (2060, 0.0), (2010, 1.0)],
)
def test_s_curve(spark, year, expected):
    df = spark.createDataFrame([(year, 2015)], "year int, vintage int")
    assert math.isclose(df.select(s_curve("year", "vintage")).first()[0], expected, abs_tol=1e-9)


def test_s_curve_falls_with_age(spark):
    df = spark.range(0, 60).select((F.col("id") + 2015).alias("year"), F.lit(2015).alias("vintage"))
    shares = [r[0] for r in df.select(s_curve("year", "vintage"), "year").orderBy("year").collect()]
    assert all(0 <= s <= 1 for s in shares)
    assert shares == sorted(shares, reverse=True)


def test_warming_bands_are_half_open(spark):
    values = [1.4, 1.5, 2.0, 3.0, 4.0, None, 1.9999]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r[0] for r in df.orderBy("i").select(warming_band("v")).collect()]
    assert got == ["A_below 1.5C", "B_1.5-2C", "C_2-3C", "D_3-4C", "E_above 4C", None, "B_1.5-2C"]
