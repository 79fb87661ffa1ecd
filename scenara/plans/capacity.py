"""Capital stock by installation year: additions, retirements, netting, cost.

``keys`` name a capital series, for example scenario, region, sector and
Units. Rows of a finer grain are first summed (strictly) to one row per series,
vintage and year, so that results never depend on the order of rows. Each
window is then one vintage of one series and holds no more rows than there are
years; all of them share one partitioning and one sort. ``unique=True`` states
that a table has such rows already and saves the shuffle of that sum; ``years``
names the model's years and lets that sum share the shuffle of the windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from scenara import vocabulary as V
from scenara.functions import cumsum_strict, floor_zero, if_else_strict, s_curve, sum_strict, to_number
from scenara.operators import attach_mapping, convert_units, rollup_sum

EXPORT_KEYS = ["scenario", "region", "sector", "Units"]
IMPORT_KEYS = ["scenario", "region", "technology", "Units"]


def to_capacity(df: DataFrame) -> DataFrame:
    """Energy flow to capacity in MTPA, vintage as a number."""
    return convert_units(df, V.EJ_MTPA, "MTPA").withColumn("vintage", to_number("vintage", "int"))


def export_capacity(capacity: DataFrame) -> DataFrame:
    return rollup_sum(capacity, ["Units", "scenario", "sector", "region", "output", "year"])


def import_capacity(capacity: DataFrame) -> DataFrame:
    return rollup_sum(capacity, ["scenario", "region", "technology", "year"])


def global_capacity(capacity: DataFrame) -> DataFrame:
    return rollup_sum(capacity, ["scenario", "year"])


def cumulative_capacity(totals: DataFrame) -> DataFrame:
    """Running sum over the years of ``export_capacity``."""
    return totals.withColumn("cum_value", cumsum_strict("value", ["Units", "scenario", "sector", "region", "output"]))


def _one_row(df: DataFrame, keys: Sequence[str], unique: bool, years: Sequence[int] | None) -> DataFrame:
    """One row per series, vintage and year; partial sums run before the shuffle.

    With ``years`` a vintage's years are slots of one aggregate by series and vintage, so that
    the sums stay where the windows need them and no second shuffle follows. A row of another
    year stops the query.
    """
    if unique:
        return df
    if years is None:
        return rollup_sum(df, [*keys, "vintage", "year"])
    if len(years) > 63:
        raise ValueError("at most 63 years, one bit of a long for each")
    number = F.array_position(F.array(*map(F.lit, years)), F.col("year")).cast("int") - 1
    rows = df.withColumn("_at", F.nullif(number, F.lit(-1)))
    bit = F.expr("shiftleft(1L, _at)")
    sums = rows.groupBy(*keys, "vintage").agg(
        *[F.sum(F.when(F.col("_at") == i, F.col("value"))).alias(f"_sum{i}") for i in range(len(years))],
        F.bit_or(bit).alias("_found"),
        F.coalesce(F.bit_or(F.when(F.col("value").isNull(), bit)), F.lit(0)).alias("_unknown"),
        F.count(F.when(F.col("_at").isNull(), F.lit(1))).alias("_stray"),
    )
    has = lambda mask, i: F.col(mask).bitwiseAND(F.lit(1 << i)) != 0
    slots = [
        F.struct(F.lit(y).alias("year"), F.when(~has("_unknown", i), F.col(f"_sum{i}")).alias("value"), has("_found", i).alias("found"))
        for i, y in enumerate(years)
    ]
    other = F.raise_error(F.lit("a row's year is not among the years given")).cast("boolean")
    rows = sums.where(F.when(F.col("_stray") > 0, other).otherwise(True))
    rows = rows.select(*keys, "vintage", F.explode(F.array(*slots)).alias("_slot"))
    return rows.where("_slot.found").select(*keys, "vintage", "_slot.year", "_slot.value")


def _by_year(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys, "vintage").orderBy("year")


def _added() -> Column:
    return if_else_strict(F.col("vintage") == F.col("year"), F.col("value"), F.lit(0.0))


def _with_retired(df: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    before = F.coalesce(F.lag("value", 1).over(_by_year(keys)), F.lit(0.0))
    # a step of its own, so that the lag is computed once
    return df.withColumn(out, before - F.col("value")).withColumn(out, floor_zero(out))


def _with_natural(df: DataFrame, keys: Sequence[str], half_life, steepness, lifetime) -> DataFrame:
    """Installed stock, its expected course along the S-curve, and the yearly decrease."""
    whole = _by_year(keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at_start = F.when(F.col("vintage") == F.col("year"), F.col("value"))
    shrinking = (F.col("year") > F.col("vintage")) & (F.col("_before") > F.col("expected"))
    decrease = F.col("_before") - F.col("expected")
    return (
        df.withColumn("s_curve_adj", s_curve("year", "vintage", half_life, steepness, lifetime))
        .withColumn("installed", F.max(at_start).over(whole))
        .withColumn("expected", F.col("installed") * F.col("s_curve_adj"))
        .withColumn("_before", F.lag("expected", 1).over(_by_year(keys)))
        .withColumn("natural_retire", if_else_strict(shrinking, decrease, F.lit(0.0)))
        .drop("_before")
    )


def additions(df: DataFrame, base_vintage: int = V.BASE_VINTAGE) -> DataFrame:
    """Capacity of a vintage counts as added in its installation year."""
    return df.where(F.col("vintage") > base_vintage).withColumn("additions", _added())


def retirements(
    df: DataFrame,
    keys: Sequence[str],
    base_vintage: int = V.BASE_VINTAGE,
    unique: bool = False,
    years: Sequence[int] | None = None,
) -> DataFrame:
    """Decrease of each vintage from the year before."""
    rows = _one_row(df.where(F.col("vintage") >= base_vintage), keys, unique, years)
    return _with_retired(rows, keys, "retirements")


def natural_retirements(
    df: DataFrame,
    keys: Sequence[str],
    base_vintage: int = V.BASE_VINTAGE,
    half_life: float = V.S_CURVE_HALF_LIFE,
    steepness: float = V.S_CURVE_STEEPNESS,
    lifetime: float = V.S_CURVE_LIFETIME,
    unique: bool = False,
    years: Sequence[int] | None = None,
) -> DataFrame:
    """Expected stock of the base vintage along the S-curve and its yearly decrease."""
    rows = _one_row(df.where(F.col("vintage") == base_vintage), keys, unique, years)
    return _with_natural(rows, keys, half_life, steepness, lifetime)


def net_changes(df: DataFrame) -> DataFrame:
    """The larger of additions and retirements, less the smaller."""
    add, ret = F.col("additions"), F.col("retirements")
    return df.withColumn("add_adj", if_else_strict(add > ret, add - ret, F.lit(0.0))).withColumn(
        "ret_adj", if_else_strict(ret > add, ret - add, F.lit(0.0))
    )


def net_add_ret(
    df: DataFrame,
    keys: Sequence[str],
    base_vintage: int = V.BASE_VINTAGE,
    half_life: float = V.S_CURVE_HALF_LIFE,
    steepness: float = V.S_CURVE_STEEPNESS,
    lifetime: float = V.S_CURVE_LIFETIME,
    keep_ret_only: bool = False,
    unique: bool = False,
    years: Sequence[int] | None = None,
) -> DataFrame:
    """Netted additions and early retirements by series and year.

    Retirements beyond the natural ones of the base vintage are early. A
    series and year with vintages of the base year only has no additions row;
    such rows are left out unless ``keep_ret_only``.

    One shuffle ages the vintages, one sums them, after the sum of repeated rows
    unless they are ``unique`` or ``years`` are given: neither the expected stock
    nor the additions need a join.
    """
    is_new = F.col("vintage") > base_vintage
    rows = _one_row(df.where(F.col("vintage") >= base_vintage), keys, unique, years)
    aged = _with_retired(rows, keys, "_retired")
    aged = _with_natural(aged, keys, half_life, steepness, lifetime)
    # only the base vintage is expected to retire
    natural = F.when(~is_new, F.coalesce(F.col("natural_retire"), F.lit(0.0))).otherwise(F.lit(0.0))
    aged = aged.withColumn("_early", F.col("_retired") - natural).withColumn("_early", floor_zero("_early"))
    new = F.when(is_new, _added())
    known = F.count(new) == F.count(F.when(is_new, F.lit(1)))
    totals = aged.groupBy(*keys, "year").agg(
        F.when(known, F.coalesce(F.sum(new), F.lit(0.0))).alias("additions"),
        sum_strict("_early").alias("retirements"),
        F.count(F.when(is_new, F.lit(1))).alias("_new_rows"),
    )
    if not keep_ret_only:
        totals = totals.where(F.col("_new_rows") > 0)
    return net_changes(totals.drop("_new_rows"))


def cumulative(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Running sums of netted additions and retirements over the years."""
    return changes.withColumn("cum_additions", cumsum_strict("add_adj", keys)).withColumn(
        "cum_retirements", cumsum_strict("ret_adj", keys)
    )


CUMULATIVE = ("cum_additions", "cum_retirements")


def cumulative_global(cum: DataFrame, category: str) -> DataFrame:
    return rollup_sum(cum, ["scenario", category, "year"], CUMULATIVE)


def cumulative_grouped(cum: DataFrame, category: str, region_groups: DataFrame) -> DataFrame:
    mapped = attach_mapping(cum, region_groups, "region")
    return rollup_sum(mapped, ["scenario", "grouped_region", category, "year"], CUMULATIVE)


def global_additions(changes: DataFrame) -> DataFrame:
    summed = rollup_sum(changes, ["scenario", "sector", "year"], ["add_adj"])
    return summed.withColumnRenamed("add_adj", "additions")


def infra_cost(
    added: DataFrame,
    lng_cost: float = V.LNG_UNIT_COST,
    pipeline_cost: float = V.PIPELINE_UNIT_COST,
    charge: float = V.CAPITAL_CHARGE,
    years: float = V.PERIOD_YEARS,
) -> DataFrame:
    """Yearly cost of the additions by kind of infrastructure."""
    unit = F.when(F.col("sector") == V.LNG_SECTOR, F.lit(lng_cost)).otherwise(F.lit(pipeline_cost))
    scale = 1e9 / V.EJ_MTPA / charge / years
    return added.where(F.col("sector").isNotNull()).withColumn("cost", F.col("additions") * unit * F.lit(scale))
