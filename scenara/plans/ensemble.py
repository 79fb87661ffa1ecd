"""Scenario ensemble: long form, warming bands and variable extracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenara import vocabulary as V
from scenara.functions import warming_band
from scenara.operators import complete_cases, wide_to_long


def year_columns(wide: DataFrame, years: Sequence[int] | None = None) -> list[str]:
    """The columns of the named years, or all year columns of the table.

    Raises if a named year has no column.
    """
    if years is None:
        return [c for c in wide.columns if c.isdigit()]
    missing = [y for y in years if str(y) not in wide.columns]
    if missing:
        raise ValueError(f"the ensemble has no columns for the years {missing}")
    return [str(y) for y in years]


def ensemble_long(wide: DataFrame, years: Sequence[int] | None = None) -> DataFrame:
    """One row per member, variable and year, of all years or of the named ones."""
    ids = [c for c in wide.columns if not c.isdigit()]
    return wide_to_long(wide, year_columns(wide, years), ids=ids)


def _band(year: int, cuts: Sequence[float]) -> Column:
    return warming_band(F.col(f"`{year}`"), cuts).alias("temp_category")


def warming_category(
    wide: DataFrame,
    variable: str = V.WARMING_VARIABLE,
    year: int = 2100,
    cuts: Sequence[float] = tuple(V.WARMING_CUTS),
) -> DataFrame:
    """Band of each member's warming, read from the one year column."""
    return wide.where(F.col("Variable") == variable).select("Model", "Scenario", _band(year, cuts))


def extract_variable(
    wide: DataFrame,
    variable: str,
    years: Sequence[int] | None = None,
    warming: str = V.WARMING_VARIABLE,
    year: int = 2100,
    cuts: Sequence[float] = tuple(V.WARMING_CUTS),
) -> DataFrame:
    """Complete long rows of one variable with the member's band.

    A member's warming is a row of the same table, so both variables are read in
    one pass and meet in a window of the member, which holds a row per region and
    variable. As in a look-up, a row of a member with several warming rows stands
    once for each. The band is attached to the wide rows, before they multiply by
    the years.
    """
    member = Window.partitionBy("Model", "Scenario")
    is_warming = F.col("Variable") == warming
    band = F.collect_list(F.when(is_warming, F.struct(_band(year, cuts)))).over(member)
    rows = wide.where(F.col("Variable").isin(variable, warming)).withColumn("_bands", band)
    rows = rows.where(F.col("Variable") == variable).withColumn("_band", F.explode("_bands"))
    rows = rows.withColumn("temp_category", F.col("_band.temp_category")).drop("_bands", "_band")
    return complete_cases(ensemble_long(rows, years))


def overlay_extract(extract: DataFrame) -> DataFrame:
    """Extract shaped for an overlay: the band takes the scenario's place."""
    return (
        extract.withColumn("category", F.lit("AR6"))
        .withColumnRenamed("Scenario", "Model_Scenario")
        .withColumnRenamed("temp_category", "scenario")
    )
