"""Emissions in CO2-equivalents and their roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenara import vocabulary as V
from scenara.functions import sum_strict
from scenara.operators import attach_mapping, complete_cases, rollup_groups, rollup_sum, union_by_name


#: keys of the three tables that ``emission_grains`` makes in one pass
GRAINS = {
    "resource": ["scenario", "region", "resource", "subresource", "ghg", "year"],
    "sector": ["scenario", "region", "sector", "ghg", "year"],
    "land": ["scenario", "region", "year"],
}


def emission_grains(rows: DataFrame) -> DataFrame:
    """Resource, sector and land-use amounts out of one table of emissions, by ``grain``.

    One aggregate over grouping sets: the rows are read and joined once, each set sums
    partially before the one shuffle. Keys that a grain does not have are null.
    """
    keys = ["scenario", "region", "resource", "subresource", "sector", "ghg", "year"]
    is_sector, is_resource = F.grouping("sector") == 0, F.grouping("resource") == 0
    grain = F.when(is_sector, "sector").when(is_resource, "resource").otherwise("land")
    sets = [[F.col(k) for k in of] for of in GRAINS.values()]
    return rows.groupingSets(sets, *keys).agg(sum_strict("value").alias("value"), grain.alias("grain"))


def _complete_or_land(grains: DataFrame) -> DataFrame:
    """Rows with all keys of their grain and a value; land-use rows as they are."""
    whole = [
        (F.col("grain") == name) & reduce(Column.__and__, [F.col(c).isNotNull() for c in [*GRAINS[name], "value"]])
        for name in ("resource", "sector")
    ]
    return grains.where((F.col("grain") == "land") | whole[0] | whole[1])


def _weighed(rows: DataFrame, factors: DataFrame, factor_col: str) -> DataFrame:
    """Amounts of all grains as CO2-equivalents; rows of a gas without a factor drop out."""
    land = F.col("grain") == "land"
    factor = factors.select(F.col("ghg").alias("GHG"), F.col(factor_col).alias("_factor"))
    named = rows.withColumnRenamed("ghg", "GHG").withColumn("_land", land)
    weighed = attach_mapping(named, factor, "GHG").where(F.col("_land") | F.col("_factor").isNotNull())
    scale = F.when(F.col("_land"), F.lit(V.CARBON_TO_CO2)).otherwise(F.col("_factor"))
    return (
        weighed.withColumn("value", F.col("value") * scale)
        .withColumn("Units", F.when(F.col("_land"), "MtCO2").otherwise("MTCO2e"))
        .withColumn("GHG", F.when(F.col("_land"), "CO2").otherwise(F.col("GHG")))
        .drop("_factor", "_land")
    )


def all_from_grains(grains: DataFrame, factors: DataFrame, factor_col: str = "AR5all") -> DataFrame:
    """``all_emissions`` out of ``emission_grains``, without a union."""
    sector = F.when(F.col("grain") == "resource", F.col("subresource")).when(F.col("grain") == "sector", F.col("sector"))
    rows = _complete_or_land(grains).withColumn("sector", F.coalesce(sector, F.lit(V.LAND_USE_SECTOR)))
    weighed = _weighed(rows, factors, factor_col)
    return weighed.select("Units", "scenario", "region", "sector", "GHG", "year", "value")


def totals_from_grains(grains: DataFrame, factors: DataFrame, factor_col: str = "AR5all") -> DataFrame:
    """``sector_totals`` out of ``emission_grains``, with land use as rows of ``grain`` land."""
    sector = F.when(F.col("grain") == "resource", F.col("resource")).when(F.col("grain") == "sector", F.col("sector"))
    rows = _complete_or_land(grains).withColumn("sector", F.coalesce(sector, F.lit(V.LAND_USE_SECTOR)))
    # amounts of one gas meet across resources and sectors before they are weighed
    source = F.when(F.col("grain") == "land", "land").otherwise("sector").alias("grain")
    sums = rollup_sum(rows.select("scenario", "sector", "ghg", "year", source, "value"), ["scenario", "sector", "ghg", "year", "grain"])
    return _weighed(sums, factors, factor_col).select("Units", "scenario", "sector", "GHG", "year", "grain", "value")


def land_use(df: DataFrame) -> DataFrame:
    """Land-use carbon as CO2 by region."""
    return (
        rollup_sum(df, ["scenario", "region", "year"])
        .withColumn("value", F.col("value") * F.lit(V.CARBON_TO_CO2))
        .withColumn("Units", F.lit("MtCO2"))
        .withColumn("sector", F.lit(V.LAND_USE_SECTOR))
        .withColumn("GHG", F.lit("CO2"))
    )


def co2_equivalent(df: DataFrame, factors: DataFrame, factor_col: str = "AR5all") -> DataFrame:
    """Emissions times the factor of their gas; incomplete rows drop out."""
    factor = factors.select(F.col("ghg").alias("GHG"), F.col(factor_col).alias("_factor"))
    weighed = attach_mapping(df.withColumnRenamed("ghg", "GHG"), factor, "GHG")
    weighed = weighed.withColumn("Units", F.lit("MTCO2e"))
    return complete_cases(weighed).withColumn("value", F.col("value") * F.col("_factor")).drop("_factor")


def all_emissions(resource: DataFrame, sector: DataFrame, land: DataFrame, factors: DataFrame) -> DataFrame:
    """Resource, sector and land-use emissions as one CO2-equivalent table."""
    by_subresource = resource.drop("resource").withColumnRenamed("subresource", "sector")
    return union_by_name(co2_equivalent(union_by_name(by_subresource, sector), factors), land_use(land))


def by_gas(emissions: DataFrame) -> DataFrame:
    """World totals by gas, which all global series are read from."""
    return rollup_sum(emissions, ["scenario", "GHG", "year"])


def grouped_emissions(emissions: DataFrame, region_groups: DataFrame) -> DataFrame:
    mapped = attach_mapping(emissions, region_groups, "region")
    return rollup_sum(mapped, ["scenario", "grouped_region", "GHG", "sector", "year"])


def global_emissions(emissions: DataFrame) -> DataFrame:
    """All gases; like the two below it takes ``all_emissions`` or ``by_gas``."""
    return rollup_sum(emissions, ["scenario", "year"])


def global_co2(emissions: DataFrame) -> DataFrame:
    return rollup_sum(emissions.where(F.col("GHG") == "CO2"), ["scenario", "year"])


def global_non_co2(emissions: DataFrame) -> DataFrame:
    return rollup_sum(emissions.where(F.col("GHG") != "CO2"), ["scenario", "year"])


def sector_totals(resource: DataFrame, sector: DataFrame, factors: DataFrame) -> DataFrame:
    """CO2-equivalents by scenario, sector, GHG and year; a resource stands as its own sector.

    Incomplete rows drop out. Amounts are summed before they are weighed, so that
    the look-up meets the few totals and serves both tables at once.
    """
    keys = ["scenario", "sector", "ghg", "year"]
    parts = [complete_cases(resource.drop("Units")).withColumn("sector", F.col("resource")), complete_cases(sector.drop("Units"))]
    rows = union_by_name(*[p.select(*keys, "value") for p in parts])
    return co2_equivalent(rollup_sum(rows, keys), factors)


def sector_rows(totals: DataFrame, co2_only: bool, land: DataFrame | None = None) -> DataFrame:
    """Scenario, sector, year, value rows out of ``sector_totals``, with land use if given."""
    parts = [totals.where(F.col("GHG") == "CO2") if co2_only else totals]
    if land is not None:
        parts.append(land_use(land))
    return union_by_name(*[p.select("scenario", "sector", "year", "value") for p in parts])


def by_group(rows: DataFrame, groups=None) -> DataFrame:
    """Totals of the eight reporting groups; land use counts with agriculture."""
    if groups is None:
        groups = {**V.EMISSION_GROUPS, V.LAND_USE_GROUP: V.EMISSION_GROUPS[V.LAND_USE_GROUP] + [V.LAND_USE_SECTOR]}
    return rollup_groups(rows, "sector", groups, ["scenario", "year"])


def fossil_co2(totals: DataFrame) -> DataFrame:
    """CO2 of fossil fuels and industry: the CO2 sector rows without land use.

    No published rule exists for this series; this definition is our own.
    """
    return rollup_sum(sector_rows(totals, co2_only=True), ["scenario", "year"])


def gas_system_rows(technology: DataFrame, resource: DataFrame, factors: DataFrame) -> DataFrame:
    """CO2-equivalent rows of gas technologies and gas production."""
    is_gas = F.col("subsector").isin(V.GAS_SUBSECTORS) | (F.col("technology") == V.GAS_TECHNOLOGY)
    gas_resource = (
        resource.where(F.col("resource") == V.GAS_RESOURCE)
        .withColumnsRenamed({"resource": "sector", "subresource": "subsector"})
        .withColumn("technology", F.col("subsector"))
    )
    return co2_equivalent(union_by_name(technology.where(is_gas), gas_resource), factors)


def gas_by_group(rows: DataFrame) -> DataFrame:
    return rollup_groups(rows, "sector", V.EMISSION_GROUPS, ["scenario", "year"])
