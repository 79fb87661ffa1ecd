"""Production, trade and consumption of gas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenara import vocabulary as V
from scenara.functions import if_else_strict
from scenara.operators import (
    as_levels,
    attach_mapping,
    attach_total,
    compare_pairs,
    rollup_sum,
    split_column,
    union_by_name,
    with_net,
)

LIMITED_TRADE_PAIRS = [
    ("Reference_LLS", "Reference"),
    ("Reference_LT_sshc", "Reference"),
    ("Transition_LLS", "Transition"),
    ("Transition_LT_sshc", "Transition"),
]
FLOW_KEYS = ["scenario", "grouped_region", "trade", "sector", "year"]


def traded_flows(traded: DataFrame) -> DataFrame:
    """Traded gas of the trade sectors, by the region that trades it."""
    kept = traded.where(F.col("sector").isin(V.TRADED_SECTORS) & (F.col("subsector") != V.BALANCING_SUBSECTOR))
    return split_column(kept.drop("region"), "subsector", ["region", None], " traded ")


def traded_vintages(traded: DataFrame) -> DataFrame:
    """``traded_flows`` of a table whose technology also packs the vintage."""
    return split_column(traded_flows(traded), "technology", [None, "vintage"], ",year=")


def regional_vintages(regional: DataFrame) -> DataFrame:
    """Regional supply with technology and vintage unpacked."""
    cols = ["scenario", "region", "technology", "vintage", "year", "value", "Units"]
    return split_column(regional, "technology", ["technology", "vintage"], ",year=").select(*cols)


def imports_and_domestic(regional: DataFrame) -> DataFrame:
    """Imports and domestic supply in energy units; domestic is its own sector."""
    rows = regional.where(F.col("Units") == "EJ").select("scenario", "region", "technology", "year", "value")
    rows = split_column(rows, "technology", ["trade", "sector"], " ")
    return rows.withColumn("sector", if_else_strict(F.col("trade") == "domestic", F.lit("domestic"), F.col("sector")))


def exports(flows: DataFrame) -> DataFrame:
    """Exports out of ``traded_flows``."""
    rows = split_column(flows, "sector", ["trade", "sector"], " ")
    trade = if_else_strict(F.col("trade") == "traded", F.lit("exported"), F.col("trade"))
    return rows.withColumn("trade", trade).drop("technology", "output", "Units")


def gross_trade(regional: DataFrame, flows: DataFrame) -> DataFrame:
    """Exports, and imports with a negative sign."""
    imported = imports_and_domestic(regional).where(F.col("trade") == "imported")
    return union_by_name(imported.withColumn("value", F.col("value") * -1), exports(flows))


def net_trade(gross: DataFrame) -> DataFrame:
    return rollup_sum(gross, ["scenario", "region", "year"])


def trade_with_net(gross: DataFrame) -> DataFrame:
    """Each flow beside its region's net trade."""
    return attach_total(gross, ["scenario", "region", "year"])


def gross_production(regional: DataFrame, flows: DataFrame) -> DataFrame:
    """Domestic supply and exports."""
    domestic = imports_and_domestic(regional).where(F.col("trade") == "domestic")
    return union_by_name(domestic, exports(flows))


def gross_consumption(regional: DataFrame) -> DataFrame:
    """Domestic supply and imports with a negative sign."""
    return imports_and_domestic(regional).withColumn("value", F.col("value") * -1)


def flow_levels(df: DataFrame, sector_levels=tuple(V.TRADE_SECTOR_LEVELS), ordinal: bool = False) -> DataFrame:
    """Ordered region groups and sectors.

    The default sector levels know no domestic sector, so domestic rows carry a
    null one; pass ``DOMESTIC_SECTOR_LEVELS`` to keep it.
    """
    df = as_levels(df, "grouped_region", V.FLIPPED_GROUPED_REGION_LEVELS, ordinal)
    return as_levels(df, "sector", list(sector_levels), ordinal)


def grouped_flows(flows: DataFrame, region_groups: DataFrame, sector_levels=tuple(V.TRADE_SECTOR_LEVELS)) -> DataFrame:
    """Flows by region group."""
    return flow_levels(rollup_sum(attach_mapping(flows, region_groups, "region"), FLOW_KEYS), sector_levels)


def grouped_trade(gross: DataFrame, region_groups: DataFrame, sector_levels=tuple(V.TRADE_SECTOR_LEVELS)) -> DataFrame:
    """Gross trade by region group beside the group's net trade."""
    rolled = rollup_sum(attach_mapping(gross, region_groups, "region"), FLOW_KEYS)
    return flow_levels(with_net(rolled, ["scenario", "grouped_region", "year"]), sector_levels)


def flow_differences(grouped: DataFrame, pairs=tuple(LIMITED_TRADE_PAIRS), unique: bool = True) -> DataFrame:
    """Limited-trade scenarios against their baselines, with the net by region group."""
    diff = compare_pairs(grouped, list(pairs), ["grouped_region", "trade", "sector", "year"], unique=unique)
    return with_net(diff, ["scenario_diff", "grouped_region", "year"])


def global_traded(flows: DataFrame) -> DataFrame:
    return rollup_sum(flows, ["scenario", "year"])


def global_domestic(regional: DataFrame) -> DataFrame:
    kept = regional.where((F.col("subsector") == V.DOMESTIC_GAS) & (F.col("Units") == "EJ"))
    return rollup_sum(kept, ["scenario", "year"])


def global_pipeline(flows: DataFrame) -> DataFrame:
    return rollup_sum(flows.where(F.col("sector").isin(V.PIPELINE_SECTORS)), ["scenario", "year"])


def global_lng(flows: DataFrame) -> DataFrame:
    return rollup_sum(flows.where(F.col("sector") == V.LNG_SECTOR), ["scenario", "sector", "year"])
