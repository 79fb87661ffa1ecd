"""Resources, primary energy, electricity and final energy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenara import vocabulary as V
from scenara.operators import attach_mapping, attach_total, diff_families, rollup_sum, union_by_name, with_net

TRADED_GAS = {V.NATURAL_GAS_FUEL: V.TRADED_SECTORS}
TRADED_GAS_CCS = {V.NATURAL_GAS_FUEL: V.TRADED_SECTORS, V.NATURAL_GAS_CCS_FUEL: V.TRADED_CCS_SECTORS}


def global_resources(production: DataFrame) -> DataFrame:
    return rollup_sum(production, ["scenario", "resource", "year"])


def collapse_fuels(
    df: DataFrame,
    collapse: Mapping[str, Sequence[str]],
    keep: Sequence[str],
    units: str = "EJ",
    collapsed_units: str | None = None,
) -> DataFrame:
    """Merge listed fuels into one, drop fuels outside ``keep``.

    Only rows in ``units`` count, but the merged fuels are taken in any units
    unless ``collapsed_units`` is given.
    """
    fuel = F.col("fuel")
    merged = F.lit(False)
    label = F.lit(None).cast("string")
    for target, members in collapse.items():
        label = F.when(fuel.isin(list(members)), F.lit(target)).otherwise(label)
        merged = merged | fuel.isin(list(members))
    in_units = F.col("Units") == units
    taken = F.lit(True) if collapsed_units is None else F.col("Units") == collapsed_units
    kept = df.where((merged & taken) | (fuel.isin(list(keep)) & ~merged & in_units))
    return kept.withColumn("fuel", F.coalesce(label, fuel)).where(F.col("fuel").isin(list(keep)))


def collapse_gas(primary: DataFrame, collapsed_units: str | None = None) -> DataFrame:
    """Primary energy with traded gas as one fuel."""
    return collapse_fuels(primary, TRADED_GAS, V.PRIMARY_FUELS, collapsed_units=collapsed_units)


def collapse_gas_ccs(primary_ccs: DataFrame, collapsed_units: str | None = None) -> DataFrame:
    """Primary energy with traded gas as one fuel, capture kept apart."""
    return collapse_fuels(primary_ccs, TRADED_GAS_CCS, V.PRIMARY_CCS_FUELS, collapsed_units=collapsed_units)


def by_region(collapsed: DataFrame) -> DataFrame:
    """Primary energy by region and fuel."""
    return rollup_sum(collapsed, ["scenario", "region", "fuel", "year"])


def difference_with_net(grouped: DataFrame, category: str, families, short: bool = True) -> DataFrame:
    """Scenario differences by region group and category, with the group's net.

    A category with many values takes ``short=False``: its net is summed and
    joined back, so that no region group has to fit into one task.
    """
    diff = diff_families(grouped, families, ["grouped_region", category, "year"])
    net = with_net if short else attach_total
    return net(diff, ["baseline", "scenario_diff", "grouped_region", "year"]).drop("baseline")


LIMITED_TRADE_FAMILIES = [
    (["Reference_LLS", "Reference_LT_sshc"], "Reference"),
    (["Transition_LLS", "Transition_LT_sshc"], "Transition"),
]


def limited_trade_difference(grouped: DataFrame, category: str = "fuel", short: bool = True) -> DataFrame:
    """Limited-trade scenarios against the baseline of their own transition."""
    return difference_with_net(grouped, category, LIMITED_TRADE_FAMILIES, short)


def transition_difference(grouped: DataFrame, category: str) -> DataFrame:
    return difference_with_net(grouped, category, [(["Transition"], "Reference")])


def electricity_sectors(generation: DataFrame, tech_sectors: DataFrame) -> DataFrame:
    """Generation with the sector of its technology."""
    return attach_mapping(generation, tech_sectors, "technology")


def grouped_by_category(df: DataFrame, category: str, region_groups: DataFrame) -> DataFrame:
    mapped = attach_mapping(df, region_groups, "region")
    return rollup_sum(mapped, ["scenario", "grouped_region", category, "year"])


def global_by_category(df: DataFrame, category: str) -> DataFrame:
    return rollup_sum(df, ["scenario", category, "year"])


def traded_literature(lng: DataFrame, pipeline: DataFrame) -> DataFrame:
    """Literature trade: LNG and pipeline together, in every unit."""
    return rollup_sum(union_by_name(lng, pipeline), ["scenario", "year"], ["Bcm", "Tcf", "EJ"])


def production_for_literature(production: DataFrame, literature_groups: DataFrame) -> DataFrame:
    """Resource production in the literature's regions."""
    mapped = attach_mapping(production, literature_groups, "region")
    return rollup_sum(mapped, ["Units", "scenario", "grouped_region", "resource", "year"])


def gas_use_for_literature(collapsed: DataFrame, literature_groups: DataFrame) -> DataFrame:
    """Gas use, capture included, in the literature's regions."""
    gas = collapsed.where(F.col("fuel").isin(V.NATURAL_GAS_FUEL, V.NATURAL_GAS_CCS_FUEL))
    return rollup_sum(attach_mapping(gas, literature_groups, "region"), ["scenario", "grouped_region", "year"])
