"""One registered query per operator, composite and finished dataset.

Every query reads the whole star-schema tables through ``scenara.sources.star``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenara import schemas
from scenara import vocabulary as V
from scenara.functions import floor_zero, if_else_strict, not_in, sum_exact, sum_strict, to_number
from scenara.operators import (
    as_levels,
    attach_mapping,
    attach_unique,
    complete_cases,
    compare_pairs,
    composite_key,
    convert_units,
    diff_from_scenario,
    drop_members,
    keep_members,
    relabel,
    rollup_groups,
    rollup_sum,
    split_column,
    union_by_name,
    wide_to_long,
    with_net,
)
from scenara.plans import capacity, emissions, energy, ensemble
from scenara.plans.marts import MART_NAMES, Options, Workspace, build_mart
from scenara.session import checkpoint_folder
from scenara.sources import (
    good_rows,
    read_csv_checked,
    read_csv_table,
    read_ensemble,
    read_named_table,
    read_ordered,
    read_refreshed,
    read_region_mapping,
    refresh_scenarios,
    rejected_cells,
    star,
    write_mart,
    write_named_table,
    write_ordered,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded for comparison across engines, negative zero made plain."""
    doubles = {n: F.round(F.col(f"`{n}`"), digits) + F.lit(0.0) for n, t in df.dtypes if t == "double"}
    return df.withColumns(doubles)


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    """The adapter's tables, whose vintage rows are summed to their keys already."""
    return Workspace(star.model_tables(spark, sf_dir), options=Options(unique_vintages=True))


def _gappy(df: DataFrame) -> DataFrame:
    """Every seventh line of an order has an unknown value."""
    return df.withColumn("value", F.when(F.col("line") != 7, F.col("value")))


# --- reshaping -------------------------------------------------------------


@query
def column_shaping(spark, sf_dir):
    """Select, drop, rename, compute, constant label, name given at run time."""
    label = "fuel"
    rows = star.long_rows(spark, sf_dir, "scenario", "region", "kind", "year", "line")
    shaped = (
        rows.select("scenario", "region", "kind", "year", "value", "line")
        .drop("line")
        .withColumnRenamed("kind", "sector")
        .withColumn("value", F.col("value") * 2 - 1)
        .withColumn("Units", F.lit("EJ"))
        .withColumn(label, F.lit("b natural gas"))
    )
    return rollup_sum(shaped, ["scenario", "region", "sector", "year", "Units", "fuel"])


@query
def split_packed(spark, sf_dir):
    rows = star.long_rows(spark, sf_dir, "kind", "name", "order_year")
    packed = F.concat("kind", F.lit(" "), "name", F.lit(",year="), F.col("order_year").cast("string"))
    rows = rows.select(packed.alias("technology"), "value")
    rows = split_column(rows, "technology", ["technology", "vintage"], ",year=")
    rows = split_column(rows, "technology", ["family", None, "item", "extra"], " ")
    return rollup_sum(rows, ["family", "item", "extra", "vintage"])


@query
def wide_to_long_years(spark, sf_dir):
    return wide_to_long(star.ensemble(spark, sf_dir), list(star.ENSEMBLE_YEARS.values()))


@query
def ordered_levels(spark, sf_dir):
    rows = star.long_rows(spark, sf_dir, "kind", "year")
    levels = as_levels(rows, "kind", ["STANDARD", "LARGE", "MEDIUM", "SMALL"])
    return rollup_sum(levels, ["kind", "kind_ord", "year"])


@query
def scenario_labels(spark, sf_dir):
    rows = star.long_rows(spark, sf_dir, "scenario", "year")
    return rollup_sum(relabel(rows, "scenario", V.SCENARIO_LABELS, "label"), ["label", "year"])


@query
def composite_label(spark, sf_dir):
    rows = star.long_rows(spark, sf_dir, "scenario", "year")
    return rollup_sum(rows.select(composite_key("scenario", "year").alias("scenario_year"), "value"), ["scenario_year"])


@query
def stacked_by_name(spark, sf_dir):
    produced = star.resource_production(spark, sf_dir)
    used = star.final_energy(spark, sf_dir)
    both = union_by_name(produced, used)
    return rollup_sum(both, ["scenario", "Units", "resource", "input", "year"])


@query
def unit_conversion(spark, sf_dir):
    rows = rollup_sum(star.traded_gas(spark, sf_dir), ["scenario", "sector", "year", "Units"])
    return rounded(convert_units(rows, V.EJ_MTPA, "MTPA"))


# --- predicates ------------------------------------------------------------


@query
def complete_rows(spark, sf_dir):
    rows = attach_mapping(star.sector_emissions(spark, sf_dir), star.gas_factors(spark, sf_dir), "ghg")
    return rollup_sum(complete_cases(rows), ["scenario", "ghg", "AR5all"])


@query
def not_in_keeps_unknown(spark, sf_dir):
    rows = star.long_rows(spark, sf_dir, "scenario", "region")
    mapped = attach_mapping(rows, star.region_groups(spark, sf_dir), "region")
    return rollup_sum(mapped.where(not_in("grouped_region", ["USA", "China"])), ["scenario", "grouped_region"])


def _members(spark, sf_dir):
    """A member table of scenarios and words with repeats and missing members: some words of the first year."""
    rows = star.long_rows(spark, sf_dir, "scenario", "word", "ship_year")
    early = rows.where((F.col("ship_year") == 1995) & (F.col("word") > "c")).select("scenario", "word")
    blank = lambda c, v: F.when(F.col(c) != v, F.col(c)).alias(c)
    return early.select(blank("scenario", "Transition_LLS"), blank("word", "hot"))


def _unnamed(spark, sf_dir):
    rows = star.long_rows(spark, sf_dir, "scenario", "word", "year")
    return rows.withColumn("word", F.when(F.col("word") != "red", F.col("word")))


@query
def member_table_semi(spark, sf_dir):
    kept = keep_members(_unnamed(spark, sf_dir), _members(spark, sf_dir), ["scenario", "word"])
    return rollup_sum(kept, ["scenario", "word", "year"])


@query
def member_table_semi_nulls(spark, sf_dir):
    kept = keep_members(_unnamed(spark, sf_dir), _members(spark, sf_dir), "word", nulls=True)
    return rollup_sum(kept, ["scenario", "word", "year"])


@query
def member_table_anti(spark, sf_dir):
    kept = drop_members(_unnamed(spark, sf_dir), _members(spark, sf_dir), ["scenario", "word"])
    return rollup_sum(kept, ["scenario", "word", "year"])


@query
def member_table_anti_nulls(spark, sf_dir):
    kept = drop_members(_unnamed(spark, sf_dir), _members(spark, sf_dir).where("word < 'n' OR word IS NULL"), "word", nulls=True)
    return rollup_sum(kept, ["scenario", "word", "year"])


@query
def member_table_store(spark, sf_dir):
    """A store read by a table of scenarios, which prunes its folders at run time."""
    base = _scratch(spark)
    write_named_table(star.electricity(spark, sf_dir), base, "electricity")
    members = star.long_rows(spark, sf_dir, "scenario", "priority").where("scenario LIKE '%LLS'").select("scenario")
    kept = keep_members(read_named_table(spark, base, "electricity"), members.distinct(), "scenario")
    return rollup_sum(kept, ["scenario", "technology", "year"])


@query
def snapshot_rows(spark, sf_dir):
    """Equality, membership, range, column against column, and an OR of ANDs."""
    rows = star.long_rows(spark, sf_dir, "scenario", "kind", "vintage", "year")
    end = (F.col("year") == 2050) | ((F.col("year") == 2015) & (F.col("scenario") == "Reference"))
    kept = (
        rows.where(end)
        .where(F.col("scenario").isin("Reference", "Transition"))
        .where(F.col("kind") != "PROMO")
        .where((F.col("vintage") == F.col("year")) | F.col("vintage").between(2020, 2040))
    )
    return rollup_sum(kept, ["scenario", "kind", "vintage", "year"])


@query
def filter_after_sum(spark, sf_dir):
    totals = rollup_sum(star.final_energy(spark, sf_dir), ["scenario", "region", "input"])
    return totals.where(F.col("value") > 1000).where(F.col("input").isin("widget", "bolt", "gear"))


@query
def strict_condition(spark, sf_dir):
    rows = _gappy(star.long_rows(spark, sf_dir, "scenario", "year", "line"))
    flag = if_else_strict(F.col("value") > 25, F.lit("high"), F.lit("low"))
    return rows.groupBy("scenario", "year", flag.alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query
def floor_at_zero(spark, sf_dir):
    rows = _gappy(star.long_rows(spark, sf_dir, "scenario", "year", "line"))
    rows = rows.withColumn("excess", floor_zero(F.col("value") - 25))
    return rows.groupBy("scenario", "year").agg(
        F.sum("excess").alias("excess"), F.count(F.when(F.col("excess").isNull(), 1)).alias("unknown")
    )


@query
def tolerant_number(spark, sf_dir):
    rows = star.long_rows(spark, sf_dir, "word", "order_year", "line")
    text = F.when(F.col("line") % 2 == 0, F.col("order_year").cast("string")).otherwise(F.col("word"))
    return rollup_sum(rows.select(to_number(text, "int").alias("number"), "value"), ["number"])


# --- sums, look-ups, totals ------------------------------------------------


@query
def strict_sum(spark, sf_dir):
    rows = _gappy(star.long_rows(spark, sf_dir, "scenario", "region", "name", "year", "line"))
    return rollup_sum(rows, ["scenario", "region", "name", "year"])


@query
def strict_running_sum(spark, sf_dir):
    rows = _gappy(star.long_rows(spark, sf_dir, "scenario", "region", "name", "year", "line"))
    totals = rollup_sum(rows, ["scenario", "region", "name", "year"])
    running = capacity.cumsum_strict("value", ["scenario", "region", "name"])
    return totals.withColumn("cum_value", running)


@query
def rollup_region(spark, sf_dir):
    rows = star.long_rows(spark, sf_dir, "scenario", "region", "year")
    mapped = attach_mapping(rows, star.region_groups(spark, sf_dir), "region")
    return rollup_sum(mapped, ["scenario", "grouped_region", "year"])


@query
def lookup_checked(spark, sf_dir):
    """The same with a look-up that stops the query where it repeats a key."""
    rows = star.long_rows(spark, sf_dir, "scenario", "region", "year")
    mapped = attach_unique(rows, star.region_groups(spark, sf_dir), "region")
    return rollup_sum(mapped, ["scenario", "grouped_region", "year"])


@query
def two_level_rollup(spark, sf_dir):
    by_region = rollup_sum(star.final_energy(spark, sf_dir), ["scenario", "region", "input", "year"])
    return rollup_sum(by_region.where(F.col("value") >= 20), ["scenario", "year"])


@query
def group_set_totals(spark, sf_dir):
    rows = star.long_rows(spark, sf_dir, "scenario", "kind", "year").withColumnRenamed("kind", "sector")
    sets = {"Big": ["LARGE", "STANDARD"], "Small": ["SMALL", "MEDIUM"], "Cheap": ["ECONOMY"]}
    return rollup_groups(rows, "sector", sets, ["scenario", "year"])


@query
def distinct_inputs(spark, sf_dir):
    return star.final_energy(spark, sf_dir).select("input").distinct()


@query
def net_alongside_detail(spark, sf_dir):
    rows = star.long_rows(spark, sf_dir, "scenario", "region", "kind", "year")
    mapped = attach_mapping(rows, star.region_groups(spark, sf_dir), "region")
    detail = rollup_sum(mapped, ["scenario", "grouped_region", "kind", "year"])
    return with_net(detail, ["scenario", "grouped_region", "year"])


# --- scenario differences --------------------------------------------------


def _by_region_and_word(spark, sf_dir):
    rows = star.long_rows(spark, sf_dir, "scenario", "region", "word", "year")
    return rollup_sum(rows, ["scenario", "region", "word", "year"])


@query
def diff_one_scenario(spark, sf_dir):
    rows = _by_region_and_word(spark, sf_dir)
    return diff_from_scenario(rows, ["Reference_LLS"], "Reference", ["region", "word", "year"])


@query
def diff_one_scenario_filled(spark, sf_dir):
    rows = _by_region_and_word(spark, sf_dir)
    keys = ["region", "word", "year"]
    return diff_from_scenario(rows, ["Reference_LLS"], "Reference", keys, fill_scenario="Reference_LLS")


@query
def diff_many_scenarios(spark, sf_dir):
    rows = _by_region_and_word(spark, sf_dir)
    diffs = ["Reference_LLS", "Reference_LT_sshc", "Transition"]
    return diff_from_scenario(rows, diffs, "Reference", ["region", "word", "year"])


@query
def diff_unknown_keys(spark, sf_dir):
    """Unmapped regions compare with each other."""
    rows = star.long_rows(spark, sf_dir, "scenario", "region", "name", "vintage", "year")
    mapped = attach_mapping(rows, star.region_groups(spark, sf_dir), "region")
    totals = rollup_sum(mapped, ["scenario", "grouped_region", "name", "vintage", "year"])
    keys = ["grouped_region", "name", "vintage", "year"]
    return diff_from_scenario(totals, ["Transition_LLS", "Transition_LT_sshc"], "Transition", keys)


@query
def diff_families_with_net(spark, sf_dir):
    """Both baselines at once over thinly filled keys, with the net of each."""
    fields = ("scenario", "region", "name", "priority", "year")
    mapped = attach_mapping(star.long_rows(spark, sf_dir, *fields), star.region_groups(spark, sf_dir), "region")
    mapped = mapped.withColumn("item", composite_key("region", "name", "priority"))
    totals = rollup_sum(mapped, ["scenario", "grouped_region", "item", "year"])
    return energy.limited_trade_difference(totals, "item", short=False)


@query
def diff_repeated_keys(spark, sf_dir):
    """Rows of a finer grain than the keys, some unknown, paired with each other."""
    rows = _gappy(star.long_rows(spark, sf_dir, "scenario", "region", "word", "kind", "year", "line"))
    finer = rollup_sum(rows, ["scenario", "region", "word", "kind", "year"])
    diffs = ["Reference_LLS", "Transition"]
    return diff_from_scenario(finer, diffs, "Reference", ["region", "word", "year"], unique=False)


def _model_years(spark, sf_dir):
    """Each scenario and ship year as a scenario of its own, some values unknown."""
    rows = _gappy(star.long_rows(spark, sf_dir, "scenario", "ship_year", "region", "word", "line"))
    own = rows.withColumn("scenario", composite_key("scenario", "ship_year"))
    return rollup_sum(own, ["scenario", "region", "word"])


PANEL = [f"{s}.{y}" for s in star.SCENARIO_CODES for y in range(1995, 2002)]


@query
def diff_wide_panel(spark, sf_dir):
    """Forty-one scenarios against one, in one scan and one shuffle."""
    return diff_from_scenario(_model_years(spark, sf_dir), PANEL[1:], PANEL[0], ["region", "word"])


@query
def diff_wide_pairs(spark, sf_dir):
    """Every scenario against the next one."""
    pairs = list(zip(PANEL, PANEL[1:], strict=False))
    return compare_pairs(_model_years(spark, sf_dir), pairs, ["region", "word"])


@query
def exact_sum(spark, sf_dir):
    """Sums of sevenths, unrounded: their bits do not depend on the order of the lines."""
    rows = _gappy(star.long_rows(spark, sf_dir, "scenario", "region", "year", "line"))
    return rows.withColumn("value", F.col("value") / 7).groupBy("scenario", "region", "year").agg(sum_exact("value").alias("value"))


# --- capacity by vintage ---------------------------------------------------


@query
def vintage_additions(spark, sf_dir):
    added = capacity.additions(workspace(spark, sf_dir)["export_vintages"])
    return rounded(rollup_sum(added, [*capacity.EXPORT_KEYS, "year"], ["additions"]))


@query
def vintage_retirements(spark, sf_dir):
    rows = workspace(spark, sf_dir)["export_vintages"]
    cols = [*capacity.EXPORT_KEYS, "vintage", "year", "value", "retirements"]
    return rounded(capacity.retirements(rows, capacity.EXPORT_KEYS, unique=True).select(*cols))


@query
def natural_retirements(spark, sf_dir):
    """S-curve, expected stock and natural retirements of the base vintage."""
    rows = workspace(spark, sf_dir)["export_vintages"]
    cols = [*capacity.EXPORT_KEYS, "year", "s_curve_adj", "installed", "expected", "natural_retire"]
    return rounded(capacity.natural_retirements(rows, capacity.EXPORT_KEYS, unique=True).select(*cols))


@query
def natural_retirements_import(spark, sf_dir):
    """The same by technology, with a short-lived curve."""
    rows = workspace(spark, sf_dir)["import_vintages"]
    curve = {"half_life": 12, "steepness": 0.4, "lifetime": 25}
    aged = capacity.natural_retirements(rows, capacity.IMPORT_KEYS, **curve, unique=True)
    cols = [*capacity.IMPORT_KEYS, "year", "s_curve_adj", "installed", "expected", "natural_retire"]
    return rounded(aged.select(*cols))


@query
def net_add_ret_keep_all(spark, sf_dir):
    """Netting that also keeps series with retirements only."""
    rows = workspace(spark, sf_dir)["export_vintages"]
    return rounded(capacity.net_add_ret(rows, capacity.EXPORT_KEYS, keep_ret_only=True, unique=True))


@query
def retirements_repeated_rows(spark, sf_dir):
    """Netting over vintage rows of a finer grain than the series."""
    fields = ("scenario", "region", "imported", "kind", "vintage", "year")
    rows = star.model_rows(spark, sf_dir, *fields, where=F.col("vintage") <= F.col("year"))
    rows = rows.withColumnRenamed("imported", "technology").withColumn("Units", F.lit("EJ"))
    rows = convert_units(rows, V.EJ_MTPA, "MTPA")
    return rounded(capacity.net_add_ret(rows, capacity.IMPORT_KEYS, years=star.MODEL_YEARS))


@query
def retirements_any_years(spark, sf_dir):
    """The same summed by year first, for tables whose years are not known beforehand."""
    fields = ("scenario", "region", "imported", "noun", "vintage", "year")
    rows = star.model_rows(spark, sf_dir, *fields, where=F.col("vintage") <= F.col("year"))
    rows = rows.withColumnRenamed("imported", "technology").withColumn("Units", F.lit("EJ"))
    return rounded(capacity.net_add_ret(convert_units(rows, V.EJ_MTPA, "MTPA"), capacity.IMPORT_KEYS))


@query
def annual_cost(spark, sf_dir):
    """Cost in billions."""
    return rounded(workspace(spark, sf_dir)["annual_cost"].withColumn("cost", F.col("cost") / 1e9))


# --- unknown values in composites -------------------------------------------


@query
def net_alongside_detail_gaps(spark, sf_dir):
    rows = _gappy(star.long_rows(spark, sf_dir, "scenario", "region", "kind", "year", "line"))
    mapped = attach_mapping(rows, star.region_groups(spark, sf_dir), "region")
    return with_net(rollup_sum(mapped, ["scenario", "region", "kind", "year"]), ["scenario", "region", "year"])


@query
def diff_many_scenarios_gaps(spark, sf_dir):
    rows = _gappy(star.long_rows(spark, sf_dir, "scenario", "region", "word", "year", "line"))
    totals = rollup_sum(rows, ["scenario", "region", "word", "year"])
    return diff_from_scenario(totals, ["Reference_LLS", "Transition"], "Reference", ["region", "word", "year"])


@query
def group_set_totals_gaps(spark, sf_dir):
    rows = _gappy(star.long_rows(spark, sf_dir, "scenario", "region", "word", "year", "line"))
    sets = {"Warm": ["hot", "red"], "Cool": ["cold", "blue"], "Both": ["hot", "cold"]}
    return rollup_groups(rows.withColumnRenamed("word", "sector"), "sector", sets, ["scenario", "region", "year"])


@query
def co2_equivalent_gaps(spark, sf_dir):
    """Rows without an amount drop out."""
    rows = _gappy(star.long_rows(spark, sf_dir, "scenario", "region", "emitter", "gas", "year", "line"))
    rows = rows.drop("line").withColumnsRenamed({"emitter": "sector", "gas": "ghg"})
    weighed = emissions.co2_equivalent(rows, star.gas_factors(spark, sf_dir))
    return rounded(rollup_sum(weighed, ["scenario", "region", "GHG", "sector", "year"]))


@query
def land_use_gaps(spark, sf_dir):
    return rounded(emissions.land_use(_gappy(star.long_rows(spark, sf_dir, "scenario", "region", "year", "line"))))


def _gappy_changes(spark, sf_dir):
    fields = ("scenario", "region", "word", "vintage", "year")
    rows = _gappy(star.long_rows(spark, sf_dir, *fields, "line")).where(F.col("vintage") <= F.col("year"))
    rows = rollup_sum(rows, fields).withColumnRenamed("word", "sector").withColumn("Units", F.lit("EJ"))
    return capacity.net_add_ret(rows, capacity.EXPORT_KEYS, unique=True)


@query
def net_add_ret_gaps(spark, sf_dir):
    return rounded(_gappy_changes(spark, sf_dir))


@query
def cumulative_add_ret_gaps(spark, sf_dir):
    return rounded(capacity.cumulative(_gappy_changes(spark, sf_dir), capacity.EXPORT_KEYS))


# --- stores ----------------------------------------------------------------


def _scratch(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark).rstrip('/')}/scenara-{uuid.uuid4().hex}"


@query
def named_store_scan(spark, sf_dir):
    """Write two named tables to a store, read one back."""
    base = _scratch(spark)
    for name in ["electricity", "final_energy"]:
        table = star.BUILDERS[name](spark, sf_dir)
        write_named_table(table, base, name)
    return rollup_sum(read_named_table(spark, base, "electricity"), ["scenario", "technology", "year"])


@query
def refreshed_scenario(spark, sf_dir):
    """A stored table read after some of its scenarios were replaced."""
    base = _scratch(spark)
    table = star.electricity(spark, sf_dir)
    refresh_scenarios(table, base, "electricity")
    newer = table.where("scenario LIKE '%LLS'").withColumn("value", F.col("value") * 2)
    refresh_scenarios(newer, base, "electricity")
    return rollup_sum(read_refreshed(spark, base, "electricity"), ["scenario", "technology", "year"])


@query
def csv_store_scan(spark, sf_dir):
    """Write a literature series as CSV, read it with its declared schema."""
    base = _scratch(spark)
    series = star.literature_region(spark, sf_dir, "F").select(*schemas.LITERATURE_REGION.names)
    write_mart(series, base, "csv")
    return read_csv_table(spark, base, schemas.LITERATURE_REGION)


@query
def store_by_title(spark, sf_dir):
    """Write a model table to a store, read it by its published title."""
    base = _scratch(spark)
    write_named_table(star.final_energy(spark, sf_dir), base, "final_energy")
    table = read_named_table(spark, base, V.TABLE_TITLES["final_energy"])
    return rollup_sum(table, ["scenario", "input", "year"])


@query
def mapping_csv_scan(spark, sf_dir):
    """Write a look-up as CSV with a further column in front, read it by its header."""
    base = _scratch(spark)
    groups = star.region_groups(spark, sf_dir)
    write_mart(groups.select(F.length("region").alias("id"), "grouped_region", "region"), base, "csv")
    return read_region_mapping(spark, base)


@query
def ensemble_csv_scan(spark, sf_dir):
    """Write the wide ensemble as CSV with its columns reversed, read it by its header."""
    base = _scratch(spark)
    wide = star.ensemble(spark, sf_dir)
    write_mart(wide.select(*reversed(wide.columns)), base, "csv")
    return read_ensemble(spark, base)


@query
def csv_rejects(spark, sf_dir):
    """Bad cells of a CSV with their column and text, read beside the good rows."""
    base = _scratch(spark)
    rows = star.long_rows(spark, sf_dir, "scenario", "word", "year", "line")
    year = F.when(F.col("line") == 6, F.concat("word", F.lit("?"))).otherwise(F.col("year").cast("string"))
    value = F.when((F.col("line") == 7) | (F.col("word") == "old"), F.concat(F.col("value"), F.lit("kg"))).otherwise(F.col("value").cast("string"))
    write_mart(rows.select("scenario", year.alias("year"), value.alias("value")), base, "csv")
    checked = read_csv_checked(spark, base, schemas.LITERATURE_CO2)
    bad = rejected_cells(checked).where(F.col("file").startswith("part-"))
    totals = rollup_sum(good_rows(checked), ["scenario", "year"]).select(
        F.lit("good").alias("kind"), "scenario", F.col("year").cast("string").alias("text"), "value"
    )
    counts = bad.groupBy(F.col("column").alias("kind"), "text").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return totals.unionByName(counts.withColumn("scenario", F.lit(None).cast("string")))


ORDERED = {"scenario": V.SCENARIO_BAR_LEVELS, "kind": ["STANDARD", "LARGE", "MEDIUM", "SMALL"], "year": None}


@query
def ordered_dataset(spark, sf_dir):
    """A dataset written in level order over several files, each row read back with its place."""
    base = _scratch(spark)
    rows = star.long_rows(spark, sf_dir, "scenario", "kind", "year", "region")
    write_ordered(rollup_sum(rows, ["year", "region", "kind", "scenario"]), base, ORDERED, 5)
    return read_ordered(spark, base)


# --- derived tables and finished datasets ----------------------------------


def _derived(name: str, digits: int | None, spark: SparkSession, sf_dir: str) -> DataFrame:
    df = workspace(spark, sf_dir)[name]
    return df if digits is None else rounded(df, digits)


def _rolled(name: str, keys: list[str], digits: int | None, spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rollup_sum(workspace(spark, sf_dir)[name], keys)
    return df if digits is None else rounded(df, digits)


def _mart(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(build_mart(name, workspace(spark, sf_dir)))


# query name -> (derived table, digits to round to or None for exact sums)
DERIVED_QUERIES = {
    "traded_total_by_scenario": ("global_traded", None),
    "domestic_total": ("global_domestic", None),
    "pipeline_total": ("global_pipeline", None),
    "lng_total": ("global_lng", None),
    "resource_total": ("global_resources", None),
    "net_trade": ("net_trade", None),
    "gross_trade_signed": ("trade_with_net", None),
    "grouped_trade": ("grouped_trade", None),
    "grouped_production": ("grouped_production", None),
    "grouped_consumption": ("grouped_consumption", None),
    "production_difference": ("production_difference", None),
    "consumption_difference": ("consumption_difference", None),
    "export_capacity": ("export_capacity", 4),
    "global_capacity": ("global_capacity", 4),
    "cumulative_capacity": ("cumulative_capacity", 4),
    "import_capacity": ("import_capacity", 4),
    "net_add_ret": ("export_changes", 4),
    "net_add_ret_import": ("import_changes", 4),
    "cumulative_add_ret": ("export_cumulative", 4),
    "cumulative_add_ret_import": ("import_cumulative", 4),
    "cumulative_global": ("export_cumulative_global", 4),
    "cumulative_grouped": ("export_cumulative_grouped", 4),
    "primary_fuel_collapse": ("primary_by_region", None),
    "primary_fuel_collapse_ccs": ("primary_ccs_by_region", None),
    "primary_global": ("primary_global", None),
    "primary_ccs_global": ("primary_ccs_global", None),
    "primary_ccs_grouped": ("primary_ccs_grouped", None),
    "primary_limited_trade": ("primary_limited_trade", None),
    "primary_transition": ("primary_transition", None),
    "tech_to_sector": ("electricity_global", None),
    "electricity_grouped": ("electricity_grouped", None),
    "electricity_transition": ("electricity_transition", None),
    "final_by_input": ("final_global", None),
    "final_grouped": ("final_grouped", None),
    "final_transition": ("final_transition", None),
    "rollup_multi_measure": ("literature_traded", None),
    "literature_regions": ("production_for_literature", None),
    "literature_gas_use": ("gas_use_for_literature", None),
    "grouped_emissions": ("grouped_emissions", 4),
    "global_emissions": ("global_emissions", 4),
    "co2_total": ("global_co2", 4),
    "non_co2_total": ("global_non_co2", 4),
    "co2_by_sector": ("co2_by_group", 4),
    "co2e_by_sector": ("co2e_by_group", 4),
    "gas_co2e_by_sector": ("gas_by_group", 4),
    "fossil_co2": ("fossil_co2", 4),
    "warming_category": ("warming", None),
    "ensemble_gas": ("ensemble_gas", None),
    "ensemble_co2": ("ensemble_co2", None),
    "ensemble_primary": ("ensemble_primary", None),
    "ensemble_gas_power": ("ensemble_gas_power", None),
}
ROLLED_QUERIES = {
    "production_flows": ("gross_production", ["scenario", "region", "trade", "sector", "year"], None),
    "consumption_flows": ("gross_consumption", ["scenario", "region", "trade", "sector", "year"], None),
    "co2_equivalent": ("all_emissions", ["scenario", "region", "GHG", "sector", "Units", "year"], 4),
}

for _name, (_table, _digits) in DERIVED_QUERIES.items():
    QUERIES[_name] = partial(_derived, _table, _digits)
for _name, (_table, _keys, _digits) in ROLLED_QUERIES.items():
    QUERIES[_name] = partial(_rolled, _table, _keys, _digits)
for _name in MART_NAMES:
    QUERIES[f"mart_{_name.lower()}"] = partial(_mart, _name)


@query
def land_use(spark, sf_dir):
    return rounded(emissions.land_use(star.land_use_emissions(spark, sf_dir)))


@query
def ensemble_long(spark, sf_dir):
    return ensemble.ensemble_long(star.ensemble(spark, sf_dir))


@query
def strict_multi_measure(spark, sf_dir):
    rows = _gappy(star.long_rows(spark, sf_dir, "scenario", "region", "name", "line"))
    rows = rows.withColumn("lines", F.col("line").cast("double"))
    return rows.groupBy("scenario", "region", "name").agg(
        sum_strict("value").alias("value"), sum_strict("lines").alias("lines")
    )
