"""Scenario differences.

Comparing scenarios is a full outer self-join in most tools. Here the table is
aggregated once by the comparison keys, with one conditional sum per scenario,
and the wanted pairs are read out of that row. That takes one scan and one
shuffle with partial sums, and null keys meet because grouping treats them as
equal. Beyond ``WIDE`` scenarios, columns for each would make a plan that takes minutes
to compile: then a small table names the families of each scenario, and rows are
gathered by keys and family, still with one scan and one shuffle and with a plan of
the same size for any number of scenarios.

Both forms need every (scenario, keys) combination once, as after a roll-up, and
stop the query where one repeats. With ``unique=False`` repeated rows are paired with
each other, as a full outer join pairs them: one join serves all families, and so
takes two scans for any number of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenara.operators.rollup import local_table

WIDE = 16
REPEATED = "a scenario repeats a comparison key: roll up first, or set unique=False"

#: Scenarios, their baseline, and the label of a row that only the baseline has.
Family = tuple[Sequence[str], str, str | None]


def _scenario_row(df: DataFrame, scenarios: Sequence[str], keys: Sequence[str], value: str) -> DataFrame:
    is_s = [F.col("scenario") == s for s in scenarios]
    return (
        df.where(F.col("scenario").isin(list(scenarios)))
        .groupBy(*keys)
        .agg(
            *[F.bool_or(t).alias(f"_has{i}") for i, t in enumerate(is_s)],
            *[_only(t, value).alias(f"_val{i}") for i, t in enumerate(is_s)],
        )
    )


def _only(here: Column, value: str) -> Column:
    """The value of a group's one row that is ``here``."""
    repeated = F.raise_error(F.lit(REPEATED))
    return F.when(F.count_if(here) > 1, repeated).otherwise(F.sum(F.when(here, F.col(value))))


def _roles(df: DataFrame, families: Sequence[Family]) -> DataFrame:
    """One row for each family that a scenario is a member or the baseline of."""
    rows = [(s, i, True, ref, fill) for i, (own, ref, fill) in enumerate(families) for s in own]
    rows += [(ref, i, False, ref, fill) for i, (_, ref, fill) in enumerate(families)]
    names = ["scenario", "_family", "_own", "baseline", "_fill"]
    columns = dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))
    roles = local_table(df.sparkSession, columns)
    return roles.withColumn("_fill", F.col("_fill").cast("string"))


def _difference(own: Column, ref: Column) -> list[Column]:
    """``value_diff``, ``value_ref`` and ``value``, a missing value counting as zero."""
    diff, base = F.coalesce(own, F.lit(0.0)), F.coalesce(ref, F.lit(0.0))
    return [diff.alias("value_diff"), base.alias("value_ref"), (diff - base).alias("value")]


def _joined(df: DataFrame, families: Sequence[Family], keys: Sequence[str], value: str) -> DataFrame:
    """Full outer join of all families' rows with their baselines', null keys meeting."""
    roles = df.join(_roles(df, families), "scenario")
    own = roles.where("_own").select("_family", *keys, "baseline", F.col("scenario").alias("_s"), F.col(value).alias("_v"))
    base = roles.where("NOT _own").select(
        F.col("_family").alias("_f"), *[F.col(k).alias(f"_{k}") for k in keys], F.col("baseline").alias("_ref"), "_fill", F.col(value).alias("_w")
    )
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.col("_family") == F.col("_f"))
    here = F.col("_family").isNotNull()
    return own.join(base, same, "full_outer").select(
        *[F.when(here, F.col(k)).otherwise(F.col(f"_{k}")).alias(k) for k in keys],
        F.coalesce("baseline", "_ref").alias("baseline"),
        F.when(here, F.col("_s")).otherwise(F.col("_fill")).alias("scenario_diff"),
        F.col("_ref").alias("scenario_ref"),
        *_difference(F.col("_v"), F.col("_w")),
    )


def _gathered(df: DataFrame, families: Sequence[Family], keys: Sequence[str], value: str, all_pairs: bool) -> DataFrame:
    """The same for unique rows and any number of scenarios, gathered by keys and family.

    ``all_pairs`` gives every scenario of a family a row where only the baseline has the
    key; otherwise the family gets one, if none of its scenarios has it.
    """
    entry = F.struct(F.col("scenario").alias("s"), F.col(value).alias("v"))
    rows = df.join(_roles(df, families), "scenario").groupBy(*keys, "_family", "baseline", "_fill").agg(
        F.collect_list(F.when(F.col("_own"), entry)).alias("_rows"),
        F.count_if(~F.col("_own")).alias("_refs"),
        F.sum(F.when(~F.col("_own"), F.col(value))).alias("_ref"),
    )
    present = F.transform("_rows", lambda r: r["s"])
    once = (F.size(F.array_distinct(present)) == F.size("_rows")) & (F.col("_refs") <= 1)
    rows = rows.withColumn("_rows", F.when(once, F.col("_rows")).otherwise(F.raise_error(F.lit(REPEATED))))
    alone = lambda s: F.struct(s.alias("s"), F.lit(None).cast(df.schema[value].dataType).alias("v"))
    none = F.slice("_rows", 1, 0)
    if all_pairs:
        members = {"_family": list(range(len(families))), "_members": [list(own) for own, *_ in families]}
        rows = rows.join(local_table(df.sparkSession, members), "_family")
        absent = F.transform(F.array_except("_members", present), alone)
        rest = F.when(F.col("_refs") > 0, absent).otherwise(none)
        rows = rows.withColumn("_rows", F.concat("_rows", rest))
    else:
        rows = rows.withColumn("_rows", F.when(F.size("_rows") > 0, F.col("_rows")).otherwise(F.array(alone(F.col("_fill")))))
    found = rows.select(*keys, "baseline", "_refs", "_ref", F.inline("_rows").alias("_s", "_v"))
    ref = F.when(F.col("_refs") > 0, F.col("baseline"))
    return found.select(
        *keys, "baseline", F.col("_s").alias("scenario_diff"), ref.alias("scenario_ref"), *_difference(F.col("_v"), F.col("_ref"))
    )


def _cell(scenario: Column, has: Column, value: Column, ref: str, ref_has: Column, ref_value: Column) -> Column:
    diff = F.coalesce(value, F.lit(0.0))
    base = F.coalesce(ref_value, F.lit(0.0))
    return F.struct(
        (has | ref_has).alias("present"),
        has.alias("own"),
        F.lit(ref).alias("baseline"),
        scenario.alias("scenario_diff"),
        F.when(ref_has, F.lit(ref)).alias("scenario_ref"),
        diff.alias("value_diff"),
        base.alias("value_ref"),
        (diff - base).alias("value"),
    )


MEASURES = ["scenario_diff", "scenario_ref", "value_diff", "value_ref", "value"]


def compare_pairs(
    df: DataFrame, pairs: Sequence[tuple[str, str]], keys: Sequence[str], value: str = "value", unique: bool = True
) -> DataFrame:
    """Difference of every ``(scenario, baseline)`` pair, labelled by the scenario.

    A key missing on one side of a pair counts as zero there.
    """
    if not unique:
        return _joined(df, [([s], ref, s) for s, ref in pairs], keys, value).drop("baseline")
    scenarios = list(dict.fromkeys(s for pair in pairs for s in pair))
    if len(scenarios) > WIDE:
        by_ref = {ref: [s for s, r in pairs if r == ref] for _, ref in pairs}
        return _gathered(df, [(own, ref, None) for ref, own in by_ref.items()], keys, value, True).drop("baseline")
    at = {s: i for i, s in enumerate(scenarios)}
    rows = _scenario_row(df, scenarios, keys, value)
    cells = [
        _cell(
            F.lit(s),
            F.col(f"_has{at[s]}"),
            F.col(f"_val{at[s]}"),
            ref,
            F.col(f"_has{at[ref]}"),
            F.col(f"_val{at[ref]}"),
        )
        for s, ref in pairs
    ]
    present = F.filter(F.array(*cells), lambda c: c["present"])
    return rows.select(*keys, F.inline(present)).select(*keys, *MEASURES)


def diff_families(
    df: DataFrame,
    families: Sequence[tuple[Sequence[str], str]],
    keys: Sequence[str],
    fill_scenario: str | None = None,
    value: str = "value",
    unique: bool = True,
) -> DataFrame:
    """``diff_from_scenario`` of several ``(scenarios, baseline)`` families at once.

    ``baseline`` names the family a row belongs to.
    """
    named = [(diffs, ref, fill_scenario) for diffs, ref in families]
    if not unique:
        return _joined(df, named, keys, value)
    scenarios = list(dict.fromkeys(s for diffs, ref in families for s in [*diffs, ref]))
    if len(scenarios) > WIDE:
        return _gathered(df, named, keys, value, False)
    has = {s: F.col(f"_has{i}") for i, s in enumerate(scenarios)}
    val = {s: F.col(f"_val{i}") for i, s in enumerate(scenarios)}
    cells = []
    for diffs, ref in families:
        own = F.array(*[_cell(F.lit(s), has[s], val[s], ref, has[ref], val[ref]) for s in diffs])
        found = F.filter(own, lambda c: c["own"])
        only_ref = F.array(
            _cell(
                F.lit(fill_scenario).cast("string"),
                F.lit(False),
                F.lit(None).cast("double"),
                ref,
                has[ref],
                val[ref],
            )
        )
        rest = F.filter(only_ref, lambda c: c["present"])
        family = F.when(F.size(found) > 0, found).otherwise(rest)
        cells.append(family)
    rows = _scenario_row(df, scenarios, keys, value)
    return rows.select(*keys, F.inline(F.concat(*cells))).select(*keys, "baseline", *MEASURES)


def diff_from_scenario(
    df: DataFrame,
    diff_scenarios: Sequence[str],
    ref_scenario: str,
    keys: Sequence[str],
    fill_scenario: str | None = None,
    value: str = "value",
    unique: bool = True,
) -> DataFrame:
    """Difference of scenarios from one baseline over the full outer key set.

    A key only the baseline has gives one row with a null ``scenario_diff``,
    or ``fill_scenario`` if given. A key that the baseline shares with one of
    several scenarios gives no row for the others.
    """
    return diff_families(df, [(diff_scenarios, ref_scenario)], keys, fill_scenario, value, unique).drop("baseline")
