"""SQL equivalents of the registered queries.

The SQL spells the steps out one by one - filters united again, full joins,
totals joined back, expected stock joined to observed stock - where the Spark
plans take one pass, so that the two check each other.
"""

from __future__ import annotations

import re

from scenara import vocabulary as V
from scenara.sources import star


def lit(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def case(col: str, codes: dict, other: str | None = None) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in codes.items())
    return f"CASE {col} {whens} ELSE {'NULL' if other is None else lit([other])} END"


def strict(expr: str, out: str = "value") -> str:
    return f'CASE WHEN count({expr}) = count(*) THEN sum({expr}) END AS "{out}"'


def strict_over(expr: str, window: str, out: str) -> str:
    over = f"OVER ({window})"
    return f'CASE WHEN count({expr}) {over} = count(*) {over} THEN sum({expr}) {over} END AS "{out}"'


def rollup(source: str, keys: str, values=("value",)) -> str:
    measures = ", ".join(strict(v, v) for v in values)
    return f"SELECT {keys}, {measures} FROM {source} GROUP BY {keys}"


def same(keys, a: str, b: str) -> str:
    return " AND ".join(f'{a}."{k}" IS NOT DISTINCT FROM {b}."{k}"' for k in keys)


def net(source: str, keys) -> str:
    """Totals by ``keys`` joined back to the detail."""
    names = ", ".join(keys)
    return (
        f"SELECT d.*, n.value_net FROM {source} d LEFT JOIN "
        f"(SELECT {names}, {strict('value', 'value_net')} FROM {source} GROUP BY {names}) n ON {same(keys, 'd', 'n')}"
    )


def diff(source: str, diffs, ref: str, keys, fill: str | None = None) -> str:
    """Full join of scenarios with their baseline."""
    both = ", ".join(f'coalesce(d."{k}", r."{k}") AS "{k}"' for k in keys)
    label = f"'{fill}'" if fill else "d.scenario"
    return (
        f"SELECT {both}, {label} AS scenario_diff, r.scenario AS scenario_ref, "
        "coalesce(d.value, 0) AS value_diff, coalesce(r.value, 0) AS value_ref, "
        "coalesce(d.value, 0) - coalesce(r.value, 0) AS value "
        f"FROM (SELECT * FROM {source} WHERE scenario IN ({lit(diffs)})) d "
        f"FULL JOIN (SELECT * FROM {source} WHERE scenario = '{ref}') r ON {same(keys, 'd', 'r')}"
    )


def rounded(sql: str, cols, digits: int = 4) -> str:
    swaps = ", ".join(f'round("{c}", {digits}) + 0.0 AS "{c}"' for c in cols)
    return f"SELECT * REPLACE ({swaps}) FROM ({sql})"


def model_year(col: str) -> str:
    return f"CAST(CASE WHEN year({col}) = 2001 THEN 2050 ELSE 2015 + (year({col}) - 1995) * 5 END AS INTEGER)"


FLIPPED = lit(V.FLIPPED_GROUPED_REGION_LEVELS)
CTES: dict[str, str] = {}

# --- model tables out of the star schema -----------------------------------

CTES["base"] = f"""
SELECT {case('l_returnflag || l_linestatus', {a + b: s for s, (a, b) in star.SCENARIO_CODES.items()})} AS scenario, n_name AS region,
  c_mktsegment AS segment, p_type AS kind, p_name AS name, split_part(p_name, ' ', 1) AS word,
  split_part(p_name, ' ', 2) AS noun, o_orderpriority AS priority,
  CAST(year(o_orderdate) AS INTEGER) AS order_year, CAST(year(l_shipdate) AS INTEGER) AS ship_year,
  {model_year('o_orderdate')} AS vintage, {model_year('l_shipdate')} AS year,
  {case("split_part(p_name, ' ', 1)", star.CARRIERS)} AS carrier,
  {case("split_part(p_name, ' ', 1)", star.EMITTERS, 'unlisted')} AS emitter,
  {case('p_type', star.RESOURCES, 'crude oil')} AS resource,
  {case('o_orderpriority', star.GASES, 'unlisted')} AS gas,
  l_linenumber AS line, l_quantity AS value
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey"""
CTES["gappy"] = "SELECT * REPLACE (CASE WHEN line = 7 THEN NULL ELSE value END AS value) FROM base"
IMPORTED = "coalesce('imported ' || carrier, 'domestic natural gas')"
TRADED = "coalesce('traded ' || carrier, 'unsold gas')"
SUBSECTOR = (
    "CASE WHEN kind = 'PROMO' THEN 'statistical differences' "
    f"ELSE region || ' ' || {TRADED} END"
)
CTES["regional_gas"] = f"""
SELECT CASE WHEN kind = 'ECONOMY' THEN 'Mt' ELSE 'EJ' END AS "Units", scenario, region,
  {IMPORTED} AS subsector, {IMPORTED} AS technology, year, sum(value) AS value FROM base GROUP BY ALL"""
CTES["traded_gas"] = f"""
SELECT 'EJ' AS "Units", scenario, {TRADED} AS sector, {SUBSECTOR} AS subsector, {TRADED} AS technology,
  'gas' AS output, year, sum(value) AS value FROM base GROUP BY ALL"""
CTES["traded_gas_vintage"] = f"""
SELECT 'EJ' AS "Units", scenario, {TRADED} AS sector, {SUBSECTOR} AS subsector,
  {TRADED} || ',year=' || CAST(vintage AS VARCHAR) AS technology, 'gas' AS output, year, sum(value) AS value
FROM base WHERE vintage <= year GROUP BY ALL"""
CTES["regional_gas_vintage"] = f"""
SELECT 'EJ' AS "Units", scenario, region, {IMPORTED} || ',year=' || CAST(vintage AS VARCHAR) AS technology, year,
  sum(value) AS value FROM base WHERE vintage <= year GROUP BY ALL"""
for _name, _large, _standard in [
    ("primary_energy", "'d biomass'", "c coal"),
    ("primary_energy_ccs", f"{TRADED} || ' CCS'", "c coal CCS"),
]:
    CTES[_name] = f"""
SELECT CASE WHEN priority = '5-LOW' THEN 'Mtoe' ELSE 'EJ' END AS "Units", scenario, region,
  CASE kind WHEN 'SMALL' THEN {TRADED} WHEN 'LARGE' THEN {_large} WHEN 'STANDARD' THEN '{_standard}'
    WHEN 'MEDIUM' THEN 'b natural gas' WHEN 'ECONOMY' THEN 'a oil' ELSE 'z other' END AS fuel, year, value FROM base"""
CTES["electricity"] = f"""
SELECT scenario, region, {case('kind', star.TECHNOLOGIES, 'unlisted')} AS technology, year, value FROM base"""
CTES["final_energy"] = "SELECT scenario, region, noun AS input, year, value FROM base"
CTES["resource_production"] = """SELECT 'EJ' AS "Units", scenario, region, resource, year, value FROM base"""
CTES["sector_emissions"] = "SELECT scenario, region, emitter AS sector, gas AS ghg, year, value FROM base"
CTES["resource_emissions"] = """
SELECT scenario, region, resource, resource || ' ' || lower(kind) AS subresource, gas AS ghg, year, value FROM base"""
CTES["technology_emissions"] = f"""
SELECT scenario, region, emitter AS sector, {case('kind', star.EMITTING_SUBSECTORS, 'coal')} AS subsector,
  CASE WHEN noun = 'widget' THEN 'NG' ELSE noun END AS technology, gas AS ghg, year, value FROM base"""
CTES["ensemble"] = (
    f"""
SELECT segment AS "Model", region AS "Scenario", 'World' AS "Region",
  {case('kind', star.VARIABLES, 'Population')} AS "Variable", 'EJ/yr' AS "Unit", """
    + ", ".join(
        f"""CASE WHEN kind = 'ECONOMY' THEN (sum(value) FILTER (ship_year = {y}) % 40) / 8
    ELSE sum(value) FILTER (ship_year = {y}) END AS "{m}\""""
        for y, m in star.ENSEMBLE_YEARS.items()
    )
    + " FROM base GROUP BY segment, region, kind"
)


def _groups(labels, size: int) -> str:
    return f"""
SELECT n_name AS region, ([{lit(labels)}])[n_nationkey % {size} + 1] AS grouped_region FROM nation
WHERE n_nationkey % {size} < {len(labels)}"""


CTES["region_groups"] = _groups(V.GROUPED_REGION_LEVELS, 15)
CTES["literature_region_groups"] = _groups(star.LITERATURE_GROUPS, 12)
CTES["tech_sectors"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{t}', '{s}')" for t, s in zip(star.TECH_SECTORS["technology"], star.TECH_SECTORS["sector"])
) + ") t(technology, sector)"
CTES["gas_factors"] = "SELECT ghg, CAST(f AS DOUBLE) AS factor FROM (VALUES " + ", ".join(
    f"('{g}', {f})" for g, f in zip(star.FACTORS["ghg"], star.FACTORS["AR5all"])
) + ") t(ghg, f)"
AMOUNTS = (
    'CAST(count(*) AS DOUBLE) AS "Bcm", CAST(count(*) AS DOUBLE) * 2 AS "Tcf", CAST(count(*) AS DOUBLE) * 4 AS "EJ"'
)
LITERATURE = case("o_orderpriority", star.LITERATURE_SCENARIOS)
for _name, _status in [("literature_lng", "F"), ("literature_pipeline", "O"), ("literature_gas", "P")]:
    CTES[_name] = f"""
SELECT {LITERATURE} AS scenario, {model_year('o_orderdate')} AS year, {AMOUNTS} FROM orders
WHERE o_orderstatus = '{_status}' GROUP BY 1, 2"""
for _name, _status in [("literature_production", "F"), ("literature_consumption", "O")]:
    CTES[_name] = f"""
SELECT {LITERATURE} AS scenario, grouped_region, {model_year('o_orderdate')} AS year, {AMOUNTS}
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN literature_region_groups g ON g.region = n_name WHERE o_orderstatus = '{_status}' GROUP BY 1, 2, 3"""
CTES["literature_co2"] = 'SELECT scenario, year, "EJ" AS value FROM literature_gas'

# --- flows -----------------------------------------------------------------

SOLD = f"sector IN ({lit(V.TRADED_SECTORS)}) AND subsector <> 'statistical differences'"
FLOW_REGION = "split_part(subsector, ' traded ', 1) AS region"
CTES["traded_flows"] = f"""
SELECT "Units", scenario, {FLOW_REGION}, sector, technology, output, year, value FROM traded_gas WHERE {SOLD}"""
CTES["imports_and_domestic"] = """
SELECT scenario, region, split_part(technology, ' ', 1) AS trade,
  CASE WHEN split_part(technology, ' ', 1) = 'domestic' THEN 'domestic' ELSE split_part(technology, ' ', 2) END AS sector,
  year, value FROM regional_gas WHERE "Units" = 'EJ'"""
CTES["exports"] = """
SELECT scenario, region, CASE WHEN split_part(sector, ' ', 1) = 'traded' THEN 'exported'
  ELSE split_part(sector, ' ', 1) END AS trade, split_part(sector, ' ', 2) AS sector, year, value FROM traded_flows"""
FLOW = "scenario, region, trade, sector, year"
CTES["gross_trade"] = f"""
SELECT {FLOW}, value * -1 AS value FROM imports_and_domestic WHERE trade = 'imported'
UNION ALL SELECT {FLOW}, value FROM exports"""
CTES["gross_production"] = f"""
SELECT {FLOW}, value FROM imports_and_domestic WHERE trade = 'domestic' UNION ALL SELECT {FLOW}, value FROM exports"""
CTES["gross_consumption"] = f"SELECT {FLOW}, value * -1 AS value FROM imports_and_domestic"
GROUPED = "scenario, grouped_region, trade, sector, year"
LEVELLED = (
    f"CASE WHEN grouped_region IN ({FLIPPED}) THEN grouped_region END AS grouped_region, "
    f"CASE WHEN sector IN ({lit(V.TRADE_SECTOR_LEVELS)}) THEN sector END AS sector"
)
for _name in ["trade", "production", "consumption"]:
    CTES[f"rolled_{_name}"] = rollup(f"gross_{_name} LEFT JOIN region_groups USING (region)", GROUPED)
    CTES[f"grouped_{_name}"] = f"SELECT * REPLACE ({LEVELLED}) FROM rolled_{_name}"
CTES["rolled_trade_net"] = net("rolled_trade", ["scenario", "grouped_region", "year"])
CTES["grouped_trade"] = f"SELECT * REPLACE ({LEVELLED}) FROM rolled_trade_net"
FLOW_KEYS = ["grouped_region", "trade", "sector", "year"]
for _name in ["production", "consumption"]:
    for _ref in ["Reference", "Transition"]:
        CTES[f"{_name}_diff_{_ref.lower()}"] = " UNION ALL ".join(
            diff(f"grouped_{_name}", [f"{_ref}_{s}"], _ref, FLOW_KEYS, f"{_ref}_{s}") for s in ["LLS", "LT_sshc"]
        )
        CTES[f"{_name}_net_{_ref.lower()}"] = net(
            f"{_name}_diff_{_ref.lower()}", ["scenario_diff", "grouped_region", "year"]
        )
    CTES[f"{_name}_difference"] = (
        f"SELECT * FROM {_name}_net_reference UNION ALL SELECT * FROM {_name}_net_transition"
    )
CTES["traded_by_region"] = rollup("traded_flows", "scenario, region, year")
CTES["global_traded"] = rollup("traded_by_region", "scenario, year")
CTES["domestic_rows"] = f"""SELECT * FROM regional_gas WHERE subsector = '{V.DOMESTIC_GAS}' AND "Units" = 'EJ'"""
CTES["global_domestic"] = rollup("domestic_rows", "scenario, year")
CTES["pipeline_rows"] = f"SELECT * FROM traded_flows WHERE sector IN ({lit(V.PIPELINE_SECTORS)})"
CTES["pipeline_by_sector"] = rollup("pipeline_rows", "scenario, sector, year")
CTES["global_pipeline"] = rollup("pipeline_by_sector", "scenario, year")
CTES["lng_rows"] = f"SELECT * FROM traded_flows WHERE sector = '{V.LNG_SECTOR}'"
CTES["global_lng"] = rollup("lng_rows", "scenario, sector, year")

# --- capacity --------------------------------------------------------------

CTES["export_vintages"] = f"""
SELECT 'MTPA' AS "Units", scenario, {FLOW_REGION}, sector,
  CAST(split_part(technology, ',year=', 2) AS INTEGER) AS vintage, output, year, value * {V.EJ_MTPA!r} AS value
FROM traded_gas_vintage WHERE {SOLD}"""
CTES["import_vintages"] = f"""
SELECT 'MTPA' AS "Units", scenario, region, split_part(technology, ',year=', 1) AS technology,
  CAST(split_part(technology, ',year=', 2) AS INTEGER) AS vintage, year, value * {V.EJ_MTPA!r} AS value
FROM regional_gas_vintage"""
CTES["export_capacity"] = rollup("export_vintages", '"Units", scenario, sector, region, output, year')
CTES["global_capacity"] = rollup("export_capacity", "scenario, year")
CTES["import_capacity"] = rollup("import_vintages", "scenario, region, technology, year")
RUNNING = "ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
CTES["cumulative_capacity"] = (
    "SELECT *, "
    + strict_over("value", f'PARTITION BY "Units", scenario, sector, region, output {RUNNING}', "cum_value")
    + " FROM export_capacity"
)


def _ageing(side: str, category: str, half_life=23, steepness=0.2, lifetime=45, tag: str = "") -> None:
    """Additions, retirements, S-curve and netting of one side, step by step."""
    keys = f'scenario, region, {category}, "Units"'
    by_year = f"PARTITION BY {keys}, vintage ORDER BY year"
    names = ["scenario", "region", category, "Units"]
    CTES[f"{side}_curve{tag}"] = f"""
SELECT {keys}, vintage, year, CASE WHEN year - vintage >= {lifetime} THEN 0.0 WHEN year > vintage
  THEN 1 / (1 + exp({steepness} * ((year - vintage) - {half_life}))) ELSE 1.0 END AS s_curve_adj
FROM {side}_vintages WHERE vintage = 2015"""
    CTES[f"{side}_installed{tag}"] = f"SELECT {keys}, vintage, value AS installed FROM {side}_vintages WHERE vintage = year"
    CTES[f"{side}_expected{tag}"] = f"""
SELECT c.*, i.installed, i.installed * c.s_curve_adj AS expected FROM {side}_curve{tag} c
LEFT JOIN {side}_installed{tag} i ON {same([*names, 'vintage'], 'c', 'i')}"""
    CTES[f"{side}_expected_lag{tag}"] = (
        f"SELECT *, lag(expected) OVER ({by_year}) AS before FROM {side}_expected{tag}"
    )
    CTES[f"{side}_natural{tag}"] = f"""
SELECT {keys}, vintage, year, s_curve_adj, installed, expected,
  CASE WHEN year > vintage AND before > expected THEN before - expected
       WHEN NOT (year > vintage AND before > expected) THEN 0.0 END AS natural_retire FROM {side}_expected_lag{tag}"""
    if tag:
        return
    CTES[f"{side}_added"] = f"""
SELECT {keys}, year, CASE WHEN vintage = year THEN value ELSE 0 END AS additions FROM {side}_vintages WHERE vintage > 2015"""
    CTES[f"{side}_total_added"] = rollup(f"{side}_added", f"{keys}, year", ("additions",))
    CTES[f"{side}_change"] = f"""
SELECT {keys}, vintage, year, value, coalesce(lag(value) OVER ({by_year}), 0) - value AS change
FROM {side}_vintages WHERE vintage >= 2015"""
    CTES[f"{side}_retired"] = f"""
SELECT {keys}, vintage, year, value, CASE WHEN change < 0 THEN 0 ELSE change END AS retirements FROM {side}_change"""
    CTES[f"{side}_adjusted"] = f"""
SELECT r.*, r.retirements - coalesce(n.natural_retire, 0) AS adjusted FROM {side}_retired r
LEFT JOIN {side}_natural n ON {same([*names, 'vintage', 'year'], 'r', 'n')}"""
    CTES[f"{side}_early"] = f"""
SELECT {keys}, year, CASE WHEN adjusted < 0 THEN 0 ELSE adjusted END AS retirements FROM {side}_adjusted"""
    CTES[f"{side}_total_retired"] = rollup(f"{side}_early", f"{keys}, year", ("retirements",))
    netted = """CASE WHEN additions > retirements THEN additions - retirements
       WHEN NOT additions > retirements THEN 0.0 END AS add_adj,
  CASE WHEN retirements > additions THEN retirements - additions
       WHEN NOT retirements > additions THEN 0.0 END AS ret_adj"""
    CTES[f"{side}_paired"] = f"""
SELECT a.*, r.retirements FROM {side}_total_added a
LEFT JOIN {side}_total_retired r ON {same([*names, 'year'], 'a', 'r')}"""
    CTES[f"{side}_changes"] = f"SELECT *, {netted} FROM {side}_paired"
    CTES[f"{side}_paired_all"] = f"""
SELECT r.* EXCLUDE (retirements), coalesce(a.additions, 0) AS additions, r.retirements FROM {side}_total_retired r
LEFT JOIN {side}_total_added a ON {same([*names, 'year'], 'a', 'r')}"""
    CTES[f"{side}_changes_all"] = f"SELECT *, {netted} FROM {side}_paired_all"
    window = f"PARTITION BY {keys} {RUNNING}"
    CTES[f"{side}_cumulative"] = (
        f"SELECT *, {strict_over('add_adj', window, 'cum_additions')}, "
        f"{strict_over('ret_adj', window, 'cum_retirements')} FROM {side}_changes"
    )
    both = ("cum_additions", "cum_retirements")
    CTES[f"{side}_cumulative_global"] = rollup(f"{side}_cumulative", f"scenario, {category}, year", both)
    CTES[f"{side}_cumulative_grouped"] = rollup(
        f"{side}_cumulative LEFT JOIN region_groups USING (region)", f"scenario, grouped_region, {category}, year", both
    )


_ageing("export", "sector")
_ageing("import", "technology")
_ageing("import", "technology", 12, 0.4, 25, "_short")
CTES["global_additions"] = (
    f"SELECT scenario, sector, year, {strict('add_adj', 'additions')} FROM export_changes GROUP BY scenario, sector, year"
)
CTES["annual_cost"] = f"""
SELECT *, additions * 2.02 * 1e9 * (1 / {V.EJ_MTPA!r}) * (1 / 0.13) * (1 / 5.0) AS cost FROM global_additions
WHERE sector = '{V.LNG_SECTOR}'
UNION ALL SELECT *, additions * 0.57 * 1e9 * (1 / {V.EJ_MTPA!r}) * (1 / 0.13) * (1 / 5.0) AS cost FROM global_additions
WHERE sector <> '{V.LNG_SECTOR}'"""

CTES["cost_in_billions"] = "SELECT * REPLACE (cost / 1e9 AS cost) FROM annual_cost"
CTES["gappy_vintages"] = f"""
SELECT 'EJ' AS "Units", scenario, region, word AS sector, vintage, year, {strict('value')} FROM gappy
WHERE vintage <= year GROUP BY scenario, region, word, vintage, year"""
_ageing("gappy", "sector")

# --- energy ----------------------------------------------------------------

CTES["global_resources"] = rollup("resource_production", "scenario, resource, year")
for _table, _out, _collapse, _keep in [
    ("primary_energy", "primary", {V.NATURAL_GAS_FUEL: V.TRADED_SECTORS}, V.PRIMARY_FUELS),
    (
        "primary_energy_ccs",
        "primary_ccs",
        {V.NATURAL_GAS_FUEL: V.TRADED_SECTORS, V.NATURAL_GAS_CCS_FUEL: V.TRADED_CCS_SECTORS},
        V.PRIMARY_CCS_FUELS,
    ),
]:
    _merged = [m for members in _collapse.values() for m in members]
    _parts = [
        f"SELECT scenario, region, '{fuel}' AS fuel, year, {strict('value')} FROM {_table} "
        f"WHERE fuel IN ({lit(members)}) GROUP BY scenario, region, year"
        for fuel, members in _collapse.items()
    ]
    CTES[f"{_out}_rows"] = " UNION ALL ".join(
        [
            f"SELECT scenario, region, fuel, year, value FROM {_table} "
            f"""WHERE coalesce(fuel NOT IN ({lit(_merged)}), true) AND "Units" = 'EJ'""",
            *_parts,
        ]
    )
    CTES[f"{_out}_all"] = rollup(f"{_out}_rows", "scenario, region, fuel, year")
    CTES[f"{_out}_by_region"] = f"SELECT * FROM {_out}_all WHERE fuel IN ({lit(_keep)})"
    CTES[f"{_out}_global"] = rollup(f"{_out}_by_region", "scenario, fuel, year")
CTES["primary_ccs_grouped"] = rollup(
    "primary_ccs_by_region LEFT JOIN region_groups USING (region)", "scenario, grouped_region, fuel, year"
)
CTES["electricity_sectors"] = "SELECT e.*, t.sector FROM electricity e LEFT JOIN tech_sectors t USING (technology)"
CTES["electricity_global"] = rollup("electricity_sectors", "scenario, sector, year")
CTES["electricity_grouped"] = rollup(
    "electricity_sectors LEFT JOIN region_groups USING (region)", "scenario, grouped_region, sector, year"
)
CTES["final_global"] = rollup("final_energy", "scenario, input, year")
CTES["final_grouped"] = rollup(
    "final_energy LEFT JOIN region_groups USING (region)", "scenario, grouped_region, input, year"
)
NET_KEYS = ["scenario_diff", "grouped_region", "year"]
for _out, _table, _category in [
    ("primary", "primary_ccs_grouped", "fuel"),
    ("electricity", "electricity_grouped", "sector"),
    ("final", "final_grouped", "input"),
]:
    CTES[f"{_out}_transition_diff"] = diff(_table, ["Transition"], "Reference", ["grouped_region", _category, "year"])
    CTES[f"{_out}_transition"] = net(f"{_out}_transition_diff", NET_KEYS)
for _ref in ["Reference", "Transition"]:
    CTES[f"primary_lt_diff_{_ref.lower()}"] = diff(
        "primary_ccs_grouped", [f"{_ref}_LLS", f"{_ref}_LT_sshc"], _ref, ["grouped_region", "fuel", "year"]
    )
    CTES[f"primary_lt_{_ref.lower()}"] = net(f"primary_lt_diff_{_ref.lower()}", NET_KEYS)
CTES["primary_limited_trade"] = (
    "SELECT * FROM primary_lt_reference UNION ALL SELECT * FROM primary_lt_transition"
)
CTES["literature_traded"] = rollup(
    "(SELECT * FROM literature_lng UNION ALL SELECT * FROM literature_pipeline)",
    "scenario, year",
    ("Bcm", "Tcf", "EJ"),
)
CTES["production_for_literature"] = rollup(
    "resource_production LEFT JOIN literature_region_groups USING (region)",
    '"Units", scenario, grouped_region, resource, year',
)
CTES["gas_use_rows"] = f"""SELECT * FROM primary_ccs_by_region
WHERE fuel IN ({lit([V.NATURAL_GAS_FUEL, V.NATURAL_GAS_CCS_FUEL])})"""
CTES["gas_use_for_literature"] = rollup(
    "gas_use_rows LEFT JOIN literature_region_groups USING (region)", "scenario, grouped_region, year"
)

# --- emissions -------------------------------------------------------------

CTES["land_use"] = f"""
SELECT scenario, region, year, value * 44 / 12 AS value, 'MtCO2' AS "Units", 'LUC' AS sector, 'CO2' AS "GHG"
FROM (SELECT scenario, region, year, {strict('value')} FROM base GROUP BY scenario, region, year)"""
for _name, _source in [
    ("resource_co2e", "resource_emissions"),
    ("sector_co2e", "sector_emissions"),
    ("technology_co2e", "technology_emissions"),
]:
    CTES[_name] = f"""
SELECT e.* EXCLUDE (ghg, value), e.ghg AS "GHG", e.value * f.factor AS value FROM {_source} e
LEFT JOIN gas_factors f ON e.ghg = f.ghg WHERE e.value * f.factor IS NOT NULL"""
CTES["all_emissions"] = """
SELECT scenario, region, subresource AS sector, "GHG", year, value, 'MTCO2e' AS "Units" FROM resource_co2e
UNION ALL SELECT scenario, region, sector, "GHG", year, value, 'MTCO2e' FROM sector_co2e
UNION ALL SELECT scenario, region, sector, "GHG", year, value, "Units" FROM land_use"""
CTES["grouped_emissions"] = rollup(
    "all_emissions LEFT JOIN region_groups USING (region)", 'scenario, grouped_region, "GHG", sector, year'
)
CTES["global_emissions"] = rollup("grouped_emissions", "scenario, year")
CTES["co2_rows"] = """SELECT * FROM all_emissions WHERE "GHG" = 'CO2'"""
CTES["non_co2_rows"] = """SELECT * FROM all_emissions WHERE "GHG" <> 'CO2'"""
CTES["global_co2"] = rollup("co2_rows", "scenario, year")
CTES["global_non_co2"] = rollup("non_co2_rows", "scenario, year")


def group_totals(source: str, land: bool) -> str:
    parts = []
    for group, members in V.EMISSION_GROUPS.items():
        extra = ["LUC"] if land and group == V.LAND_USE_GROUP else []
        parts.append(
            f"SELECT scenario, year, {strict('value')}, '{group}' AS sector FROM {source} "
            f"WHERE sector IN ({lit(members + extra)}) GROUP BY scenario, year"
        )
    return " UNION ALL ".join(parts)


for _tag, _gas in [("co2", """WHERE "GHG" = 'CO2'"""), ("co2e", "")]:
    CTES[f"{_tag}_fossil_rows"] = f"""
SELECT scenario, resource AS sector, year, {strict('value')} FROM resource_co2e {_gas} GROUP BY scenario, resource, year
UNION ALL SELECT scenario, sector, year, {strict('value')} FROM sector_co2e {_gas} GROUP BY scenario, sector, year"""
    CTES[f"{_tag}_sector_rows"] = f"""
SELECT * FROM {_tag}_fossil_rows UNION ALL SELECT scenario, sector, year, value FROM land_use"""
    CTES[f"{_tag}_by_group"] = group_totals(f"{_tag}_sector_rows", land=True)
CTES["fossil_co2"] = rollup("co2_fossil_rows", "scenario, year")
CTES["gas_rows"] = f"""
SELECT scenario, sector, year, value FROM technology_co2e
WHERE subsector IN ({lit(V.GAS_SUBSECTORS)}) OR technology = 'NG'
UNION ALL SELECT scenario, resource AS sector, year, value FROM resource_co2e WHERE resource = 'natural gas'"""
CTES["gas_by_sector"] = rollup("gas_rows", "scenario, sector, year")
CTES["gas_by_group"] = group_totals("gas_by_sector", land=False)

# --- ensemble --------------------------------------------------------------

YEARS = list(star.ENSEMBLE_YEARS.values())
CTES["ensemble_long"] = " UNION ALL ".join(
    f'SELECT "Model", "Scenario", "Region", "Variable", "Unit", CAST({y} AS INTEGER) AS year, "{y}" AS value FROM ensemble'
    for y in YEARS
)
CTES["warming"] = f"""
SELECT "Model", "Scenario", CASE WHEN value < 1.5 THEN 'A_below 1.5C' WHEN value >= 1.5 AND value < 2 THEN 'B_1.5-2C'
  WHEN value >= 2 AND value < 3 THEN 'C_2-3C' WHEN value >= 3 AND value < 4 THEN 'D_3-4C'
  WHEN value >= 4 THEN 'E_above 4C' END AS temp_category
FROM ensemble_long WHERE "Variable" = '{V.WARMING_VARIABLE}' AND year = 2100"""


def extract(variable: str) -> str:
    return f"""
SELECT e.*, w.temp_category FROM ensemble_long e LEFT JOIN warming w ON e."Model" = w."Model" AND e."Scenario" = w."Scenario"
WHERE e."Variable" = '{variable}' AND e.value IS NOT NULL AND w.temp_category IS NOT NULL"""


def overlay(variable: str) -> str:
    return f"""
SELECT "Model", "Scenario" AS "Model_Scenario", "Region", "Variable", "Unit", year, value, temp_category AS scenario,
  'AR6' AS category FROM ({extract(variable)})"""


CTES["ensemble_gas"] = overlay(V.PRIMARY_GAS_VARIABLE)
CTES["ensemble_co2"] = overlay(V.FOSSIL_CO2_VARIABLE)
CTES["ensemble_primary"] = extract(V.PRIMARY_ENERGY_VARIABLE)
CTES["ensemble_gas_power"] = extract(V.GAS_POWER_VARIABLE)


def _needs(sql: str) -> set[str]:
    return {w for w in re.findall(r"\b[a-z_0-9]+\b", sql) if w in CTES}


def with_ctes(sql: str) -> str:
    """``sql`` preceded by the tables it reads, in the order they depend on."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for other in sorted(_needs(CTES[name]) - {name}):
                add(other)
            order.append(name)

    for name in sorted(_needs(sql)):
        add(name)
    if not order:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in order) + f"\n{sql}"


# --- queries ---------------------------------------------------------------

SQL: dict[str, str] = {}
SQL["column_shaping"] = f"""
SELECT scenario, region, sector, year, 'EJ' AS "Units", 'b natural gas' AS fuel, {strict('value')}
FROM (SELECT scenario, region, kind AS sector, year, value * 2 - 1 AS value FROM base) GROUP BY ALL"""
SQL["split_packed"] = f"""
SELECT kind AS family, noun AS item, CAST(NULL AS VARCHAR) AS extra, CAST(order_year AS VARCHAR) AS vintage,
  {strict('value')} FROM base GROUP BY kind, noun, order_year"""
SQL["wide_to_long_years"] = "SELECT * FROM ensemble_long"
SQL["ordered_levels"] = f"""
SELECT CASE WHEN kind IN ('STANDARD', 'LARGE', 'MEDIUM', 'SMALL') THEN kind END AS kind,
  CAST(CASE kind WHEN 'STANDARD' THEN 0 WHEN 'LARGE' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'SMALL' THEN 3 END AS INTEGER)
    AS kind_ord, year, {strict('value')} FROM base GROUP BY 1, 2, 3"""
SQL["scenario_labels"] = f"""
SELECT CASE scenario WHEN 'Reference_LT_sshc' THEN 'Reference_LT' WHEN 'Transition_LT_sshc' THEN 'Transition_LT'
  ELSE scenario END AS label, year, {strict('value')} FROM base GROUP BY 1, 2"""
SQL["composite_label"] = f"""
SELECT scenario || '.' || CAST(year AS VARCHAR) AS scenario_year, {strict('value')} FROM base GROUP BY 1"""
SQL["stacked_by_name"] = rollup(
    "(SELECT * FROM resource_production UNION ALL BY NAME SELECT * FROM final_energy)",
    'scenario, "Units", resource, input, year',
)
SQL["unit_conversion"] = rounded(
    f"""SELECT scenario, sector, year, 'MTPA' AS "Units", sum(value) * {V.EJ_MTPA!r} AS value FROM traded_gas
GROUP BY scenario, sector, year""",
    ["value"],
)
SQL["complete_rows"] = f"""
SELECT scenario, e.ghg, f.factor AS "AR5all", {strict('value')} FROM sector_emissions e JOIN gas_factors f ON e.ghg = f.ghg
GROUP BY ALL"""
SQL["not_in_keeps_unknown"] = f"""
SELECT scenario, grouped_region, {strict('value')} FROM base LEFT JOIN region_groups USING (region)
WHERE grouped_region IS NULL OR grouped_region NOT IN ('USA', 'China') GROUP BY scenario, grouped_region"""
CTES["members"] = """SELECT nullif(scenario, 'Transition_LLS') AS scenario, nullif(word, 'hot') AS word FROM base WHERE ship_year = 1995 AND word > 'c'"""
CTES["unnamed"] = "SELECT scenario, nullif(word, 'red') AS word, year, value FROM base"
SQL["member_table_semi"] = rollup(
    "(SELECT u.* FROM unnamed u WHERE EXISTS (SELECT 1 FROM members m WHERE m.scenario = u.scenario AND m.word = u.word))",
    "scenario, word, year",
)
SQL["member_table_semi_nulls"] = rollup(
    "(SELECT u.* FROM unnamed u WHERE EXISTS (SELECT 1 FROM members m WHERE m.word IS NOT DISTINCT FROM u.word))",
    "scenario, word, year",
)
SQL["member_table_anti"] = rollup(
    "(SELECT u.* FROM unnamed u WHERE NOT EXISTS (SELECT 1 FROM members m WHERE m.scenario = u.scenario AND m.word = u.word))",
    "scenario, word, year",
)
SQL["member_table_anti_nulls"] = rollup(
    "(SELECT u.* FROM unnamed u WHERE NOT EXISTS (SELECT 1 FROM members m "
    "WHERE (m.word < 'n' OR m.word IS NULL) AND m.word IS NOT DISTINCT FROM u.word))",
    "scenario, word, year",
)
SQL["member_table_store"] = rollup(
    "(SELECT * FROM electricity WHERE scenario IN (SELECT scenario FROM base WHERE scenario LIKE '%LLS'))",
    "scenario, technology, year",
)
SQL["snapshot_rows"] = f"""
SELECT scenario, kind, vintage, year, {strict('value')} FROM base
WHERE (year = 2050 OR (year = 2015 AND scenario = 'Reference')) AND scenario IN ('Reference', 'Transition')
  AND kind <> 'PROMO' AND (vintage = year OR vintage BETWEEN 2020 AND 2040) GROUP BY scenario, kind, vintage, year"""
SQL["filter_after_sum"] = f"""
SELECT * FROM ({rollup('final_energy', 'scenario, region, input')})
WHERE value > 1000 AND input IN ('widget', 'bolt', 'gear')"""
SQL["strict_condition"] = """
SELECT scenario, year, CASE WHEN value > 25 THEN 'high' WHEN value <= 25 THEN 'low' END AS band, count(*) AS n
FROM gappy GROUP BY ALL"""
SQL["floor_at_zero"] = """
SELECT scenario, year, sum(CASE WHEN value - 25 < 0 THEN 0 ELSE value - 25 END) AS excess,
  count(*) - count(value) AS unknown FROM gappy GROUP BY scenario, year"""
SQL["tolerant_number"] = f"""
SELECT TRY_CAST(CASE WHEN line % 2 = 0 THEN CAST(order_year AS VARCHAR) ELSE word END AS INTEGER) AS number,
  {strict('value')} FROM base GROUP BY 1"""
SQL["strict_sum"] = rollup("gappy", "scenario, region, name, year")
SQL["strict_running_sum"] = (
    "SELECT *, "
    + strict_over("value", f"PARTITION BY scenario, region, name {RUNNING}", "cum_value")
    + f" FROM ({rollup('gappy', 'scenario, region, name, year')})"
)
SQL["strict_multi_measure"] = f"""
SELECT scenario, region, name, {strict('value')}, sum(CAST(line AS DOUBLE)) AS lines FROM gappy
GROUP BY scenario, region, name"""
SQL["rollup_region"] = rollup("base LEFT JOIN region_groups USING (region)", "scenario, grouped_region, year")
SQL["two_level_rollup"] = rollup(
    f"(SELECT * FROM ({rollup('final_energy', 'scenario, region, input, year')}) WHERE value >= 20)", "scenario, year"
)
SQL["group_set_totals"] = " UNION ALL ".join(
    f"SELECT scenario, year, '{g}' AS sector, {strict('value')} FROM base WHERE kind IN ({lit(m)}) GROUP BY scenario, year"
    for g, m in {"Big": ["LARGE", "STANDARD"], "Small": ["SMALL", "MEDIUM"], "Cheap": ["ECONOMY"]}.items()
)
SQL["distinct_inputs"] = "SELECT DISTINCT input FROM final_energy"
CTES["kind_detail"] = rollup("base LEFT JOIN region_groups USING (region)", "scenario, grouped_region, kind, year")
SQL["net_alongside_detail"] = net("kind_detail", ["scenario", "grouped_region", "year"])
CTES["word_detail"] = rollup("base", "scenario, region, word, year")
WORD_KEYS = ["region", "word", "year"]
SQL["diff_one_scenario"] = diff("word_detail", ["Reference_LLS"], "Reference", WORD_KEYS)
SQL["diff_one_scenario_filled"] = diff("word_detail", ["Reference_LLS"], "Reference", WORD_KEYS, "Reference_LLS")
SQL["diff_many_scenarios"] = diff(
    "word_detail", ["Reference_LLS", "Reference_LT_sshc", "Transition"], "Reference", WORD_KEYS
)
CTES["name_detail"] = rollup(
    "base LEFT JOIN region_groups USING (region)", "scenario, grouped_region, name, vintage, year"
)
SQL["diff_unknown_keys"] = diff(
    "name_detail",
    ["Transition_LLS", "Transition_LT_sshc"],
    "Transition",
    ["grouped_region", "name", "vintage", "year"],
)
CTES["items"] = """
SELECT scenario, grouped_region, region || '.' || name || '.' || priority AS item, year, value
FROM base LEFT JOIN region_groups USING (region)"""
CTES["item_detail"] = rollup("items", "scenario, grouped_region, item, year")
for _ref in ["Reference", "Transition"]:
    CTES[f"item_diff_{_ref.lower()}"] = diff(
        "item_detail", [f"{_ref}_LLS", f"{_ref}_LT_sshc"], _ref, ["grouped_region", "item", "year"]
    )
SQL["diff_families_with_net"] = " UNION ALL ".join(
    net(f"item_diff_{r}", ["scenario_diff", "grouped_region", "year"]) for r in ["reference", "transition"]
)
SQL["gross_trade_signed"] = net("gross_trade", ["scenario", "region", "year"])
SQL["net_trade"] = rollup("gross_trade", "scenario, region, year")
SQL["production_flows"] = rollup("gross_production", FLOW)
SQL["consumption_flows"] = rollup("gross_consumption", FLOW)
SQL["vintage_additions"] = rounded("SELECT * FROM export_total_added", ["additions"])
SQL["vintage_retirements"] = rounded("SELECT * FROM export_retired", ["value", "retirements"])
NATURAL = ["s_curve_adj", "installed", "expected", "natural_retire"]
SQL["natural_retirements"] = rounded("SELECT * EXCLUDE (vintage) FROM export_natural", NATURAL)
SQL["natural_retirements_import"] = rounded("SELECT * EXCLUDE (vintage) FROM import_natural_short", NATURAL)
CHANGES = ["additions", "retirements", "add_adj", "ret_adj"]
CUMULATIVE = ["cum_additions", "cum_retirements"]
SQL["net_add_ret_keep_all"] = rounded("SELECT * FROM export_changes_all", CHANGES)
SQL["retirements_repeated_rows"] = rounded("SELECT * FROM import_changes", CHANGES)
SQL["retirements_any_years"] = SQL["retirements_repeated_rows"]
SQL["net_add_ret_gaps"] = rounded("SELECT * FROM gappy_changes", CHANGES)
SQL["cumulative_add_ret_gaps"] = rounded("SELECT * FROM gappy_cumulative", CHANGES + CUMULATIVE)
CTES["gappy_kinds"] = rollup("gappy", "scenario, region, kind, year")
SQL["net_alongside_detail_gaps"] = net("gappy_kinds", ["scenario", "region", "year"])
CTES["gappy_words"] = rollup("gappy", "scenario, region, word, year")
SQL["diff_many_scenarios_gaps"] = diff("gappy_words", ["Reference_LLS", "Transition"], "Reference", WORD_KEYS)
CTES["gappy_word_kinds"] = rollup("gappy", "scenario, region, word, kind, year")
CTES["repeated_words"] = "SELECT scenario, region, word, year, value FROM gappy_word_kinds"
SQL["diff_repeated_keys"] = diff("repeated_words", ["Reference_LLS", "Transition"], "Reference", WORD_KEYS)
CTES["model_years"] = f"""
SELECT scenario || '.' || CAST(ship_year AS VARCHAR) AS scenario, region, word, {strict('value')} FROM gappy GROUP BY 1, 2, 3"""
PANEL = [f"{s}.{y}" for s in star.SCENARIO_CODES for y in range(1995, 2002)]
SQL["diff_wide_panel"] = diff("model_years", PANEL[1:], PANEL[0], ["region", "word"])
SQL["diff_wide_pairs"] = " UNION ALL ".join(diff("model_years", [s], ref, ["region", "word"], s) for s, ref in zip(PANEL, PANEL[1:], strict=False))
CTES["limbs"] = """
SELECT scenario, region, year, value IS NULL AS unknown, floor(s) AS u, (s - floor(s)) * 1048576 AS r
FROM (SELECT *, value / 7 * 1048576 AS s FROM gappy)"""
CTES["limb_sums"] = """
SELECT scenario, region, year, bool_or(unknown) AS unknown, CAST(sum(CAST(u AS BIGINT)) AS BIGINT) AS u,
  CAST(sum(CAST(floor(r) AS BIGINT)) AS BIGINT) AS m, CAST(sum(CAST(round_even((r - floor(r)) * 1048576, 0) AS BIGINT)) AS BIGINT) AS l
FROM limbs GROUP BY scenario, region, year"""
CTES["carried"] = "SELECT *, m + (l >> 20) AS m2, l & 1048575 AS l2 FROM limb_sums"
SQL["exact_sum"] = """
SELECT scenario, region, year, CASE WHEN NOT unknown THEN
  (u + (m2 >> 20)) / 1048576.0::DOUBLE + ((m2 & 1048575) / 1099511627776.0::DOUBLE + l2 / 1152921504606846976.0::DOUBLE) END AS value
FROM carried"""
SQL["group_set_totals_gaps"] = " UNION ALL ".join(
    f"SELECT scenario, region, year, '{g}' AS sector, {strict('value')} FROM gappy WHERE word IN ({lit(m)}) "
    "GROUP BY scenario, region, year"
    for g, m in {"Warm": ["hot", "red"], "Cool": ["cold", "blue"], "Both": ["hot", "cold"]}.items()
)
SQL["co2_equivalent_gaps"] = rounded(
    """SELECT scenario, region, gas AS "GHG", emitter AS sector, year, sum(value * factor) AS value
FROM gappy JOIN gas_factors ON gas = ghg WHERE value IS NOT NULL GROUP BY ALL""",
    ["value"],
)
SQL["land_use_gaps"] = rounded(
    f"""SELECT scenario, region, year, value * 44 / 12 AS value, 'MtCO2' AS "Units", 'LUC' AS sector, 'CO2' AS "GHG"
FROM (SELECT scenario, region, year, {strict('value')} FROM gappy GROUP BY scenario, region, year)""",
    ["value"],
)
SQL["store_by_title"] = rollup("final_energy", "scenario, input, year")
SQL["mapping_csv_scan"] = "SELECT * FROM region_groups"
CTES["csv_cells"] = """
SELECT scenario, CASE WHEN line = 6 THEN word || '?' ELSE CAST(year AS VARCHAR) END AS year, line = 6 AS bad_year,
    CASE WHEN line = 7 OR word = 'old' THEN CAST(value AS VARCHAR) || 'kg' ELSE CAST(value AS VARCHAR) END AS value, line = 7 OR word = 'old' AS bad_value,
    value AS amount
FROM base"""
SQL["csv_rejects"] = """
SELECT 'good' AS kind, scenario, year AS text, sum(amount) AS value FROM csv_cells WHERE NOT bad_year AND NOT bad_value GROUP BY scenario, year
UNION ALL SELECT 'year', NULL, year, CAST(count(*) AS DOUBLE) FROM csv_cells WHERE bad_year GROUP BY year
UNION ALL SELECT 'value', NULL, value, CAST(count(*) AS DOUBLE) FROM csv_cells WHERE bad_value GROUP BY value"""
SQL["ordered_dataset"] = f"""
SELECT *, row_number() OVER (ORDER BY list_position([{lit(V.SCENARIO_BAR_LEVELS)}], scenario) NULLS LAST, scenario NULLS LAST,
    list_position(['STANDARD', 'LARGE', 'MEDIUM', 'SMALL'], kind) NULLS LAST, kind NULLS LAST, year NULLS LAST, region NULLS LAST) - 1 AS position
FROM (SELECT scenario, kind, year, region, {strict('value')} FROM base GROUP BY scenario, kind, year, region)"""
SQL["ensemble_csv_scan"] = "SELECT * FROM ensemble"
SQL["named_store_scan"] = rollup("electricity", "scenario, technology, year")
SQL["refreshed_scenario"] = rollup(
    "(SELECT scenario, technology, year, CASE WHEN scenario LIKE '%LLS' THEN 2 * value ELSE value END AS value FROM electricity)",
    "scenario, technology, year",
)
SQL["lookup_checked"] = SQL["rollup_region"]
SQL["csv_store_scan"] = "SELECT * FROM literature_production"
SQL["land_use"] = rounded("SELECT * FROM land_use", ["value"])
SQL["ensemble_long"] = "SELECT * FROM ensemble_long"
SQL["co2_equivalent"] = rounded(rollup("all_emissions", 'scenario, region, "GHG", sector, "Units", year'), ["value"])

# query -> derived table, rounded columns, digits
for _query, _table, _cols, _digits in [
    ("traded_total_by_scenario", "global_traded", None, 4),
    ("domestic_total", "global_domestic", None, 4),
    ("pipeline_total", "global_pipeline", None, 4),
    ("lng_total", "global_lng", None, 4),
    ("resource_total", "global_resources", None, 4),
    ("grouped_trade", "grouped_trade", None, 4),
    ("grouped_production", "grouped_production", None, 4),
    ("grouped_consumption", "grouped_consumption", None, 4),
    ("production_difference", "production_difference", None, 4),
    ("consumption_difference", "consumption_difference", None, 4),
    ("export_capacity", "export_capacity", ["value"], 4),
    ("global_capacity", "global_capacity", ["value"], 4),
    ("cumulative_capacity", "cumulative_capacity", ["value", "cum_value"], 4),
    ("import_capacity", "import_capacity", ["value"], 4),
    ("net_add_ret", "export_changes", CHANGES, 4),
    ("net_add_ret_import", "import_changes", CHANGES, 4),
    ("cumulative_add_ret", "export_cumulative", CHANGES + CUMULATIVE, 4),
    ("cumulative_add_ret_import", "import_cumulative", CHANGES + CUMULATIVE, 4),
    ("cumulative_global", "export_cumulative_global", CUMULATIVE, 4),
    ("cumulative_grouped", "export_cumulative_grouped", CUMULATIVE, 4),
    ("annual_cost", "cost_in_billions", ["additions", "cost"], 4),
    ("primary_fuel_collapse", "primary_by_region", None, 4),
    ("primary_fuel_collapse_ccs", "primary_ccs_by_region", None, 4),
    ("primary_global", "primary_global", None, 4),
    ("primary_ccs_global", "primary_ccs_global", None, 4),
    ("primary_ccs_grouped", "primary_ccs_grouped", None, 4),
    ("primary_limited_trade", "primary_limited_trade", None, 4),
    ("primary_transition", "primary_transition", None, 4),
    ("tech_to_sector", "electricity_global", None, 4),
    ("electricity_grouped", "electricity_grouped", None, 4),
    ("electricity_transition", "electricity_transition", None, 4),
    ("final_by_input", "final_global", None, 4),
    ("final_grouped", "final_grouped", None, 4),
    ("final_transition", "final_transition", None, 4),
    ("rollup_multi_measure", "literature_traded", None, 4),
    ("literature_regions", "production_for_literature", None, 4),
    ("literature_gas_use", "gas_use_for_literature", None, 4),
    ("grouped_emissions", "grouped_emissions", ["value"], 4),
    ("global_emissions", "global_emissions", ["value"], 4),
    ("co2_total", "global_co2", ["value"], 4),
    ("non_co2_total", "global_non_co2", ["value"], 4),
    ("co2_by_sector", "co2_by_group", ["value"], 4),
    ("co2e_by_sector", "co2e_by_group", ["value"], 4),
    ("gas_co2e_by_sector", "gas_by_group", ["value"], 4),
    ("fossil_co2", "fossil_co2", ["value"], 4),
    ("warming_category", "warming", None, 4),
    ("ensemble_gas", "ensemble_gas", None, 4),
    ("ensemble_co2", "ensemble_co2", None, 4),
    ("ensemble_primary", "ensemble_primary", None, 4),
    ("ensemble_gas_power", "ensemble_gas_power", None, 4),
]:
    SQL[_query] = f"SELECT * FROM {_table}" if _cols is None else rounded(f"SELECT * FROM {_table}", _cols, _digits)

# --- finished datasets -----------------------------------------------------

PLOTTED = f"scenario IN ({lit(V.PAPER_SCENARIOS)}) AND year >= 2015 AND year <= 2050"
ENDED = f"scenario IN ({lit(V.PAPER_SCENARIOS)}) AND year = 2050"
SNAPSHOT = (
    "(year = 2050 OR (year = 2015 AND scenario = 'Reference')) AND scenario IN ('Reference', 'Transition')"
)
LLS = "year = 2050 AND scenario_diff IN ('Reference_LLS', 'Transition_LLS')"
LT = "year = 2050 AND scenario_diff IN ('Reference_LT_sshc', 'Transition_LT_sshc')"


def level(col: str, levels) -> str:
    """The column limited to its levels, and its position among them."""
    at = " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(levels))
    return (
        f"CASE WHEN {col} IN ({lit(levels)}) THEN {col} END AS {col}, "
        f"CAST(CASE {col} {at} END AS INTEGER) AS {col}_ord"
    )


def number(expr: str, out: str) -> str:
    return f"round({expr}, 4) + 0.0 AS {out}"


UP = level("grouped_region", V.FLIPPED_GROUPED_REGION_LEVELS)
DOWN = level("grouped_region", V.GROUPED_REGION_LEVELS)
FLOW_SECTOR = level("sector", V.TRADE_SECTOR_LEVELS)
PANEL = "scenario || '.' || CAST(year AS VARCHAR) AS scenario_year"
EXPORT_SECTOR = level("sector", V.TRADED_SECTOR_LEVELS)
IMPORT_TECHNOLOGY = level("technology", V.IMPORT_TECHNOLOGY_LEVELS)
BARS = level("scenario", V.SCENARIO_BAR_LEVELS)


def mart(name: str, table: str, where: str, *cols: str) -> None:
    SQL[f"mart_{name.lower()}"] = f"SELECT {', '.join(cols)} FROM {table} WHERE {where}"


VALUE, NET = number("value", "value"), number("value_net", "value_net")
for _name, _table in [
    ("2A", "global_traded"),
    ("2B", "global_domestic"),
    ("2C", "global_pipeline"),
    ("2D", "global_lng"),
]:
    mart(_name, _table, PLOTTED, "scenario, year", VALUE)
mart("3A", "grouped_production", SNAPSHOT, UP, FLOW_SECTOR, PANEL, VALUE)
mart("3B", "grouped_trade", SNAPSHOT, UP, FLOW_SECTOR, PANEL, VALUE, NET)
mart("3C", "grouped_consumption", SNAPSHOT, UP, FLOW_SECTOR, PANEL, number("value * -1", "value"))
for _name, _table, _where in [
    ("4A", "production_difference", LLS),
    ("4D", "production_difference", LT),
]:
    mart(_name, _table, _where, UP, FLOW_SECTOR, "scenario_diff", VALUE, NET)
for _name, _where in [("4B", LLS), ("4E", LT)]:
    _negative = number("value * -1", "value"), number("value_net * -1", "value_net")
    mart(_name, "consumption_difference", _where, UP, FLOW_SECTOR, "scenario_diff", *_negative)
for _name, _where in [("4C", LLS), ("4F", LT)]:
    mart(_name, "primary_limited_trade", _where, UP, "fuel, scenario_diff", VALUE, NET)
for _name, _measure in [("A", "cum_additions"), ("B", "cum_retirements")]:
    _value = number(_measure, _measure)
    _foreign = f"{ENDED} AND technology <> '{V.DOMESTIC_GAS}'"
    mart(f"5{_name}", "export_cumulative_global", ENDED, BARS, EXPORT_SECTOR, _value)
    mart(f"S2{_name}", "export_cumulative_grouped", ENDED, DOWN, EXPORT_SECTOR, "scenario", _value)
    mart(f"S3{_name}", "import_cumulative_global", _foreign, BARS, IMPORT_TECHNOLOGY, _value)
    mart(f"S4{_name}", "import_cumulative_grouped", _foreign, DOWN, IMPORT_TECHNOLOGY, "scenario", _value)
mart(
    "S5",
    "annual_cost",
    PLOTTED,
    "year",
    EXPORT_SECTOR,
    level("scenario", V.SCENARIO_PANEL_LEVELS),
    number("cost / 1e9", "cost"),
)
mart("S6A", "primary_ccs_global", PLOTTED, "year, fuel, scenario", VALUE)
mart("S6B", "primary_transition", "year = 2050", UP, "fuel", VALUE, NET)
mart("S7A", "electricity_global", PLOTTED, "year, sector, scenario", number("value * 277.778", "value"))
mart("S7B", "electricity_transition", "year = 2050", UP, "sector", number("value * 277.778", "value"), NET)
mart("S8A", "final_global", PLOTTED, "year, input, scenario", VALUE)
mart("S8B", "final_transition", "year = 2050", UP, "input", VALUE, NET)
for _name, _table in [("S14", "co2_by_group"), ("S15", "co2e_by_group"), ("S16", "gas_by_group")]:
    mart(_name, _table, PLOTTED, "year, sector, scenario", number("value / 1000", "value"))


def layers(name: str, dims: str, *parts: tuple[str, str, str, str]) -> None:
    """Series of an overlay: label, table, condition, value, and own dims if any."""
    SQL[f"mart_{name.lower()}"] = " UNION ALL ".join(
        f"SELECT '{series}' AS series, {dims}, {number(value, 'value')} FROM {table} WHERE {where}"
        for series, table, where, value in parts
    )


for _name, _table, _lit in [
    ("S9A", "global_traded", "literature_traded"),
    ("S9B", "global_lng", "literature_lng"),
    ("S9C", "global_pipeline", "literature_pipeline"),
]:
    layers(_name, "scenario, year", ("model", _table, PLOTTED, "value"), ("literature", _lit, "true", '"EJ"'))
REGIONAL = "scenario, grouped_region, year"
layers(
    "S10",
    REGIONAL,
    ("model", "production_for_literature", f"{PLOTTED} AND resource = 'natural gas'", "value"),
    ("literature", "literature_production", "year >= 2015", '"EJ"'),
)
layers(
    "S11",
    REGIONAL,
    ("model", "gas_use_for_literature", PLOTTED, "value"),
    ("literature", "literature_consumption", "year >= 2015", '"EJ"'),
)
for _name, _ensemble, _factor, _model, _extra, _divisor, _lit, _col in [
    ("S12", "ensemble_gas", "* 0.981", "primary_global", "AND fuel = 'b natural gas'", "", "literature_gas", '"EJ"'),
    ("S13", "ensemble_co2", "/ 1000", "fossil_co2", "", "/ 1000", "literature_co2", "value / 1000"),
]:
    _member = "scenario, CAST(NULL AS VARCHAR) AS member, year"
    SQL[f"mart_{_name.lower()}"] = f"""
SELECT 'ensemble' AS series, scenario, "Model" || '.' || "Model_Scenario" AS member, year,
  {number(f'value {_factor}', 'value')} FROM {_ensemble} WHERE year >= 2020 AND year <= 2050
UNION ALL SELECT 'model', {_member}, {number(f'value {_divisor}', 'value')} FROM {_model} WHERE {PLOTTED} {_extra}
UNION ALL SELECT 'literature', {_member}, {number(_col, 'value')} FROM {_lit}"""

ORACLE = {name: with_ctes(sql.strip()) for name, sql in SQL.items()}
