"""Model tables read out of a sales star schema.

Order lines stand in for model output: return and line status name the
scenario, the customer's nation the region, part type and name the category,
order and ship year the vintage and year, and the quantity is the value. A
table is a projection of the joined lines, and only the dimensions that it
needs are joined.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenara import vocabulary as V
from scenara.operators import local_table
from scenara.plans import emissions

# return flag and line status of each scenario
SCENARIO_CODES = {
    "Reference": ("N", "F"),
    "Transition": ("N", "O"),
    "Reference_LLS": ("A", "F"),
    "Transition_LLS": ("A", "O"),
    "Reference_LT_sshc": ("R", "F"),
    "Transition_LT_sshc": ("R", "O"),
}
CARRIERS = {
    "blue": "LNG",
    "new": "Afr_MidE pipeline gas",
    "cold": "EUR pipeline gas",
    "small": "LA pipeline gas",
    "hot": "N.Amer pipeline gas",
    "old": "PAC pipeline gas",
    "red": "RUS pipeline gas",
}
GASES = {"1-URGENT": "CO2", "2-HIGH": "CH4", "3-MEDIUM": "N2O", "4-NOT SPECIFIED": "SF6"}
FACTORS = {"ghg": ["CO2", "CH4", "N2O", "SF6"], "AR5all": [3.7, 28.0, 265.0, 23.5]}
EMITTERS = {
    "blue": "comm cooling",
    "new": "elec_gas (CC)",
    "cold": "trn_freight",
    "small": "cement",
    "hot": "urban processes",
    "old": "Rice",
    "red": "refining",
}
RESOURCES = {"SMALL": "natural gas", "MEDIUM": "natural gas", "LARGE": "coal"}
TECHNOLOGIES = {
    "ECONOMY": "biomass (conv)",
    "LARGE": "coal (conv pul)",
    "SMALL": "gas (CC)",
    "STANDARD": "wind",
    "PROMO": "gas (CC CCS)",
}
TECH_SECTORS = {
    "technology": ["biomass (conv)", "coal (conv pul)", "gas (CC)", "wind", "gas (CC CCS)"],
    "sector": ["biomass", "coal", "gas", "wind", "gas CCS"],
}
EMITTING_SUBSECTORS = {"SMALL": "gas", "LARGE": "gas (CC)", "STANDARD": "gas pipeline", "PROMO": "oil"}
VARIABLES = {
    "ECONOMY": V.WARMING_VARIABLE,
    "LARGE": V.PRIMARY_GAS_VARIABLE,
    "SMALL": V.PRIMARY_ENERGY_VARIABLE,
    "STANDARD": V.GAS_POWER_VARIABLE,
    "PROMO": V.FOSSIL_CO2_VARIABLE,
}
ENSEMBLE_YEARS = {1995: 2020, 1996: 2025, 1997: 2030, 1998: 2035, 1999: 2040, 2000: 2050, 2001: 2100}
LITERATURE_SCENARIOS = {
    "1-URGENT": "historical",
    "2-HIGH": "IEA-STEPS",
    "3-MEDIUM": "IEA-APS",
    "4-NOT SPECIFIED": "IEA-NZE",
    "5-LOW": "IEEJ-REF",
}
LITERATURE_GROUPS = [
    "USA",
    "Africa",
    "Australia_NZ",
    "LAC",
    "Can.+Mex.",
    "rest of Eurasia",
    "China",
    "Europe",
    "India",
    "rest of Asia",
    "Middle East",
    "Russia",
]

# columns read of each star table, declared so that no file footer is opened to plan
STAR_SCHEMAS = {
    "nation": "n_nationkey int, n_name string",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz,"
    " o_orderpriority string",
    "part": "p_partkey bigint, p_name string, p_type string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, l_returnflag string,"
    " l_linestatus string, l_shipdate timestamp_ntz",
}


def case(tested: str, codes: dict[str, str], other: str = "NULL") -> str:
    """SQL that translates ``tested`` by ``codes``, anything else to ``other``."""
    whens = " ".join(f"WHEN '{code}' THEN '{label}'" for code, label in codes.items())
    return f"CASE {tested} {whens} ELSE {other} END"


def calendar_year(date: str) -> str:
    return f"CAST(year({date}) AS INT)"


def model_year(date: str) -> str:
    """1995 to 2000 in five-year steps from 2015, 2001 as 2050."""
    return f"CAST(IF(year({date}) = 2001, 2050, 2015 + (year({date}) - 1995) * 5) AS INT)"


#: every year that ``model_year`` gives for the dates of the orders and lines, 1992 to 2001
MODEL_YEARS = [*range(2000, 2045, 5), 2050]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(STAR_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


WORD, NOUN = "get(split(p_name, ' '), 0)", "get(split(p_name, ' '), 1)"
CARRIER = case(WORD, CARRIERS)
TRADED = f"coalesce('traded ' || {CARRIER}, 'unsold gas')"


def _fuel(large: str, standard: str) -> str:
    return (
        f"CASE p_type WHEN 'SMALL' THEN {TRADED} WHEN 'LARGE' THEN {large} WHEN 'STANDARD' THEN '{standard}'"
        f" WHEN 'MEDIUM' THEN '{V.NATURAL_GAS_FUEL}' WHEN 'ECONOMY' THEN 'a oil' ELSE 'z other' END"
    )


# fields by the table that owns them; each is made where it is owned, so a
# category label is made once per part and not once per order line
LINE_FIELDS = {
    "scenario": "CASE "
    + " ".join(
        f"WHEN l_returnflag = '{flag}' AND l_linestatus = '{status}' THEN '{label}'"
        for label, (flag, status) in SCENARIO_CODES.items()
    )
    + " END",
    "year": model_year("l_shipdate"),
    "ship_year": calendar_year("l_shipdate"),
    "line": "l_linenumber",
}
ORDER_FIELDS = {
    "priority": "o_orderpriority",
    "status": "o_orderstatus",
    "gas": case("o_orderpriority", GASES, "'unlisted'"),
    "fuel_units": "IF(o_orderpriority = '5-LOW', 'Mtoe', 'EJ')",
    "order_year": calendar_year("o_orderdate"),
    "vintage": model_year("o_orderdate"),
    "literature_scenario": case("o_orderpriority", LITERATURE_SCENARIOS),
}
CUSTOMER_FIELDS = {"segment": "c_mktsegment"}
NATION_FIELDS = {"region": "n_name"}
PART_FIELDS = {
    "kind": "p_type",
    "name": "p_name",
    "word": WORD,
    "noun": NOUN,
    "gas_units": "IF(p_type = 'ECONOMY', 'Mt', 'EJ')",
    "imported": f"coalesce('imported ' || {CARRIER}, '{V.DOMESTIC_GAS}')",
    "traded": TRADED,
    "balancing": "p_type = 'PROMO'",
    "fuel": _fuel("'d biomass'", "c coal"),
    "fuel_ccs": _fuel(f"{TRADED} || ' CCS'", "c coal CCS"),
    "generator": case("p_type", TECHNOLOGIES, "'unlisted'"),
    "resource": case("p_type", RESOURCES, "'crude oil'"),
    "emitter": case(WORD, EMITTERS, "'unlisted'"),
    "emitting_subsector": case("p_type", EMITTING_SUBSECTORS, "'coal'"),
    "emitting_technology": f"IF({NOUN} = 'widget', '{V.GAS_TECHNOLOGY}', {NOUN})",
    "variable": case("p_type", VARIABLES, "'Population'"),
}


def _taken(owned: dict[str, str], wanted: set[str]) -> list[str]:
    return [f"{sql} AS {name}" for name, sql in owned.items() if name in wanted]


def order_rows(spark: SparkSession, sf_dir: str, wanted: set[str]) -> DataFrame:
    """Orders with the wanted fields of their customer and nation.

    Customer and nation join the orders, not the far longer order lines.
    """
    o = _read(spark, sf_dir, "orders")
    own = _taken(ORDER_FIELDS, wanted)
    customer, nation = _taken(CUSTOMER_FIELDS, wanted), _taken(NATION_FIELDS, wanted)
    if not customer and not nation:
        return o.selectExpr("o_orderkey", *own)
    c = _read(spark, sf_dir, "customer").selectExpr("c_custkey", "c_nationkey", *customer)
    o = o.selectExpr("o_orderkey", "o_custkey", *own)
    o = o.join(c, o["o_custkey"] == c["c_custkey"])
    if nation:
        n = _read(spark, sf_dir, "nation").selectExpr("n_nationkey", *nation)
        o = o.join(n, o["c_nationkey"] == n["n_nationkey"])
    return o.select("o_orderkey", *[f for f in o.columns if f in wanted])


def long_rows(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    """Order lines as scenario rows with the wanted fields and ``value``.

    Only the dimensions that own a wanted field are joined. Parts come first, so
    that filters on their labels act before the lines are shuffled. Lines and orders
    both grow with the data, so they are merge joined and never broadcast.
    """
    wanted = set(fields)
    own = _taken(LINE_FIELDS, wanted)
    rows = _read(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_partkey", *own, "l_quantity AS value")
    labels = _taken(PART_FIELDS, wanted)
    if labels:
        p = _read(spark, sf_dir, "part").selectExpr("p_partkey", *labels)
        rows = rows.join(p, rows["l_partkey"] == p["p_partkey"])
    if wanted & {*ORDER_FIELDS, *CUSTOMER_FIELDS, *NATION_FIELDS}:
        o = order_rows(spark, sf_dir, wanted)
        rows = rows.hint("merge").join(o, rows["l_orderkey"] == o["o_orderkey"])
    return rows.select(*fields, "value")


def model_rows(spark: SparkSession, sf_dir: str, *fields: str, where: Column | None = None) -> DataFrame:
    """``long_rows`` summed to one row per key, as model output is.

    Lines are shuffled once to meet their orders, where a field of those is
    wanted; partial sums shrink them before the shuffle of the sum, and labels
    are packed on the few summed rows.
    """
    rows = long_rows(spark, sf_dir, *fields)
    if where is not None:
        rows = rows.where(where)
    return rows.groupBy(*fields).agg(F.sum("value").alias("value"))


def regional_gas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_rows(spark, sf_dir, "scenario", "region", "gas_units", "imported", "year").select(
        F.col("gas_units").alias("Units"),
        "scenario",
        "region",
        F.lit("regional natural gas").alias("sector"),
        F.col("imported").alias("subsector"),
        F.col("imported").alias("technology"),
        "year",
        "value",
    )


def _traded(rows: DataFrame, technology: Column) -> DataFrame:
    pair = F.concat("region", F.lit(" "), "traded")
    return rows.select(
        F.lit("EJ").alias("Units"),
        "scenario",
        F.lit("Global").alias("region"),
        F.col("traded").alias("sector"),
        F.when(F.col("balancing"), V.BALANCING_SUBSECTOR).otherwise(pair).alias("subsector"),
        technology.alias("technology"),
        F.lit("gas").alias("output"),
        "year",
        "value",
    )


def traded_gas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model_rows(spark, sf_dir, "scenario", "region", "traded", "balancing", "year")
    return _traded(rows, F.col("traded"))


def _with_vintage(technology: str) -> Column:
    return F.concat(technology, F.lit(",year="), F.col("vintage").cast("string"))


def traded_gas_vintage(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ("scenario", "region", "traded", "balancing", "vintage", "year")
    rows = model_rows(spark, sf_dir, *fields, where=F.col("vintage") <= F.col("year"))
    return _traded(rows, _with_vintage("traded"))


def regional_gas_vintage(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ("scenario", "region", "imported", "vintage", "year")
    rows = model_rows(spark, sf_dir, *fields, where=F.col("vintage") <= F.col("year"))
    technology = _with_vintage("imported").alias("technology")
    return rows.select(F.lit("EJ").alias("Units"), "scenario", "region", technology, "year", "value")


def primary(spark: SparkSession, sf_dir: str, fuel: str) -> DataFrame:
    rows = model_rows(spark, sf_dir, "scenario", "region", fuel, "fuel_units", "year")
    names = F.col("fuel_units").alias("Units"), F.col(fuel).alias("fuel")
    return rows.select(names[0], "scenario", "region", names[1], "year", "value")


def electricity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model_rows(spark, sf_dir, "scenario", "region", "generator", "year")
    return rows.withColumnRenamed("generator", "technology")


def final_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_rows(spark, sf_dir, "scenario", "region", "noun", "year").withColumnRenamed("noun", "input")


def resource_production(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model_rows(spark, sf_dir, "scenario", "region", "resource", "year")
    return rows.select(F.lit("EJ").alias("Units"), *rows.columns)


def emission_grains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resource, sector and land-use emissions out of one pass over the order lines.

    Lines are summed by all keys first, so that only those few sums are repeated by grain.
    """
    labels = {"emitter": "sector", "gas": "ghg"}
    rows = model_rows(spark, sf_dir, "scenario", "region", "emitter", "resource", "kind", "gas", "year")
    packed = F.concat("resource", F.lit(" "), F.lower("kind"))
    return emissions.emission_grains(rows.withColumnsRenamed(labels).withColumn("subresource", packed))


def sector_emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model_rows(spark, sf_dir, "scenario", "region", "emitter", "gas", "year")
    rows = rows.withColumnsRenamed({"emitter": "sector", "gas": "ghg"})
    return rows.select(F.lit("Tg").alias("Units"), *rows.columns)


def resource_emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_rows(spark, sf_dir, "scenario", "region", "resource", "kind", "gas", "year").select(
        F.lit("Tg").alias("Units"),
        "scenario",
        "region",
        "resource",
        F.concat("resource", F.lit(" "), F.lower("kind")).alias("subresource"),
        F.col("gas").alias("ghg"),
        "year",
        "value",
    )


def technology_emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = {
        "emitter": "sector",
        "emitting_subsector": "subsector",
        "emitting_technology": "technology",
        "gas": "ghg",
    }
    rows = model_rows(spark, sf_dir, "scenario", "region", *labels, "year").withColumnsRenamed(labels)
    return rows.select(F.lit("Tg").alias("Units"), *rows.columns)


def land_use_emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_rows(spark, sf_dir, "scenario", "region", "year")


def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide ensemble: one member per market segment and nation."""
    rows = long_rows(spark, sf_dir, "segment", "region", "variable", "ship_year")
    by_year = [
        F.sum(F.when(F.col("ship_year") == y, F.col("value"))).alias(str(model)) for y, model in ENSEMBLE_YEARS.items()
    ]
    wide = rows.groupBy("segment", "region", "variable").agg(*by_year)
    cells = {str(m): F.col(f"`{m}`") for m in ENSEMBLE_YEARS.values()}
    warming = F.col("variable") == V.WARMING_VARIABLE
    return wide.select(
        F.col("segment").alias("Model"),
        F.col("region").alias("Scenario"),
        F.lit("World").alias("Region"),
        F.col("variable").alias("Variable"),
        F.lit("EJ/yr").alias("Unit"),
        # degrees between 0 and 5 in steps of an eighth
        *[F.when(warming, (c % 40) / 8).otherwise(c).alias(m) for m, c in cells.items()],
    )


def _groups(spark: SparkSession, sf_dir: str, labels: list[str], size: int) -> DataFrame:
    label = F.get(F.array(*map(F.lit, labels)), F.col("n_nationkey") % size)
    n = _read(spark, sf_dir, "nation").select(F.col("n_name").alias("region"), label.alias("grouped_region"))
    return n.where(F.col("grouped_region").isNotNull())


def region_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fourteen region groups; every fifteenth nation belongs to none."""
    return _groups(spark, sf_dir, V.GROUPED_REGION_LEVELS, 15)


def literature_region_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir, LITERATURE_GROUPS, 12)


def tech_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return local_table(spark, TECH_SECTORS)


def gas_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return local_table(spark, FACTORS)


def _amounts() -> list[Column]:
    n = F.count(F.lit(1)).cast("double")
    return [n.alias("Bcm"), (n * 2).alias("Tcf"), (n * 4).alias("EJ")]


def literature_world(spark: SparkSession, sf_dir: str, status: str) -> DataFrame:
    rows = order_rows(spark, sf_dir, {"vintage", "literature_scenario", "status"}).where(F.col("status") == status)
    named = rows.withColumnsRenamed({"literature_scenario": "scenario", "vintage": "year"})
    return named.groupBy("scenario", "year").agg(*_amounts())


def literature_region(spark: SparkSession, sf_dir: str, status: str) -> DataFrame:
    fields = {"vintage", "literature_scenario", "status", "region"}
    rows = order_rows(spark, sf_dir, fields).where(F.col("status") == status)
    rows = rows.join(literature_region_groups(spark, sf_dir), "region")
    named = rows.withColumnsRenamed({"literature_scenario": "scenario", "vintage": "year"})
    return named.groupBy("scenario", "grouped_region", "year").agg(*_amounts())


def literature_co2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literature_world(spark, sf_dir, "P").select("scenario", "year", F.col("EJ").alias("value"))


BUILDERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "regional_gas": regional_gas,
    "traded_gas": traded_gas,
    "traded_gas_vintage": traded_gas_vintage,
    "regional_gas_vintage": regional_gas_vintage,
    "primary_energy": partial(primary, fuel="fuel"),
    "primary_energy_ccs": partial(primary, fuel="fuel_ccs"),
    "electricity": electricity,
    "final_energy": final_energy,
    "resource_production": resource_production,
    "sector_emissions": sector_emissions,
    "resource_emissions": resource_emissions,
    "technology_emissions": technology_emissions,
    "land_use_emissions": land_use_emissions,
    "ensemble": ensemble,
    "region_groups": region_groups,
    "literature_region_groups": literature_region_groups,
    "tech_sectors": tech_sectors,
    "gas_factors": gas_factors,
    "literature_lng": partial(literature_world, status="F"),
    "literature_pipeline": partial(literature_world, status="O"),
    "literature_gas": partial(literature_world, status="P"),
    "literature_production": partial(literature_region, status="F"),
    "literature_consumption": partial(literature_region, status="O"),
    "literature_co2": literature_co2,
}


def model_tables(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], DataFrame]]:
    """Loaders of every model table, by name, and of the emissions that one pass makes at all grains."""
    builders = {**BUILDERS, "emission_grains": emission_grains}
    return {name: partial(build, spark, sf_dir) for name, build in builders.items()}
