"""The 38 finished datasets, declared as data and built by one function."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenara import vocabulary as V
from scenara.operators import as_levels, composite_key, union_by_name
from scenara.plans import capacity, emissions, energy, ensemble, flows
from scenara.session import checkpoint_folder
from scenara.sources import write_mart, write_ordered
from scenara.sources.tables import finished

Table = DataFrame | Callable[[], DataFrame]


@dataclass(frozen=True)
class Options:
    """Choices where the published figures and a strict reading part.

    The defaults give the published figures.

    sector_levels: ``DOMESTIC_SECTOR_LEVELS`` keeps the sector of domestic rows.
    collapsed_units: ``"EJ"`` limits merged traded gas to energy units.
    keep_ret_only: keeps series and years that only retire.
    power_net_factor: ``EJ_TWH_REPORTED`` reports the net of S7B in TWh.
    ensemble_gas_factor: ``1.0`` leaves the ensemble's gas in EJ in S12.
    unique_vintages: the vintage tables have one row per series, vintage and year.
    vintage_years: the years of the vintage tables; repeated rows are then summed
        in the shuffle that ageing needs anyway.
    unique_flows: ``False`` pairs repeated rows of grouped flows as a full join
        does, instead of stopping at them.
    """

    sector_levels: Sequence[str] = tuple(V.TRADE_SECTOR_LEVELS)
    collapsed_units: str | None = None
    keep_ret_only: bool = False
    power_net_factor: float = 1.0
    ensemble_gas_factor: float = V.EJ_TCF
    unique_vintages: bool = False
    vintage_years: Sequence[int] | None = None
    unique_flows: bool = True
    base_vintage: int = V.BASE_VINTAGE
    half_life: float = V.S_CURVE_HALF_LIFE
    steepness: float = V.S_CURVE_STEEPNESS
    lifetime: float = V.S_CURVE_LIFETIME


class Workspace:
    """Input tables and the intermediate tables derived from them.

    ``tables`` maps a name to a DataFrame or a function that loads one. Plans
    are built on demand and remembered. With ``checkpoint`` every shared
    intermediate is computed once and kept in the session's checkpoint folder,
    which pays off when many datasets are written in one run and lets a run
    survive lost executors. With a folder ``shared`` they are written there instead, and
    one that a stopped run has finished is read again.
    """

    def __init__(
        self, tables: Mapping[str, Table], checkpoint: bool = False, options: Options = Options(), shared: str | None = None
    ):
        self.options = options
        self._shared = shared
        self._tables = tables
        self._checkpoint = checkpoint
        self._known: dict[str, DataFrame] = {}

    def __contains__(self, name: str) -> bool:
        return name in self._tables or name in DERIVED

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._known:
            self._known[name] = self._build(name)
        return self._known[name]

    def _build(self, name: str) -> DataFrame:
        if name in self._tables:
            table = self._tables[name]
            return table() if callable(table) else table
        df = DERIVED[name](self)
        if self._shared and name in SHARED:
            path = f"{self._shared}/{name}"
            if not finished(df.sparkSession, path):
                df.write.mode("overwrite").parquet(path)
            return df.sparkSession.read.schema(df.schema).parquet(path)
        if self._checkpoint and name in SHARED:
            checkpoint_folder(df.sparkSession)
            df = df.checkpoint()
        return df


def _changes(ws: Workspace, vintages: str, keys: Sequence[str]) -> DataFrame:
    o = ws.options
    ageing = o.base_vintage, o.half_life, o.steepness, o.lifetime
    kept = {"keep_ret_only": o.keep_ret_only, "unique": o.unique_vintages, "years": o.vintage_years}
    return capacity.net_add_ret(ws[vintages], keys, *ageing, **kept)


def _flows(ws: Workspace, gross: str) -> DataFrame:
    return flows.grouped_flows(ws[gross], ws["region_groups"], ws.options.sector_levels)


def _flow_diff(ws: Workspace, grouped: str) -> DataFrame:
    return flows.flow_differences(ws[grouped], unique=ws.options.unique_flows)


def _plain(ws: Workspace) -> DataFrame:
    return energy.collapse_gas(ws["primary_energy"], ws.options.collapsed_units)


def _ccs(ws: Workspace) -> DataFrame:
    return energy.collapse_gas_ccs(ws["primary_energy_ccs"], ws.options.collapsed_units)


def _all_emissions(ws: Workspace) -> DataFrame:
    if "emission_grains" in ws:
        return emissions.all_from_grains(ws["emission_grains"], ws["gas_factors"])
    inputs = [ws[name] for name in ("resource_emissions", "sector_emissions", "land_use_emissions", "gas_factors")]
    return emissions.all_emissions(*inputs)


def _emissions_by_sector(ws: Workspace) -> DataFrame:
    if "emission_grains" in ws:
        return emissions.totals_from_grains(ws["emission_grains"], ws["gas_factors"])
    return emissions.sector_totals(ws["resource_emissions"], ws["sector_emissions"], ws["gas_factors"])


def _by_group(ws: Workspace, co2_only: bool) -> DataFrame:
    # totals made in one pass hold the land-use rows already
    land = None if "emission_grains" in ws else ws["land_use_emissions"]
    return emissions.by_group(emissions.sector_rows(ws["emissions_by_sector"], co2_only, land))


def _fossil_co2(ws: Workspace) -> DataFrame:
    totals = ws["emissions_by_sector"]
    return emissions.fossil_co2(totals.where(F.col("grain") != "land") if "emission_grains" in ws else totals)


DERIVED: dict[str, Callable[[Workspace], DataFrame]] = {
    "global_resources": lambda ws: energy.global_resources(ws["resource_production"]),
    "traded_flows": lambda ws: flows.traded_flows(ws["traded_gas"]),
    "gross_trade": lambda ws: flows.gross_trade(ws["regional_gas"], ws["traded_flows"]),
    "net_trade": lambda ws: flows.net_trade(ws["gross_trade"]),
    "trade_with_net": lambda ws: flows.trade_with_net(ws["gross_trade"]),
    "gross_production": lambda ws: flows.gross_production(ws["regional_gas"], ws["traded_flows"]),
    "gross_consumption": lambda ws: flows.gross_consumption(ws["regional_gas"]),
    "grouped_trade": lambda ws: flows.grouped_trade(ws["gross_trade"], ws["region_groups"], ws.options.sector_levels),
    "grouped_production": lambda ws: _flows(ws, "gross_production"),
    "grouped_consumption": lambda ws: _flows(ws, "gross_consumption"),
    "production_difference": lambda ws: _flow_diff(ws, "grouped_production"),
    "consumption_difference": lambda ws: _flow_diff(ws, "grouped_consumption"),
    "global_traded": lambda ws: flows.global_traded(ws["traded_flows"]),
    "global_domestic": lambda ws: flows.global_domestic(ws["regional_gas"]),
    "global_pipeline": lambda ws: flows.global_pipeline(ws["traded_flows"]),
    "global_lng": lambda ws: flows.global_lng(ws["traded_flows"]),
    "export_vintages": lambda ws: capacity.to_capacity(flows.traded_vintages(ws["traded_gas_vintage"])),
    "export_capacity": lambda ws: capacity.export_capacity(ws["export_vintages"]),
    "global_capacity": lambda ws: capacity.global_capacity(ws["export_vintages"]),
    "cumulative_capacity": lambda ws: capacity.cumulative_capacity(ws["export_capacity"]),
    "export_changes": lambda ws: _changes(ws, "export_vintages", capacity.EXPORT_KEYS),
    "export_cumulative": lambda ws: capacity.cumulative(ws["export_changes"], capacity.EXPORT_KEYS),
    "export_cumulative_global": lambda ws: capacity.cumulative_global(ws["export_cumulative"], "sector"),
    "export_cumulative_grouped": lambda ws: capacity.cumulative_grouped(
        ws["export_cumulative"], "sector", ws["region_groups"]
    ),
    "annual_cost": lambda ws: capacity.infra_cost(capacity.global_additions(ws["export_changes"])),
    "import_vintages": lambda ws: capacity.to_capacity(flows.regional_vintages(ws["regional_gas_vintage"])),
    "import_capacity": lambda ws: capacity.import_capacity(ws["import_vintages"]),
    "import_changes": lambda ws: _changes(ws, "import_vintages", capacity.IMPORT_KEYS),
    "import_cumulative": lambda ws: capacity.cumulative(ws["import_changes"], capacity.IMPORT_KEYS),
    "import_cumulative_global": lambda ws: capacity.cumulative_global(ws["import_cumulative"], "technology"),
    "import_cumulative_grouped": lambda ws: capacity.cumulative_grouped(
        ws["import_cumulative"], "technology", ws["region_groups"]
    ),
    "primary_by_region": lambda ws: energy.by_region(_plain(ws)),
    "primary_global": lambda ws: energy.global_by_category(_plain(ws), "fuel"),
    "primary_ccs_by_region": lambda ws: energy.by_region(_ccs(ws)),
    "primary_ccs_global": lambda ws: energy.global_by_category(_ccs(ws), "fuel"),
    "primary_ccs_grouped": lambda ws: energy.grouped_by_category(_ccs(ws), "fuel", ws["region_groups"]),
    "primary_limited_trade": lambda ws: energy.limited_trade_difference(ws["primary_ccs_grouped"]),
    "primary_transition": lambda ws: energy.transition_difference(ws["primary_ccs_grouped"], "fuel"),
    "electricity_sectors": lambda ws: energy.electricity_sectors(ws["electricity"], ws["tech_sectors"]),
    "electricity_global": lambda ws: energy.global_by_category(ws["electricity_sectors"], "sector"),
    "electricity_grouped": lambda ws: energy.grouped_by_category(
        ws["electricity_sectors"], "sector", ws["region_groups"]
    ),
    "electricity_transition": lambda ws: energy.transition_difference(ws["electricity_grouped"], "sector"),
    "final_global": lambda ws: energy.global_by_category(ws["final_energy"], "input"),
    "final_grouped": lambda ws: energy.grouped_by_category(ws["final_energy"], "input", ws["region_groups"]),
    "final_transition": lambda ws: energy.transition_difference(ws["final_grouped"], "input"),
    "literature_traded": lambda ws: energy.traded_literature(ws["literature_lng"], ws["literature_pipeline"]),
    "production_for_literature": lambda ws: energy.production_for_literature(
        ws["resource_production"], ws["literature_region_groups"]
    ),
    "gas_use_for_literature": lambda ws: energy.gas_use_for_literature(_ccs(ws), ws["literature_region_groups"]),
    "all_emissions": _all_emissions,
    "grouped_emissions": lambda ws: emissions.grouped_emissions(ws["all_emissions"], ws["region_groups"]),
    "emissions_by_gas": lambda ws: emissions.by_gas(ws["all_emissions"]),
    "global_emissions": lambda ws: emissions.global_emissions(ws["emissions_by_gas"]),
    "global_co2": lambda ws: emissions.global_co2(ws["emissions_by_gas"]),
    "global_non_co2": lambda ws: emissions.global_non_co2(ws["emissions_by_gas"]),
    "emissions_by_sector": _emissions_by_sector,
    "co2_by_group": lambda ws: _by_group(ws, co2_only=True),
    "co2e_by_group": lambda ws: _by_group(ws, co2_only=False),
    "gas_system_rows": lambda ws: emissions.gas_system_rows(
        ws["technology_emissions"], ws["resource_emissions"], ws["gas_factors"]
    ),
    "gas_by_group": lambda ws: emissions.gas_by_group(ws["gas_system_rows"]),
    "fossil_co2": _fossil_co2,
    "warming": lambda ws: ensemble.warming_category(ws["ensemble"]),
    "ensemble_gas": lambda ws: ensemble.overlay_extract(
        ensemble.extract_variable(ws["ensemble"], V.PRIMARY_GAS_VARIABLE)
    ),
    "ensemble_co2": lambda ws: ensemble.overlay_extract(
        ensemble.extract_variable(ws["ensemble"], V.FOSSIL_CO2_VARIABLE)
    ),
    "ensemble_primary": lambda ws: ensemble.extract_variable(ws["ensemble"], V.PRIMARY_ENERGY_VARIABLE),
    "ensemble_gas_power": lambda ws: ensemble.extract_variable(ws["ensemble"], V.GAS_POWER_VARIABLE),
}

# used by several datasets and already rolled up, so worth keeping in a full run
SHARED = {
    "grouped_trade",
    "grouped_production",
    "grouped_consumption",
    "production_difference",
    "consumption_difference",
    "global_traded",
    "global_pipeline",
    "global_lng",
    "export_changes",
    "export_cumulative_global",
    "export_cumulative_grouped",
    "import_cumulative_global",
    "import_cumulative_grouped",
    "primary_ccs_grouped",
    "primary_limited_trade",
    "emissions_by_gas",
    "emissions_by_sector",
}


def _in_paper(col: str = "scenario") -> Column:
    return F.col(col).isin(V.PAPER_SCENARIOS)


PLOTTED = _in_paper, lambda: F.col("year").between(V.FIRST_YEAR, V.LAST_YEAR)
END_YEAR = (lambda: F.col("year") == V.LAST_YEAR,)
SNAPSHOT = (
    lambda: (F.col("year") == 2050) | ((F.col("year") == 2015) & (F.col("scenario") == "Reference")),
    lambda: F.col("scenario").isin("Reference", "Transition"),
)
IMPORTED = (lambda: F.col("technology") != V.DOMESTIC_GAS,)


def _difference_of(*scenarios: str):
    return (lambda: F.col("scenario_diff").isin(*scenarios),)


LLS = _difference_of("Reference_LLS", "Transition_LLS")
LT = _difference_of("Reference_LT_sshc", "Transition_LT_sshc")
REGIONS_UP = {"grouped_region": V.FLIPPED_GROUPED_REGION_LEVELS}
REGIONS_DOWN = {"grouped_region": V.GROUPED_REGION_LEVELS}
FLOW_LEVELS = {**REGIONS_UP, "sector": "sector_levels"}
EXPORT_BARS = {"sector": V.TRADED_SECTOR_LEVELS, "scenario": V.SCENARIO_BAR_LEVELS}
IMPORT_BARS = {"technology": V.IMPORT_TECHNOLOGY_LEVELS, "scenario": V.SCENARIO_BAR_LEVELS}


@dataclass(frozen=True)
class Mart:
    """One dataset: which rows of which table, with which measures and dims.

    A measure is a column and the factor it is reported in. ``levels`` orders
    dims and blanks undeclared values; ``panel`` joins scenario and year into
    one label. A factor or level list given as a name is taken from the options.
    """

    source: str
    keep: Sequence[Callable[[], Column]]
    dims: Sequence[str]
    measures: Mapping[str, tuple[str, float | str]] = field(default_factory=lambda: {"value": ("value", 1.0)})
    levels: Mapping[str, Sequence[str] | str] = field(default_factory=dict)
    panel: bool = False


def _scaled(factor: float, net: float | str | None = None) -> dict[str, tuple[str, float | str]]:
    out: dict[str, tuple[str, float | str]] = {"value": ("value", factor)}
    if net is not None:
        out["value_net"] = ("value_net", net)
    return out


LINES = ["scenario", "year"]
FLOW_DIMS = ["grouped_region", "sector"]
ADDED = {"cum_additions": ("cum_additions", 1.0)}
RETIRED = {"cum_retirements": ("cum_retirements", 1.0)}

MARTS: dict[str, Mart] = {
    "2A": Mart("global_traded", PLOTTED, LINES),
    "2B": Mart("global_domestic", PLOTTED, LINES),
    "2C": Mart("global_pipeline", PLOTTED, LINES),
    "2D": Mart("global_lng", PLOTTED, LINES),
    "3A": Mart("grouped_production", SNAPSHOT, FLOW_DIMS, levels=FLOW_LEVELS, panel=True),
    "3B": Mart("grouped_trade", SNAPSHOT, FLOW_DIMS, _scaled(1.0, 1.0), FLOW_LEVELS, panel=True),
    "3C": Mart("grouped_consumption", SNAPSHOT, FLOW_DIMS, _scaled(-1.0), FLOW_LEVELS, panel=True),
    "4A": Mart(
        "production_difference", END_YEAR + LLS, FLOW_DIMS + ["scenario_diff"], _scaled(1.0, 1.0), FLOW_LEVELS
    ),
    "4B": Mart(
        "consumption_difference", END_YEAR + LLS, FLOW_DIMS + ["scenario_diff"], _scaled(-1.0, -1.0), FLOW_LEVELS
    ),
    "4C": Mart(
        "primary_limited_trade",
        END_YEAR + LLS,
        ["grouped_region", "fuel", "scenario_diff"],
        _scaled(1.0, 1.0),
        REGIONS_UP,
    ),
    "4D": Mart("production_difference", END_YEAR + LT, FLOW_DIMS + ["scenario_diff"], _scaled(1.0, 1.0), FLOW_LEVELS),
    "4E": Mart(
        "consumption_difference", END_YEAR + LT, FLOW_DIMS + ["scenario_diff"], _scaled(-1.0, -1.0), FLOW_LEVELS
    ),
    "4F": Mart(
        "primary_limited_trade",
        END_YEAR + LT,
        ["grouped_region", "fuel", "scenario_diff"],
        _scaled(1.0, 1.0),
        REGIONS_UP,
    ),
    "5A": Mart("export_cumulative_global", (_in_paper,) + END_YEAR, ["scenario", "sector"], ADDED, EXPORT_BARS),
    "5B": Mart("export_cumulative_global", (_in_paper,) + END_YEAR, ["scenario", "sector"], RETIRED, EXPORT_BARS),
    "S2A": Mart(
        "export_cumulative_grouped",
        (_in_paper,) + END_YEAR,
        ["grouped_region", "sector", "scenario"],
        ADDED,
        {**REGIONS_DOWN, "sector": V.TRADED_SECTOR_LEVELS},
    ),
    "S2B": Mart(
        "export_cumulative_grouped",
        (_in_paper,) + END_YEAR,
        ["grouped_region", "sector", "scenario"],
        RETIRED,
        {**REGIONS_DOWN, "sector": V.TRADED_SECTOR_LEVELS},
    ),
    "S3A": Mart(
        "import_cumulative_global", (_in_paper,) + END_YEAR + IMPORTED, ["scenario", "technology"], ADDED, IMPORT_BARS
    ),
    "S3B": Mart(
        "import_cumulative_global", (_in_paper,) + END_YEAR + IMPORTED, ["scenario", "technology"], RETIRED, IMPORT_BARS
    ),
    "S4A": Mart(
        "import_cumulative_grouped",
        (_in_paper,) + END_YEAR + IMPORTED,
        ["grouped_region", "technology", "scenario"],
        ADDED,
        {**REGIONS_DOWN, "technology": V.IMPORT_TECHNOLOGY_LEVELS},
    ),
    "S4B": Mart(
        "import_cumulative_grouped",
        (_in_paper,) + END_YEAR + IMPORTED,
        ["grouped_region", "technology", "scenario"],
        RETIRED,
        {**REGIONS_DOWN, "technology": V.IMPORT_TECHNOLOGY_LEVELS},
    ),
    "S5": Mart(
        "annual_cost",
        PLOTTED,
        ["year", "sector", "scenario"],
        {"cost": ("cost", 1e-9)},
        {"sector": V.TRADED_SECTOR_LEVELS, "scenario": V.SCENARIO_PANEL_LEVELS},
    ),
    "S6A": Mart("primary_ccs_global", PLOTTED, ["year", "fuel", "scenario"]),
    "S6B": Mart("primary_transition", END_YEAR, ["grouped_region", "fuel"], _scaled(1.0, 1.0), REGIONS_UP),
    "S7A": Mart("electricity_global", PLOTTED, ["year", "sector", "scenario"], _scaled(V.EJ_TWH_REPORTED)),
    "S7B": Mart(
        "electricity_transition",
        END_YEAR,
        ["grouped_region", "sector"],
        _scaled(V.EJ_TWH_REPORTED, "power_net_factor"),
        REGIONS_UP,
    ),
    "S8A": Mart("final_global", PLOTTED, ["year", "input", "scenario"]),
    "S8B": Mart("final_transition", END_YEAR, ["grouped_region", "input"], _scaled(1.0, 1.0), REGIONS_UP),
    "S14": Mart("co2_by_group", PLOTTED, ["year", "sector", "scenario"], _scaled(1e-3)),
    "S15": Mart("co2e_by_group", PLOTTED, ["year", "sector", "scenario"], _scaled(1e-3)),
    "S16": Mart("gas_by_group", PLOTTED, ["year", "sector", "scenario"], _scaled(1e-3)),
}


@dataclass(frozen=True)
class Layer:
    """One series of an overlay dataset."""

    series: str
    source: str
    keep: Sequence[Callable[[], Column]] = ()
    value: str = "value"
    factor: float | str = 1.0


ENSEMBLE_SHOWN = (lambda: F.col("year").between(V.ENSEMBLE_PLOT_YEARS[0], V.ENSEMBLE_PLOT_YEARS[-1]),)
FROM_2015 = (lambda: F.col("year") >= V.FIRST_YEAR,)

OVERLAYS: dict[str, tuple[list[str], list[Layer]]] = {
    "S9A": (
        LINES,
        [Layer("model", "global_traded", PLOTTED), Layer("literature", "literature_traded", value="EJ")],
    ),
    "S9B": (LINES, [Layer("model", "global_lng", PLOTTED), Layer("literature", "literature_lng", value="EJ")]),
    "S9C": (
        LINES,
        [Layer("model", "global_pipeline", PLOTTED), Layer("literature", "literature_pipeline", value="EJ")],
    ),
    "S10": (
        ["scenario", "grouped_region", "year"],
        [
            Layer(
                "model",
                "production_for_literature",
                PLOTTED + (lambda: F.col("resource") == V.GAS_RESOURCE,),
            ),
            Layer("literature", "literature_production", FROM_2015, "EJ"),
        ],
    ),
    "S11": (
        ["scenario", "grouped_region", "year"],
        [
            Layer("model", "gas_use_for_literature", PLOTTED),
            Layer("literature", "literature_consumption", FROM_2015, "EJ"),
        ],
    ),
    "S12": (
        ["scenario", "member", "year"],
        [
            Layer("ensemble", "ensemble_gas", ENSEMBLE_SHOWN, factor="ensemble_gas_factor"),
            Layer("model", "primary_global", PLOTTED + (lambda: F.col("fuel") == V.NATURAL_GAS_FUEL,)),
            Layer("literature", "literature_gas", value="EJ"),
        ],
    ),
    "S13": (
        ["scenario", "member", "year"],
        [
            Layer("ensemble", "ensemble_co2", ENSEMBLE_SHOWN, factor=1e-3),
            Layer("model", "fossil_co2", PLOTTED, factor=1e-3),
            Layer("literature", "literature_co2", factor=1e-3),
        ],
    ),
}

MART_NAMES = [*MARTS, *OVERLAYS]


def _where(df: DataFrame, keep: Sequence[Callable[[], Column]]) -> DataFrame:
    for condition in keep:
        df = df.where(condition())
    return df


def _measure(col: str, factor: float | str, options: Options) -> Column:
    if isinstance(factor, str):
        factor = getattr(options, factor)
    return F.col(col) if factor == 1.0 else F.col(col) * F.lit(factor)


def _overlay(ws: Workspace, dims: Sequence[str], layers: Sequence[Layer]) -> DataFrame:
    parts = []
    for layer in layers:
        df = _where(ws[layer.source], layer.keep)
        if "member" in dims:
            own = composite_key("Model", "Model_Scenario") if "Model_Scenario" in df.columns else F.lit(None)
            df = df.withColumn("member", own.cast("string"))
        value = _measure(layer.value, layer.factor, ws.options).alias("value")
        parts.append(df.select(F.lit(layer.series).alias("series"), *dims, value))
    return union_by_name(*parts)


def build_mart(name: str, tables: Workspace | Mapping[str, Table]) -> DataFrame:
    """The dataset ``name`` out of the named input tables."""
    ws = tables if isinstance(tables, Workspace) else Workspace(tables)
    if name in OVERLAYS:
        return _overlay(ws, *OVERLAYS[name])
    mart = MARTS[name]
    df = _where(ws[mart.source], mart.keep)
    dims = list(mart.dims)
    if mart.panel:
        df = df.withColumn("scenario_year", composite_key("scenario", "year"))
        dims.append("scenario_year")
    for col, levels in mart.levels.items():
        df = as_levels(df, col, getattr(ws.options, levels) if isinstance(levels, str) else levels)
        dims.append(f"{col}_ord")
    return df.select(*dims, *[_measure(c, f, ws.options).alias(out) for out, (c, f) in mart.measures.items()])


def mart_order(name: str, options: Options = Options()) -> dict[str, Sequence[str] | None]:
    """The order of a dataset's rows: its columns one after the other, those with declared
    levels by these."""
    if name in OVERLAYS:
        return dict.fromkeys(["series", *OVERLAYS[name][0]])
    mart = MARTS[name]
    levels = {c: getattr(options, v) if isinstance(v, str) else v for c, v in mart.levels.items()}
    return {c: levels.get(c) for c in mart.dims}


def write_marts(
    tables: Mapping[str, Table],
    base: str,
    names: Sequence[str] = tuple(MART_NAMES),
    kind: str = "parquet",
    options: Options = Options(),
    threads: int = 4,
    files: int | None = None,
    resume: bool = False,
) -> None:
    """Write datasets to ``base``, computing what they share once.

    Datasets do not depend on each other, so ``threads`` of them are written at a time.
    With ``files`` each is written in its declared order to that many files at most.
    With ``resume`` shared tables are kept below ``base`` and a run over the same inputs and
    options goes on where an earlier one stopped: what carries the committer's marker,
    shared table or dataset, is not computed again.
    """
    base = base.rstrip("/")
    ws = Workspace(tables, checkpoint=True, options=options, shared=f"{base}/_shared" if resume else None)
    spark = SparkSession.active()
    left = [name for name in names if not (resume and finished(spark, f"{base}/{name}"))]
    built = {name: build_mart(name, ws) for name in left}

    def write(name: str) -> None:
        path = f"{base}/{name}"
        if files is None:
            write_mart(built[name], path, kind)
        else:
            write_ordered(built[name], path, mart_order(name, options), files, kind)

    with ThreadPoolExecutor(threads) as pool:
        list(pool.map(write, built))
