"""Declared schemas, so that no read needs an inference pass."""

from __future__ import annotations

from pyspark.sql import types as T

from scenara import vocabulary as V

_KINDS = {"year": T.IntegerType()}
_DOUBLES = {"value", "Bcm", "Tcf", "EJ", "SAR", "AR5", "AR4", "SARall", "AR5all", "AR4all"}


def table(*names: str) -> T.StructType:
    """String columns, but for the well-known numeric names."""
    return T.StructType(
        [T.StructField(n, T.DoubleType() if n in _DOUBLES else _KINDS.get(n, T.StringType())) for n in names]
    )


REGION_MAPPING = table("region", "grouped_region")
TECHNOLOGY_MAPPING = table("sector", "technology")
GAS_FACTORS = table("ghg", "SAR", "AR5", "AR4", "SARall", "AR5all", "AR4all")
LITERATURE_WORLD = table("scenario", "year", "Bcm", "Tcf", "EJ")
LITERATURE_REGION = table("scenario", "grouped_region", "year", "Bcm", "Tcf", "EJ")
LITERATURE_CO2 = table("scenario", "year", "value")


def ensemble(years=V.ENSEMBLE_YEARS) -> T.StructType:
    """Wide ensemble table: five labels, then one column per year."""
    labels = table("Model", "Scenario", "Region", "Variable", "Unit")
    return T.StructType(labels.fields + [T.StructField(str(y), T.DoubleType()) for y in years])


_FLOW = ("Units", "scenario", "region", "sector", "subsector", "technology")

# the model's named query results
NAMED_TABLES = {
    "regional_gas": table(*_FLOW, "year", "value"),
    "traded_gas": table(*_FLOW, "output", "year", "value"),
    "traded_gas_vintage": table(*_FLOW, "output", "year", "value"),
    "regional_gas_vintage": table("Units", "scenario", "region", "technology", "year", "value"),
    "primary_energy": table("Units", "scenario", "region", "fuel", "year", "value"),
    "primary_energy_ccs": table("Units", "scenario", "region", "fuel", "year", "value"),
    "electricity": table("scenario", "region", "technology", "year", "value"),
    "final_energy": table("scenario", "region", "input", "year", "value"),
    "resource_production": table("Units", "scenario", "region", "resource", "year", "value"),
    "sector_emissions": table("Units", "scenario", "region", "sector", "ghg", "year", "value"),
    "resource_emissions": table("Units", "scenario", "region", "resource", "subresource", "ghg", "year", "value"),
    "land_use_emissions": table("scenario", "region", "year", "value"),
    "technology_emissions": table(*_FLOW, "ghg", "year", "value"),
}
