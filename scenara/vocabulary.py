"""Names, levels, groups and parameters of the scenario data model."""

# ---------------------------------------------------------------------------
# Fixed values. These must equal the published model vocabulary: scenario
# names, sector and fuel labels, level orders, category groups, unit factors
# and ageing parameters.
# ---------------------------------------------------------------------------

PAPER_SCENARIOS = [
    "Reference",
    "Transition",
    "Reference_LLS",
    "Transition_LLS",
    "Reference_LT_sshc",
    "Transition_LT_sshc",
]

SCENARIO_LABELS = {
    "Reference": "Reference",
    "Transition": "Transition",
    "Reference_LLS": "Reference_LLS",
    "Transition_LLS": "Transition_LLS",
    "Reference_LT_sshc": "Reference_LT",
    "Transition_LT_sshc": "Transition_LT",
}

# bar order of the cumulative datasets, bottom to top
SCENARIO_BAR_LEVELS = [
    "Transition_LT_sshc",
    "Transition_LLS",
    "Transition",
    "Reference_LT_sshc",
    "Reference_LLS",
    "Reference",
]

# panel order of the cost dataset
SCENARIO_PANEL_LEVELS = [
    "Reference",
    "Reference_LLS",
    "Reference_LT_sshc",
    "Transition",
    "Transition_LLS",
    "Transition_LT_sshc",
]

PIPELINE_SECTORS = [
    "traded Afr_MidE pipeline gas",
    "traded EUR pipeline gas",
    "traded LA pipeline gas",
    "traded N.Amer pipeline gas",
    "traded PAC pipeline gas",
    "traded RUS pipeline gas",
]
LNG_SECTOR = "traded LNG"
TRADED_SECTORS = PIPELINE_SECTORS + [LNG_SECTOR]
TRADED_SECTOR_LEVELS = [LNG_SECTOR] + PIPELINE_SECTORS
TRADED_CCS_SECTORS = [s + " CCS" for s in TRADED_SECTORS]

DOMESTIC_GAS = "domestic natural gas"
IMPORT_TECHNOLOGY_LEVELS = [
    DOMESTIC_GAS,
    "imported LNG",
    "imported Afr_MidE pipeline gas",
    "imported EUR pipeline gas",
    "imported LA pipeline gas",
    "imported N.Amer pipeline gas",
    "imported PAC pipeline gas",
    "imported RUS pipeline gas",
]
BALANCING_SUBSECTOR = "statistical differences"

TRADE_SECTOR_LEVELS = ["LNG", "Afr_MidE", "EUR", "LA", "N.Amer", "PAC", "RUS"]
DOMESTIC_SECTOR_LEVELS = ["domestic"] + TRADE_SECTOR_LEVELS

GROUPED_REGION_LEVELS = [
    "USA",
    "Middle East",
    "Russia",
    "Europe",
    "SE.Asia",
    "Can.+Mex.",
    "Africa",
    "C.Asia+E.Eur",
    "LAC",
    "China",
    "Australia+NZ",
    "S.Asia",
    "India",
    "E.Asia",
]
FLIPPED_GROUPED_REGION_LEVELS = GROUPED_REGION_LEVELS[::-1]

NATURAL_GAS_FUEL = "b natural gas"
NATURAL_GAS_CCS_FUEL = "b natural gas CCS"
PRIMARY_FUELS = [
    "a oil",
    "b natural gas",
    "c coal",
    "d biomass",
    "e nuclear",
    "f hydro",
    "g wind",
    "h solar",
    "i geothermal",
    "j traditional biomass",
]
PRIMARY_CCS_FUELS = [
    "a oil",
    "a oil CCS",
    "b natural gas",
    "b natural gas CCS",
    "c coal",
    "c coal CCS",
    "d biomass",
    "d biomass CCS",
    "e nuclear",
    "f hydro",
    "g wind",
    "h solar",
    "i geothermal",
    "j traditional biomass",
]

# emission sectors by reporting group; members never overlap
EMISSION_GROUPS = {
    "Buildings": [
        "comm cooling",
        "comm heating",
        "comm others",
        "resid cooling",
        "resid heating",
        "resid others",
        "district heat",
    ],
    "Electricity": [
        "backup_electricity",
        "elec_biomass (IGCC CCS)",
        "elec_biomass (IGCC)",
        "elec_biomass (conv CCS)",
        "elec_biomass (conv)",
        "elec_coal (IGCC CCS)",
        "elec_coal (IGCC)",
        "elec_coal (conv pul CCS)",
        "elec_coal (conv pul)",
        "elec_gas (CC CCS)",
        "elec_gas (CC)",
        "elec_gas (steam/CT)",
        "elec_refined liquids (CC CCS)",
        "elec_refined liquids (CC)",
        "elec_refined liquids (steam/CT)",
        "electricity",
        "electricity_net_ownuse",
        "csp_backup",
    ],
    "Transportation": [
        "trn_aviation_intl",
        "trn_freight",
        "trn_freight_road",
        "trn_pass",
        "trn_pass_road",
        "trn_pass_road_LDV",
        "trn_pass_road_LDV_4W",
        "trn_shipping_intl",
    ],
    "Industry": [
        "N fertilizer",
        "cement",
        "industrial energy use",
        "industrial feedstocks",
        "industrial processes",
        "process heat cement",
    ],
    "Urban": ["desalinated water", "urban processes"],
    "Agriculture and Land Use": [
        "Corn",
        "FiberCrop",
        "FodderGrass",
        "FodderHerb",
        "MiscCrop",
        "OilCrop",
        "OtherGrain",
        "PalmFruit",
        "Rice",
        "RootTuber",
        "SugarCrop",
        "Wheat",
        "biomass",
        "UnmanagedLand",
        "regional biomass",
        "regional biomassOil",
        "regional corn for ethanol",
        "regional sugar for ethanol",
        "Beef",
        "Dairy",
        "Pork",
        "Poultry",
        "SheepGoat",
    ],
    "Transformation": [
        "gas pipeline",
        "gas processing",
        "refining",
        "H2 central production",
        "H2 forecourt production",
    ],
    "Resource Production": ["coal", "unconventional oil", "crude oil", "natural gas"],
}
LAND_USE_SECTOR = "LUC"
LAND_USE_GROUP = "Agriculture and Land Use"

GAS_SUBSECTORS = ["gas", "gas (CC)", "gas (steam/CT)", "gas pipeline", "gas to liquids"]
GAS_TECHNOLOGY = "NG"
GAS_RESOURCE = "natural gas"

WARMING_VARIABLE = (
    "AR6 climate diagnostics|Surface Temperature (GSAT)|MAGICCv7.5.3|50.0th Percentile"
)
WARMING_LEVELS = ["A_below 1.5C", "B_1.5-2C", "C_2-3C", "D_3-4C", "E_above 4C"]
WARMING_CUTS = [1.5, 2.0, 3.0, 4.0]
PRIMARY_GAS_VARIABLE = "Primary Energy|Gas"
PRIMARY_ENERGY_VARIABLE = "Primary Energy"
GAS_POWER_VARIABLE = "Secondary Energy|Electricity|Gas"
FOSSIL_CO2_VARIABLE = "Emissions|CO2|Energy and Industrial Processes"

# unit factors
EJ_TCF = 0.981
EJ_TWH_REPORTED = 277.778
CARBON_TO_CO2 = 44 / 12
MJ_BTU = 947.777
BTU_CF = 1 / 1027
CF_TON_LNG = 1 / 48700
EJ_MTPA = MJ_BTU * BTU_CF * CF_TON_LNG * 10**6

# ageing and cost parameters
BASE_VINTAGE = 2015
S_CURVE_HALF_LIFE = 23
S_CURVE_STEEPNESS = 0.2
S_CURVE_LIFETIME = 45
LNG_UNIT_COST = 2.02
PIPELINE_UNIT_COST = 0.57
CAPITAL_CHARGE = 0.13
PERIOD_YEARS = 5

FIRST_YEAR, LAST_YEAR = 2015, 2050
ENSEMBLE_YEARS = list(range(1995, 2101))
ENSEMBLE_PLOT_YEARS = list(range(2020, 2051))

# titles under which the model's query results are stored
TABLE_TITLES = {
    "regional_gas": "regional natural gas by tech (nest)",
    "traded_gas": "traded gas by tech",
    "traded_gas_vintage": "traded gas by tech and vintage",
    "regional_gas_vintage": "regional natural gas by tech and vintage",
    "primary_energy": "primary energy consumption by region (direct equivalent)",
    "primary_energy_ccs": "primary energy consumption with CCS by region (direct equivalent)",
    "electricity": "elec gen by gen tech",
    "final_energy": "final energy consumption by sector and fuel",
    "resource_production": "resource production",
    "sector_emissions": "nonCO2 emissions by sector",
    "resource_emissions": "nonCO2 emissions by resource production",
    "land_use_emissions": "LUC emissions by region",
    "technology_emissions": "emissions by technology",
}
