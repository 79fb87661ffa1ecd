from scenara.sources.ordered import read_ordered, write_ordered  # noqa: F401
from scenara.sources.tables import (  # noqa: F401
    good_rows,
    load_tables,
    read_csv_checked,
    read_csv_table,
    read_ensemble,
    read_gas_factors,
    read_literature_co2,
    read_literature_region,
    read_literature_world,
    read_named_table,
    read_region_mapping,
    read_store,
    read_technology_mapping,
    rejected_cells,
    write_mart,
    write_named_table,
    write_store,
)
from scenara.sources.versions import current_versions, drop_unused, read_refreshed, refresh_scenarios  # noqa: F401
