from scenara.operators.audit import LookupAudit, attach_unique, unique_mapping  # noqa: F401
from scenara.operators.compare import compare_pairs, diff_families, diff_from_scenario  # noqa: F401
from scenara.operators.membership import drop_members, keep_members  # noqa: F401
from scenara.operators.reshape import (  # noqa: F401
    as_levels,
    complete_cases,
    composite_key,
    convert_units,
    relabel,
    split_column,
    union_by_name,
    wide_to_long,
)
from scenara.operators.rollup import (  # noqa: F401
    attach_mapping,
    attach_total,
    local_table,
    rollup_groups,
    rollup_sum,
    with_net,
)
