from scenara.functions.columns import (  # noqa: F401
    cumsum_strict,
    floor_zero,
    if_else_strict,
    not_in,
    s_curve,
    sum_exact,
    sum_strict,
    to_number,
    warming_band,
)
