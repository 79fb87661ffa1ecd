"""Column expressions whose null handling differs from Spark's defaults.

A missing value is treated as *unknown* throughout: it makes sums, running
sums and conditions unknown instead of being skipped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from scenara import vocabulary as V


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sum_strict(c: Column | str) -> Column:
    """Sum that is null when any member is null."""
    c = _col(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


PART_BITS = 20
LARGEST_EXACT = float(2**42)


def sum_exact(c: Column | str) -> Column:
    """``sum_strict`` whose bits do not depend on the order of the rows.

    Doubles round at each addition, so that plain sums change with the partitioning. Here a
    value is split into whole multiples of 2**-20, 2**-40 and 2**-60, whose sums commute and are
    put together once. What is below 2**-60 is rounded away; values of 2**42 and more,
    not-a-number, and sums of parts that do not fit a long stop the query.
    """
    c = _col(c).cast("double")
    step = F.lit(float(2**PART_BITS))
    too_large = F.raise_error(F.lit("a value is too large for an exact sum")).cast("long")
    fits = F.abs(c) < LARGEST_EXACT
    scaled = F.when(fits, c * step)
    upper = F.when(fits, F.floor(scaled)).when(c.isNotNull(), too_large)
    rest = (scaled - F.floor(scaled)) * step
    middle, lower = F.floor(rest), F.rint((rest - F.floor(rest)) * step).cast("long")
    low = F.sum(lower)
    mid = F.sum(middle) + F.shiftright(low, PART_BITS)
    high = F.sum(upper) + F.shiftright(mid, PART_BITS)
    under = lambda part, n: F.pmod(part, F.lit(2**PART_BITS)) / F.lit(float(2 ** (PART_BITS * n)))
    total = high / step + (under(mid, 2) + under(low, 3))
    return F.when(F.count(c) == F.count(F.lit(1)), total)


def sum_strict_over(c: Column | str, window: WindowSpec) -> Column:
    """``sum_strict`` as a window expression."""
    c = _col(c)
    complete = F.count(c).over(window) == F.count(F.lit(1)).over(window)
    return F.when(complete, F.sum(c).over(window))


def cumsum_strict(c: Column | str, keys: Sequence[str], order: str = "year") -> Column:
    """Running sum by ``order`` within ``keys``; null from the first null on."""
    running = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return sum_strict_over(c, running)


def if_else_strict(condition: Column, yes, no) -> Column:
    """``yes`` or ``no`` by ``condition``; null where the condition is unknown."""
    return F.when(condition, yes).when(~condition, no)


def not_in(c: Column | str, values: Sequence) -> Column:
    """True for every value outside ``values``, a null included."""
    return ~F.coalesce(_col(c).isin(list(values)), F.lit(False))


def floor_zero(c: Column | str) -> Column:
    """Negative values to zero, nulls kept."""
    c = _col(c)
    return F.when(c < 0, F.lit(0.0)).otherwise(c)


def to_number(c: Column | str, kind: str = "double") -> Column:
    """Numeric value of a string; null where it is not a number."""
    return _col(c).try_cast(kind)


def s_curve(
    year: Column | str,
    vintage: Column | str,
    half_life: float = V.S_CURVE_HALF_LIFE,
    steepness: float = V.S_CURVE_STEEPNESS,
    lifetime: float = V.S_CURVE_LIFETIME,
) -> Column:
    """Share of a vintage still running: logistic in its age, nothing from ``lifetime`` on."""
    age = _col(year) - _col(vintage)
    logistic = 1 / (1 + F.exp(F.lit(steepness) * (age - F.lit(half_life))))
    return (
        F.when(age >= lifetime, F.lit(0.0))
        .when(age > 0, logistic)
        .otherwise(F.lit(1.0))
    )


def warming_band(
    c: Column | str,
    cuts: Sequence[float] = tuple(V.WARMING_CUTS),
    labels: Sequence[str] = tuple(V.WARMING_LEVELS),
) -> Column:
    """Label of the half-open band ``[cut, next cut)`` a value falls into."""
    c = _col(c)
    band = F.when(c < cuts[0], labels[0])
    for upper, label in zip(cuts[1:], labels[1:]):
        band = band.when(c < upper, label)
    return band.when(c >= cuts[-1], labels[len(cuts)])
