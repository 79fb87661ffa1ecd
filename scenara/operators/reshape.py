"""Row-wise reshaping of long and wide tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenara.functions import to_number


def split_column(df: DataFrame, col: str, into: Sequence[str | None], sep: str) -> DataFrame:
    """Split ``col`` at the regex ``sep`` into new columns that replace it.

    A ``None`` in ``into`` discards its piece. Extra pieces are dropped and
    missing ones are null.
    """
    pieces = F.split(F.col(col), sep)
    new = [F.get(pieces, i).alias(name) for i, name in enumerate(into) if name is not None]
    kept = [c for c in df.columns if c != col and c not in into]
    return df.select(*kept, *new)


def wide_to_long(
    df: DataFrame,
    value_cols: Sequence[int | str],
    name: str = "year",
    value: str = "value",
    ids: Sequence[str] | None = None,
) -> DataFrame:
    """One row per year column, nulls kept, the column name as an integer."""
    cols = [str(c) for c in value_cols]
    if ids is None:
        ids = [c for c in df.columns if c not in set(cols)]
    long = df.unpivot(list(ids), cols, name, value)
    return long.withColumn(name, to_number(name, "int"))


def as_levels(df: DataFrame, col: str, levels: Sequence[str], ordinal: bool = True) -> DataFrame:
    """Keep only the declared levels of ``col``, anything else becomes null.

    ``<col>_ord`` holds the position of the level, to sort by.
    """
    c = F.col(col)
    levels = list(levels)
    if ordinal:
        position = F.array_position(F.array(*map(F.lit, levels)), c)
        df = df.withColumn(f"{col}_ord", (F.nullif(position, F.lit(0)) - 1).cast("int"))
    return df.withColumn(col, F.when(c.isin(levels), c))


def relabel(df: DataFrame, col: str, labels: Mapping[str, str], out: str | None = None) -> DataFrame:
    """Replace the values named in ``labels``, leave the others."""
    pairs = [F.lit(x) for pair in labels.items() for x in pair]
    mapped = F.create_map(*pairs)[F.col(col)]
    return df.withColumn(out or col, F.coalesce(mapped, F.col(col)))


def composite_key(*cols: Column | str, sep: str = ".") -> Column:
    """One label out of several columns; null if any part is null."""
    parts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    return F.concat(*[x for p in parts for x in (F.lit(sep), p)][1:])


def complete_cases(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows without a null, as plain predicates that reach the scan and the joins."""
    tests = [F.col(f"`{c}`").isNotNull() for c in (cols or df.columns)]
    return df.where(reduce(Column.__and__, tests))


def union_by_name(*frames: DataFrame) -> DataFrame:
    """All rows of all frames by column name, absent columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def convert_units(df: DataFrame, factor: float, unit: str | None = None, value: str = "value") -> DataFrame:
    """Scale ``value`` and, if given, restate ``Units``."""
    df = df.withColumn(value, F.col(value) * F.lit(float(factor)))
    return df if unit is None else df.withColumn("Units", F.lit(unit))
