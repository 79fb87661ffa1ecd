"""Membership in a table of members, for lists too long for a literal one.

Both forms are joins without a hint: Spark broadcasts a member table below its size
limit, and merge joins a longer one, where AQE splits hot partitions. Neither repeats a
row, so members may repeat. Missing keys follow the library's rule for lists: they
are no members, and stay outside a list. With ``nulls=True`` a missing member
matches a missing key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _members(members: DataFrame, on: Sequence[str]) -> DataFrame:
    """The member keys without missing ones.

    On strings that is said by a comparison, as Spark prunes the folders of a
    partitioned store at run time only by a table that a comparison filters.
    """
    keys = members.select(*on)
    for name in on:
        text = isinstance(keys.schema[name].dataType, StringType)
        keys = keys.where(F.col(name) >= "" if text else F.col(name).isNotNull())
    return keys


def _joined(df: DataFrame, members: DataFrame, on: Sequence[str], nulls: bool, how: str) -> DataFrame:
    if not nulls:
        return df.join(_members(members, on), list(on), how)
    keys = members.select(*[F.col(k).alias(f"_member_{k}") for k in on])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_member_{k}")) for k in on])
    return df.join(keys, same, how)


def keep_members(df: DataFrame, members: DataFrame, on: str | Sequence[str], nulls: bool = False) -> DataFrame:
    """Rows whose key columns ``on`` are a row of ``members``."""
    return _joined(df, members, [on] if isinstance(on, str) else on, nulls, "left_semi")


def drop_members(df: DataFrame, members: DataFrame, on: str | Sequence[str], nulls: bool = False) -> DataFrame:
    """Rows whose key columns ``on`` are no row of ``members``, missing keys included."""
    return _joined(df, members, [on] if isinstance(on, str) else on, nulls, "left_anti")
