"""Keyed sums, look-ups and totals.

No join here carries a broadcast hint. Spark broadcasts a look-up only when
its size - the file's, the local table's, or under AQE the measured one - is
below ``spark.sql.autoBroadcastJoinThreshold``; a larger one is sort-merge
joined, and AQE splits the hot partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenara.functions.columns import sum_strict, sum_strict_over


def local_table(spark: SparkSession, columns: Mapping[str, Sequence]) -> DataFrame:
    """A small constant table; as Arrow it keeps its exact size for the planner."""
    return spark.createDataFrame(pa.table(dict(columns)))


def rollup_sum(df: DataFrame, keys: Sequence[str], values: Sequence[str] = ("value",)) -> DataFrame:
    """Strict sum of each measure by ``keys``; partial sums run before the shuffle."""
    return df.groupBy(*keys).agg(*[sum_strict(v).alias(v) for v in values])


def attach_mapping(df: DataFrame, mapping: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Left look-up; rows without a match get nulls."""
    return df.join(mapping, [on] if isinstance(on, str) else list(on), "left")


def group_table(spark: SparkSession, groups: Mapping[str, Sequence[str]], member: str, group: str) -> DataFrame:
    pairs = [(m, g) for g, members in groups.items() for m in members]
    return local_table(spark, {member: [m for m, _ in pairs], group: [g for _, g in pairs]})


def rollup_groups(
    df: DataFrame,
    member_col: str,
    groups: Mapping[str, Sequence[str]] | DataFrame,
    keys: Sequence[str],
    value: str = "value",
) -> DataFrame:
    """Totals of named member sets in one pass, labelled in ``member_col``.

    ``groups`` is a dict or a table ``(member_col, group_name)``; members of
    no set drop out, and a member of two sets counts in both.
    """
    if isinstance(groups, Mapping):
        groups = group_table(df.sparkSession, groups, member_col, "group_name")
    return (
        df.join(groups, member_col)
        .groupBy(*keys, "group_name")
        .agg(sum_strict(value).alias(value))
        .withColumnRenamed("group_name", member_col)
    )


def with_net(df: DataFrame, keys: Sequence[str], value: str = "value", out: str = "value_net") -> DataFrame:
    """Total by ``keys`` beside each row of an already rolled-up table.

    One row per category stands in each window, so a window is as small as the
    list of categories. For raw rows use ``attach_total``.
    """
    return df.withColumn(out, sum_strict_over(value, Window.partitionBy(*keys)))


def attach_total(df: DataFrame, keys: Sequence[str], value: str = "value", out: str = "value_net") -> DataFrame:
    """Total by ``keys`` beside each raw row.

    The total is summed with partial aggregation and joined back, null keys
    matching each other, so that no key's rows have to meet in one task.
    """
    total = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(sum_strict(value).alias(out))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return df.join(total, same, "left").drop(*[f"_{k}" for k in keys])
