"""Datasets stored in a declared order over many files, none of them written by a single task.

Rows are dealt to files by ranges of the order and sorted within each, so file after
file they are in order. The order is by declared levels where a column has them, by
value elsewhere; what is no level, and then what is missing, comes last. The other
columns break ties, so that a level that holds most rows is spread over many files too.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenara.operators import local_table

Order = Mapping[str, Sequence[str] | None]


def order_by(columns: Sequence[str], order: Order) -> list[Column]:
    """Sort expressions of ``order``, the remaining ``columns`` after it."""
    out = []
    for name in [*order, *(c for c in columns if c not in order)]:
        value = F.col(f"`{name}`")
        if order.get(name) is not None:
            place = F.array_position(F.array(*map(F.lit, order[name])), value)
            out.append(F.nullif(place, F.lit(0)).asc_nulls_last())
        out.append(value.asc_nulls_last())
    return out


def write_ordered(df: DataFrame, path: str, order: Order, files: int, kind: str = "parquet") -> None:
    """Write ``df`` to ``files`` files at most, in order within and across them."""
    if kind not in ("parquet", "csv"):
        raise ValueError(f"unknown dataset format: {kind}")
    by = order_by(df.columns, order)
    writer = df.repartitionByRange(files, *by).sortWithinPartitions(*by).write.mode("overwrite")
    writer.csv(path, header=True) if kind == "csv" else writer.parquet(path)


def read_ordered(spark: SparkSession, path: str, position: str = "position") -> DataFrame:
    """A Parquet dataset of ``write_ordered`` with the place of each row, from 0.

    Files are read by any number of tasks: a row's place is its place in its file, which
    the reader knows, after the rows of the files before. The driver gets one count a file.
    """
    rows = spark.read.parquet(path)
    counts = rows.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n")).collect()
    number = lambda r: int(r["file"].split("-")[1])
    before, files, starts = 0, [], []
    for r in sorted(counts, key=number):
        files.append(r["file"])
        starts.append(before)
        before += r["n"]
    if not files:
        return rows.withColumn(position, F.lit(None).cast("long"))
    named = rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    placed = named.join(local_table(spark, {"_file": files, "_start": starts}), "_file")
    return placed.select(*rows.columns, (F.col("_start") + F.col("_index")).alias(position))
