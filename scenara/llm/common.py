"""Helpers the operators share: written tables, row keys, text buffers, ranks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenara.session import checkpoint_folder

NO_ID = -(2**63)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    Cuts the lineage: a lost executor costs a reread, not a recomputation. The
    folder is the one the session names in ``spark.checkpoint.dir``.
    """
    return stored_at(df, name)[0]


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``stored`` with the path, for tables that are ``removed`` when their successor is written."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table of ``stored_at`` that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """All columns of ``docs`` in the struct ``row``, whatever their names, beside ``columns``."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, *[c.alias(name) for name, c in columns.items()])


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` out of ``row``."""
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` narrowed to ``doc_id``, ``text`` and a row key ``k1``, ``k2``.

    Rows of equal id and text share a key; they are copies and get the same
    result. A missing text is the empty text, a missing id a fixed number.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", text.alias("text"), F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("k1"), F.xxhash64(text).alias("k2")
    )


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column, without a copy per row, and the n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows that hold about ``most`` bytes; a longer row stands alone."""
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), len(offsets) - 1)
        yield first, last
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15 | 1


class Rolling:
    """Hashes of substrings from prefix sums of a polynomial modulo 2**64."""

    def __init__(self) -> None:
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        self.size = n
        up = np.full(n + 1, BASE, np.uint64)
        down = np.full(n + 1, pow(BASE, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        if len(data) > self.size:
            self._grow(len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.down[start])

    def grams(self, prefix: np.ndarray, k: int) -> np.ndarray:
        n = max(0, len(prefix) - k)
        return mix((prefix[k:] - prefix[:n]) * self.down[:n])


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs free of space, tab, \\n, \\v, \\f and \\r."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def salted_rank(df: DataFrame, keys: list[str], order: list[Column], salts: int, name: str = "rank") -> DataFrame:
    """``df`` with each row's rank (from 0) among the rows of its ``keys``.

    A key may hold any share of the rows: rows are numbered within (key, salt),
    and each pair is shifted by the counts of the salts before it. The table of
    counts has at most ``salts`` rows for a key.
    """
    salted = df.withColumn("_salt", F.pmod(F.hash(*order), F.lit(salts)))
    within = Window.partitionBy(*keys, "_salt").orderBy(*order)
    counts = salted.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(*keys, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    left = salted.withColumn("_row", F.row_number().over(within) - 1)
    renamed = shift.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_salt").alias("_k__salt"), "_before")
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in [*keys, "_salt"]]
    joined = left.join(renamed, on, "left")
    return joined.withColumn(name, F.col("_row") + F.col("_before")).select(*df.columns, name)
