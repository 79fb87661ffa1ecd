"""Readers and writers for look-ups, series, named tables and finished datasets."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from scenara import schemas
from scenara import vocabulary as V


def _text_columns(spark: SparkSession, path: str) -> DataFrame:
    """CSV as text under its header; empty cells and ``NA`` are missing.

    All files of a folder need the same header.
    """
    return spark.read.csv(path, header=True, nullValue="NA", emptyValue="NA", enforceSchema=False)


def _typed(field: StructField, bad_numbers: str) -> Column:
    text = F.col(f"`{field.name}`")
    if isinstance(field.dataType, StringType):
        return text
    number = text.try_cast(field.dataType)
    if bad_numbers == "fail":
        bad = F.raise_error(F.concat(F.lit(f"no {field.dataType.simpleString()} in {field.name}: "), text))
        number = F.when(text.isNotNull() & number.isNull(), bad).otherwise(number)
    return number.alias(field.name)


def _declared(text: DataFrame, schema: StructType, path: str, bad_numbers: str) -> DataFrame:
    if bad_numbers not in ("fail", "null"):
        raise ValueError(f"unknown way with bad numbers: {bad_numbers}")
    missing = [n for n in schema.names if n not in text.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    return text.select(*[_typed(f, bad_numbers) for f in schema.fields])


def read_csv_table(spark: SparkSession, path: str, schema: StructType, bad_numbers: str = "fail") -> DataFrame:
    """CSV whose columns are found by their header and cast to ``schema``.

    Their order and further columns do not matter; an absent one raises. A cell
    that is no number of its column's type stops the query, or is missing with
    ``bad_numbers="null"``. Byte-order marks and CRLF are left to Spark's reader.
    """
    return _declared(_text_columns(spark, path), schema, path, bad_numbers)


def read_csv_checked(spark: SparkSession, path: str, schema: StructType, rejects: str = "_rejects") -> DataFrame:
    """``read_csv_table`` that keeps bad cells beside the rows, in one read.

    A bad cell is missing in its row, and ``rejects`` lists its file, column and text;
    it is empty for a good row. ``good_rows`` and ``rejected_cells`` tell the two apart.
    """
    text = _text_columns(spark, path).select("*", F.col("_metadata.file_name").alias(rejects))
    missing = [n for n in schema.names if n not in text.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    cells = []
    for f in schema.fields:
        if not isinstance(f.dataType, StringType):
            cell = F.col(f"`{f.name}`")
            bad = cell.isNotNull() & cell.try_cast(f.dataType).isNull()
            entry = F.struct(F.col(rejects).alias("file"), F.lit(f.name).alias("column"), cell.alias("text"))
            cells.append(F.when(bad, entry))
    found = F.array_compact(F.array(*cells)) if cells else F.array().cast("array<struct<file:string,column:string,text:string>>")
    return text.select(*[_typed(f, "null") for f in schema.fields], found.alias(rejects))


def good_rows(checked: DataFrame, rejects: str = "_rejects") -> DataFrame:
    """Rows of ``read_csv_checked`` without a bad cell."""
    return checked.where(F.size(rejects) == 0).drop(rejects)


def rejected_cells(checked: DataFrame, rejects: str = "_rejects") -> DataFrame:
    """``file``, ``column`` and ``text`` of every bad cell of ``read_csv_checked``."""
    return checked.select(F.inline(rejects))


def read_region_mapping(spark: SparkSession, path: str) -> DataFrame:
    """``region`` to ``grouped_region``."""
    return read_csv_table(spark, path, schemas.REGION_MAPPING)


def read_technology_mapping(spark: SparkSession, path: str) -> DataFrame:
    """``technology`` to ``sector``."""
    return read_csv_table(spark, path, schemas.TECHNOLOGY_MAPPING)


def read_gas_factors(spark: SparkSession, path: str) -> DataFrame:
    """Warming factors by gas."""
    return read_csv_table(spark, path, schemas.GAS_FACTORS)


def read_literature_world(spark: SparkSession, path: str) -> DataFrame:
    return read_csv_table(spark, path, schemas.LITERATURE_WORLD)


def read_literature_region(spark: SparkSession, path: str) -> DataFrame:
    return read_csv_table(spark, path, schemas.LITERATURE_REGION)


def read_literature_co2(spark: SparkSession, path: str) -> DataFrame:
    return read_csv_table(spark, path, schemas.LITERATURE_CO2)


def read_ensemble(spark: SparkSession, path: str, bad_numbers: str = "fail") -> DataFrame:
    """Wide ensemble CSV with its own year columns; only those a query uses are parsed."""
    text = _text_columns(spark, path)
    years = [int(c) for c in text.columns if c.isdigit()]
    return _declared(text, schemas.ensemble(years), path, bad_numbers)


def _folder(base: str, name: str) -> str:
    return f"{base.rstrip('/')}/query={name}"


def write_named_table(df: DataFrame, base: str, name: str) -> None:
    """Store a query result under its name, one folder per name and scenario.

    Nearly every dataset asks for some scenarios only, so those are the
    partitions; the rebalance gives a large scenario many files and a small
    one few.
    """
    cols = schemas.NAMED_TABLES[name].names
    spread = df.select(*cols).hint("rebalance", "scenario")
    spread.write.mode("overwrite").partitionBy("scenario").parquet(_folder(base, name))


def table_name(name_or_title: str) -> str:
    """The name of a model table given by name or by published title."""
    named = {title: name for name, title in V.TABLE_TITLES.items()}
    name = named.get(name_or_title, name_or_title)
    if name not in schemas.NAMED_TABLES:
        raise KeyError(f"no model table is called {name_or_title}")
    return name


def read_named_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One table of a store, by name or title; the other tables' files are not touched."""
    name = table_name(name)
    schema = schemas.NAMED_TABLES[name]
    return spark.read.schema(schema).parquet(_folder(base, name)).select(*schema.names)


def write_store(tables: Mapping[str, DataFrame | Callable[[], DataFrame]], base: str) -> None:
    """Store every named table among ``tables``, so that datasets need not derive them again."""
    for name in schemas.NAMED_TABLES:
        if name in tables:
            table = tables[name]
            write_named_table(table() if callable(table) else table, base, name)


def read_store(spark: SparkSession, base: str) -> dict[str, Callable[[], DataFrame]]:
    """Loaders of a store's named tables; a table is read when it is first used."""
    return {name: partial(read_named_table, spark, base, name) for name in schemas.NAMED_TABLES}


MAPPING_READERS = {
    "region_groups": read_region_mapping,
    "literature_region_groups": read_region_mapping,
    "tech_sectors": read_technology_mapping,
    "gas_factors": read_gas_factors,
}
COMPARISON_READERS = {
    "literature_lng": read_literature_world,
    "literature_pipeline": read_literature_world,
    "literature_gas": read_literature_world,
    "literature_production": read_literature_region,
    "literature_consumption": read_literature_region,
    "literature_co2": read_literature_co2,
}


def load_tables(
    spark: SparkSession,
    store: str,
    mappings: Mapping[str, str],
    comparison: Mapping[str, str] | None = None,
    ensemble: str | None = None,
) -> dict[str, Callable[[], DataFrame]]:
    """Loaders of all inputs of the datasets, under the names ``build_mart`` asks for.

    ``store`` is a folder of ``write_store``; ``mappings`` and ``comparison`` give
    the CSV path of each table of ``MAPPING_READERS`` and ``COMPARISON_READERS``
    that the wanted datasets need; ``ensemble`` is the path of the wide ensemble
    CSV. A file is read when its table is first used; an unknown name raises.
    """
    tables = read_store(spark, store)
    for paths, readers in [(mappings, MAPPING_READERS), (comparison or {}, COMPARISON_READERS)]:
        for name, path in paths.items():
            if name not in readers:
                raise KeyError(f"{name} is none of {sorted(readers)}")
            tables[name] = partial(readers[name], spark, path)
    if ensemble is not None:
        tables["ensemble"] = partial(read_ensemble, spark, ensemble)
    return tables


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` was committed: its marker is the committer's own."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def write_mart(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write a finished dataset as ``parquet`` or ``csv`` part files."""
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.csv(path, header=True)
    elif kind == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown dataset format: {kind}")
