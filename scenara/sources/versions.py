"""Refresh single scenarios of a stored table that others are reading.

Each write goes to a folder of its own, ``query=<name>/version=<id>/scenario=<s>``, which
nobody reads yet. Then a one-line pointer, ``query=<name>/current``, is exchanged: it
names the version of each scenario. A reader follows the pointer it finds and
so sees all of a write or nothing of it; files that it has begun to read stay where they
are. Scenarios that a write does not hold keep their version, and their files are
neither read nor written again.

A table has one writer at a time. Versions that the pointer no longer names are
left for running readers; ``drop_unused`` removes them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from scenara import schemas
from scenara.sources.tables import table_name

POINTER = "current"


def _table(base: str, name: str) -> str:
    return f"{base.rstrip('/')}/query={table_name(name)}"


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below ``path``."""
    fs, target = _file_system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(target) if s.isDirectory()] if fs.exists(target) else []


def current_versions(spark: SparkSession, base: str, name: str) -> dict[str, str]:
    """The version folder of each ``scenario=`` folder; empty for a table never written."""
    path = f"{_table(base, name)}/{POINTER}"
    fs, target = _file_system(spark, path)
    if not fs.exists(target):
        return {}
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def _point(spark: SparkSession, base: str, name: str, versions: dict[str, str]) -> None:
    """Exchange the pointer in one step: a reader finds the old line or the new one."""
    path = f"{_table(base, name)}/{POINTER}"
    fs, written = _file_system(spark, f"{path}-{uuid.uuid4().hex}")
    out = fs.create(written, False)
    out.write(bytearray(json.dumps(versions, sort_keys=True).encode()))
    out.close()
    jvm = spark._jvm
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark._sc._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(written), fs.makeQualified(_file_system(spark, path)[1]), options)


def refresh_scenarios(df: DataFrame, base: str, name: str, gone: Sequence[str] = ()) -> list[str]:
    """Replace the scenarios that ``df`` holds; the others stay as they are.

    ``gone`` names ``scenario=`` folders that are dropped, as ``current_versions`` lists
    them. Returns the replaced folders. Empty ``df`` replaces none.
    """
    spark = df.sparkSession
    version = f"version={uuid.uuid4().hex}"
    columns = schemas.NAMED_TABLES[table_name(name)].names
    folder = f"{_table(base, name)}/{version}"
    df.select(*columns).hint("rebalance", "scenario").write.partitionBy("scenario").parquet(folder)
    replaced = [f for f in _folders(spark, folder) if f.startswith("scenario=")]
    kept = {s: v for s, v in current_versions(spark, base, name).items() if s not in gone}
    _point(spark, base, name, {**kept, **dict.fromkeys(replaced, version)})
    return sorted(replaced)


def read_refreshed(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The table as its pointer stands now; scenario filters prune folders."""
    schema = schemas.NAMED_TABLES[table_name(name)]
    folder = _table(base, name)
    paths = [f"{folder}/{v}/{s}" for s, v in sorted(current_versions(spark, base, name).items())]
    if not paths:
        return spark.createDataFrame([], schema).select(*schema.names)
    return spark.read.schema(schema).option("basePath", folder).parquet(*paths).select(*schema.names)


def drop_unused(spark: SparkSession, base: str, name: str) -> list[str]:
    """Remove scenario folders that the pointer does not name; call it when nobody reads them."""
    folder = _table(base, name)
    used = {f"{v}/{s}" for s, v in current_versions(spark, base, name).items()}
    dropped = []
    for version in (v for v in _folders(spark, folder) if v.startswith("version=")):
        held = _folders(spark, f"{folder}/{version}")
        unused = [f"{version}/{s}" for s in held if f"{version}/{s}" not in used]
        for path in [version] if len(unused) == len(held) else unused:
            fs, target = _file_system(spark, f"{folder}/{path}")
            fs.delete(target, True)
        dropped += unused
    return sorted(dropped)
