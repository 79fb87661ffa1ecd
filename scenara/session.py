"""Spark session settings the plans are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # AQE sizes shuffle partitions, turns small build sides into broadcasts by
    # their measured size, and splits hot partitions of a sort-merge join
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


PARTITION_BYTES = 256 * 2**20


def shuffle_partitions(shuffle_bytes: float, cores: int) -> int:
    """Partitions that keep each at about 256 MB, and every core busy.

    AQE merges what turns out smaller, so an ample number costs little.
    """
    return max(cores, -int(-shuffle_bytes // PARTITION_BYTES))


def build_session(app_name: str = "scenara", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the toolkit's settings; ``extra`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, shared by driver and executors.

    Where none is set, a local session gets a folder of its own below the
    working directory's warehouse; a cluster session is refused, as executors
    there would write to their own disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")
