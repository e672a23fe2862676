"""Session settings and lineage cuts."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings every operator is written for. UTC is required: all epoch columns are UTC.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot market's join partition even where the next aggregate could reuse it.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows of whole texts: a batch of the default 10,000 may not fit beside the other tasks of an executor.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def local_session(cpus: int = 8, partitions: int = 8, app: str = "marketlens") -> SparkSession:
    """A local session for tests and the benchmark; a cluster supplies its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Set on a given session what results, skew handling and memory rely on: UTC, forced skew splits, small batches."""
    for key in ("spark.sql.session.timeZone", "spark.sql.adaptive.forceOptimizeSkewedJoin", "spark.sql.execution.arrow.maxRecordsPerBatch"):
        if spark.conf.get(key) != SETTINGS[key]:
            spark.conf.set(key, SETTINGS[key])
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a frame that several later branches read.

    The files go to the shared folder that the cluster names in ``spark.checkpoint.dir``, so a
    lost executor costs nothing but the tasks it held.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, ``spark.checkpoint.dir``. A single-process session (tests) that names none
    gets a temporary one; a cluster that names none is an error, as its hosts would not see each other's files."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return shared.rstrip("/")
