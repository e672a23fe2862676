"""Tables that are replaced whole, on shared storage.

A table is a folder with ``data/`` and ``log/``. Each load writes a new folder under ``data`` and then one line under
``log`` that names it; the line is created exclusively, so of two writers that saw the same version one commits and the
other merges again. Readers take the newest complete line: they see a whole old or a whole new table, never a mixture. A
load has a name, and a name that is in the log changes nothing when it is sent again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.sources import normalise as N

_LINE = "version long, load string, folder string"


def history(spark: SparkSession, root: str) -> DataFrame | None:
    """version, load, folder of every committed load; None before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/log")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    # A line that a writer has not finished is no JSON yet and is no version.
    return spark.read.text(f"{root}/log").select(F.from_json("value", _LINE).alias("x")).select("x.*").where("version IS NOT NULL AND folder IS NOT NULL")


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    """The table as of a version, the newest by default; None if there is none. The frame keeps to its files while
    later loads are committed."""
    log = history(spark, root)
    if log is None:
        return None
    at = (log if version is None else log.where(F.col("version") == version)).orderBy(F.desc("version")).first()
    return None if at is None else spark.read.parquet(f"{root}/data/{at['folder']}")


def commit(df: DataFrame, root: str, load: str, seen: int) -> bool:
    """Write ``df`` as version ``seen + 1``; False, and no change to readers, if another writer has that number."""
    spark = df.sparkSession
    folder = uuid.uuid4().hex
    df.write.parquet(f"{root}/data/{folder}")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/log/{seen + 1:020d}")
    try:
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise
    try:
        out.write(bytearray(json.dumps({"version": seen + 1, "load": load, "folder": folder}).encode() + b"\n"))
    finally:
        out.close()
    return True


def _taken(spark: SparkSession, root: str) -> int:
    """The highest number in the log, lines that were never finished included."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/log")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return max((int(f.getPath().getName()) for f in fs.listStatus(path) if f.getPath().getName().isdigit()), default=0) if fs.exists(path) else 0


def merge(new: DataFrame, root: str, load: str, key: Sequence[str], order: Sequence[str], tries: int = 5) -> int:
    """Merge a load into the table, the last load of each key kept (S13), and return the version that holds it.

    A load that the log has already changes nothing. If another writer commits first, the merge starts again from its
    table. Null keys are keys; an empty load is a version like any other.
    """
    spark = new.sparkSession
    for _ in range(tries):
        log = history(spark, root)
        done = log.where(F.col("load") == load).first() if log is not None else None
        if done is not None:
            return done["version"]
        seen = _taken(spark, root)
        old = read(spark, root)
        both = N.merge_dedupe(old if old is not None else new.limit(0), new, key, order)
        if commit(both, root, load, seen):
            return seen + 1
    raise RuntimeError(f"{tries} other loads came first; send {load} again")
