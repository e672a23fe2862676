"""Spread a small input over the cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-spread rows by a unique key when the scan has fewer tasks than there are cores.

    A large table already has more scan tasks than cores and is left alone, so its text is never
    shuffled. Spreading by the key keeps a retried task's rows the same.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
