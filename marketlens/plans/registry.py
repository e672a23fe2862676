"""Registry of runnable queries and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register ``fn(spark, sf_dir)``; ``sql`` is the DuckDB statement of the same result."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def shape(df: DataFrame, columns: Mapping[str, int | str | None]) -> DataFrame:
    """Select result columns; an int rounds a double, a string casts, None passes through."""
    out = []
    for name, how in columns.items():
        c = F.col(name)
        if isinstance(how, int):
            c = F.round(c.cast("double"), how)
            c = F.when(c == 0, F.lit(0.0)).otherwise(c)
        elif isinstance(how, str):
            c = c.cast(how)
        out.append(c.alias(name))
    return df.select(*out)
