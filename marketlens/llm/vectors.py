"""Integer vectors: which rows take part, and packed matrices of theirs inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components saturate here: a double has no unit digit beyond, and products of two stay within 38 digits.
MOST = 1 << 52


def scaled(vector: Column, scale: int) -> Column:
    """``floor(scale * component)`` of every component, taken as a double."""
    one = lambda c: F.floor(F.least(F.greatest(c.cast("double") * scale, F.lit(float(-MOST))), F.lit(float(MOST))))
    return F.transform(vector, one)


def valid(vector: Column) -> Column:
    """True for a vector with components that are all there and finite."""
    bad = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, bad), F.lit(False))


def dimension(df: DataFrame, vector: str) -> int:
    """The most frequent length of the vectors, the larger of two; 0 without rows."""
    top = df.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return top["d"] if top else 0


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """The rows of a list column without nulls as a matrix of longs."""
    return np.asarray(column.flatten()).astype(np.int64, copy=False).reshape(-1, d)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` of integers, exact: in doubles where no sum can leave 53 bits, in longs below 63, in Python's beyond."""
    high = max(1, int(np.abs(a).max(initial=0))) * max(1, int(np.abs(b).max(initial=0))) * max(1, a.shape[1])
    if high < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    if high < 1 << 63:
        return a.astype(np.int64) @ b.astype(np.int64)
    return a.astype(object) @ b.astype(object)
