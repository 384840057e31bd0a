"""Vectors of a table as whole numbers, for operators that need exact arithmetic."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a component is multiplied by before it is rounded down.
SCALE = 256


def sound(vector: str | Column) -> Column:
    """True for a vector that is there, has components, and none of them null, NaN or infinite."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def whole(vector: str | Column) -> Column:
    """Each component c as floor(256 * c), c as double."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE))


def same_length(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is as long as most are (the longest of equally many): others cannot be compared with them."""
    most = df.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return df.filter(F.size(vector) == (most["d"] if most else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths, without nulls, as a matrix of 64-bit integers."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.int64, copy=False)


def highest(a: np.ndarray) -> int:
    """The largest absolute value, exactly."""
    return max(int(a.max()), -int(a.min())) if a.size else 0


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a with those of b: doubles where these hold them all, else integers of any size."""
    if highest(a) * highest(b) * max(1, a.shape[1]) < 1 << 53:
        return a.astype(np.float64) @ b.astype(np.float64).T
    return a.astype(object) @ b.astype(object).T
