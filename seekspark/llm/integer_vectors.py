"""Vectors of integers: floor(scale * x) of the components, exact, and their way through Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components of at least this size, scaled, have no place in the arithmetic on longs: their vectors are left out like those that aren't finite.
MOST = float(1 << 62)


def usable(column: str, scale: float, most: float = MOST) -> Column:
    """Whether the vector is there and all its components are finite and, scaled, below `most`."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < most)
    return F.col(column).isNotNull() & F.forall(column, fine)


def integer_vectors(vectors: DataFrame, scale: float = 256.0, most: float = MOST) -> DataFrame:
    """(vec_id, x) of vectors(vec_id, embedding): x is floor(scale * component) as longs, of usable vectors only."""
    wide = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("_c"))
    long = lambda x: F.when(F.abs(x * scale) < most, F.floor(x * scale))
    return wide.where(usable("_c", scale, most)).select("vec_id", F.transform("_c", long).alias("x"))


def padded(vectors: DataFrame, dim: int) -> DataFrame:
    """Shorter vectors end in zeros."""
    zeros = F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(0), F.lit(dim) - F.size("x")))
    return vectors.withColumn("x", F.concat("x", zeros))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of int64; every vector of the column has dim components."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), dim)


def largest(x: np.ndarray) -> int:
    """The largest absolute value; 0 of nothing."""
    return max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0


def as_longs(values: np.ndarray) -> pa.Array:
    """Exact integers as longs, null where one doesn't fit."""
    if values.dtype == np.int64:
        return pa.array(values)
    return pa.array([v if -(1 << 63) <= v < 1 << 63 else None for v in map(int, values)], pa.int64())
