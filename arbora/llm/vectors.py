"""Vector columns as whole numbers, for the operators over embeddings.

A component x counts as floor(256 * x). A vector that is null or that holds a
null, NaN or infinite component takes no part, nor does one of another length
than the vector of the smallest id (nulls last; of repeated ids the shortest).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256


def whole(vector: str) -> Column:
    """Whether the vector is there with finite components only; array_contains is null beside a null component."""
    col = F.col(vector).cast("array<double>")
    found = F.lit(False)
    for odd in (float("nan"), float("inf"), float("-inf")):
        found = found | F.array_contains(col, F.lit(odd))
    return F.coalesce(~found, F.lit(False))


def taken(df: DataFrame, id: str, vector: str) -> tuple[DataFrame, int]:
    """The rows whose vector takes part, and its length (0 if there are none)."""
    kept = df.where(whole(vector))
    first = kept.agg(F.min(F.struct(F.col(id).isNull(), F.col(id), F.size(vector))).alias("first")).head()[0]
    size = first[2] if first else 0
    return kept.where(F.size(vector) == size), size


def numbers(column: pa.Array, size: int) -> np.ndarray:
    """Rows of floor(256 * x) as float64, which holds them exactly."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * SCALE).reshape(len(column), size)


def exact(top: float, terms: int) -> np.dtype:
    """The type in which sums of ``terms`` products of values up to ``top`` are exact; more than 63 bits are an error."""
    most = float(top) * float(top) * max(terms, 1)
    if most < 2.0**52:
        return np.dtype(np.float64)
    if most < 2.0**62:
        return np.dtype(np.int64)
    raise OverflowError("components are too large for 64-bit sums of their products")
