"""Exact integer arithmetic on matrices of 64-bit components, by floating-point products wherever these are exact."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Results beyond 64 bits count as the largest or smallest long.
LARGEST = (1 << 63) - 1


def whole_components(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component x, taken as a double, as longs; beyond 64 bits the largest or smallest long."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def finite(vector: Column) -> Column:
    """True for a vector that is there and holds neither null nor a non-finite component."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def largest(x: np.ndarray) -> float:
    return float(np.abs(x.astype(np.float64)).max()) if x.size else 0.0


def clipped(x: np.ndarray) -> np.ndarray:
    """Python integers as longs."""
    return np.maximum(np.minimum(x, LARGEST), -LARGEST).astype(np.int64)


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(rows of a, rows of b) longs of two int64 matrices of one width."""
    bound = largest(a) * largest(b) * max(1, a.shape[1])
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if bound < 1 << 62:
        return a @ b.T
    return clipped(a.astype(object) @ b.T.astype(object))


def matrices(vectors: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and int64 matrix of the vectors of each length; the vectors are lists of longs without nulls."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    at = vectors.offsets.to_numpy()
    flat, size = vectors.values.to_numpy(zero_copy_only=False), np.diff(at)
    out = {}
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        out[int(d)] = rows, flat[at[rows][:, None] + np.arange(d)].astype(np.int64, copy=False)
    return out
