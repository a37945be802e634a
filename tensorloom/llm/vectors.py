"""Vectors of array columns as matrices and as bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F


def lengths(column: pa.Array) -> np.ndarray:
    """Components of each vector; 0 for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.array(column.value_lengths().fill_null(0), np.int64)


def by_length(column: pa.Array):
    """(length, rows, matrix of doubles, all finite) for each length that occurs. Null vectors are in none; null components are NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = lengths(column)
    values = column.flatten()  # without what null rows hide
    flat = np.asarray(values.cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64)
    first = np.cumsum(size) - size
    for n in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == n)
        matrix = flat[first[rows][:, None] + np.arange(n)]
        yield n, rows, matrix, np.isfinite(matrix).all(axis=1)


def packed(matrix: np.ndarray) -> list[bytes]:
    """Each row's bytes: single precision where that is exact for all, else double."""
    with np.errstate(over="ignore"):
        small = matrix.astype(np.float32)
    return [r.tobytes() for r in (small if (small == matrix).all() else matrix.astype(np.float64))]


def unpacked(rows: list[bytes], dim: int) -> np.ndarray:
    """The matrix of packed() rows, which may come from different calls."""
    out = np.empty((len(rows), dim))
    for i, b in enumerate(rows):
        out[i] = np.frombuffer(b, np.float32 if len(b) == 4 * dim else np.float64)
    return out


def blob(matrix: np.ndarray) -> bytes:
    return b"".join(packed(matrix))


def matrix_of(b: bytes, n: int, dim: int) -> np.ndarray:
    """The matrix of doubles of a blob()."""
    return np.frombuffer(b, np.float32 if len(b) == 4 * n * dim else np.float64).astype(np.float64).reshape(n, dim)


def same_keys(column: str):
    """Two 64-bit hashes of a vector: 128 bits that equal vectors share."""
    return F.xxhash64(F.lit(1), column).alias("k1"), F.xxhash64(F.lit(2), column).alias("k2")
