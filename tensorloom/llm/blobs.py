"""Compact columns of integers in binary values, for shuffles of many small records.

A record that goes through a shuffle as a row of its own costs tens of bytes; here a task deals its records out to
buckets by hash and sends one row a bucket with the records' columns, each in as few bytes as its range takes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack(x: np.ndarray) -> bytes:
    """Integers (signed or unsigned, 64 bits) as: least value, bytes a value, then one plane a byte."""
    x = np.ascontiguousarray(x)
    if not len(x):
        return b""
    base = x.min()
    rest = (x - base).astype(np.uint64)
    width = max(1, (int(rest.max()).bit_length() + 7) // 8)
    planes = rest.view(np.uint8).reshape(-1, 8)[:, :width].T
    return np.asarray(base).astype(x.dtype).tobytes() + bytes([width]) + np.ascontiguousarray(planes).tobytes()


def unpack(b: bytes, dtype: type = np.int64) -> np.ndarray:
    if not b:
        return np.zeros(0, dtype)
    base, width = np.frombuffer(b, dtype, 1)[0], b[8]
    planes = np.frombuffer(b, np.uint8, offset=9).reshape(width, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, :width] = planes.T
    return wide.view(np.uint64).ravel().astype(dtype) + base


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending unsigned integers as the first and the steps from each to the next."""
    return x[:1].tobytes() + pack(np.diff(x)) if len(x) else b""


def unpack_sorted(b: bytes) -> np.ndarray:
    first = np.frombuffer(b, np.uint64, 1) if b else np.zeros(0, np.uint64)
    return np.cumsum(np.concatenate((first, unpack(b[8:], np.uint64)))) if b else first


def dealt(bucket: np.ndarray, buckets: int, columns: list[np.ndarray], packers: list | None = None) -> tuple[list[int], list[list[bytes]]]:
    """The buckets that got records, and for each column its values bucket by bucket, in their order, packed."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    used = np.flatnonzero(np.diff(edges)).tolist()
    columns = [c[order] for c in columns]
    return used, [[f(c[edges[b] : edges[b + 1]]) for b in used] for c, f in zip(columns, packers or [pack] * len(columns), strict=True)]


def column(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def joined(table: pa.Table, name: str, dtype: type = np.int64, ascending: bool = False) -> np.ndarray:
    """All records of a column of blobs; ascending: of pack_sorted()."""
    parts = [unpack_sorted(b) if ascending else unpack(b, dtype) for b in table.column(name).to_pylist() if b]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)
