"""Words of whole texts as 64-bit hashes, vectorised over Arrow batches.

A word is a run of bytes other than space and 0x09-0x0D in the UTF-8 text. Words of a batch are hashed together: one
prefix sum of a polynomial in an odd base modulo 2**64 gives each word's value, which is then mixed. Memory is about 40
bytes for each byte of a slice, and slices hold SLICE_BYTES or one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .worker import free, trim

SLICE_BYTES = 1 << 20
_MASK = (1 << 64) - 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Odd bases of the polynomials: one for bytes in a word, two for words in a sequence.
BYTE_BASE, SEQ_BASE, SEQ_BASE_2 = 0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        full = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        full[0] = 1
        have = np.cumprod(full, dtype=np.uint64)
        if n <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column (null: empty) and the n+1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """The rows of batches again, in slices of at most `most` bytes of text or one row.

    keep: what the worker holds is for this operator; else it goes first. Free memory goes back to the system at the end.
    """
    if not keep:
        free()
    for batch in batches:
        _, at = raw(batch.column(batch.schema.get_field_index(column)))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(at, at[row] + most, side="right")) - 1)
            yield batch.slice(row, end - row)
            row = end
    trim()


class Words:
    """hash: of each word; start, end: its bytes; at: the n+1 offsets of each document's words."""

    def __init__(self, column: pa.Array, lower: bool = False):
        self.data, self.doc_at = raw(column)
        data, doc_at, n = self.data, self.doc_at, len(self.data)
        if lower:
            data = _LOWER[data]
        space = _SPACE[data]
        before, after = np.ones(n, bool), np.ones(n, bool)
        before[1:], after[:-1] = space[:-1], space[1:]
        edges = doc_at[(doc_at > 0) & (doc_at < n)]
        before[edges], after[edges - 1] = True, True
        self.start = np.flatnonzero(~space & before)
        self.end = np.flatnonzero(~space & after) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BYTE_BASE, n), out=sums[1:])
        value = (sums[self.end] - sums[self.start]) * powers(inverse(BYTE_BASE), n + 1)[self.start]
        self.hash = mix(value + (self.end - self.start).astype(np.uint64) * np.uint64(SEQ_BASE_2))
        self.at = np.searchsorted(self.start, doc_at)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.at)


def sequences(hashes: np.ndarray, n: int, base: int = SEQ_BASE) -> np.ndarray:
    """The hash of the n words from each position on; the last n-1 positions have none."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(base, len(hashes)), out=sums[1:])
    return mix((sums[n:] - sums[:m]) * powers(inverse(base), m))


def starts(at: np.ndarray, n: int) -> np.ndarray:
    """Positions where n words of one document start, in order."""
    counts = np.maximum(np.diff(at) - n + 1, 0)
    return ranges(at[:-1], counts)


def ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[i], first[i]+1, ... (counts[i] of them) for each i, one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(first - (ends - counts), counts)
