"""The byte formats of streams, coordinates, sparse matrices and coverings (numpy; used inside grouped maps)."""

from __future__ import annotations

import struct

import numpy as np

from .expressions import VARINT_TAGS, stored_quality, varint_bases, word_layout

RAW, INTIFY = 0, 1


def pack_varint(value: int) -> bytes:
    if not 0 <= value < 1 << 64:
        raise ValueError(f"{value} is no unsigned 64-bit integer")
    bases = varint_bases()
    n = sum(value >= b for b in bases)
    tag, bits = VARINT_TAGS[n - 1]
    if n == 9:
        return bytes([tag]) + value.to_bytes(8, "little")
    return ((value - bases[n - 1]) << bits | tag).to_bytes(n, "little")


def unpack_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """(value, place after it)."""
    first = data[at]
    n = next(i for i, (tag, bits) in enumerate(VARINT_TAGS, 1) if first & ((1 << bits) - 1) == tag)
    if n == 9:
        return int.from_bytes(data[at + 1 : at + 9], "little"), at + 9
    return (int.from_bytes(data[at : at + n], "little") >> VARINT_TAGS[n - 1][1]) + varint_bases()[n - 1], at + n


def bit_width(values: np.ndarray) -> int:
    if not np.issubdtype(values.dtype, np.integer):
        raise ValueError(f"{values.dtype} is no integer type")
    if len(values) and int(values.min()) < 0:
        raise ValueError("negative values have no width")
    return int(values.max()).bit_length() if len(values) else 0


def packed_size(n: int, width: int) -> int:
    if width == 0:
        return 0
    if width == 1:
        return -(-n // 8)
    bits, per = word_layout(width)
    return -(-n // per) * bits // 8


def pack_ints(values: np.ndarray, width: int) -> bytes:
    """Low values first in little-endian words; single bits from the highest bit of each byte down."""
    if width == 0:
        return b""
    values = values.astype(np.uint64)
    if width == 1:
        return np.packbits(values.astype(np.uint8)).tobytes()
    bits, per = word_layout(width)
    rows = np.zeros(-(-len(values) // per) * per, np.uint64)
    rows[: len(values)] = values
    words = np.bitwise_or.reduce(rows.reshape(-1, per) << (np.arange(per, dtype=np.uint64) * np.uint64(width)), axis=1) if len(rows) else rows
    return words.astype(f"<u{bits // 8}").tobytes()


def unpack_ints(data: bytes, n: int, width: int, at: int = 0) -> tuple[np.ndarray, int]:
    size = packed_size(n, width)
    if at + size > len(data):
        raise ValueError("the packed values are cut short")
    if width == 0:
        return np.zeros(n, np.uint64), at
    if width == 1:
        return np.unpackbits(np.frombuffer(data, np.uint8, size, at))[:n].astype(np.uint64), at + size
    bits, per = word_layout(width)
    words = np.frombuffer(data, f"<u{bits // 8}", size * 8 // bits, at).astype(np.uint64)
    mask = np.uint64((1 << width) - 1)
    values = words[:, None] >> (np.arange(per, dtype=np.uint64) * np.uint64(width)) & mask
    return values.ravel()[:n], at + size


def intify(x: np.ndarray, quality: float) -> bytes | None:
    """Multiples of the quality as differences above their least; None for nothing, or where 63 bits do not hold them."""
    q = stored_quality(quality)
    if not len(x) or q <= 0:
        return None
    multiples = np.rint(x.astype(np.float64) / q)
    if np.abs(multiples).max() >= 2**61:
        return None
    steps = np.diff(multiples.astype(np.int64), prepend=0)
    base = int(steps.min())
    rest = (steps - base).astype(np.uint64)
    width = bit_width(rest)
    return struct.pack("<qfB", base, q, width) + pack_varint(len(x)) + pack_ints(rest, width)


def unintify(payload: bytes, dtype: np.dtype) -> np.ndarray:
    base, q, width = struct.unpack_from("<qfB", payload)
    n, at = unpack_varint(payload, 13)
    rest, _ = unpack_ints(payload, n, width, at)
    return (np.cumsum(rest.astype(np.int64) + base) * float(np.float32(q))).astype(dtype)


#: Stream codecs by their byte: (name, encode(x, quality) -> bytes or None, decode(bytes, dtype)). Append only.
CODECS: list[tuple] = [
    ("raw", lambda x, quality: x.tobytes(), lambda b, dtype: np.frombuffer(b, dtype)),
    ("intify", intify, unintify),
]


def register_codec(name: str, encode, decode) -> int:
    """Adds a stream codec; its byte is returned."""
    CODECS.append((name, encode, decode))
    return len(CODECS) - 1


def encode_stream(x: np.ndarray, quality: float) -> bytes:
    """A flat stream by the codec with the shortest payload, the first of equals."""
    if x.ndim != 1:
        raise ValueError("a stream is flat")
    payloads = [(len(p), i, p) for i, (_, encode, _) in enumerate(CODECS) if (p := encode(x, quality)) is not None]
    _, codec, payload = min(payloads)
    return bytes([codec]) + (b"" if codec == RAW else pack_varint(len(payload))) + payload


def decode_stream(data: bytes, at: int, n: int, dtype: np.dtype) -> tuple[np.ndarray, int]:
    codec, at = data[at], at + 1
    size, at = (n * np.dtype(dtype).itemsize, at) if codec == RAW else unpack_varint(data, at)
    return CODECS[codec][2](data[at : at + size], np.dtype(dtype)), at + size


def stream_header(data: bytes, at: int, n: int, dtype: np.dtype) -> tuple[int, int, int]:
    """(codec, place of the payload, place after it) without decoding."""
    codec, at = data[at], at + 1
    size, at = (n * np.dtype(dtype).itemsize, at) if codec == RAW else unpack_varint(data, at)
    return codec, at, at + size


def pack_stream(x: np.ndarray, quality: float) -> bytes:
    """A stream that tells its own type and length."""
    return bytes([x.dtype.itemsize]) + pack_varint(len(x)) + encode_stream(x, quality)


def unpack_stream(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    dtype = np.dtype(f"<f{data[at]}")
    n, at = unpack_varint(data, at + 1)
    return decode_stream(data, at, n, dtype)


def encode_coordinates(x: np.ndarray, quality: float | np.ndarray) -> bytes:
    """A stream for each index of the last axis, the other axes flattened. Any number of axes, last ones of length 1 too."""
    if x.size == 0:
        return b""
    flat = x.reshape(-1, x.shape[-1]) if x.ndim > 1 else x.reshape(-1, 1)
    qualities = np.broadcast_to(np.asarray(quality, np.float64), flat.shape[1:])
    return b"".join(encode_stream(np.ascontiguousarray(flat[:, k]), float(qualities[k])) for k in range(flat.shape[1]))


def decode_coordinates(data: bytes, at: int, shape: tuple[int, ...], dtype: np.dtype) -> tuple[np.ndarray, int]:
    columns = shape[-1] if len(shape) > 1 else 1
    n = int(np.prod(shape)) // columns if columns else 0
    if n == 0:
        return np.zeros(shape, dtype), at
    out = np.empty((n, columns), dtype)
    for k in range(columns):
        out[:, k], at = decode_stream(data, at, n, dtype)
    return out.reshape(shape), at


def encode_sparse(matrix: np.ndarray, counts: np.ndarray, quality: float | np.ndarray) -> bytes:
    """A width byte, the packed counts, then for each column the rows whose count exceeds its index."""
    most = int(counts.max()) if len(counts) else 0
    if most == 0:
        return b"\0"
    width = most.bit_length()
    qualities = np.broadcast_to(np.asarray(quality, np.float64), (most,))
    columns = [encode_stream(np.ascontiguousarray(matrix[counts > k, k]), float(qualities[k])) for k in range(most)]
    return bytes([width]) + pack_ints(counts, width) + b"".join(columns)


def decode_sparse(data: bytes, at: int, rows: int, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray, int]:
    width, at = data[at], at + 1
    if width == 0:
        return np.zeros((rows, 0), dtype), np.zeros(rows, np.int64), at
    counts, at = unpack_ints(data, rows, width, at)
    counts = counts.astype(np.int64)
    out = np.zeros((rows, int(counts.max())), dtype)
    for k in range(out.shape[1]):
        pick = counts > k
        out[pick, k], at = decode_stream(data, at, int(pick.sum()), dtype)
    return out, counts, at


def zero_jagged(matrix: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Entries past their row's count are zero; columns that no row keeps go."""
    most = int(counts.max()) if len(counts) else 0
    return np.where(np.arange(most) < counts[:, None], matrix[:, :most], 0)


def range_width(values: np.ndarray) -> tuple[int, bool]:
    """(1, 2 or 3 for 1, 2 or 4 bytes; signed)."""
    low, high = int(values.min()), int(values.max())
    if low < 0:
        return (1 if low >= -128 and high < 127 else 2 if low >= -32768 and high < 32767 else 3), True
    return (1 if high < 255 else 2 if high < 65535 else 3), False


def covering_bytes(vertices: np.ndarray, sizes: np.ndarray) -> bytes:
    """A covering: vertices cluster by cluster and the clusters' sizes. Identical orders and single clusters take no array."""

    def better(x: np.ndarray) -> tuple[int, bytes]:
        steps = np.diff(x.astype(np.int64), prepend=0)
        (w, s), (dw, ds) = range_width(x), range_width(steps)
        width, signed, diff, values = (w, s, False, x) if w <= dw else (dw, ds, True, steps)
        return width << 2 | diff << 1 | signed, values.astype(f"<{'i' if signed else 'u'}{(1, 2, 4)[width - 1]}").tobytes()

    order, order_bytes = (0, b"") if (vertices == np.arange(len(vertices))).all() else better(vertices)
    inner = sizes[:-1]
    count, count_bytes = better(inner) if len(inner) else (0, b"")
    head = bytes([order << 4 | count]) + struct.pack("<I", len(vertices)) + order_bytes
    return head + (struct.pack("<I", len(inner)) + count_bytes if len(inner) else b"")


def read_covering(data: bytes, at: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """(vertices, sizes, place after them)."""

    def array(nibble: int, n: int, at: int) -> tuple[np.ndarray, int]:
        width, diff, signed = nibble >> 2, nibble >> 1 & 1, nibble & 1
        kind = np.dtype(f"<{'i' if signed else 'u'}{(1, 2, 4)[width - 1]}")
        values = np.frombuffer(data, kind, n, at).astype(np.int64)
        return (np.cumsum(values) if diff else values), at + n * kind.itemsize

    head, n = data[at], struct.unpack_from("<I", data, at + 1)[0]
    at += 5
    vertices, at = array(head >> 4, n, at) if head >> 4 else (np.arange(n), at)
    if not head & 15:
        return vertices, np.array([n]), at
    m = struct.unpack_from("<I", data, at)[0]
    sizes, at = array(head & 15, m, at + 4)
    return vertices, np.append(sizes, n - sizes.sum()), at
