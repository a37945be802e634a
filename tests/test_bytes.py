"""Byte formats: lengths at breakpoints and round trips."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tensorloom.functions import bytes as B
from tensorloom.functions.expressions import word_layout


@pytest.mark.parametrize("value,size", [(0, 1), (1, 1), (63, 1), (64, 2), (65, 2), (16447, 2), (16448, 3), (2**32, 5), (2**60, 9), (2**64 - 1, 9)])
def test_varint_lengths(value, size):
    data = B.pack_varint(value)
    assert len(data) == size
    assert B.unpack_varint(b"x" + data + b"y", 1) == (value, 1 + size)


@given(st.integers(0, 2**64 - 1))
def test_varint_round_trip(value):
    assert B.unpack_varint(B.pack_varint(value))[0] == value


@pytest.mark.parametrize("values,width", [([0, 0, 0], 0), ([0, 1], 1), (range(64), 6), (range(65), 7), ([2**31], 32), ([2**60], 61)])
def test_widths(values, width):
    assert B.bit_width(np.array(list(values))) == width


def test_width_rejects():
    with pytest.raises(ValueError):
        B.bit_width(np.array([-1]))
    with pytest.raises(ValueError):
        B.bit_width(np.array([1.5]))


def test_word_table():
    want = {1: (8, 8), 2: (8, 4), 3: (64, 21), 4: (8, 2), 5: (16, 3), 6: (32, 5), 7: (64, 9), 8: (8, 1), 9: (64, 7), 10: (32, 3), 11: (64, 5), 12: (64, 5), 13: (16, 1), 16: (16, 1), 17: (64, 3), 21: (64, 3), 22: (32, 1), 32: (32, 1), 33: (64, 1), 64: (64, 1)}
    assert {w: word_layout(w) for w in want} == want


@settings(max_examples=60)
@given(st.integers(0, 63), st.lists(st.integers(0, 2**63 - 1), max_size=70))
def test_pack_round_trip(width, values):
    x = np.array([v & ((1 << width) - 1) for v in values], np.uint64)
    data = B.pack_ints(x, width)
    assert len(data) == B.packed_size(len(x), width)
    back, at = B.unpack_ints(data, len(x), width)
    assert at == len(data) and (back == x).all()


def test_nibbles():
    x = np.array([*range(16), *reversed(range(16))], np.uint64)
    assert len(B.pack_ints(x, 4)) == 16 and len(B.pack_ints(x // 2, 3)) == 16
    assert B.pack_ints(np.array([1, 0, 0, 0, 0, 0, 0, 1], np.uint64), 1) == b"\x81"  # single bits from the highest down


def test_short_data_is_an_error():
    with pytest.raises(ValueError):
        B.unpack_ints(b"", 9, 4)


@pytest.mark.parametrize("shape", [(112,), (56, 2), (7, 8, 2), (7, 16, 1), (0, 3)])
def test_coordinates(shape):
    x = np.arange(int(np.prod(shape)), dtype=np.float32).reshape(shape)
    data = B.encode_coordinates(x, 0.1)
    back, at = B.decode_coordinates(data, 0, shape, np.dtype(np.float32))
    assert at == len(data) and np.allclose(back, x, rtol=0, atol=0.1)


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_no_drift(scale):
    x = np.random.default_rng(1).normal(0, scale, 500)
    back, _ = B.unpack_stream(B.pack_stream(x, 1e-4 * scale))
    assert np.abs(back - x).max() <= 0.5001e-4 * scale


def test_raw_wins_on_tiny_quality():
    x = np.random.default_rng(1).normal(0, 1, 50)
    data = B.encode_stream(x, 1e-30)
    assert data[0] == B.RAW and (B.decode_stream(data, 0, 50, np.dtype(float))[0] == x).all()
    assert B.stream_header(data, 0, 50, np.dtype(float)) == (B.RAW, 1, len(data))


def test_constant_and_single():
    for x in (np.full(40, 2.5), np.array([7.0])):
        back, at = B.unpack_stream(B.pack_stream(x, 0.25))
        assert np.allclose(back, x, atol=0.13)


def test_jagged():
    x = np.arange(1, 101, dtype=np.float32).reshape(10, 10)
    counts = np.arange(10) // 2
    z = B.zero_jagged(x, counts)
    assert z.shape == (10, 4) and ((z != 0).sum(axis=1) == counts).all()
    data = B.encode_sparse(z, counts, 0.25)
    back, got, at = B.decode_sparse(data, 0, 10, np.dtype(np.float32))
    assert at == len(data) and (got == counts).all() and np.allclose(back, z, atol=0.25)
    assert B.encode_sparse(x, np.zeros(10, int), 1.0) == b"\0"


@pytest.mark.parametrize("vertices,sizes", [(np.arange(53), [17, 36]), (np.arange(300), [300]), (np.arange(300)[::-1], [100, 100, 100]), (np.random.default_rng(2).permutation(70_000), [255, 69_745]), (np.arange(255, -1, -1), [1, 255])])
def test_covering(vertices, sizes):
    data = B.covering_bytes(vertices, np.array(sizes))
    v, s, at = B.read_covering(data)
    assert at == len(data) and (v == vertices).all() and s.tolist() == sizes


def test_register_codec():
    n = B.register_codec("zeros", lambda x, q: b"" if not x.any() else None, lambda b, dtype: np.zeros(0, dtype))
    try:
        assert B.encode_stream(np.zeros(100), 0.1) == bytes([n]) + b"\0"
    finally:
        B.CODECS.pop()
    with pytest.raises(ValueError):
        B.encode_stream(np.zeros((2, 2)), 0.1)
