"""Sizes, widths and distances as native columns: nothing here leaves the JVM."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tag and tag bits of variable-length integers of 1 to 9 bytes.
VARINT_TAGS = ((0b00, 2), (0b01, 2), (0b10, 2), (0b0011, 4), (0b0111, 4), (0b1011, 4), (0b01111, 5), (0b011111, 6), (0b111111, 6))
WORD_BITS = (8, 16, 32, 64)
#: Bytes of a quantised stream's head: base int64, quality float32, width uint8.
INTIFY_HEAD = 13


def varint_bases() -> list[int]:
    """The least value of each length from 1 byte on; a length holds 2 ** (8 * bytes - tag bits) values."""
    bases = [0]
    for n, (_, bits) in enumerate(VARINT_TAGS[:-1], 1):
        bases.append(bases[-1] + (1 << 8 * n - bits))
    return bases


def varint_length(value: Column) -> Column:
    """Bytes of a non-negative integer in variable-length form."""
    out = F.lit(9)
    for n, base in reversed([*enumerate(varint_bases()[1:], 1)]):
        out = F.when(value < F.lit(base), F.lit(n)).otherwise(out)
    return out


def bit_width(value: Column) -> Column:
    """Bits of a non-negative integer; 0 for 0. Exact, unlike a logarithm."""
    return F.when(value == 0, F.lit(0)).otherwise(F.length(F.bin(value)))


def word_layout(width: int) -> tuple[int, int]:
    """(bits of a word, values in it) for packing values of `width` bits: the word that wastes the fewest bits of 64, the smaller of equals."""
    if not 1 <= width <= 64:
        raise ValueError(f"width {width} is not in 1..64")
    waste = lambda s: (s % width if s >= width else s) * (64 // s)
    bits = min((s for s in WORD_BITS if s >= width), key=lambda s: (waste(s), s))
    return bits, bits // width


def word_bits(width: Column) -> Column:
    out = F.lit(64)
    for w in range(63, 0, -1):
        if word_layout(w)[0] != 64:
            out = F.when(width == w, F.lit(word_layout(w)[0])).otherwise(out)
    return out


def packed_bytes(n: Column, width: Column) -> Column:
    """Bytes of n values of `width` bits (single bits fill bytes)."""
    words = F.ceil(n / F.floor(word_bits(width) / width)) * (word_bits(width) / 8)
    return F.when(width == 0, F.lit(0)).when(width == 1, F.ceil(n / 8)).otherwise(words).cast("long")


def int_range_width(low: Column, high: Column) -> Column:
    """1, 2 or 3 for integers stored in 1, 2 or 4 bytes; bounds are strict, so 255 takes 2 bytes."""
    signed = F.when((low >= -128) & (high < 127), 1).when((low >= -32768) & (high < 32767), 2).otherwise(3)
    return F.when(low < 0, signed).when(high < 255, 1).when(high < 65535, 2).otherwise(3)


def stored_quality(quality: float) -> float:
    """The quality as streams store it (float32): used to quantise too, so that decoding does not drift."""
    return float(np.float32(quality))


def quantised(value: Column, quality: float) -> Column:
    """Multiples of the quality, half to even."""
    return F.rint(value.cast("double") / F.lit(stored_quality(quality))).cast("long")


def intify_bytes(n: Column, width: Column) -> Column:
    return F.lit(INTIFY_HEAD) + varint_length(n) + packed_bytes(n, width)


def stream_bytes(n: Column, width: Column, item_bytes: Column | int) -> Column:
    """Bytes of a stream whose length the reader knows: a codec byte, then raw values, or a length and a quantised payload."""
    raw = n * item_bytes
    small = intify_bytes(n, width)
    return F.when(n == 0, F.lit(0)).when(raw <= small, 1 + raw).otherwise(1 + varint_length(small) + small).cast("long")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def line_angle(a: Column, b: Column) -> Column:
    """Squared sine of the angle between the lines through two unit vectors."""
    return 1 - dot(a, b) * dot(a, b)


def component_epsilon(quality: Column | float, components: Column | int, size: Column) -> Column:
    """The rounding of a component that keeps the product's error below quality / components; size: the largest factors' sum."""
    q = F.lit(quality) if isinstance(quality, float) else quality
    k = F.lit(components) if isinstance(components, int) else components
    return 0.5 * (F.sqrt(4 * q / k + size * size) - size)


def bin_name(path: Column) -> Column:
    """The file of a property: separators become dashes, leading dashes and dots go."""
    return F.concat(F.regexp_replace(F.regexp_replace(path, "[/:;]", "-"), "^[-.]+", ""), F.lit(".bin"))


def plain_name(path: Column) -> Column:
    """The file stem of a scene path: dashes for separators, none at the ends."""
    return F.regexp_replace(F.regexp_replace(path, "[-./ ()]", "-"), "^-+|-+$", "")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)
