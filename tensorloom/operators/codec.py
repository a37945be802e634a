"""Quantise-and-difference codecs with exact sizes, as native windows and aggregates; streams are groups of rows.

A stream is keyed by `by` and ordered by `order`. Sizes are known without encoding; encode() makes the bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import bit_width, intify_bytes, quantised, stored_quality, stream_bytes
from .rank import before


def quantise(t: DataFrame, quality: float) -> DataFrame:
    """t with quantised bigint."""
    return t.withColumn("quantised", quantised(F.col("value"), quality))


def delta(t: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """quantise()'s rows with delta: the difference to the one before in the stream, the first as it is."""
    last = F.lag("quantised").over(Window.partitionBy(*by).orderBy(*order))
    return t.withColumn("delta", F.col("quantised") - F.coalesce(last, F.lit(0)))


def undelta(t: DataFrame, by: list[str], order: list[str], quality: float) -> DataFrame:
    """Rows with delta, and decoded: running sums times the quality."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return t.withColumn("decoded", F.sum("delta").over(w) * F.lit(stored_quality(quality)))


def headers(t: DataFrame, by: list[str]) -> DataFrame:
    """A row per stream of rows with delta: n, base (least delta), width (bits of what is above it)."""
    return t.groupBy(*by).agg(F.count("*").alias("n"), F.min("delta").alias("base"), bit_width(F.max("delta") - F.min("delta")).cast("int").alias("width"))


def sizes(head: DataFrame, item_bytes: int = 8) -> DataFrame:
    """headers()' rows with raw_bytes, intify_bytes, codec (the shorter, raw of equals) and stream_bytes."""
    raw, small = F.col("n") * item_bytes, intify_bytes(F.col("n"), F.col("width")).cast("long")
    return head.select("*", raw.alias("raw_bytes"), small.alias("intify_bytes"), F.when(raw <= small, "raw").otherwise("intify").alias("codec"), stream_bytes(F.col("n"), F.col("width"), item_bytes).alias("stream_bytes"))


def stream_sizes(t: DataFrame, by: list[str], order: list[str], quality: float, item_bytes: int = 8) -> DataFrame:
    return sizes(headers(delta(quantise(t, quality), by, order), by), item_bytes)


def coordinates_size(t: DataFrame, quality: float, by: list[str] = ("series",), item_bytes: int = 8) -> DataFrame:  # type: ignore[assignment]
    """Bytes of each group's coordinate streams (sample by sample, in vertex order): by, coord, n, width, stream_bytes.

    A group may be the whole table: its streams are spread over tasks by range.
    """
    keys = [*by, "coord"]
    steps = before(quantise(t, quality).select(*keys, "sample", "vertex", "quantised"), keys, ["sample", "vertex"], "quantised", "last")
    deltas = steps.withColumn("delta", F.col("quantised") - F.coalesce("last", F.lit(0)))
    return sizes(headers(deltas, keys), item_bytes).select(*keys, "n", "width", "codec", "stream_bytes")


def zero_jagged(m: DataFrame, count: Column) -> DataFrame:
    """Entries (row, k, value) with k below their row's count: the long form needs no zeros."""
    return m.where(F.col("k") < count)


def jagged_counts(m: DataFrame, count: Column) -> DataFrame:
    """k, rows: how many rows keep column k."""
    return zero_jagged(m, count).groupBy("k").agg(F.count("*").alias("rows"))


def encode(t: DataFrame, by: list[str], order: list[str], quality: float) -> DataFrame:
    """by, n, payload binary: each stream's bytes. A stream is held by one task."""
    from ..functions.bytes import pack_stream

    keys = t.select(*by).schema
    out = pa.schema([*( (f.name, _arrow(f.dataType)) for f in keys.fields), ("n", pa.int64()), ("payload", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order])
        x = table.column("value").to_numpy().astype(np.float64)
        row = {c: table.column(c)[0].as_py() for c in by}
        return pa.Table.from_pylist([row | {"n": len(x), "payload": pack_stream(x, quality)}], out)

    return t.select(*by, *order, "value").groupBy(*by).applyInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys.fields) + ", n long, payload binary")


def decode(encoded: DataFrame, by: list[str]) -> DataFrame:
    """by, pos, value of encode()'s rows."""
    from ..functions.bytes import unpack_stream

    fields = encoded.select(*by).schema.fields

    def run(batches):
        for batch in batches:
            streams = [unpack_stream(p)[0].astype(np.float64) for p in batch.column("payload").to_pylist()]
            n = np.array([len(s) for s in streams], np.int64)
            rows = pa.array(np.repeat(np.arange(len(streams)), n))
            pos = np.concatenate([np.arange(k) for k in n] or [np.zeros(0, np.int64)])
            value = np.concatenate(streams or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in by), pa.array(pos.astype(np.int64)), pa.array(value)], [*by, "pos", "value"])

    return encoded.select(*by, "payload").mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", pos long, value double")


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
