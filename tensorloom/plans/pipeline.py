"""Compression end to end: cluster, reduce, choose, decode, measure; all series of a tensor in one plan."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import varint_length
from ..operators import cluster, codec, metric
from ..operators.embed import best, embed, reconstruct
from ..operators.tensor import KEY, unsliced
from ..tables import shared_table
from .registry import CLUSTERINGS

#: Physical error of a metre's unit.
QUALITY_METRES = 1e-4


def quality_for(metres_per_unit: float) -> float:
    """The quality in a scene's units that is QUALITY_METRES."""
    return QUALITY_METRES / metres_per_unit


def compress(t: DataFrame, quality: float, clustering: str = "by_index", cluster_size: int = 10_000, candidates: tuple[str, ...] = ("raw", "static", "pca", "rotation"), item_bytes: int = 8) -> tuple[DataFrame, DataFrame]:
    """(encoded clusters, covering), both tables in the shared folder. Values are floats of item_bytes."""
    cover = shared_table(CLUSTERINGS[clustering](t, quality, cluster_size), "covering")
    return shared_table(best(embed(t, cover, quality, candidates, item_bytes), quality), "encoded"), cover


def decompress(encoded: DataFrame, cover: DataFrame) -> DataFrame:
    return unsliced(reconstruct(encoded), cover)


def covering_files(cover: DataFrame) -> DataFrame:
    """series, covering binary: the bytes of each series' covering (an order of a series' vertices is one value)."""
    from ..functions.bytes import covering_bytes

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cluster", "ascending"), ("rank_in_cluster", "ascending")])
        vertices = table.column("vertex").to_numpy()
        sizes = np.bincount(table.column("cluster").to_numpy())
        return pa.table({"series": [table.column("series")[0].as_py()], "covering": pa.array([covering_bytes(vertices, sizes)], pa.binary())})

    return cover.groupBy("series").applyInArrow(run, "series string, covering binary")


def embedding_files(encoded: DataFrame, cover: DataFrame) -> DataFrame:
    """series, header, projection, clusters binary: the three files of each series, clusters one after another in the first two."""
    from ..functions.bytes import pack_varint

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("cluster")
        head = b"".join(pack_varint(n) + h for n, h in zip(table.column("number").to_pylist(), table.column("header").to_pylist(), strict=True))
        body = b"".join(table.column("payload").to_pylist())
        return pa.table({"series": [table.column("series")[0].as_py()], "header": pa.array([head], pa.binary()), "projection": pa.array([body], pa.binary())})

    parts = encoded.select("series", "cluster", "number", "header", "payload").groupBy("series").applyInArrow(run, "series string, header binary, projection binary")
    return parts.join(covering_files(cover).withColumnRenamed("covering", "clusters"), "series")


def read_embedding_files(files: DataFrame) -> DataFrame:
    """The long tensors of embedding_files()' rows; clusters are found by reading on from one to the next."""
    from ..functions.bytes import read_covering, unpack_varint
    from ..operators.embed import METHODS

    methods = {n: m for n, m in METHODS.values()}

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                vertices, sizes, _ = read_covering(r["clusters"])
                h = p = first = 0
                for size in sizes.tolist():
                    number, h = unpack_varint(r["header"], h)
                    x, h, p = methods[number].decode(r["header"], r["projection"], h, p)
                    at = np.indices(x.shape, np.int32).reshape(3, -1)
                    own = vertices[first : first + size].astype(np.int64)
                    first += size
                    yield pa.RecordBatch.from_arrays([pa.array([r["series"]] * x.size), pa.array(at[0]), pa.array(own[at[1]]), pa.array(at[2]), pa.array(np.ascontiguousarray(x).ravel().astype(np.float64))], [*KEY, "value"])

    return files.select("series", "header", "projection", "clusters").mapInArrow(run, "series string, sample int, vertex long, coord int, value double")


def compressed_size(encoded: DataFrame, cover: DataFrame) -> DataFrame:
    """series, compressed_size: headers with their method numbers, payloads, and the covering."""
    parts = encoded.groupBy("series").agg(F.sum(F.col("nbytes") + varint_length(F.col("number"))).alias("bytes"))
    return parts.join(cluster.bytes_size(cover), "series").select("series", (F.col("bytes") + F.col("covering_bytes")).cast("long").alias("compressed_size"))


def run_reports(t: DataFrame, quality: float, item_bytes: int = 8, **options) -> DataFrame:
    """A report per series of compressing and decompressing t, whose values are floats of item_bytes."""
    encoded, cover = compress(t, quality, item_bytes=item_bytes, **options)
    return metric.report(t, decompress(encoded, cover), compressed_size(encoded, cover), item_bytes)


def scenarios(t: DataFrame, qualities: list[float], clusterings: list[str], cluster_sizes: list[int]) -> DataFrame:
    """Combined reports of a grid of settings: clustering, cluster_size, quality, then the report's columns. The grid is a few cells."""
    done = None
    for quality in qualities:
        for name in clusterings:
            for size in cluster_sizes:
                reports = metric.combined(run_reports(t, quality, clustering=name, cluster_size=size)).where("series is null").drop("series")
                cell = reports.select(F.lit(name).alias("clustering"), F.lit(size).alias("cluster_size"), F.lit(float(quality)).alias("quality"), "*")
                done = cell if done is None else done.unionByName(cell)
    return done


def codec_report(t: DataFrame, quality: float, by: list[str], order: list[str]) -> DataFrame:
    """The flagship plan: quantise, difference, size, choose, decode by running sums, and report; native from scan to result."""
    steps = codec.delta(codec.quantise(t, quality), by, order)
    size = codec.sizes(codec.headers(steps, by)).groupBy("series").agg(F.sum("stream_bytes").alias("compressed_size"))
    back = codec.undelta(steps, by, order, quality).select(*KEY, F.col("decoded").alias("value"))
    return metric.report(t, back, size).withColumn("ratio", metric.ratio())
