"""Tensors as long DataFrames: series string, sample int, vertex bigint, coord int, value double."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rank import ranked

KEY = ("series", "sample", "vertex", "coord")


def from_arrays(df: DataFrame, id_col: str, array_col: str, ndim: int, series: str) -> DataFrame:
    """An array per vertex, cut into samples of ndim components; fewer that are left over at the end are a sample of a series of their own, `series`_rest."""
    flat = df.select(F.col(id_col).alias("vertex"), F.posexplode(array_col).alias("i", "value"), F.size(array_col).alias("n"))
    rest = F.col("i") >= F.col("n") - F.col("n") % ndim
    name = F.when(rest, f"{series}_rest").otherwise(series)
    sample = F.when(rest, 0).otherwise(F.floor(F.col("i") / ndim)).cast("int")
    return flat.select(name.alias("series"), sample.alias("sample"), "vertex", (F.col("i") % ndim).cast("int").alias("coord"), F.col("value").cast("double").alias("value"))


def from_rows(df: DataFrame, vertex: str, order: list[str], coords: list[str], series: str) -> DataFrame:
    """All rows of each vertex in an order as its samples. Vertices may have any number of them; by_length() makes dense series of such a tensor."""
    ranked = df.withColumn("sample", F.row_number().over(Window.partitionBy(vertex).orderBy(*order)) - 1)
    values = F.posexplode(F.array(*(F.col(c).cast("double") for c in coords))).alias("coord", "value")
    return ranked.select(F.lit(series).alias("series"), F.col("sample").cast("int").alias("sample"), F.col(vertex).cast("long").alias("vertex"), values)


def by_length(t: DataFrame) -> DataFrame:
    """t with its series split by their vertices' number of samples, as `series`_n: each is dense, and no value goes."""
    n = t.groupBy("series", "vertex").agg((F.max("sample") + 1).alias("n"))
    return t.join(n, ["series", "vertex"]).select(F.concat_ws("_", "series", "n").alias("series"), *KEY[1:], "value")


def embeddings(spark, sf_dir: str, ndim: int) -> DataFrame:
    return from_arrays(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), "vec_id", "embedding", ndim, f"emb{ndim}")


def embeddings3(spark, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir, 3)


def embeddings4(spark, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir, 4)


def event_values(spark, sf_dir: str) -> DataFrame:
    return from_rows(spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"], ["value"], "evt")


def as_floats(t: DataFrame, item_bytes: int) -> DataFrame:
    """t with values as floats of 2, 4 or 8 bytes hold them, natively: of 2 bytes, 11 significant bits down to multiples of 2**-24; larger values than they hold are infinite."""
    if item_bytes == 8:
        return t
    if item_bytes == 4:
        return t.withColumn("value", F.col("value").cast("float").cast("double"))
    if item_bytes != 2:
        raise ValueError("floats have 2, 4 or 8 bytes")
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs("value"))), F.lit(-14)) - 10)
    near = F.when(F.col("value") == 0, F.col("value")).otherwise(F.rint(F.col("value") / step) * step)
    return t.withColumn("value", F.when(F.abs(near) > 65504, F.signum("value") * float("inf")).otherwise(near))


LINEITEM_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]


def lineitems(spark, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", *LINEITEM_ORDER, "l_discount")
    return from_rows(df, "l_suppkey", LINEITEM_ORDER, ["l_quantity", "l_extendedprice", "l_discount"], "li")


def shape(t: DataFrame) -> DataFrame:
    """A row per series: nsamples, nverts, ndim, values, and whether it is dense and finite without repeats."""
    bad = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    sums = t.groupBy("series").agg(
        (F.max("sample") + 1).alias("nsamples"), F.count_distinct("vertex").alias("nverts"), (F.max("coord") + 1).alias("ndim"), F.count("*").alias("nvalues"), F.count_if(bad).alias("nbad"),
        F.min("sample").alias("first_sample"), F.min("coord").alias("first_coord"))
    dense = (F.col("nvalues") == F.col("nsamples") * F.col("nverts") * F.col("ndim")) & (F.col("nbad") == 0) & (F.col("first_sample") == 0) & (F.col("first_coord") == 0)
    return sums.select("series", "nsamples", "nverts", "ndim", "nvalues", dense.alias("valid"))


def validated(t: DataFrame) -> DataFrame:
    """t itself; ValueError names the series that are not dense or hold null, NaN or infinite values."""
    wrong = [r["series"] for r in shape(t).where("not valid").select("series").limit(10).collect()]
    if wrong:
        raise ValueError(f"not dense and finite: {', '.join(wrong)}")
    return t


def curve(t: DataFrame, vertex: int) -> DataFrame:
    """The samples of one vertex."""
    return t.where(F.col("vertex") == vertex).select("series", "sample", "coord", "value")


def curves(t: DataFrame) -> DataFrame:
    """A row per vertex: its samples in order, each an array of coordinates flattened sample by sample."""
    ordered = F.array_sort(F.collect_list(F.struct("sample", "coord", "value")))
    return t.groupBy("series", "vertex").agg(F.transform(ordered, lambda x: x["value"]).alias("curve"))


def flatten_config(t: DataFrame, covering: DataFrame | None = None) -> DataFrame:
    """series, row (sample), col, value: configuration space with columns coordinate by coordinate.

    Columns count vertices by rank; without a covering, by their order.
    """
    rank = covering.select("series", "vertex", "rank_in_cluster") if covering is not None else _ranks(t)
    n = rank.groupBy("series").agg(F.count("*").alias("nverts"))
    return t.join(rank, ["series", "vertex"]).join(n, "series").select("series", F.col("sample").alias("row"), (F.col("coord") * F.col("nverts") + F.col("rank_in_cluster")).cast("long").alias("col"), "value")


def unflatten_config(flat: DataFrame, ndim: int) -> DataFrame:
    """series, sample, rank, coord, value of flatten_config()'s rows; the number of columns must be a multiple of ndim."""
    n = flat.groupBy("series").agg((F.max("col") + 1).alias("ncols"))
    each = F.expr(f"assert_true(ncols % {ndim} = 0, 'columns are no multiple of the dimension')")
    sized = n.withColumn("ok", each).withColumn("nverts", F.expr(f"ncols div {ndim}"))
    return flat.join(sized, "series").where("ok is null").select("series", F.col("row").alias("sample"), F.expr("col % nverts").alias("rank"), F.expr("cast(col div nverts as int)").alias("coord"), "value")


def flatten_vertex(t: DataFrame) -> DataFrame:
    """series, vertex, col (sample * ndim + coord), value."""
    n = t.groupBy("series").agg((F.max("coord") + 1).alias("ndim"))
    return t.join(n, "series").select("series", "vertex", (F.col("sample") * F.col("ndim") + F.col("coord")).cast("long").alias("col"), "value")


def _ranks(t: DataFrame) -> DataFrame:
    """The order of vertices within each series, without a window over all values."""
    return ranked(t.select("series", "vertex").distinct(), ["series"], ["vertex"], "rank_in_cluster")


def sliced(t: DataFrame, covering: DataFrame) -> DataFrame:
    """t with cluster and rank_in_cluster."""
    return t.join(covering, ["series", "vertex"])


def unsliced(parts: DataFrame, covering: DataFrame) -> DataFrame:
    """series, sample, vertex, coord, value of rows with cluster and rank_in_cluster."""
    return parts.join(covering, ["series", "cluster", "rank_in_cluster"]).select(*KEY, "value")


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """Values of two tensors side by side (a, b); every point of either is there, so a difference in shape shows as null."""
    return a.select(*KEY, F.col("value").alias("a")).join(b.select(*KEY, F.col("value").alias("b")), list(KEY), "full_outer")
