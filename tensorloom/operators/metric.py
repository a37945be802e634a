"""Distances and compression reports of tensors as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tensor import aligned

SUMS = ("original_size", "compressed_size", "original_numvalues", "numerrors", "numuncorrectable")
MAXIMA = ("hausdorff", "linf", "corrected_linf")


def box_range(t: DataFrame) -> DataFrame:
    """series, coord, range: greatest minus least value."""
    return t.groupBy("series", "coord").agg((F.max("value") - F.min("value")).alias("range"))


def centroid(t: DataFrame) -> DataFrame:
    """series, vertex, coord, centroid: the mean over samples."""
    return t.groupBy("series", "vertex", "coord").agg(F.avg("value").alias("centroid"))


def rounded_centroid(t: DataFrame, quality: float) -> DataFrame:
    """centroid() in multiples of the quality, as it is stored and then subtracted."""
    from ..functions.expressions import quantised, stored_quality

    return centroid(t).withColumn("centroid", quantised(F.col("centroid"), quality) * F.lit(stored_quality(quality)))


def centred(t: DataFrame, quality: float) -> DataFrame:
    """t minus its rounded centroid, so that the centroid's rounding is not added to later errors."""
    return t.join(rounded_centroid(t, quality), ["series", "vertex", "coord"]).select("series", "sample", "vertex", "coord", (F.col("value") - F.col("centroid")).alias("value"))


def bounding_box(t: DataFrame) -> DataFrame:
    """series, vertex, coord, low, high, midpoint."""
    return t.groupBy("series", "vertex", "coord").agg(F.min("value").alias("low"), F.max("value").alias("high")).withColumn("midpoint", 0.5 * (F.col("low") + F.col("high")))


def linf(a: DataFrame, b: DataFrame) -> DataFrame:
    """series, linf: the greatest coordinate difference."""
    return aligned(a, b).groupBy("series").agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("linf"))


def hausdorff(a: DataFrame, b: DataFrame) -> DataFrame:
    """series, hausdorff: the greatest distance of a point to its counterpart."""
    points = aligned(a, b).groupBy("series", "sample", "vertex").agg(F.sum((F.col("a") - F.col("b")) ** 2).alias("d2"))
    return points.groupBy("series").agg(F.sqrt(F.max("d2")).alias("hausdorff"))


def report(before: DataFrame, after: DataFrame, compressed: DataFrame, item_bytes: int = 8) -> DataFrame:
    """A row per series: sizes, number of values and of changed ones, distances, and what a correction by differences leaves.

    compressed: series, compressed_size. Points that only one tensor has raise an error. One shuffle by point, one by series.
    """
    d = F.col("a") - F.col("b")
    fixed = F.abs(F.col("b") + d - F.col("a"))
    both = aligned(before, after).withColumn("ok", F.expr("assert_true(a is not null and b is not null, 'shapes differ')")).where("ok is null")
    points = both.groupBy("series", "sample", "vertex").agg(
        F.count("*").alias("n"), F.sum(d * d).alias("d2"), F.max(F.abs(d)).alias("linf"), F.count_if(F.col("a") != F.col("b")).alias("errors"), F.max(fixed).alias("fixed"), F.count_if(fixed > 0).alias("unfixed"))
    sums = points.groupBy("series").agg(
        (F.sum("n") * item_bytes).alias("original_size"), F.sum("n").alias("original_numvalues"), F.sqrt(F.max("d2")).alias("hausdorff"), F.max("linf").alias("linf"),
        F.sum("errors").alias("numerrors"), F.max("fixed").alias("corrected_linf"), F.sum("unfixed").alias("numuncorrectable"))
    return sums.join(compressed, "series").select("series", *SUMS, *MAXIMA)


def combined(reports: DataFrame) -> DataFrame:
    """Reports by series and, with series null, over all of them in the same pass. No reports give no rows."""
    return reports.rollup("series").agg(*(F.sum(c).alias(c) for c in SUMS), *(F.max(c).alias(c) for c in MAXIMA)).withColumn("ratio", ratio())


def ratio():
    """The share of bytes saved; null where there was nothing to save."""
    return F.when(F.col("original_size") > 0, 1 - F.col("compressed_size") / F.col("original_size"))


def described(reports: DataFrame, metres_per_unit: float = 0.01) -> DataFrame:
    """A line of text per report with distances in metres and shares in percent."""
    return reports.select("series", F.format_string(
        "%d -> %d bytes (%.1f%% saved), hausdorff %.3e m, max error %.3e m, %.2f%% of values changed", "original_size", "compressed_size", 100 * F.coalesce(ratio(), F.lit(0.0)),
        F.col("hausdorff") * metres_per_unit, F.col("linf") * metres_per_unit, 100 * F.col("numerrors") / F.greatest("original_numvalues", F.lit(1))).alias("line"))
