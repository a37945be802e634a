"""Vertex clusterings: coverings (series, vertex, cluster int, rank_in_cluster int) of a tensor's vertices."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import int_range_width, line_angle
from ..tables import shared_table
from .rank import before, ranked
from .tensor import curves

#: Rounds of the greedy cover between two writes of its state.
ROUNDS_KEPT = 16
#: Bytes of centres that go to every task at once; with more, as many lots of centres as it takes.
CENTRE_BYTES = 16 << 20


def vertices(t: DataFrame) -> DataFrame:
    return t.select("series", "vertex").distinct()


def covering(labels: DataFrame) -> DataFrame:
    """A covering from series, vertex, label: clusters numbered by label, empty labels left out, ranks by vertex."""
    used = labels.select("series", "label").distinct().withColumn("cluster", (F.row_number().over(Window.partitionBy("series").orderBy("label")) - 1).cast("int"))
    joined = labels.join(used, ["series", "label"]).select("series", "vertex", "cluster")
    return _placed(joined, ["series", "cluster"])


def _placed(rows: DataFrame, by: list[str]) -> DataFrame:
    """series, vertex, cluster, rank_in_cluster of rows with a cluster."""
    return ranked(rows, by, ["vertex"], "place").select("series", "vertex", "cluster", F.col("place").cast("int").alias("rank_in_cluster"))


def monolithic(t: DataFrame, quality: float = 1e-6, cluster_size: int = 10_000) -> DataFrame:
    """All vertices in one cluster."""
    return _placed(vertices(t).withColumn("cluster", F.lit(0)), ["series"])


def even_bucket(place: Column, n: Column, size: int) -> tuple[Column, Column]:
    """Bucket and place in it of n things in 1 + (n - 1) div size buckets, larger ones first, as ntile deals them out."""
    buckets = F.floor((n - 1) / size) + 1
    small, extra = F.floor(n / buckets), n % buckets
    edge = extra * (small + 1)
    first = place < edge
    bucket = F.when(first, F.floor(place / (small + 1))).otherwise(extra + F.floor((place - edge) / F.greatest(small, F.lit(1))))
    within = F.when(first, place % (small + 1)).otherwise((place - edge) % F.greatest(small, F.lit(1)))
    return bucket.cast("int"), within.cast("int")


def by_index(t: DataFrame, quality: float = 1e-6, cluster_size: int = 10_000) -> DataFrame:
    """Clusters of at most cluster_size vertices in a row, as even as can be."""
    placed = ranked(vertices(t), ["series"], ["vertex"], "place")
    n = placed.groupBy("series").agg(F.count("*").alias("n"))
    bucket, within = even_bucket(F.col("place"), F.col("n"), cluster_size)
    return placed.join(n, "series").select("series", "vertex", bucket.alias("cluster"), within.alias("rank_in_cluster"))


def static_vertices(t: DataFrame, quality: float, every: bool = True) -> DataFrame:
    """series, vertex, static: whether coordinates stay within less than the quality of their first sample.

    every: all coordinates must; else one is enough.
    """
    at = t.groupBy("series", "vertex", "coord").agg(F.min_by("value", "sample").alias("first"), F.min("value").alias("low"), F.max("value").alias("high"))
    still = F.greatest(F.col("high") - F.col("first"), F.col("first") - F.col("low")) < quality
    return at.groupBy("series", "vertex").agg((F.bool_and(still) if every else F.bool_or(still)).alias("static"))


def static_first(t: DataFrame, quality: float = 1e-6, cluster_size: int = 10_000, cluster_fn=by_index, every: bool = True) -> DataFrame:
    """Static vertices as cluster 0, the others by cluster_fn after it; only one of both where the other is empty."""
    still = shared_table(static_vertices(t, quality, every), "static")
    quiet = still.where("static").select("series", "vertex")
    first = _placed(quiet.withColumn("cluster", F.lit(0)), ["series"])
    moving = cluster_fn(t.join(quiet, ["series", "vertex"], "left_anti"), quality, cluster_size)
    some = quiet.select("series").distinct().withColumn("shift", F.lit(1))
    after = moving.join(some, "series", "left").select("series", "vertex", (F.col("cluster") + F.coalesce("shift", F.lit(0))).alias("cluster"), "rank_in_cluster")
    return first.unionByName(after)


def counts(cover: DataFrame) -> DataFrame:
    """series, cluster, size."""
    return cover.groupBy("series", "cluster").agg(F.count("*").alias("size"))


def offsets(cover: DataFrame) -> DataFrame:
    """series, cluster, offset: where clusters but the first begin in the order of vertices by cluster."""
    w = Window.partitionBy("series").orderBy("cluster").rowsBetween(Window.unboundedPreceding, -1)
    return counts(cover).withColumn("offset", F.sum("size").over(w)).where("offset is not null").select("series", "cluster", "offset")


def verify(cover: DataFrame) -> DataFrame:
    """series, exact: every vertex once, ranks and clusters without gaps; identity: vertices 0, 1, ... stay in order."""
    per = cover.groupBy("series", "cluster").agg(F.count("*").alias("n"), F.count_distinct("rank_in_cluster").alias("ranks"), F.min("rank_in_cluster").alias("low"), F.max("rank_in_cluster").alias("high"))
    good = per.groupBy("series").agg(F.bool_and((F.col("n") == F.col("ranks")) & (F.col("low") == 0) & (F.col("high") == F.col("n") - 1)).alias("ranks_ok"), (F.max("cluster") == F.count("*") - 1).alias("clusters_ok"), F.sum("n").alias("n"))
    distinct = cover.groupBy("series").agg(F.count_distinct("vertex").alias("vertices"))
    return good.join(distinct, "series").select("series", (F.col("ranks_ok") & F.col("clusters_ok") & (F.col("n") == F.col("vertices"))).alias("exact")).join(identity(cover), "series")


def places(cover: DataFrame) -> DataFrame:
    """cover with place: the vertex's place in the order by cluster and rank, from the clusters' offsets."""
    first = offsets(cover).select("series", "cluster", "offset")
    return cover.join(first, ["series", "cluster"], "left").withColumn("place", F.coalesce("offset", F.lit(0)) + F.col("rank_in_cluster")).drop("offset")


def identity(cover: DataFrame) -> DataFrame:
    return places(cover).groupBy("series").agg(F.bool_and(F.col("vertex") == F.col("place")).alias("identity"))


def is_sorted(t: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """by, sorted: no value is smaller than the one before it."""
    last = F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    return t.withColumn("rises", F.coalesce(F.col(value) >= last, F.lit(True))).groupBy(*by).agg(F.bool_and("rises").alias("sorted"))


def bytes_size(cover: DataFrame) -> DataFrame:
    """series, covering_bytes: a head, the order unless it is the identity, the inner sizes unless there is one cluster."""
    item = lambda w: F.when(w == 1, 1).when(w == 2, 2).otherwise(4)
    placed = before(places(cover), ["series"], ["place"], "vertex", "last")
    order = placed.withColumn("step", F.col("vertex") - F.coalesce("last", F.lit(0))).groupBy("series").agg(
        F.count("*").alias("n"), F.bool_and(F.col("vertex") == F.col("place")).alias("identity"), F.min("vertex").alias("a"), F.max("vertex").alias("b"), F.min("step").alias("c"), F.max("step").alias("d"))
    inner = counts(cover)
    last = inner.groupBy("series").agg(F.max("cluster").alias("last"))
    changes = before(inner, ["series"], ["cluster"], "size", "size_before")
    inner = changes.join(last, "series").withColumn("change", F.col("size") - F.coalesce("size_before", F.lit(0))).where("cluster < last").groupBy("series").agg(
        F.count("*").alias("m"), F.min("size").alias("e"), F.max("size").alias("f"), F.min("change").alias("g"), F.max("change").alias("h"))
    width = lambda a, b, c, d: item(F.least(int_range_width(F.col(a), F.col(b)), int_range_width(F.col(c), F.col(d))))
    total = 5 + F.when(F.col("identity"), 0).otherwise(F.col("n") * width("a", "b", "c", "d")) + F.when(F.col("m").isNull(), 0).otherwise(4 + F.col("m") * width("e", "f", "g", "h"))
    return order.join(inner, "series", "left").select("series", total.cast("long").alias("covering_bytes"))


def _kmeans(features: DataFrame, cluster_size: int, seed: int) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    done = None
    for r in features.groupBy("series").count().collect():  # series are few
        own = features.where(F.col("series") == r["series"]).select("series", "vertex", array_to_vector("features").alias("features")).persist()
        k = max(1, math.ceil(r["count"] / cluster_size))
        labels = own.select("series", "vertex", F.lit(0).alias("label")) if k == 1 else KMeans(k=k, seed=seed).fit(own).transform(own).select("series", "vertex", F.col("prediction").alias("label"))
        done = labels if done is None else done.unionByName(labels)
    if done is None:
        return features.select("series", "vertex", F.lit(0).alias("label"))
    return done


def kmeans(t: DataFrame, quality: float = 1e-6, cluster_size: int = 10_000, seed: int = 1) -> DataFrame:
    """k-means of centred curves, about cluster_size vertices a cluster."""
    centre = t.groupBy("series", "vertex", "coord").agg(F.avg("value").alias("c"))
    moved = t.join(centre, ["series", "vertex", "coord"]).select("series", "sample", "vertex", "coord", (F.col("value") - F.col("c")).alias("value"))
    return covering(_kmeans(curves(moved).withColumnRenamed("curve", "features"), cluster_size, seed))


def axes(t: DataFrame, form: str) -> DataFrame:
    """series, vertex, axis array<double> of centred curves, whole curves at a time through Arrow.

    form: 'first' or 'last' principal axis, 'all' axes flattened, or 'quaternion' of the rotation they make (x, y, z, w;
    three coordinates). Signs are fixed: the largest component of an axis is positive; of a quaternion w is not negative.
    """
    from .embed import quaternion, rotation_of

    ndim = t.groupBy("series").agg((F.max("coord") + 1).alias("ndim"))

    def run(batches):
        for batch in batches:
            out = []
            for curve, d in zip(batch.column("curve").to_pylist(), batch.column("ndim").to_pylist(), strict=True):
                x = np.array(curve).reshape(-1, d)
                vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=len(x) < d)[2]
                if form == "quaternion":
                    if d != 3:
                        raise ValueError("a quaternion needs three coordinates")
                    out.append(quaternion(rotation_of(vt)).tolist())
                else:
                    signs = np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(axis=1)])
                    vt = vt * np.where(signs == 0, 1, signs)[:, None]
                    out.append((vt[0] if form == "first" else vt[-1] if form == "last" else vt.ravel()).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("series"), batch.column("vertex"), pa.array(out, pa.list_(pa.float64()))], ["series", "vertex", "axis"])

    return curves(t).join(ndim, "series").mapInArrow(run, "series string, vertex long, axis array<double>")


def pca_kmeans(t: DataFrame, quality: float = 1e-6, cluster_size: int = 10_000, seed: int = 1) -> DataFrame:
    """k-means of the principal axes of each curve."""
    return covering(_kmeans(axes(t, "all").withColumnRenamed("axis", "features"), cluster_size, seed))


def _lots(centres: DataFrame) -> DataFrame:
    """all: centres (centre, at) as arrays, a row for each CENTRE_BYTES of them, which is what is broadcast at a time."""
    size = centres.agg(F.sum(8 * F.size("at") + 32)).first()[0] or 0
    lots = max(1, -(-size // CENTRE_BYTES))
    dealt = centres.withColumn("lot", F.pmod(F.xxhash64("centre"), F.lit(lots)))
    return shared_table(dealt.groupBy("lot").agg(F.collect_list(F.struct("centre", "at")).alias("all")).select("all"), "centres")


def _beside(points: DataFrame, lots: DataFrame, one: bool) -> DataFrame:
    return points.crossJoin(F.broadcast(lots) if one else lots)  # one: CENTRE_BYTES, about


def distances(points: DataFrame, centres: DataFrame, metric=line_angle) -> DataFrame:
    """Each point (series, vertex, axis) with each centre (centre, at): distance. All pairs are the result; nearest() makes none of them.

    Centres come to the points as arrays; points are never shuffled.
    """
    lots = _lots(centres)
    each = _beside(points, lots, lots.count() <= 1).withColumn("c", F.explode("all"))
    return each.select(*points.columns, F.col("c.centre").alias("centre"), F.col("c.at").alias("at")).withColumn("distance", metric(F.col("axis"), F.col("at")))


def nearest(points: DataFrame, centres: DataFrame, metric=line_angle) -> DataFrame:
    """series, vertex, centre, distance of the nearest centre; equals go to the smaller centre.

    The least is taken over the array of centres within a point's row; a row per point and lot of centres is all that is made.
    """
    lots = _lots(centres)
    one = lots.count() <= 1
    best = F.array_min(F.transform("all", lambda c: F.struct(metric(F.col("axis"), c["at"]).alias("distance"), c["centre"].alias("centre"))))
    each = _beside(points, lots, one).select("series", "vertex", best.alias("b"))
    if not one:
        each = each.groupBy("series", "vertex").agg(F.min("b").alias("b"))
    return each.select("series", "vertex", F.col("b.centre").alias("centre"), F.col("b.distance").alias("distance"))


def farthest_rounds(points: DataFrame, seed: Column, rounds: int, least: float = -1.0, metric=line_angle):
    """Greedy cover of one series: (points with best distance and label, vertices chosen round by round).

    seed: an array, where the first centre is. Each round adds the vertex farthest from all centres so far (the smallest
    of equals) and ends when that is within `least`, or is a centre already. A round is one pass; the state is written
    to the shared folder every few rounds.
    """
    state = points.withColumn("best", metric(F.col("axis"), seed)).withColumn("label", F.lit(0))
    chosen: list[int] = []
    for k in range(1, rounds + 1):
        top = state.agg(F.max_by(F.struct("vertex", "axis", "best"), F.struct("best", -F.col("vertex"))).alias("p")).first()["p"]
        if top is None or top["best"] <= least or top["vertex"] in chosen:
            break
        chosen.append(top["vertex"])
        d = metric(F.col("axis"), F.array(*(F.lit(float(x)) for x in top["axis"])))
        state = state.withColumn("d", d).select("series", "vertex", "axis", F.least("best", "d").alias("best"), F.when(F.col("d") < F.col("best"), k).otherwise(F.col("label")).alias("label"))
        if k % ROUNDS_KEPT == 0:
            state = shared_table(state, "cover")
    return state, chosen


#: Below this, distances are rounding noise: no centre is added for it.
LEAST_ANGLE = 1e-12


def near_states(t: DataFrame, quality: float, form: str, metric=line_angle) -> DataFrame:
    """series, vertex, label, best: the greedy cover by principal axes or rotations, and how far each vertex is from its centre.

    The first centre is the axis of the curves of all vertices, each about its own mean, taken as one curve. Ends for any
    quality, with no other cap on rounds: a centre is never chosen twice and distances below LEAST_ANGLE count as none.
    """
    points = shared_table(axes(t, form), "axes")
    done = points.select("series", "vertex", F.lit(0).alias("label"), F.lit(0.0).alias("best")).limit(0)
    for r in points.groupBy("series").count().collect():  # series are few
        own = points.where(F.col("series") == r["series"])
        seed = _pooled_axis(t.where(F.col("series") == r["series"]), form)
        state, _ = farthest_rounds(own, F.array(*(F.lit(float(x)) for x in seed)), r["count"], bound_of(quality), metric)
        done = done.unionByName(state.select("series", "vertex", "label", "best"))
    return done


def bound_of(quality: float) -> float:
    """The largest distance to a centre that a cover by axes leaves."""
    return max((1 - math.cos(quality)) / 2, LEAST_ANGLE)


def near_values(t: DataFrame, quality: float, form: str, metric=line_angle) -> DataFrame:
    """The covering of near_states(): every vertex is within an angle of about quality / 2 of its centre."""
    return covering(near_states(t, quality, form, metric).select("series", "vertex", "label"))


def _pooled_axis(t: DataFrame, form: str) -> list[float]:
    """The axis of all vertices' samples, each about its vertex's mean, from sums of products (one small matrix comes to the driver)."""
    from .embed import quaternion, rotation_of

    d = t.agg(F.max("coord") + 1).first()[0]
    point = t.groupBy("sample", "vertex").pivot("coord", list(range(d))).agg(F.first("value"))
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    own = point.groupBy("vertex").agg(F.count("*").alias("n"), *(F.covar_pop(f"`{i}`", f"`{j}`").alias(f"c{i}_{j}") for i, j in pairs))
    sums = own.agg(*(F.sum(F.col("n") * F.col(f"c{i}_{j}")).alias(f"p{i}_{j}") for i, j in pairs)).first()
    p = np.array([[sums[f"p{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
    vt = np.linalg.eigh(p)[1][:, ::-1].T
    if form == "quaternion":
        return quaternion(rotation_of(vt)).tolist()
    return (vt[0] if form == "first" else vt[-1]).tolist()


def first_axis(t: DataFrame, quality: float = 1e-6, cluster_size: int = 10_000) -> DataFrame:
    return near_values(t, quality, "first")


def last_axis(t: DataFrame, quality: float = 1e-6, cluster_size: int = 10_000) -> DataFrame:
    return near_values(t, quality, "last")


def near_quaternions(t: DataFrame, quality: float = 1e-6, cluster_size: int = 10_000) -> DataFrame:
    return near_values(t, quality, "quaternion")
