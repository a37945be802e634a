"""Reductions, clusterings and pipelines keep their bounds; inputs are rebuilt from their descriptions."""

import numpy as np
import pandas as pd
import pytest

from tensorloom.operators import cluster, codec, embed, metric, tensor
from tensorloom.plans import pipeline, registry

SIMPLE = np.array([[[0, 1], [5, 3]], [[0.6, 1.4], [6, 2]], [[1, 2], [7, 1]]])


def moving(reps: int, samples: int = 30) -> np.ndarray:
    """Vertices that move along one of three base vectors, each at its own speed."""
    base = np.array([[1, 1, 1], [0.5, 0.5, 1], [-1, 1, -1]])
    n = 3 * reps
    i = np.arange(n)
    return np.array([10, 0, -10]) + np.arange(samples)[:, None, None] * (i / n)[None, :, None] * base[i % 3][None]


def long(spark, x, series="x"):
    t, v, d = x.shape
    at = np.indices(x.shape).reshape(3, -1)
    return spark.createDataFrame(pd.DataFrame({"series": series, "sample": at[0].astype("int32"), "vertex": at[1], "coord": at[2].astype("int32"), "value": x.ravel().astype(float)}), "series string, sample int, vertex long, coord int, value double")


@pytest.mark.parametrize("name", ["raw", "static", "pca", "rotation"])
@pytest.mark.parametrize("x,quality", [(SIMPLE, 1.0), (SIMPLE, 1e-3), (moving(40), 1e-2), (moving(1), 1e-4), (SIMPLE[:, :1], 0.1), (SIMPLE[:1], 0.1), (SIMPLE[:, :, :1], 0.1), (np.full((4, 3, 3), 2.0), 0.1)])
def test_methods_round_trip(name, x, quality):
    method = embed.METHODS[name][1]
    if not method.valid(x, quality):
        pytest.skip("not valid here")
    header, payload = method.encode(x, quality)
    back, h, p = method.decode(header, payload)
    assert back.shape == x.shape and (h, p) == (len(header), len(payload))
    assert np.abs(back - x).max() <= (1.5 if name == "static" else 1.0) * quality * (1 + 1e-5)


def test_validity():
    assert not embed.Static.valid(SIMPLE, 1e-6) and embed.Static.valid(SIMPLE, 1.0)
    assert not embed.Rotation.valid(SIMPLE, 1) and embed.Rotation.valid(moving(2), 1)


def test_rotations():
    rng = np.random.default_rng(3)
    for vector in [*rng.normal(0, 1, (50, 3)), np.zeros(3), np.array([np.pi, 0, 0]), np.array([0, 1e-10, 0]), np.array([0, 2, 2.4])]:
        r = embed.rotations(vector[None])[0]
        assert np.allclose(r @ r.T, np.eye(3)) and np.isclose(np.linalg.det(r), 1)
        assert np.allclose(embed.rotations(embed.rotation_vector(r)[None])[0], r, atol=1e-7)
        q = embed.quaternion(r)
        assert np.isclose(np.linalg.norm(q), 1) and q[3] >= 0


@pytest.mark.parametrize("eps,rows", [(0.5, [3, 1, 2, 0]), (0.01, [3, 1, 2, 2]), (2.0001, [2, 0, 2, 0])])
def test_truncation(eps, rows):
    a = np.array([[0, 1, 2], [1, 1e-6, 2e-6], [2, 3, 1e-7], [0.1, 0.2, 0]])
    b = np.ones((3, 7))
    need = embed.components_needed(a @ b, a, b, eps)
    assert need.max(axis=1).tolist() == rows and need.max() <= 3


def test_truncation_never_exceeds_rank():
    a, b = np.ones((2, 1)), np.ones((1, 2))
    assert (embed.components_needed(a @ b + 5, a, b, 0.1) == 1).all()


@pytest.mark.parametrize("x,quality,best", [(SIMPLE, 1e-6, "raw"), (SIMPLE, 1.0, "static"), (moving(1000), 1e-2, "pca")])
def test_selector(spark, x, quality, best):
    t = long(spark, x)
    cover = cluster.monolithic(t)
    chosen = embed.best(embed.embed(t, cover, quality), quality).collect()
    assert [r["method"] for r in chosen] == [best]


def test_compress_keeps_bound(spark):
    t = long(spark, moving(30)).unionByName(long(spark, SIMPLE, "y"))
    for clustering in ("monolithic", "by_index", "static_first"):
        encoded, cover = pipeline.compress(t, 0.01, clustering, 20)
        back = pipeline.decompress(encoded, cover)
        assert all(r["linf"] <= 0.01 * (1 + 1e-6) for r in metric.linf(t, back).collect())
        assert back.count() == t.count()
        sizes = {r["series"]: len(r["covering"]) for r in pipeline.covering_files(cover).collect()}
        assert sizes == {r["series"]: r["covering_bytes"] for r in cluster.bytes_size(cover).collect()}


def test_files_round_trip(spark):
    x = moving(30)
    t = long(spark, x).unionByName(long(spark, SIMPLE, "y"))
    encoded, cover = pipeline.compress(t, 0.01, "by_index", 20)
    files = pipeline.embedding_files(encoded, cover)
    sizes = {r["series"]: len(r["header"]) + len(r["projection"]) + len(r["clusters"]) for r in files.collect()}
    assert sizes == {r["series"]: r["compressed_size"] for r in pipeline.compressed_size(encoded, cover).collect()}
    back = pipeline.read_embedding_files(files)
    assert back.count() == t.count() and all(r["linf"] <= 0.01 * (1 + 1e-6) for r in metric.linf(t, back).collect())


def test_by_index_sizes(spark):
    t = long(spark, moving(1000, 1))
    sizes = [r["size"] for r in cluster.counts(cluster.by_index(t, 1e-2, 11)).collect()]
    assert len(sizes) == 273 and max(sizes) <= 11 and len(sizes) * 11 - sum(sizes) < 11


@pytest.mark.parametrize("n,size", [(10, 3), (23, 5), (7, 7), (1, 4), (3000, 11)])
def test_even_buckets(spark, n, size):
    from pyspark.sql import functions as F

    bucket, within = cluster.even_bucket(F.col("id"), F.lit(n), size)
    got = [(r[0], r[1]) for r in spark.range(n).orderBy("id").select(bucket, within).collect()]
    k = 1 + (n - 1) // size
    want = [(b, w) for b in range(k) for w in range(n // k + (b < n % k))]
    assert got == want


@pytest.mark.parametrize("form", ["first_axis", "last_axis", "near_quaternions"])
def test_greedy_covers_end(spark, form):
    rng = np.random.default_rng(1)
    x = moving(4) + rng.normal(0, 0.3, (30, 12, 3))
    for quality in (1e-8, 2.0):  # tiny qualities end too
        cover = registry.CLUSTERINGS[form](long(spark, x), quality, 100)
        assert cluster.verify(cover).first()["exact"]


def test_kmeans(spark):
    cover = cluster.kmeans(long(spark, moving(20)), 1e-2, 20)
    assert cluster.verify(cover).first()["exact"]


def test_static_first_extremes(spark):
    still, x = np.ones((5, 4, 2)), moving(2)
    assert {r["cluster"] for r in cluster.static_first(long(spark, still), 0.1).collect()} == {0}
    assert cluster.counts(cluster.static_first(long(spark, x), 1e-9, 3)).count() == 3  # vertex 0 has speed 0
    mixed = np.concatenate((np.ones((30, 2, 3)), x), axis=1)
    sizes = {r["cluster"]: r["size"] for r in cluster.counts(cluster.static_first(long(spark, mixed), 1e-9, 3)).collect()}
    assert sizes[0] == 3 and sum(sizes.values()) == 8
    half = np.stack((np.ones((6, 1)), np.arange(6.0)[:, None]), axis=2)  # one coordinate of two is static
    flags = [cluster.static_vertices(long(spark, half), 0.5, every=e).first()["static"] for e in (True, False)]
    assert flags == [False, True]


def test_rejects_bad_tensors(spark):
    for bad in (np.nan, np.inf):
        x = SIMPLE.copy()
        x[0, 0, 0] = bad
        with pytest.raises(ValueError):
            tensor.validated(long(spark, x))
    with pytest.raises(ValueError):
        tensor.validated(long(spark, SIMPLE).limit(5))
    assert tensor.validated(long(spark, SIMPLE)).count() == 12
    with pytest.raises(ValueError):
        embed.embed(long(spark, SIMPLE), cluster.monolithic(long(spark, SIMPLE)), 0.0)


def test_reports(spark):
    t = long(spark, SIMPLE)
    empty = t.limit(0)
    size = spark.createDataFrame([("x", 10)], "series string, compressed_size long")
    assert metric.combined(metric.report(empty, empty, size)).collect() == []
    r = metric.combined(metric.report(t, t, size)).where("series is null").first()
    assert (r["original_size"], r["compressed_size"], r["linf"], r["numerrors"]) == (96, 10, 0.0, 0) and r["ratio"] == 1 - 10 / 96
    with pytest.raises(Exception, match="shapes differ"):
        metric.report(t, t.where("vertex = 0"), size).collect()
    assert "96 -> 10 bytes" in metric.described(metric.report(t, t, size)).first()["line"]


def test_sizes_foretell_bytes(spark):
    x = np.random.default_rng(5).normal(0, 3, (200, 4, 3))
    t = long(spark, x)
    sizes = {r["coord"]: r["stream_bytes"] for r in codec.coordinates_size(t, 1e-3).collect()}
    from tensorloom.functions.bytes import encode_stream

    assert sizes == {k: len(encode_stream(np.ascontiguousarray(x[:, :, k].ravel()), 1e-3)) for k in range(3)}


def test_ranks_over_tasks(spark):
    from pyspark.sql import functions as F

    from tensorloom.operators.rank import ranked

    df = spark.range(5000).select((F.col("id") % 3 == 0).cast("string").alias("series"), F.expr("(id * 7919) % 5003").alias("vertex"))
    a, b = (sorted(map(tuple, ranked(df, ["series"], ["vertex"], "place", n).collect())) for n in (10**6, 0))
    assert a == b and [r[2] for r in a if r[0] == "true"] == list(range(1667))
    assert ranked(df.limit(0), ["series"], ["vertex"], "place").count() == 0


def test_registry(spark):
    with pytest.raises(ValueError):
        registry.register_method("other", 1, embed.Raw)
    with pytest.raises(ValueError):
        registry.register_clustering("kmeans", cluster.by_index)
    registry.register_clustering("mine", cluster.by_index)
    registry.register_clustering("mine", cluster.by_index)
    del registry.CLUSTERINGS["mine"]


def test_unflatten_checks_columns(spark):
    flat = tensor.flatten_config(long(spark, SIMPLE))
    assert tensor.unflatten_config(flat, 2).count() == 12
    with pytest.raises(Exception, match="no multiple"):
        tensor.unflatten_config(flat, 3).collect()


def test_whole_streams(spark):
    """No row goes for the sake of a short vertex; by length, series are dense."""
    df = spark.createDataFrame([(v, i, float(i)) for v, n in ((1, 1), (2, 50), (3, 7), (4, 7)) for i in range(n)], "v long, i int, x double")
    t = tensor.from_rows(df, "v", ["i"], ["x"], "s")
    assert sorted((r["vertex"], r["sample"], r["value"]) for r in t.collect()) == sorted((v, i, x) for v, i, x in map(tuple, df.collect()))
    shapes = {r["series"]: (r["nverts"], r["valid"]) for r in tensor.shape(tensor.by_length(t)).collect()}
    assert shapes == {"s_1": (1, True), "s_50": (1, True), "s_7": (2, True)}


def test_whole_arrays(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0, 5.0]), (2, [1.0]), (3, [])], "id long, a array<double>")
    got = sorted((r["series"], r["sample"], r["vertex"], r["coord"], r["value"]) for r in tensor.from_arrays(df, "id", "a", 3, "s").collect())
    assert got == [("s", 0, 1, c, c + 1.0) for c in range(3)] + [("s_rest", 0, 1, 0, 4.0), ("s_rest", 0, 1, 1, 5.0), ("s_rest", 0, 2, 0, 1.0)]


@pytest.mark.parametrize("item_bytes", embed.FLOATS)
@pytest.mark.parametrize("name", ["raw", "static", "pca", "rotation"])
def test_floats_of_each_size(name, item_bytes):
    """Decoding gives the type again; streams that are not quantised take its bytes."""
    method, x = embed.METHODS[name][1], (moving(40) / 4).astype(f"<f{item_bytes}")
    quality = {2: 0.5, 4: 1e-2, 8: 1e-2}[item_bytes]
    x = x[:, :, :] if name != "static" else np.broadcast_to(x[:1], x.shape)
    header, payload = method.encode(x, quality)
    back, h, p = method.decode(header, payload)
    assert back.dtype == x.dtype and back.shape == x.shape and (h, p) == (len(header), len(payload))
    assert np.abs(back.astype(np.float64) - x).max() <= quality
    if name == "raw":
        header, payload = method.encode(x, 1e-30)  # nothing to be saved by quantising
        assert len(payload) == 3 + x.size * item_bytes and (method.decode(header, payload)[0] == x).all()


def test_floats_as_columns(spark):
    x = np.concatenate((np.random.default_rng(4).normal(0, 10.0 ** np.arange(-9, 6), (20, 15)).ravel(), [0.0, 65504.0, 65519.0, 65520.0, 1e9, -1e9, 2048.0, 2049.0, 2.0**-24, 2.0**-26]))
    t = long(spark, x[:, None, None])
    with np.errstate(over="ignore"):
        for b in embed.FLOATS:
            got = {r["sample"]: r["value"] for r in tensor.as_floats(t, b).collect()}
            assert [got[i] for i in range(len(x))] == x.astype(f"f{b}").astype(float).tolist()


def test_errors_name_the_series(spark):
    t = long(spark, SIMPLE, "good").unionByName(long(spark, SIMPLE, "short").where("sample + vertex > 0"))
    with pytest.raises(Exception, match="series 'short', cluster 0"):
        embed.embed(t, cluster.monolithic(t), 0.1).collect()
    with pytest.raises(Exception, match="does not fit floats of 2 bytes"):
        embed.embed(long(spark, SIMPLE * 1e6), cluster.monolithic(long(spark, SIMPLE)), 0.1, item_bytes=2).collect()


def test_before_over_tasks(spark):
    from pyspark.sql import functions as F

    from tensorloom.operators.rank import before

    df = spark.range(5000).select((F.col("id") % 3 == 0).cast("string").alias("series"), F.expr("(id * 7919) % 5003").alias("at"), (F.col("id") * 1.5).alias("x"))
    df = df.unionByName(spark.createDataFrame([("alone", 1, 2.0)], df.schema))
    a, b = (sorted(map(tuple, before(df, ["series"], ["at"], "x", "last", n).collect())) for n in (10**6, 0))
    assert a == b and sum(r[3] is None for r in a) == 3


def test_nearest_over_lots(spark, monkeypatch):
    rng = np.random.default_rng(8)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1)[:, None])(rng.normal(0, 1, (n, 3)))
    p, c = unit(40), unit(25)
    points = spark.createDataFrame([("s", i, x.tolist()) for i, x in enumerate(p)], "series string, vertex long, axis array<double>")
    centres = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(c)], "centre long, at array<double>")
    d = 1 - (p @ c.T) ** 2
    for size in (cluster.CENTRE_BYTES, 100):
        monkeypatch.setattr(cluster, "CENTRE_BYTES", size)
        got = {r["vertex"]: (r["centre"], r["distance"]) for r in cluster.nearest(points, centres).collect()}
        assert all(got[i][0] == d[i].argmin() and abs(got[i][1] - d[i].min()) < 1e-12 for i in range(40))
        assert cluster.distances(points, centres).count() == 1000


@pytest.mark.parametrize("form", ["first", "last"])
def test_greedy_cover(spark, form):
    """The cover's first centre, its further ones and its labels, by plain numpy."""
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (6, 25, 3)) * [1.5, 1, 0.8] + rng.normal(0, 50, (1, 25, 3))
    moved = x - x.mean(axis=0)
    axis = lambda m: np.linalg.svd(m, full_matrices=False)[2][0 if form == "first" else -1]
    own = np.array([axis(moved[:, i]) for i in range(25)])
    centres = [axis(moved.transpose(1, 0, 2).reshape(-1, 3))]
    eps = cluster.bound_of(0.8)
    while (best := (1 - (own @ np.array(centres).T) ** 2).min(axis=1)).max() > eps:
        centres.append(own[best.argmax()])
    labels = (1 - (own @ np.array(centres).T) ** 2).argmin(axis=1)
    got = {r["vertex"]: r for r in cluster.near_states(long(spark, x), 0.8, form).collect()}
    assert len(centres) > 2 and [got[i]["label"] for i in range(25)] == labels.tolist()
    assert np.allclose([got[i]["best"] for i in range(25)], best, atol=1e-9) and best.max() <= eps


def test_covers_end_by_distance_only(spark, monkeypatch):
    """A cover may take as many rounds as there are vertices."""
    from pyspark.sql import functions as F

    from tensorloom.operators import cluster

    asked = []

    def rounds(points, seed, most, *_):
        asked.append(most)
        return points.withColumn("label", F.lit(0)).withColumn("best", F.lit(0.0)), []

    monkeypatch.setattr(cluster, "farthest_rounds", rounds)
    corner = F.posexplode(F.array(F.col("id") * 0.0, F.sin("id"), F.col("id") * 0.0, F.cos("id")))
    t = spark.range(10_050).select(F.lit("s").alias("series"), F.col("id").alias("vertex"), corner.alias("i", "value"))
    t = t.select("series", F.expr("cast(i % 2 as int)").alias("sample"), "vertex", F.expr("cast(i div 2 as int)").alias("coord"), "value")
    cluster.first_axis(t)
    assert asked == [10_050]
