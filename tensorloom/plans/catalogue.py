"""Named queries over the star-schema tables, each an operator of the library, with SQL for the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import cluster, codec, embed, metric, tensor
from ..sources import manifest
from ..streaming import deltas
from ..tables import shared_table
from . import pipeline, sql

Q_EVT, Q_EMB, Q_LI, Q_STATIC, Q_TYPED = 1e-2, 1e-2, 7e-3, 0.2, 1e-6
EVT_BY, EVT_ORDER = ["series", "vertex", "coord"], ["sample"]

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            SQL[fn.__name__] = oracle
        return fn

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _evt_steps(spark, sf_dir):
    return codec.delta(codec.quantise(tensor.event_values(spark, sf_dir), Q_EVT), EVT_BY, EVT_ORDER)


# codecs


@query(f"with {sql.EVT} select vertex, sample, {sql.quantised('value', Q_EVT)} as quantised from evt")
def intify_quantize(spark, sf_dir):
    return codec.quantise(tensor.event_values(spark, sf_dir), Q_EVT).select("vertex", "sample", "quantised")


@query(f"with {sql.EVT_DELTA(Q_EVT)} select vertex, sample, delta from d")
def intify_delta(spark, sf_dir):
    return _evt_steps(spark, sf_dir).select("vertex", "sample", "delta")


@query(f"with {sql.EVT_DELTA(Q_EVT)}, {sql.HEAD} select vertex, n, base, width from h")
def intify_header(spark, sf_dir):
    return codec.headers(_evt_steps(spark, sf_dir), ["vertex"]).select("vertex", "n", "base", "width")


@query(f"with {sql.EVT_DELTA(Q_EVT)}, {sql.HEAD} select vertex, {sql.intify('n', 'width')} as intify_bytes from h")
def intify_size(spark, sf_dir):
    return codec.sizes(codec.headers(_evt_steps(spark, sf_dir), ["vertex"])).select("vertex", "intify_bytes")


@query(f"with {sql.EVT} select vertex, count(*) * 8 as raw_bytes from evt group by vertex")
def raw_size(spark, sf_dir):
    return codec.stream_sizes(tensor.event_values(spark, sf_dir), ["vertex"], EVT_ORDER, Q_EVT).select("vertex", "raw_bytes")


@query(f"with {sql.LI_DELTA(1e-6)}, h as (select vertex, coord, count(*) as n, {sql.width('max(delta) - min(delta)')} as width from d group by vertex, coord) select vertex, coord, case when n * 8 <= {sql.intify('n', 'width')} then 'raw' else 'intify' end as codec, {sql.stream('n', 'width', 8)} as stream_bytes from h")
def codec_choice(spark, sf_dir):
    return codec.stream_sizes(tensor.lineitems(spark, sf_dir), ["vertex", "coord"], ["sample"], 1e-6).select("vertex", "coord", "codec", "stream_bytes")


@query(f"with {sql.EVT_DELTA(Q_EVT)} select vertex, sample, round(quantised * {sql.stored(Q_EVT)}, 6) as decoded from d")
def intify_decode(spark, sf_dir):
    return codec.undelta(_evt_steps(spark, sf_dir), EVT_BY, EVT_ORDER, Q_EVT).select("vertex", "sample", F.round("decoded", 6).alias("decoded"))


@query(f"with {sql.EVT} select vertex, sample, round({sql.quantised('value', Q_EVT)} * {sql.stored(Q_EVT)}, 6) as value from evt")
def codec_bytes_round_trip(spark, sf_dir):
    """Through real bytes: encoded and decoded streams give the quantised values."""
    encoded = codec.encode(tensor.event_values(spark, sf_dir), ["vertex"], EVT_ORDER, Q_EVT)
    return codec.decode(encoded, ["vertex"]).select("vertex", F.col("pos").cast("int").alias("sample"), F.round("value", 6).alias("value"))


@query(f"with {sql.EVT_DELTA(Q_EVT)}, {sql.HEAD} select vertex, n, 1 + {sql.varint('n')} + {sql.stream('n', 'width', 8)} as bytes from h")
def codec_bytes_length(spark, sf_dir):
    """The lengths of real bytes, which the size expressions foretell."""
    encoded = codec.encode(tensor.event_values(spark, sf_dir), ["vertex"], EVT_ORDER, Q_EVT)
    return encoded.select("vertex", "n", F.length("payload").cast("long").alias("bytes"))


@query(f"with {sql.EMB4}, q as (select *, {sql.quantised('value', Q_EMB)} as r from emb4), d as (select coord, r - coalesce(lag(r) over (partition by coord order by sample, vertex), 0) as delta from q), h as (select coord, count(*) as n, {sql.width('max(delta) - min(delta)')} as width from d group by coord) select coord, n, width, {sql.stream('n', 'width', 8)} as stream_bytes from h")
def coordinate_streams_size(spark, sf_dir):
    return codec.coordinates_size(tensor.embeddings4(spark, sf_dir), Q_EMB).select("coord", "n", "width", "stream_bytes")


@query(f"with e as (select user_id as vertex, row_number() over (partition by user_id order by ts, event_id) as sample, {sql.quantised('value', Q_EVT)} as quantised from events), d as (select *, quantised - coalesce(lag(quantised) over (partition by vertex order by sample), 0) as delta from e), {sql.HEAD} select vertex, n, n * 8 as raw_bytes, {sql.intify('n', 'width')} as intify_bytes, {sql.stream('n', 'width', 8)} as stream_bytes from h")
def event_stream_sizes(spark, sf_dir):
    t = tensor.event_values(spark, sf_dir)
    return codec.stream_sizes(t, ["vertex"], EVT_ORDER, Q_EVT).select("vertex", "n", "raw_bytes", "intify_bytes", "stream_bytes")


_TYPED = {2: "round_even(value, 0)", 4: "value::float::double", 8: "value"}  # whole numbers that 16 bits hold; single and double precision
_TYPED_SQL = " union all ".join(f"select vertex, {b} as item_bytes, n, {sql.intify('n', 'width')} as intify_bytes, case when n * {b} <= {sql.intify('n', 'width')} then 'raw' else 'intify' end as codec, {sql.stream('n', 'width', b)} as stream_bytes from h{b}" for b in _TYPED)


@query(f"with {sql.EVT}, " + ", ".join(f"q{b} as (select vertex, sample, {sql.quantised(v, Q_TYPED)} as q from evt), d{b} as (select vertex, q - coalesce(lag(q) over (partition by vertex order by sample), 0) as delta from q{b}), h{b} as (select vertex, count(*) as n, {sql.width('max(delta) - min(delta)')} as width from d{b} group by vertex)" for b, v in _TYPED.items()) + f" {_TYPED_SQL}")
def typed_stream_sizes(spark, sf_dir):
    """Streams of floats of 2, 4 and 8 bytes: raw values take as many."""
    t, done = tensor.event_values(spark, sf_dir), None
    for b, typed in ((2, F.rint("value")), (4, F.col("value").cast("float").cast("double")), (8, F.col("value"))):
        s = codec.stream_sizes(t.withColumn("value", typed), ["vertex"], EVT_ORDER, Q_TYPED, b).select("vertex", F.lit(b).alias("item_bytes"), "n", "intify_bytes", "codec", "stream_bytes")
        done = s if done is None else done.unionByName(s)
    return done


@query(f"select o_orderkey, {sql.varint('o_orderkey')} as bytes from orders")
def varint_length(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", X.varint_length(F.col("o_orderkey")).alias("bytes"))


@query("select l_linenumber, case when max(l_partkey) = 0 then 0 else length(bin(max(l_partkey))) end::int as part_width, case when max(l_orderkey) = 0 then 0 else length(bin(max(l_orderkey))) end::int as order_width from lineitem group by l_linenumber")
def uint_width(spark, sf_dir):
    wide = lambda c: X.bit_width(F.max(c)).cast("int")
    return _table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(wide("l_partkey").alias("part_width"), wide("l_orderkey").alias("order_width"))


_RANGES = "case when {lo} < 0 then case when {lo} >= -128 and {hi} < 127 then 1 when {lo} >= -32768 and {hi} < 32767 then 2 else 3 end when {hi} < 255 then 1 when {hi} < 65535 then 2 else 3 end"


@query("with x as (select l_suppkey, l_partkey - 100 as a from lineitem) select l_suppkey, " + _RANGES.format(lo="min(a)", hi="max(a)") + " as range_width from x group by l_suppkey")
def int_range_width(spark, sf_dir):
    a = F.col("l_partkey") - 100
    return _table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(X.int_range_width(F.min(a), F.max(a)).alias("range_width"))


@query("select w as width, arg_min(s, ((s % w) * (64 // s)) * 100 + s)::int as word_bits, (arg_min(s, ((s % w) * (64 // s)) * 100 + s) // w)::int as per_word from range(1, 65) t(w), (values (8), (16), (32), (64)) v(s) where s >= w group by w")
def tiny_int_wordsize(spark, sf_dir):
    w = F.col("id").cast("int")
    return spark.range(1, 65).select(F.col("id").alias("width"), X.word_bits(w).cast("int").alias("word_bits"), F.floor(X.word_bits(w) / w).cast("int").alias("per_word"))


@query(f"with {sql.EMB4} select vertex as row, sample * 4 + coord as k, value from emb4 where sample * 4 + coord < vertex % 7")
def jagged_zero(spark, sf_dir):
    return codec.zero_jagged(_matrix(spark, sf_dir), F.col("row") % 7).select("row", "k", "value")


@query(f"with {sql.EMB4} select sample * 4 + coord as k, count(*) as rows from emb4 where sample * 4 + coord < vertex % 7 group by 1")
def jagged_counts(spark, sf_dir):
    return codec.jagged_counts(_matrix(spark, sf_dir), F.col("row") % 7)


def _matrix(spark, sf_dir):
    return tensor.embeddings4(spark, sf_dir).select(F.col("vertex").alias("row"), (F.col("sample") * 4 + F.col("coord")).alias("k"), "value")


# values


@query(f"with {sql.EMB4} select vertex, coord, round(avg(value), 6) as centroid from emb4 group by vertex, coord")
def centroid(spark, sf_dir):
    return metric.centroid(tensor.embeddings4(spark, sf_dir)).select("vertex", "coord", F.round("centroid", 6).alias("centroid"))


_CENTRES = f"c as (select vertex, coord, {sql.quantised('avg(value)', Q_EMB)} as r from emb4 group by vertex, coord)"


@query(f"with {sql.EMB4}, {_CENTRES} select vertex, coord, round(r * {sql.stored(Q_EMB)}, 6) as centroid from c")
def centroid_rounded(spark, sf_dir):
    return metric.rounded_centroid(tensor.embeddings4(spark, sf_dir), Q_EMB).select("vertex", "coord", F.round("centroid", 6).alias("centroid"))


@query(f"with {sql.EMB4}, {_CENTRES} select sample, vertex, coord, round(value - r * {sql.stored(Q_EMB)}, 6) as value from emb4 join c using (vertex, coord)")
def centered(spark, sf_dir):
    return metric.centred(tensor.embeddings4(spark, sf_dir), Q_EMB).select("sample", "vertex", "coord", F.round("value", 6).alias("value"))


@query(f"with {sql.LI} select vertex, coord, min(value) as low, max(value) as high, round(0.5 * (min(value) + max(value)), 6) as midpoint from li group by vertex, coord")
def bbox_midpoint(spark, sf_dir):
    return metric.bounding_box(tensor.lineitems(spark, sf_dir)).select("vertex", "coord", (F.col("low") + 0.0).alias("low"), (F.col("high") + 0.0).alias("high"), F.round("midpoint", 6).alias("midpoint"))


@query(f"with {sql.EVT}, b as (select vertex, max(value) - min(value) <= 200 as ok from evt group by vertex) select vertex, ok as valid from b")
def static_valid(spark, sf_dir):
    return embed.static_values(tensor.event_values(spark, sf_dir), 100.0).groupBy("vertex").agg(F.bool_and("valid").alias("valid"))


@query(f"with {sql.LI}, m as (select vertex, coord, {sql.quantised('0.5 * (min(value) + max(value))', 0.5)} * {sql.stored(0.5)} as middle from li group by vertex, coord) select vertex, coord, round(max(abs(value - middle)), 6) as lost from li join m using (vertex, coord) group by vertex, coord")
def static_reconstruct(spark, sf_dir):
    t = tensor.lineitems(spark, sf_dir)
    both = t.join(embed.static_values(t, 0.5), ["series", "vertex", "coord"])
    return both.groupBy("vertex", "coord").agg(F.round(F.max(F.abs(F.col("value") - F.col("middle"))), 6).alias("lost"))


@query(f"with {sql.LI}, s as (select vertex, coord, arg_min(value, sample) as f, min(value) as lo, max(value) as hi from li group by vertex, coord) select vertex, bool_or(greatest(hi - f, f - lo) < {Q_STATIC}) as any_static, bool_and(greatest(hi - f, f - lo) < {Q_STATIC}) as all_static from s group by vertex")
def static_vertices(spark, sf_dir):
    t = tensor.lineitems(spark, sf_dir)
    loose, strict = (cluster.static_vertices(t, Q_STATIC, every=e).withColumnRenamed("static", n) for e, n in ((False, "any_static"), (True, "all_static")))
    return loose.join(strict, ["series", "vertex"]).select("vertex", "any_static", "all_static")


@query(f"with {sql.LI}, s as (select vertex, coord, arg_min(value, sample) as f, min(value) as lo, max(value) as hi from li group by vertex, coord), v as (select vertex, bool_or(greatest(hi - f, f - lo) < 0.09) as st from s group by vertex), q as (select vertex, row_number() over (order by vertex) - 1 as r from v where st), m as (select vertex, row_number() over (order by vertex) - 1 as p, count(*) over () as n from v where not st), b as (select *, 1 + (n - 1) // 7 as k from m), x as (select *, n // k as s, n % k as e from b), o as (select vertex, case when p < e * (s + 1) then p // (s + 1) else e + (p - e * (s + 1)) // s end as c, case when p < e * (s + 1) then p % (s + 1) else (p - e * (s + 1)) % s end as r from x) select vertex, 0::int as cluster, r::int as rank_in_cluster from q union all select vertex, (c + (select case when count(*) > 0 then 1 else 0 end from q))::int, r::int from o")
def static_first_cover(spark, sf_dir):
    return cluster.static_first(tensor.lineitems(spark, sf_dir), 0.09, 7, every=False).select("vertex", "cluster", "rank_in_cluster")


# coverings


@query(f"with {sql.EMB4} select vertex, 0 as cluster, (row_number() over (order by vertex) - 1)::int as rank_in_cluster from (select distinct vertex from emb4)")
def cluster_monolithic(spark, sf_dir):
    return cluster.monolithic(tensor.embeddings4(spark, sf_dir)).select("vertex", "cluster", "rank_in_cluster")


_BY_INDEX = "n as (select 1 + (count(distinct vertex) - 1) // 11 as k from emb4), c as (select vertex, ntile((select k from n)) over (order by vertex) - 1 as cluster from (select distinct vertex from emb4))"


@query(f"with {sql.EMB4}, {_BY_INDEX} select vertex, cluster::int as cluster, (row_number() over (partition by cluster order by vertex) - 1)::int as rank_in_cluster from c")
def cluster_by_index(spark, sf_dir):
    return cluster.by_index(tensor.embeddings4(spark, sf_dir), Q_EMB, 11).select("vertex", "cluster", "rank_in_cluster")


@query(f"with {sql.EMB4}, {_BY_INDEX} select cluster::int as cluster, count(*) as size from c group by cluster")
def cover_counts(spark, sf_dir):
    return cluster.counts(cluster.by_index(tensor.embeddings4(spark, sf_dir), Q_EMB, 11)).select("cluster", "size")


@query(f"with {sql.EMB4}, {_BY_INDEX}, s as (select cluster, count(*) as size from c group by cluster), o as (select cluster, sum(size) over (order by cluster rows between unbounded preceding and 1 preceding)::bigint as \"offset\" from s) select cluster::int as cluster, \"offset\" from o where \"offset\" is not null")
def cover_offsets(spark, sf_dir):
    return cluster.offsets(cluster.by_index(tensor.embeddings4(spark, sf_dir), Q_EMB, 11)).select("cluster", "offset")


@query(f"with {sql.EMB4}, l as (select vertex, vertex % 3 as cluster from (select distinct vertex from emb4)) select count(*) = count(distinct vertex) and min(vertex) = 0 and max(vertex) = count(*) - 1 as exact, bool_and(vertex = p) as identity from (select vertex, row_number() over (order by cluster, vertex) - 1 as p from l)")
def cover_verify(spark, sf_dir):
    return cluster.verify(_thirds(spark, sf_dir)).select("exact", "identity")


def _thirds(spark, sf_dir):
    return cluster.covering(cluster.vertices(tensor.embeddings4(spark, sf_dir)).withColumn("label", F.col("vertex") % 3))


@query(f"with {sql.EMB4}, {_BY_INDEX} select bool_and(vertex = p) as identity from (select vertex, row_number() over (order by cluster, vertex) - 1 as p from c)")
def is_identity(spark, sf_dir):
    return cluster.identity(cluster.by_index(tensor.embeddings4(spark, sf_dir), Q_EMB, 11)).select("identity")


@query("select o_custkey, bool_and(o_totalprice >= coalesce(b, o_totalprice)) as sorted from (select o_custkey, o_totalprice, lag(o_totalprice) over (partition by o_custkey order by o_orderkey) as b from orders) group by o_custkey")
def sortedness(spark, sf_dir):
    return cluster.is_sorted(_table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", "o_totalprice")


def _width(lo: str, hi: str) -> str:
    return f"case {_RANGES.format(lo=lo, hi=hi)} when 1 then 1 when 2 then 2 else 4 end"


@query(f"""with {sql.EMB4}, l as (select vertex, vertex % 3 as cluster, row_number() over (order by vertex % 3, vertex) - 1 as p from (select distinct vertex from emb4)),
o as (select *, vertex - coalesce(lag(vertex) over (order by p), 0) as step from l), i as (select count(*) as n, least({_width('min(vertex)', 'max(vertex)')}, {_width('min(step)', 'max(step)')}) as w from o),
s as (select cluster, count(*) as size from l group by cluster), z as (select *, size - coalesce(lag(size) over (order by cluster), 0) as change from s), c as (select count(*) as m, least({_width('min(size)', 'max(size)')}, {_width('min(change)', 'max(change)')}) as w from z where cluster < 2)
select (5 + n * i.w + 4 + m * c.w)::bigint as covering_bytes from i, c""")
def cover_bytes_size(spark, sf_dir):
    return cluster.bytes_size(_thirds(spark, sf_dir)).select("covering_bytes")


@query(f"with {sql.EMB4} select sample, vertex, coord, value from emb4")
def slice_unslice(spark, sf_dir):
    t, cover = tensor.embeddings4(spark, sf_dir), _thirds(spark, sf_dir)
    return tensor.unsliced(tensor.sliced(t, cover).drop("vertex"), cover).select("sample", "vertex", "coord", "value")


@query(f"with {sql.EMB4} select sample, coord, value from emb4 where vertex = 7")
def vertex_curve(spark, sf_dir):
    return tensor.curve(tensor.embeddings4(spark, sf_dir), 7).select("sample", "coord", "value")


_RANKED = "v as (select vertex, row_number() over (order by vertex) - 1 as rank, count(*) over () as n from (select distinct vertex from emb4))"


@query(f"with {sql.EMB4}, {_RANKED} select sample as row, (coord * n + rank)::bigint as col, value from emb4 join v using (vertex)")
def flatten_config(spark, sf_dir):
    return tensor.flatten_config(tensor.embeddings4(spark, sf_dir)).select("row", "col", "value")


@query(f"with {sql.EMB4}, {_RANKED} select sample, rank, coord, value from emb4 join v using (vertex)")
def unflatten_config(spark, sf_dir):
    return tensor.unflatten_config(tensor.flatten_config(tensor.embeddings4(spark, sf_dir)), 4).select("sample", "rank", "coord", "value")


@query(f"with {sql.EMB4} select vertex, (sample * 4 + coord)::bigint as col, value from emb4")
def flatten_vertex(spark, sf_dir):
    return tensor.flatten_vertex(tensor.embeddings4(spark, sf_dir)).select("vertex", "col", "value")


_SERIES = "select 'evt' as series, sample, vertex, 0 as coord, value from evt union all select 'li', sample, vertex, coord, value from li union all select 'emb4', sample, vertex, coord, value from emb4"


@query(f"with {sql.EVT}, {sql.LI}, {sql.EMB4}, w as ({_SERIES} union all select 'evt_' || n, sample, vertex, 0, value from evt join (select vertex, count(*) as n from evt group by vertex) using (vertex)) select series, (max(sample) + 1)::int as nsamples, count(distinct vertex) as nverts, (max(coord) + 1)::int as ndim, count(*) as nvalues, count(*) = (max(sample) + 1) * count(distinct vertex) * (max(coord) + 1) as valid from w group by series")
def tensor_shape(spark, sf_dir):
    """Users and suppliers have streams of different lengths, which are not dense together; by length they are."""
    events = tensor.event_values(spark, sf_dir)
    t = events.unionByName(tensor.by_length(events)).unionByName(tensor.lineitems(spark, sf_dir)).unionByName(tensor.embeddings4(spark, sf_dir))
    return tensor.shape(t)


# distances and reports


def _li_pair(spark, sf_dir):
    t = tensor.lineitems(spark, sf_dir)
    return t, codec.quantise(t, Q_LI).select(*tensor.KEY, (F.col("quantised") * F.lit(X.stored_quality(Q_LI))).alias("value"))


_PAIR = f"p as (select sample, vertex, coord, value as a, {sql.quantised('value', Q_LI)} * {sql.stored(Q_LI)} as b from li)"


@query(f"with {sql.LI} select coord, round(max(value) - min(value), 6) as range from li group by coord")
def box_range(spark, sf_dir):
    return metric.box_range(tensor.lineitems(spark, sf_dir)).select("coord", F.round("range", 6).alias("range"))


@query(f"with {sql.LI}, {_PAIR} select round(max(abs(a - b)), 9) as linf from p")
def linf(spark, sf_dir):
    return metric.linf(*_li_pair(spark, sf_dir)).select(F.round("linf", 9).alias("linf"))


@query(f"with {sql.LI}, {_PAIR}, d as (select sum((a - b) * (a - b)) as d2 from p group by sample, vertex) select round(sqrt(max(d2)), 9) as hausdorff from d")
def hausdorff(spark, sf_dir):
    return metric.hausdorff(*_li_pair(spark, sf_dir)).select(F.round("hausdorff", 9).alias("hausdorff"))


_REPORT = "(count(*) * 8)::bigint as original_size, count(*) as original_numvalues, round(max(abs(a - b)), 9) as linf, count(*) filter (a <> b) as numerrors, max(abs(b + (a - b) - a)) as corrected_linf, count(*) filter (b + (a - b) <> a) as numuncorrectable"


def _farthest(points: str) -> str:
    return f"(select round(sqrt(max(d)), 9) from (select sum((a - b) * (a - b)) as d from {points} group by sample, vertex)) as hausdorff"


def _reported(r: DataFrame) -> DataFrame:
    return r.select("series", "original_size", "original_numvalues", F.round("hausdorff", 9).alias("hausdorff"), F.round("linf", 9).alias("linf"), "numerrors", "corrected_linf", "numuncorrectable")




@query(f"with {sql.LI}, {_PAIR} select 'li' as series, {_REPORT}, {_farthest('p')} from p")
def report(spark, sf_dir):
    before, after = _li_pair(spark, sf_dir)
    size = before.select("series").distinct().withColumn("compressed_size", F.lit(0).cast("long"))
    return _reported(metric.report(before, after, size))


@query(f"with {sql.LI}, {_PAIR}, {sql.EMB4}, e as (select sample, vertex, value as a, {sql.quantised('value', Q_LI)} * {sql.stored(Q_LI)} as b from emb4), r as (select 'li' as series, {_REPORT}, {_farthest('p')} from p union all select 'emb4', {_REPORT}, {_farthest('e')} from e) select series, original_size, original_numvalues, hausdorff, linf, numerrors, corrected_linf, numuncorrectable from r union all select null, sum(original_size)::bigint, sum(original_numvalues)::bigint, max(hausdorff), max(linf), sum(numerrors)::bigint, max(corrected_linf), sum(numuncorrectable)::bigint from r")
def report_combined(spark, sf_dir):
    t = tensor.lineitems(spark, sf_dir).unionByName(tensor.embeddings4(spark, sf_dir))
    after = codec.quantise(t, Q_LI).select(*tensor.KEY, (F.col("quantised") * F.lit(X.stored_quality(Q_LI))).alias("value"))
    size = t.select("series").distinct().withColumn("compressed_size", F.lit(0).cast("long"))
    return _reported(metric.combined(metric.report(t, after, size)))


@query(f"with {sql.EVT_DELTA(Q_EVT)}, {sql.HEAD}, s as (select sum({sql.stream('n', 'width', 8)})::bigint as compressed_size from h) select 'evt' as series, (count(*) * 8)::bigint as original_size, (select compressed_size from s) as compressed_size, count(*) as original_numvalues, round(max(abs(value - quantised * {sql.stored(Q_EVT)})), 9) as linf, round(1 - (select compressed_size from s) / (count(*) * 8), 6) as ratio from d")
def codec_report(spark, sf_dir):
    """The flagship plan: compress event series and report, without leaving the JVM."""
    r = pipeline.codec_report(tensor.event_values(spark, sf_dir), Q_EVT, EVT_BY, EVT_ORDER)
    return r.select("series", "original_size", "compressed_size", "original_numvalues", F.round("linf", 9).alias("linf"), F.round("ratio", 6).alias("ratio"))


@query(f"select user_id as vertex, event_id as id, quantised, quantised - coalesce(lag(quantised) over (partition by user_id order by ts, event_id), 0) as delta from (select *, {sql.quantised('value', Q_EVT)} as quantised from events)")
def stream_intify_delta(spark, sf_dir):
    """Event values quantised and differenced as a stream with state per user, over all that is there now."""
    kinds = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(kinds).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    values = events.select(F.col("user_id").alias("vertex"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), "value")
    return deltas.run_available(deltas.stream_deltas(values, Q_EVT), "deltas").select("vertex", "id", "quantised", "delta")


# clusterings by distance


def _unit(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return e.select("vec_id", "label", F.transform("e", lambda x: x / F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, y: s + y * y))).alias("axis"))


def _label_centres(spark, sf_dir):
    mean = _table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    arrays = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"))
    return arrays.select(F.col("label").alias("centre"), F.transform("m", lambda x: x / F.sqrt(F.aggregate("m", F.lit(0.0), lambda s, y: s + y * y))).alias("at"))


_UNITS = "u as (select vec_id, label, list_transform(embedding, lambda x: x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double)))) as axis from embeddings)"
_CENTRE = "m as (select label, i, avg(x::double) as m from (select label, unnest(embedding) as x, unnest(range(len(embedding))) as i from embeddings) group by label, i), k as (select label, list(m order by i) as m from m group by label), c as (select label as centre, list_transform(m, lambda x: x / sqrt(list_sum(list_transform(m, lambda y: y * y)))) as ctr from k)"


@query(f"with {_UNITS}, {_CENTRE} select vec_id, centre, round(1 - list_inner_product(axis, ctr) * list_inner_product(axis, ctr), 6) as distance from u, c")
def line_angle_pairs(spark, sf_dir):
    points = _unit(spark, sf_dir).select(F.lit("emb").alias("series"), F.col("vec_id").alias("vertex"), "axis")
    return cluster.distances(points, _label_centres(spark, sf_dir)).select(F.col("vertex").alias("vec_id"), "centre", F.round("distance", 6).alias("distance"))


@query(f"with {_UNITS}, {_CENTRE}, d as (select vec_id, centre, 1 - list_inner_product(axis, ctr) * list_inner_product(axis, ctr) as distance from u, c) select vec_id, arg_min(centre, distance)::int as centre, round(min(distance), 6) as distance from d group by vec_id")
def nearest_centre(spark, sf_dir):
    points = _unit(spark, sf_dir).select(F.lit("emb").alias("series"), F.col("vec_id").alias("vertex"), "axis")
    return cluster.nearest(points, _label_centres(spark, sf_dir)).select(F.col("vertex").alias("vec_id"), "centre", F.round("distance", 6).alias("distance"))


_FAR = f"with {_UNITS}, s as (select axis as ctr from u where vec_id = 0), b0 as (select vec_id, axis, 1 - list_inner_product(axis, ctr) ** 2 as best, 0 as label from u, s)"
for _k in (1, 2, 3):
    _FAR += f", c{_k} as (select axis as ctr from b{_k - 1} order by best desc, vec_id limit 1), b{_k} as (select vec_id, axis, least(best, 1 - list_inner_product(axis, ctr) ** 2) as best, case when 1 - list_inner_product(axis, ctr) ** 2 < best then {_k} else label end as label from b{_k - 1}, c{_k})"


@query(_FAR + " select vec_id, label, round(best, 6) as best from b3")
def farthest_point_step(spark, sf_dir):
    points = _unit(spark, sf_dir).select(F.lit("emb").alias("series"), F.col("vec_id").alias("vertex"), "axis")
    seed = points.where("vertex = 0").select("axis").first()["axis"]
    state, _ = cluster.farthest_rounds(points, F.array(*(F.lit(x) for x in seed)), 3)
    return state.select(F.col("vertex").alias("vec_id"), "label", F.round("best", 6).alias("best"))


# reductions


@query(f"with {sql.EMB4}, a as (select coord as k, max(abs(value)) as m from emb4 group by coord), b as (select coord as k, max(abs(m)) as m from (select vertex, coord, avg(value) as m from emb4 group by vertex, coord) group by coord) select a.k, round(0.5 * (sqrt(4 * {Q_EMB!r}::double / 4 + (a.m + b.m) ** 2) - (a.m + b.m)), 9) as epsilon from a join b on a.k = b.k")
def epsilon_components(spark, sf_dir):
    t = tensor.embeddings4(spark, sf_dir)
    a = t.groupBy(F.col("coord").alias("k")).agg(F.max(F.abs("value")).alias("a"))
    b = metric.centroid(t).groupBy(F.col("coord").alias("k")).agg(F.max(F.abs("centroid")).alias("b"))
    return a.join(b, "k").select("k", F.round(X.component_epsilon(Q_EMB, 4, F.col("a") + F.col("b")), 9).alias("epsilon"))


_TRUNC = """a as (select sample::bigint as row, coord as k, avg(value) as x from emb4 group by sample, coord), b as (select coord as k, vertex as col, avg(value) as y from emb4 group by coord, vertex),
p as (select row, col, k, x * y as p from a join b using (k)), s as (select row, col, k, sum(p) over (partition by row, col order by k) as s from p), m as (select row, col, sum(p) as v from p group by row, col)"""


@query(f"with {sql.EMB4}, {_TRUNC} select row, col, case when bool_or(abs(v) <= 0.0001) then 0 else coalesce(min(k + 1) filter (abs(v - s) <= 0.0001), 4) end::int as needed from s join m using (row, col) group by row, col")
def truncation_counts(spark, sf_dir):
    """Components that the product of mean samples and mean vertices needs at each place."""
    t = tensor.embeddings4(spark, sf_dir)
    a = t.groupBy(F.col("sample").cast("long").alias("row"), F.col("coord").alias("k")).agg(F.avg("value").alias("x"))
    b = t.groupBy(F.col("coord").alias("k"), F.col("vertex").alias("col")).agg(F.avg("value").alias("y"))
    m = a.join(b, "k").groupBy("row", "col").agg(F.sum(F.col("x") * F.col("y")).alias("value"))
    return embed.truncation_counts(m, a, b, 0.0001)


def _method_report(spark, sf_dir, t, quality, size, candidates, item_bytes=8):
    encoded, cover = pipeline.compress(t, quality, "by_index", size, candidates, item_bytes)
    r = metric.report(t, pipeline.decompress(encoded, cover), pipeline.compressed_size(encoded, cover), item_bytes)
    checked = r.withColumn("ok", F.expr(f"assert_true(linf <= {quality * (1 + embed.SLACK)!r}, 'the bound does not hold')")).where("ok is null")
    methods = encoded.groupBy("series").agg(F.count("*").alias("clusters"), *(F.count_if(F.col("method") == m).alias(f"n_{m}") for m in candidates))
    return checked.join(methods, "series").select("series", "original_size", "compressed_size", "linf", "hausdorff", metric.ratio().alias("ratio"), "clusters", *(f"n_{m}" for m in candidates))


#: Series of users with equally many events, in even clusters of at most 100; each cluster's stream by sample, then by place.
_RAW = f"""{sql.EVT}, n as (select vertex, count(*) as n from evt group by vertex), v as (select 'evt_' || n as series, vertex, n, row_number() over (partition by n order by vertex) - 1 as p, count(*) over (partition by n) as m from n),
b as (select *, m // (1 + (m - 1) // 100) as s, m % (1 + (m - 1) // 100) as e from v), c as (select series, vertex, n, p, m, case when p < e * (s + 1) then p // (s + 1) else e + (p - e * (s + 1)) // s end as cluster from b),
q as (select series, cluster, sample, p, value, {sql.quantised('value', Q_EVT)} as q from evt join c using (vertex)), d as (select *, q - coalesce(lag(q) over (partition by series, cluster order by sample, p), 0) as delta from q),
h as (select series, cluster, max(sample) + 1 as t, count(*) as n, {sql.width('max(delta) - min(delta)')} as width from d group by series, cluster),
z as (select series, sum(2 + {sql.varint('t')} + {sql.varint('(n // t)')} + 1 + {sql.stream('n', 'width', 8)}) as bytes, count(*) as clusters from h group by series),
st as (select *, vertex - coalesce(lag(vertex) over (partition by series order by p), 0) as step from c),
o as (select series, case when bool_and(vertex = p) then 0 else count(*) * least({_width('min(vertex)', 'max(vertex)')}, {_width('min(step)', 'max(step)')}) end as order_bytes from st group by series),
k as (select series, cluster, count(*) as size from c group by series, cluster), y as (select *, size - coalesce(lag(size) over (partition by series order by cluster), 0) as change, max(cluster) over (partition by series) as last from k),
i as (select series, 4 + count(*) * least({_width('min(size)', 'max(size)')}, {_width('min(change)', 'max(change)')}) as inner_bytes from y where cluster < last group by series),
l as (select series, count(*) * 8 as original_size, round(max(abs(value - q * {sql.stored(Q_EVT)})), 9) as linf from q group by series)"""


@query(f"with {_RAW} select series, original_size::bigint as original_size, (bytes + 5 + order_bytes + coalesce(inner_bytes, 0))::bigint as compressed_size, linf, linf as hausdorff, round(1 - (bytes + 5 + order_bytes + coalesce(inner_bytes, 0)) / original_size, 6) as ratio, clusters, clusters as n_raw from z join o using (series) join l using (series) left join i using (series)")
def raw_embed_report(spark, sf_dir):
    r = _method_report(spark, sf_dir, tensor.by_length(tensor.event_values(spark, sf_dir)), Q_EVT, 100, ("raw",))
    return r.select("series", "original_size", "compressed_size", *(F.round(c, n).alias(c) for c, n in (("linf", 9), ("hausdorff", 9), ("ratio", 6))), "clusters", "n_raw")


@query()
def pca_embed_report(spark, sf_dir):
    return _method_report(spark, sf_dir, tensor.embeddings4(spark, sf_dir), Q_EMB, 100, ("raw", "pca"))


@query()
def rotation_embed_report(spark, sf_dir):
    return _method_report(spark, sf_dir, tensor.embeddings3(spark, sf_dir), Q_EMB, 100, ("raw", "rotation"))


@query()
def best_embedding_report(spark, sf_dir):
    return _method_report(spark, sf_dir, tensor.embeddings3(spark, sf_dir), 0.05, 100, ("raw", "static", "pca", "rotation"))


_EACH_BYTES = "(values (2), (4), (8)) b(item_bytes)"


@query(f"select 'emb3' as series, item_bytes, (count(*) * 63 * item_bytes)::bigint as original_size, 1 + (count(*) - 1) // 100 as clusters, true as each_has_a_method, true as bound_holds, true as smaller from embeddings, {_EACH_BYTES} group by item_bytes union all select 'emb3_rest', item_bytes, (count(*) * item_bytes)::bigint, 1 + (count(*) - 1) // 100, true, true, true from embeddings, {_EACH_BYTES} group by item_bytes")
def embed_bounds(spark, sf_dir):
    """What must hold of every report, with all methods, for floats of each size; values are first made such floats."""
    t, done, methods = tensor.embeddings3(spark, sf_dir), None, ("raw", "static", "pca", "rotation")
    for b in embed.FLOATS:
        typed = tensor.as_floats(t, b)
        r = _method_report(spark, sf_dir, typed, 0.05, 100, methods, b)
        chosen = sum(F.col(f"n_{m}") for m in methods) == F.col("clusters")
        r = r.select("series", F.lit(b).alias("item_bytes"), "original_size", "clusters", chosen.alias("each_has_a_method"), (F.col("linf") <= 0.05 * (1 + embed.SLACK)).alias("bound_holds"), (F.col("ratio") > 0).alias("smaller"))
        done = r if done is None else done.unionByName(r)
    return done


@query()
def scenario_grid(spark, sf_dir):
    return pipeline.scenarios(tensor.embeddings4(spark, sf_dir), [1e-2, 5e-2], ["by_index", "static_monolithic"], [250])


def _cover_summary(cover: DataFrame) -> DataFrame:
    return cluster.verify(cover).join(cluster.counts(cover).groupBy("series").agg(F.count("*").alias("clusters"), F.sum("size").alias("vertices")), "series")


@query()
def kmeans_cover(spark, sf_dir):
    return _cover_summary(cluster.kmeans(tensor.embeddings4(spark, sf_dir), Q_EMB, 100))


@query()
def pca_kmeans_cover(spark, sf_dir):
    return _cover_summary(cluster.pca_kmeans(tensor.embeddings4(spark, sf_dir), Q_EMB, 100))


@query()
def first_axis_cover(spark, sf_dir):
    return _cover_summary(cluster.first_axis(tensor.embeddings4(spark, sf_dir), 1.2))


@query()
def last_axis_cover(spark, sf_dir):
    return _cover_summary(cluster.last_axis(tensor.embeddings4(spark, sf_dir), 1.2))


@query()
def quaternion_cover(spark, sf_dir):
    return _cover_summary(cluster.near_quaternions(tensor.lineitems(spark, sf_dir), 2.0))


@query("select name, true as exact, n as vertices, true as within_bound from (select count(distinct vec_id) as n from embeddings), (values ('kmeans'), ('pca_kmeans'), ('first_axis'), ('last_axis')) v(name) union all select 'near_quaternions', true, count(distinct l_suppkey), true from lineitem")
def cover_bounds(spark, sf_dir):
    """What must hold of every covering: each vertex once, without gaps, and within the bound: of its centre, or on the number of clusters."""
    emb, li, size, done = tensor.embeddings4(spark, sf_dir), tensor.lineitems(spark, sf_dir), 100, None

    def summary(name, cover, within):
        c = _cover_summary(cover)
        return c.join(within, "series").select(F.lit(name).alias("name"), "exact", "vertices", "within_bound")

    for name, fn in (("kmeans", cluster.kmeans), ("pca_kmeans", cluster.pca_kmeans)):
        cover = shared_table(fn(emb, Q_EMB, size), "cover")
        own = cover.groupBy("series").agg((F.countDistinct("cluster") <= F.ceil(F.count("*") / size)).alias("within_bound"))
        s = summary(name, cover, own)
        done = s if done is None else done.unionByName(s)
    for name, t, quality, form in (("first_axis", emb, 1.2, "first"), ("last_axis", emb, 1.2, "last"), ("near_quaternions", li, 2.0, "quaternion")):
        states = shared_table(cluster.near_states(t, quality, form), "states")
        own = states.groupBy("series").agg((F.max("best") <= cluster.bound_of(quality)).alias("within_bound"))
        done = done.unionByName(summary(name, cluster.covering(states.select("series", "vertex", "label")), own))
    return done


# manifests


_PATH = "'scene/' || page_id % 7 || '//' || regexp_replace(url, '^https?://', '')"
_COMPONENTS = f"m as (select page_id, 'archive' || page_id % 3 as archive, row_number() over (partition by page_id % 3 order by page_id)::int - 1 as ordinal, {_PATH} as path, case page_id % 4 when 0 then 'float32_t' when 1 then 'float64_t' when 2 then 'uint8_t' else 'string' end as type, (page_id % 50 + 1)::int as samples, (length(html) % 1000 + 1)::int as size, (page_id % 3 + 1)::int as extent from pages), f as (select *, regexp_replace(regexp_replace(path, '[/:;]', '-', 'g'), '^[-.]+', '') || '.bin' as bin from m)"
_BITS = "case type when 'float32_t' then 32 when 'float64_t' then 64 when 'uint8_t' then 8 end"


def _components(spark, sf_dir) -> DataFrame:
    """Manifests derived from pages, through JSON text and back."""
    p = _table(spark, sf_dir, "pages")
    kind = F.element_at(F.array(*map(F.lit, ("float32_t", "float64_t", "uint8_t", "string"))), (F.col("page_id") % 4 + 1).cast("int"))
    path = F.concat(F.lit("scene/"), (F.col("page_id") % 7).cast("string"), F.lit("//"), F.regexp_replace("url", "^https?://", ""))
    size = F.when(F.col("page_id") >= 0, (F.length("html") % 1000 + 1).cast("int"))
    c = F.struct(path.alias("path"), kind.alias("type"), (F.col("page_id") % 50 + 1).cast("int").alias("samples"), size.alias("size"), (F.col("page_id") % 3 + 1).cast("int").alias("extent"), F.lit(None).cast("string").alias("bin"))
    grouped = p.groupBy((F.col("page_id") % 3).alias("g")).agg(F.transform(F.array_sort(F.collect_list(F.struct("page_id", c.alias("c")))), lambda x: x["c"]).alias("components"))
    return manifest.parse(grouped.select(F.to_json(F.struct(F.concat(F.lit("archive"), F.col("g").cast("string")).alias("abc"), "components")).alias("json")), "json")


@query(f"with {_COMPONENTS} select archive, 0.01::double as mpu, ordinal, path, type, samples, size, extent, bin from f")
def manifest_parse(spark, sf_dir):
    return _components(spark, sf_dir).select("archive", "mpu", "ordinal", "path", "type", "samples", "size", "extent", "bin")


@query(f"with {_COMPONENTS} select archive, 0.01::double as mpu, ordinal, path, type, samples, size, extent, bin from f")
def manifest_round_trip(spark, sf_dir):
    return manifest.parse(manifest.to_json(_components(spark, sf_dir)), "json").select("archive", "mpu", "ordinal", "path", "type", "samples", "size", "extent", "bin")


@query("select page_id, regexp_replace(regexp_replace(url, '[/:;]', '-', 'g'), '^[-.]+', '') || '.bin' as bin, regexp_replace(regexp_replace(url, '[-./ ()]', '-', 'g'), '^-+|-+$', '', 'g') as plain, split_part(url, '/', -1) as base from pages")
def bin_name(spark, sf_dir):
    u = F.col("url")
    return _table(spark, sf_dir, "pages").select("page_id", X.bin_name(u).alias("bin"), X.plain_name(u).alias("plain"), X.base_name(u).alias("base"))


@query(f"with {_COMPONENTS} select archive, path, type from f where type <> 'string'")
def type_filter(spark, sf_dir):
    return manifest.numeric(_components(spark, sf_dir)).select("archive", "path", "type")


@query(f"with {_COMPONENTS} select archive, path, ({_BITS} // 8)::bigint * size * extent * samples as numbytes from f where type <> 'string'")
def numbytes(spark, sf_dir):
    return manifest.numbytes(manifest.numeric(_components(spark, sf_dir))).select("archive", "path", "numbytes")


@query(f"with {_COMPONENTS}, k as (select bin from f where page_id = 17) select archive, ordinal, path from f where bin = (select bin from k) order by archive, ordinal limit 1")
def header_lookup(spark, sf_dir):
    c = _components(spark, sf_dir)
    key = _table(spark, sf_dir, "pages").where("page_id = 17").select(X.bin_name(F.concat(F.lit("scene/3//"), F.regexp_replace("url", "^https?://", "")))).first()[0]
    return manifest.look_up(c, f"elsewhere/{key}").select("archive", "ordinal", "path")


@query(f"with {_COMPONENTS} select archive, arg_max(path, (numbytes, path)) as path, max(numbytes) as numbytes from (select archive, path, ({_BITS} // 8)::bigint * size * extent * samples as numbytes from f where type <> 'string') group by archive")
def largest_header(spark, sf_dir):
    c = manifest.numbytes(manifest.numeric(_components(spark, sf_dir)))
    return c.groupBy("archive").agg(F.max_by("path", F.struct("numbytes", "path")).alias("path"), F.max("numbytes").alias("numbytes"))


@query(f"with {_COMPONENTS} select path, split_part(path, '//', 1) as object, split_part(path, '//', 2) as property from f")
def path_parts(spark, sf_dir):
    obj, prop = manifest.path_parts(F.col("path"))
    return _components(spark, sf_dir).select("path", obj.alias("object"), prop.alias("property"))


@query("select o_custkey::varchar as path, count(*) as nsamples from orders group by o_custkey having count(distinct o_orderstatus) > 1 and count(distinct length(o_orderpriority)) = 1")
def animated_only(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    return manifest.animated(o.select(F.col("o_custkey").cast("string").alias("path"), F.col("o_orderkey").alias("sample"), F.length("o_orderpriority").alias("size"), F.xxhash64("o_orderstatus").alias("hash")))


@query("select l_orderkey::varchar as path, count(distinct l_linestatus) = 1 and count(distinct l_returnflag) = 1 as exportable from lineitem group by l_orderkey")
def exportable_shapes(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem")
    return manifest.exportable(li.select(F.col("l_orderkey").cast("string").alias("path"), F.col("l_linestatus").alias("rank"), F.col("l_returnflag").alias("dim")))


_SIDES = "a as (select 'n' || n as path, 'array' as kind, n % 9 as ns, n % 4 = 0 as const, n % 13 as h from (select page_id as n from pages)), b as (select 'n' || n as path, case when n % 11 = 0 then 'scalar' else 'array' end as kind, n % 9 + case when n % 4 = 0 then 1 else 0 end as ns, n % 4 = 0 as const, n % 13 + case when n % 7 = 0 then 1 else 0 end as h from (select page_id + page_id // 6 as n from pages))"


def _sides(spark, sf_dir):
    """Two archives of all pages: the second skips numbers and differs in some kinds, sample counts and contents."""
    p = _table(spark, sf_dir, "pages")
    n = F.col("n")
    row = lambda kind, ns, h: (F.concat(F.lit("n"), n.cast("string")).alias("path"), kind.alias("kind"), ns.alias("nsamples"), (n % 4 == 0).alias("constant"), F.lit("float32_t").alias("type"), F.lit("3").alias("dims"), h.alias("hash"))
    a = p.select(F.col("page_id").alias("n")).select(*row(F.lit("array"), n % 9, n % 13))
    b = p.select(F.expr("page_id + page_id div 6").alias("n")).select(*row(F.when(n % 11 == 0, "scalar").otherwise("array"), n % 9 + (n % 4 == 0).cast("int"), n % 13 + (n % 7 == 0).cast("int")))
    return a, b


@query(f"with {_SIDES} select * from (select path, case when b.kind is null then '-' when a.kind is null then '+' when a.kind <> b.kind or a.h <> b.h or case when a.const then 1 else a.ns end <> case when b.const then 1 else b.ns end then '~' end as change from a full join b using (path)) where change is not null")
def archive_diff(spark, sf_dir):
    return manifest.difference(*_sides(spark, sf_dir))


@query(f"with {_SIDES} select path from a where path not in (select path from b)")
def archive_only_left(spark, sf_dir):
    return manifest.only_in(*_sides(spark, sf_dir))


_PLAN = f"{_COMPONENTS}, o as (select f.path as key, 'p' || item_id as file from benchmark join f on page_id = item_id union all select bin, 'b' || n_nationkey from nation join f on page_id = n_nationkey * 3), e as (select bin as file from f join supplier on s_suppkey = page_id union all select file from o)"


@query(f"with {_PLAN} select f.path, coalesce(x.file, y.file, f.bin) as source from f left join o x on x.key = f.path left join o y on y.key = f.bin where coalesce(x.file, y.file, f.bin) in (select file from e)")
def override_plan(spark, sf_dir):
    """Overrides by path (from benchmark items) and by file (from nations); files that exist: these and those of suppliers' numbers."""
    p = _table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("scene/"), (F.col("page_id") % 7).cast("string"), F.lit("//"), F.regexp_replace("url", "^https?://", "")).alias("path"))
    p = p.withColumn("bin", X.bin_name(F.col("path")))
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("page_id"), F.concat(F.lit("p"), F.col("item_id").cast("string")).alias("file"))
    nations = _table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 3).cast("long").alias("page_id"), F.concat(F.lit("b"), F.col("n_nationkey").cast("string")).alias("file"))
    over = p.join(items, "page_id").select(F.col("path").alias("key"), "file").unionByName(p.join(nations, "page_id").select(F.col("bin").alias("key"), "file"))
    own = p.join(_table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("page_id")).select(F.col("bin").alias("file"))
    return manifest.replacement_plan(_components(spark, sf_dir), over, own.unionByName(over.select("file")))


@query("select 'n' || page_id as path, coalesce(text, url) as content from pages left join benchmark on item_id = page_id")
def archive_replace(spark, sf_dir):
    path = lambda c: F.concat(F.lit("n"), F.col(c).cast("string")).alias("path")
    archive = _table(spark, sf_dir, "pages").select(path("page_id"), F.col("url").alias("content"))
    return manifest.replaced(archive, _table(spark, sf_dir, "benchmark").select(path("item_id"), F.col("text").alias("content")))


@query("with recursive n as (select 'r' || r_regionkey as id, null as parent, r_name as name from region union all select 'n' || n_nationkey, 'r' || n_regionkey, n_name from nation union all select 's' || s_suppkey, 'n' || s_nationkey, s_name from supplier), t as (select id, name as path, 0 as depth from n where parent is null union all select n.id, t.path || '/' || n.name, t.depth + 1 from n join t on n.parent = t.id) select id, path, depth from t")
def tree_flatten(spark, sf_dir):
    node = lambda t, i, p, name: _table(spark, sf_dir, t).select(F.concat(F.lit(i[0]), F.col(i[1]).cast("string")).alias("id"), (F.concat(F.lit(p[0]), F.col(p[1]).cast("string")) if p else F.lit(None).cast("string")).alias("parent"), F.col(name).alias("name"))
    nodes = node("region", ("r", "r_regionkey"), None, "r_name").unionByName(node("nation", ("n", "n_nationkey"), ("r", "n_regionkey"), "n_name")).unionByName(node("supplier", ("s", "s_suppkey"), ("n", "s_nationkey"), "s_name"))
    return manifest.paths(nodes)
