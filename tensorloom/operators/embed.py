"""Reductions of a cluster's tensor under a bound on every value, and the choice of the smallest.

A method turns a dense array (samples, vertices, coordinates) into a header and a payload, and back; decode() also gives the
places after what it has read, so clusters can follow one another in files. Each cluster is one
group of a grouped map, so a covering bounds what a task holds. What a method really loses is measured after decoding;
only methods within the bound can be chosen, and raw always is.

Arrays have floats of 2, 4 or 8 bytes. Headers tell which; streams that are not quantised take as many bytes a value, and
decoding gives that type again. All arithmetic between is in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bytes import decode_coordinates, decode_sparse, encode_coordinates, encode_sparse, pack_ints, pack_varint, unpack_ints, unpack_varint, zero_jagged
from .tensor import sliced

#: Bytes of the floats that arrays may have.
FLOATS = (2, 4, 8)


def _kind(x: np.ndarray) -> bytes:
    return bytes([x.dtype.itemsize])


def _kind_of(header: bytes, h: int) -> np.dtype:
    if header[h] not in FLOATS:
        raise ValueError(f"no floats have {header[h]} bytes")
    return np.dtype(f"<f{header[h]}")


# rotations, from the published formulas


def rotation_of(vt: np.ndarray) -> np.ndarray:
    """Orthonormal rows as a proper rotation: the last row turns where the determinant is negative."""
    r = vt.copy()
    if np.linalg.det(r) < 0:
        r[-1] = -r[-1]
    return r


def quaternion(r: np.ndarray) -> np.ndarray:
    """x, y, z, w of a rotation matrix, from its largest component for accuracy; w is not negative."""
    m = np.array([
        [r[0, 0] - r[1, 1] - r[2, 2], 0, 0, 0],
        [r[0, 1] + r[1, 0], r[1, 1] - r[0, 0] - r[2, 2], 0, 0],
        [r[0, 2] + r[2, 0], r[1, 2] + r[2, 1], r[2, 2] - r[0, 0] - r[1, 1], 0],
        [r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1], r[0, 0] + r[1, 1] + r[2, 2]],
    ]) / 3
    values, vectors = np.linalg.eigh(m)
    q = vectors[:, values.argmax()]
    return -q if q[3] < 0 else q


def rotation_vector(r: np.ndarray) -> np.ndarray:
    """Axis times angle (at most pi)."""
    q = quaternion(r)
    size = np.linalg.norm(q[:3])
    return np.zeros(3) if size < 1e-15 else q[:3] / size * 2 * np.arctan2(size, q[3])


def rotations(vectors: np.ndarray) -> np.ndarray:
    """Matrices of rotation vectors, by Rodrigues' formula."""
    angle = np.linalg.norm(vectors, axis=-1)[..., None, None]
    k = np.zeros((*vectors.shape[:-1], 3, 3))
    x, y, z = np.moveaxis(vectors, -1, 0)
    k[..., 0, 1], k[..., 0, 2], k[..., 1, 2] = -z, y, -x
    k[..., 1, 0], k[..., 2, 0], k[..., 2, 1] = z, -y, x
    with np.errstate(invalid="ignore", divide="ignore"):
        a = np.where(angle > 1e-8, np.sin(angle) / angle, 1 - angle**2 / 6)
        b = np.where(angle > 1e-8, (1 - np.cos(angle)) / angle**2, 0.5 - angle**2 / 24)
    return np.eye(3) + a * k + b * (k @ k)


# helpers of the linear reduction


def component_epsilons(a: np.ndarray, b: np.ndarray, quality: float) -> np.ndarray:
    """How far each component's factors (columns of a, rows of b) may be rounded so that products stay within the quality."""
    size = np.abs(a).max(axis=0) + np.abs(b).max(axis=1)
    return 0.5 * (np.sqrt(size**2 + 4 * quality / len(size)) - size)


def components_needed(m: np.ndarray, a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """For each entry of m, the fewest leading components whose product is within eps of it; all of them where none are enough.

    The remainder is updated in place, so memory is that of m.
    """
    most = a.shape[1]
    need = np.full(m.shape, most)
    rest, open_ = m.astype(np.float64), np.ones(m.shape, bool)
    for k in range(most + 1):
        if k:
            rest = rest - np.outer(a[:, k - 1], b[k - 1])
        good = open_ & (np.abs(rest) <= eps)
        need[good] = k
        open_ &= ~good
        if not open_.any():
            break
    return need


def linear_parts(m: np.ndarray, quality: float):
    """(u, v, u counts, v counts, eps per component or None) with u v^T near m; singular values go to the smaller factor."""
    u, s, vt = np.linalg.svd(m, full_matrices=False)
    if vt.size < u.size:
        vt = s[:, None] * vt
    else:
        u = u * s
    need = components_needed(m, u, vt, quality)
    nu, nv = need.max(axis=1), need.max(axis=0)
    u, v = zero_jagged(u, nu), zero_jagged(vt.T, nv)
    if not u.shape[1]:
        return u, v, nu, nv, None
    used = float(np.abs(m - u @ v.T).max())
    return u, v, nu, nv, component_epsilons(u, v.T, quality - used if used < quality else quality)


def _config(x: np.ndarray) -> np.ndarray:
    return x.transpose(0, 2, 1).reshape(len(x), -1)


def _unconfig(m: np.ndarray, v: int, d: int) -> np.ndarray:
    return m.reshape(len(m), d, v).transpose(0, 2, 1)


def _stored_centre(x: np.ndarray, quality: float) -> tuple[np.ndarray, bytes]:
    """The mean as it will be decoded, and its bytes."""
    b = encode_coordinates(x.mean(axis=0, dtype=np.float64).astype(x.dtype), quality)
    return decode_coordinates(b, 0, x.shape[1:], x.dtype)[0].astype(np.float64), b


class Raw:
    """All values as coordinate streams."""

    @staticmethod
    def valid(x, quality):
        return True

    @staticmethod
    def encode(x, quality):
        return b"".join(map(pack_varint, x.shape)) + _kind(x), encode_coordinates(x, quality)

    @staticmethod
    def decode(header, payload, h=0, p=0):
        shape = []
        for _ in range(3):
            n, h = unpack_varint(header, h)
            shape.append(n)
        x, p = decode_coordinates(payload, p, tuple(shape), _kind_of(header, h))
        return x, h + 1, p


class Static:
    """The middle of each vertex's bounding box, in the header."""

    @staticmethod
    def valid(x, quality):
        return bool((x.max(axis=0) - x.min(axis=0) <= 2 * quality).all())

    @staticmethod
    def encode(x, quality):
        middle = 0.5 * (x.min(axis=0).astype(np.float64) + x.max(axis=0))
        return b"".join(map(pack_varint, x.shape)) + _kind(x) + encode_coordinates(middle.astype(x.dtype), quality), b""

    @staticmethod
    def decode(header, payload, h=0, p=0):
        t, h = unpack_varint(header, h)
        v, h = unpack_varint(header, h)
        d, h = unpack_varint(header, h)
        middle, h = decode_coordinates(header, h + 1, (v, d), _kind_of(header, h))
        return np.broadcast_to(middle, (t, v, d)), h, p


class Pca:
    """Principal components in configuration space, as jagged factors."""

    @staticmethod
    def valid(x, quality):
        return True

    @staticmethod
    def encode(x, quality):
        t, v, d = x.shape
        centre, centre_bytes = _stored_centre(x, quality)
        a, b, na, nb, eps = linear_parts(_config(x - centre), quality)
        eps = 1.0 if eps is None else eps
        a, b = a.astype(x.dtype), b.astype(x.dtype)
        return pack_varint(t) + pack_varint(v * d) + _kind(x) + encode_sparse(b, nb, eps) + pack_varint(d) + centre_bytes, encode_sparse(a, na, eps)

    @staticmethod
    def decode(header, payload, h=0, p=0):
        t, h = unpack_varint(header, h)
        m, h = unpack_varint(header, h)
        kind = _kind_of(header, h)
        b, _, h = decode_sparse(header, h + 1, m, kind)
        d, h = unpack_varint(header, h)
        centre, h = decode_coordinates(header, h, (m // d, d), kind)
        a, _, p = decode_sparse(payload, p, t, kind)
        k = min(a.shape[1], b.shape[1])
        product = a[:, :k].astype(np.float64) @ b[:, :k].astype(np.float64).T
        return (_unconfig(product, m // d, d) + centre).astype(kind), h, p


class Rotation:
    """Each vertex's curve in its own principal axes, with as few axes as half the quality allows."""

    @staticmethod
    def valid(x, quality):
        return x.shape[2] == 3 and x.shape[0] >= 3

    @staticmethod
    def encode(x, quality):
        t, v, _ = x.shape
        centre, centre_bytes = _stored_centre(x, quality)
        moved = (x - centre).transpose(1, 0, 2)
        vt = np.linalg.svd(moved, full_matrices=False)[2]
        vectors = np.array([rotation_vector(rotation_of(r)) for r in vt])
        vector_bytes = encode_coordinates(vectors.astype(x.dtype), quality / 40)
        r = rotations(decode_coordinates(vector_bytes, 0, (v, 3), x.dtype)[0].astype(np.float64))
        u = moved @ r.transpose(0, 2, 1)
        eps, need = quality / 2, np.full(v, 3)
        for k in (2, 1, 0):
            off = np.abs(u[:, :, :k] @ r[:, :k] - moved).max(axis=(1, 2))
            need[off <= eps] = k
        columns = [encode_coordinates(u[need > k][:, :, k].astype(x.dtype), eps) for k in range(3)]
        return pack_varint(v) + _kind(x) + centre_bytes + vector_bytes, pack_varint(t) + pack_ints(need, 2) + b"".join(columns)

    @staticmethod
    def decode(header, payload, h=0, p=0):
        v, h = unpack_varint(header, h)
        kind = _kind_of(header, h)
        centre, h = decode_coordinates(header, h + 1, (v, 3), kind)
        vectors, h = decode_coordinates(header, h, (v, 3), kind)
        t, p = unpack_varint(payload, p)
        need, p = unpack_ints(payload, v, 2, p)
        u = np.zeros((v, t, 3))
        for k in range(3):
            pick = np.flatnonzero(need > k)
            u[pick, :, k], p = decode_coordinates(payload, p, (len(pick), t), kind)
        return ((u @ rotations(vectors.astype(np.float64))).transpose(1, 0, 2) + centre).astype(kind), h, p


#: Methods by name, with their numbers in files; register_method() adds to them.
METHODS: dict[str, tuple[int, type]] = {"raw": (1, Raw), "static": (2, Static), "pca": (3, Pca), "rotation": (4, Rotation)}


def register_method(name: str, number: int, method: type) -> None:
    if not 0 <= number < 1 << 16:
        raise ValueError("a method's number has 16 bits")
    for other, (n, known) in METHODS.items():
        if n == number and (known is not method or other != name):
            raise ValueError(f"number {number} is {other}'s")
    METHODS[name] = (number, method)


def dense(sample: np.ndarray, vertex: np.ndarray, coord: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Long columns of one cluster as an array, vertices in the order of their numbers given."""
    t, v, d = int(sample.max()) + 1, int(vertex.max()) + 1, int(coord.max()) + 1
    if len(value) != t * v * d or not np.isfinite(value).all():
        raise ValueError("a cluster is not dense and finite")
    out = np.full((t, v, d), np.nan)
    out[sample, vertex, coord] = value
    if np.isnan(out).any():
        raise ValueError("a point occurs twice")
    return out


def embed(t: DataFrame, covering: DataFrame, quality: float, candidates: tuple[str, ...] = ("raw", "static", "pca", "rotation"), item_bytes: int = 8) -> DataFrame:
    """A row per cluster and candidate that is valid there: series, cluster, method, number, header, payload binary, nbytes long, linf double.

    Values are floats of item_bytes; the loss is measured against them as that type holds them. An error names its series.
    """
    if not quality > 0:
        raise ValueError("the quality is positive")
    if item_bytes not in FLOATS:
        raise ValueError("floats have 2, 4 or 8 bytes")
    methods = {name: METHODS[name] for name in candidates}
    schema = pa.schema([("series", pa.string()), ("cluster", pa.int32()), ("method", pa.string()), ("number", pa.int32()), ("header", pa.binary()), ("payload", pa.binary()), ("nbytes", pa.int64()), ("linf", pa.float64())])

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        series, cluster = (k.as_py() for k in key)
        rows = []
        try:
            with np.errstate(over="ignore"):
                x = dense(*(table.column(c).to_numpy() for c in ("sample", "rank_in_cluster", "coord", "value"))).astype(f"<f{item_bytes}")
            if not np.isfinite(x).all():
                raise ValueError(f"a value does not fit floats of {item_bytes} bytes")
            for name, (number, method) in methods.items():
                if method.valid(x, quality):
                    header, payload = method.encode(x, quality)
                    lost = float(np.abs(method.decode(header, payload)[0].astype(np.float64) - x).max())
                    rows.append({"series": series, "cluster": cluster, "method": name, "number": number, "header": header, "payload": payload, "nbytes": len(header) + len(payload), "linf": lost})
        except Exception as e:
            raise ValueError(f"series {series!r}, cluster {cluster}: {e}") from e
        return pa.Table.from_pylist(rows, schema)

    parts = sliced(t, covering).select("series", "cluster", "sample", "rank_in_cluster", "coord", "value")
    return parts.groupBy("series", "cluster").applyInArrow(run, "series string, cluster int, method string, number int, header binary, payload binary, nbytes long, linf double")


#: A measured error counts as within the bound up to this share above it (float32 qualities).
SLACK = 1e-6


def best(embedded: DataFrame, quality: float) -> DataFrame:
    """The smallest candidate within the bound of each cluster, the one of smaller number of equals; raw where none is."""
    fits = (F.col("linf") <= quality * (1 + SLACK)) | (F.col("method") == "raw")
    w = Window.partitionBy("series", "cluster").orderBy((~fits).cast("int"), "nbytes", "number")
    return embedded.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def reconstruct(chosen: DataFrame) -> DataFrame:
    """series, cluster, rank_in_cluster, sample, coord, value of rows with a method, header and payload."""
    methods = dict(METHODS)

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                x = methods[r["method"]][1].decode(r["header"], r["payload"])[0]
                t, v, d = x.shape
                at = np.indices((t, v, d), np.int32).reshape(3, -1)
                n = x.size
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["series"]] * n), pa.array(np.full(n, r["cluster"], np.int32)), pa.array(at[1]), pa.array(at[0]), pa.array(at[2]), pa.array(np.ascontiguousarray(x).ravel().astype(np.float64))],
                    ["series", "cluster", "rank_in_cluster", "sample", "coord", "value"])

    return chosen.select("series", "cluster", "method", "header", "payload").mapInArrow(run, "series string, cluster int, rank_in_cluster int, sample int, coord int, value double")


def truncation_counts(m: DataFrame, a: DataFrame, b: DataFrame, eps: float) -> DataFrame:
    """row, col, needed: components_needed() of long factors a (row, k, x) and b (k, col, y) with m (row, col, value), natively.

    Rows times columns times components pass through a window: for factors of a few components.
    """
    most = a.groupBy().agg((F.max("k") + 1).alias("most"))
    products = a.join(b, "k").select("row", "col", "k", (F.col("x") * F.col("y")).alias("p"))
    w = Window.partitionBy("row", "col").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    partial = products.withColumn("sum", F.sum("p").over(w)).join(m, ["row", "col"])
    ok = partial.groupBy("row", "col").agg(F.min(F.when(F.abs(F.col("value") - F.col("sum")) <= eps, F.col("k") + 1)).alias("k"), F.first(F.abs("value") <= eps).alias("none"))
    return ok.crossJoin(F.broadcast(most)).select("row", "col", F.when(F.col("none"), 0).otherwise(F.coalesce("k", "most")).cast("int").alias("needed"))  # most: a single row


def static_values(t: DataFrame, quality: float) -> DataFrame:
    """Static reduction without leaving the JVM: series, vertex, coord, middle (in multiples of the quality), valid (moves by at most twice the quality)."""
    from ..functions.expressions import quantised, stored_quality
    from .metric import bounding_box

    box = bounding_box(t)
    return box.select("series", "vertex", "coord", (quantised(F.col("midpoint"), quality) * F.lit(stored_quality(quality))).alias("middle"), (F.col("high") - F.col("low") <= 2 * quality).alias("valid"))
