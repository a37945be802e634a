"""Exact top-k inner products by branch and bound in ball trees, a tree for each shard.

A node is a ball (centre, radius) around its vectors, so no inner product in it exceeds q.c + |q| r, nor |q| times its
longest vector. Shards are groups of a cell (cells.py) and have one row of bounds each; blocks of queries are groups of
the same cells. Each block searches the shards in rounds, those with the best centres first, one, two, four, ... at a
time; before a round the bounds of its shards are compared with the k-th scores so far, and only what may still hold a
result is sent. In a shard, nodes are taken in the order of their bounds, a node is left when its bound is below each
query's k-th score, which rises with every leaf, and of a leaf only the rows that are far enough out are scored.

All scores are sums of integers and exact. Of equal vectors, only the ids that can be among the k best are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cells import fit, grouped, placed
from .store import written
from .vectors import blob, by_length, matrix_of, packed, unpacked

K, SCALE = 20, 64
SHARD, LEAF, QUERIES, TILE = 16_384, 32, 2048, 512
#: Rows, in multiples of k, that each query meets before bounds are looked at.
SEEN = 3
#: Candidates a query, on average, at which k-th scores are taken anew.
MERGED = 4
#: A node's smaller child has one row in so many at least, else both have half.
LEAST_SHARE = 16
#: Rows in which a task looks for equal vectors at a time.
ALIKE_ROWS = 65_536
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def whole(matrix: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as doubles, which hold these integers exactly; beyond their range, the outermost double."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(matrix * SCALE), -np.finfo(np.float64).max, np.finfo(np.float64).max)


def build_tree(vectors: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """An order of the rows and the nodes over it: start, end, left, right (-1: a leaf), centre, radius and longest; away: of each row from its leaf's centre, falling within a leaf."""
    order, away_of = np.arange(len(vectors)), np.zeros(len(vectors))
    nodes: list[list] = []
    centres, bounds, todo = [], [], [(0, len(vectors), -1)]
    while todo:
        start, end, parent = todo.pop()
        own = vectors[order[start:end]]
        with np.errstate(over="ignore", invalid="ignore"):
            centre = own.mean(axis=0)
            away, size = np.linalg.norm(own - centre, axis=1), np.linalg.norm(own, axis=1)
        if parent >= 0:
            nodes[parent][2 if nodes[parent][2] < 0 else 3] = len(nodes)
        me = len(nodes)
        nodes.append([start, end, -1, -1])
        centres.append(centre)
        bounds.append([away.max() * (1 + 1e-9) + 1e-9, size.max() * (1 + 1e-9)])
        if end - start > LEAF and away.max() > 0:
            a = own[away.argmax()]
            b = own[np.linalg.norm(own - a, axis=1).argmax()]
            place = own @ (b - a)
            near = int((place <= (a + b) @ (b - a) / 2).sum())  # as many as are nearer to a: groups stay whole
            half = near if min(near, end - start - near) * LEAST_SHARE >= end - start else (end - start) // 2
            order[start:end] = order[start:end][np.argpartition(place, half)]
            todo += [(start + half, end, me), (start, start + half, me)]
        else:
            outer = np.argsort(-away, kind="stable")
            order[start:end], away_of[start:end] = order[start:end][outer], away[outer] * (1 + 1e-9) + 1e-9
    bounds = np.array(bounds)
    return order, {"span": np.array(nodes, np.int64), "radius": bounds[:, 0].copy(), "longest": bounds[:, 1].copy(), "centre": np.array(centres), "away": away_of}


def upper(q: np.ndarray, size: np.ndarray, centre: np.ndarray, radius: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """No inner product of a query (rows) with a vector of a ball (columns) is larger; what can't be told is infinite."""
    with np.errstate(over="ignore", invalid="ignore"):
        bound = np.minimum(q @ centre.T + size[:, None] * radius, size[:, None] * longest)
        bound += 1e-6 + np.abs(bound) * 1e-12  # rounding never hides a row
    return np.where(np.isnan(bound), np.inf, bound)


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """q @ x.T of doubles that are integers: by doubles where they hold every sum exactly, else by longer integers; sums are clipped to 64 bits."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), np.int64)
    most = float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1]
    if most < 2**52:
        return (q @ x.T).astype(np.int64)
    if most < 2**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    ints = lambda m: [[int(v) for v in r] for r in m.tolist()]
    others = ints(x)
    return np.array([[min(max(sum(a * b for a, b in zip(r, o, strict=True)), _LOW), _HIGH) for o in others] for r in ints(q)], np.int64)


def best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query, by score, then by smaller id."""
    order = np.lexsort((ids, ~score, query))  # ~score: larger scores first, without overflow
    query, ids, score = query[order], ids[order], score[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query, side="left") < k
    return query[keep], ids[keep], score[keep]


def kth_scores(query: np.ndarray, score: np.ndarray, n: int, k: int) -> np.ndarray:
    """Of best() rows of n queries: the k-th score of those with k rows; the least integer for others."""
    out = np.full(n, _LOW)
    last = np.flatnonzero(np.concatenate((query[1:] != query[:-1], [True]))) if len(query) else np.zeros(0, np.int64)
    out[query[last]] = score[last]
    out[np.bincount(query, minlength=n) < k] = _LOW
    return out


def search(q: np.ndarray, own: np.ndarray, floor: np.ndarray, x: np.ndarray, ids: np.ndarray, tree: dict, k: int):
    """(query row, id, score) of the k best rows for each query but the row of its own id, and how many pairs were scored; floor: a score that each query's k-th best has at least."""
    parts = [_search(q[s : s + TILE], own[s : s + TILE], floor[s : s + TILE], x, ids, tree, k) for s in range(0, len(q), TILE)]
    i, found, score = (np.concatenate([p[c] + (n * TILE if c == 0 else 0) for n, p in enumerate(parts)]) for c in range(3))
    return i, found, score, sum(p[3] for p in parts)


def _search(q, own, floor, x, ids, tree, k):
    kth, scored = floor.copy(), 0
    with np.errstate(over="ignore", invalid="ignore"):
        size = np.linalg.norm(q, axis=1)
        middle = q @ tree["centre"].T
    bound = upper(q, size, tree["centre"], tree["radius"], tree["longest"])
    plain = q.size and x.size and float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < 2**52  # doubles hold every sum
    span, found, done = tree["span"], (np.zeros(0, np.int64),) * 3, np.zeros(bound.shape, bool)

    def score(node: int, active: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        nonlocal scored
        start, end = span[node][:2]
        done[active, node] = True
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            away = (kth[active] - 1e-6 - middle[active, node]) / size[active]  # nearer to the centre, rows score less
            far = np.where(size[active] > 0, away - np.abs(away) * 1e-9, -np.inf)
        rows = np.searchsorted(-tree["away"][start:end], -far, side="right")  # of each query; NaN sorts last: all rows
        rows[~np.isfinite(tree["away"][start:end]).all() | np.isnan(far)] = end - start
        active = active[rows > 0]
        if not active.size:
            return (np.zeros(0, np.int64),) * 3
        most = int(rows.max())
        scored += len(active) * most
        own_x = x[start : start + most]
        products = (q[active] @ own_x.T).astype(np.int64) if plain else _exact(q[active], own_x)
        i, j = np.nonzero((products >= kth[active, None]) & (ids[start : start + most][None, :] != own[active, None]))
        return active[i], ids[start : start + most][j], products[i, j]

    def take(parts) -> None:
        nonlocal found, kth
        parts = [p for p in parts if len(p[0])]
        if parts:
            found = best(*(np.concatenate(c) for c in zip(found, *parts, strict=True)), k)
            kth = np.maximum(kth, kth_scores(found[0], found[2], len(q), k))

    # the leaves whose centres score best come first, for each query its own, until they hold SEEN times k rows
    leaves = np.flatnonzero(span[:, 2] < 0)
    rows = span[leaves, 1] - span[leaves, 0]
    with np.errstate(invalid="ignore"):
        first = np.argsort(-np.nan_to_num(middle[:, leaves], nan=np.inf), axis=1, kind="stable")[:, : max(1, -(-SEEN * k // max(1, int(np.median(rows)))))]
    chosen = np.zeros((len(q), len(leaves)), bool)
    np.put_along_axis(chosen, first, True, axis=1)
    chosen &= bound[:, leaves] >= kth[:, None]
    take([score(int(leaves[c]), np.flatnonzero(chosen[:, c])) for c in np.flatnonzero(chosen.any(axis=0))])
    stack, later, waiting = [0], [], 0
    while stack:
        node = stack.pop()
        if waiting > MERGED * len(q):
            take(later)
            later, waiting = [], 0
        active = np.flatnonzero((bound[:, node] >= kth) & ~done[:, node])
        if not active.size:
            continue
        left, right = span[node][2:]
        if left >= 0:
            stack += sorted((left, right), key=lambda c: (bound[active, c]).sum())  # the better one is taken first
        else:
            later.append(score(node, active))
            waiting += len(later[-1][0])
    take(later)
    return *found, scored


_TREE = ("span", "radius", "longest", "centre", "away")
_BLOB = "dim int, cell int, name long, n int, ids binary, matrix binary"


def _few_alike(rows: DataFrame, k: int) -> DataFrame:
    """dim, id, x of rows (id, vec): whole components; of equal vectors that a task meets together, only the k + 1 smallest ids."""

    def run(batches):
        held: list[tuple] = []

        def flush():
            for dim in sorted({d for d, _, _ in held}):
                ids, x = np.concatenate([i for d, i, _ in held if d == dim]), np.concatenate([m for d, _, m in held if d == dim])
                x = x + 0.0  # no negative zeros
                order = np.lexsort((ids, *x.T))
                ids, x = ids[order], x[order]
                new = np.concatenate(([True], (x[1:] != x[:-1]).any(axis=1)))
                again = np.concatenate(([False], ~new[1:] & (ids[1:] == ids[:-1])))
                ids, x, new = ids[~again], x[~again], new[~again]
                first = np.flatnonzero(new)
                keep = np.arange(len(ids)) - first[np.cumsum(new) - 1] <= k
                yield pa.RecordBatch.from_arrays([pa.array(np.full(keep.sum(), dim, np.int32)), pa.array(ids[keep]), pa.array(packed(x[keep]), pa.binary())], ["dim", "id", "x"])
            held.clear()

        for batch in batches:
            ids = batch.column("id").to_numpy()
            for dim, at, matrix, ok in by_length(batch.column("vec")):
                if ok.any():
                    held.append((dim, ids[at[ok]], whole(matrix[ok])))
            if sum(len(i) for _, i, _ in held) >= ALIKE_ROWS:
                yield from flush()
        yield from flush()

    clean = rows.where("id is not null and vec is not null").where("size(vec) > 0")
    return clean.mapInArrow(run, "dim int, id long, x binary")


def _blobs(rows: DataFrame, size: int, name: str, tree: bool) -> DataFrame:
    """Rows (dim, id, x, cell) as blobs of about `size`: dim, cell, name, n, ids, matrix, and the ball tree over them. Equal rows count once."""

    def gather(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        dim, cell, sub = (v.as_py() for v in key)
        ids, x = table.column("id").to_numpy(), unpacked(table.column("x").to_pylist(), dim)
        order = np.lexsort((*x.T, ids))
        ids, x = ids[order], x[order]
        new = np.concatenate(([True], (ids[1:] != ids[:-1]) | (x[1:] != x[:-1]).any(axis=1)))
        ids, x = ids[new], x[new]
        out = {"dim": dim, "cell": cell, "name": (cell << 32) + sub, "n": len(ids)}
        if tree:
            place, nodes = build_tree(x)
            ids, x = ids[place], x[place]
            out |= {c: nodes[c].tobytes() for c in _TREE}
        return pa.Table.from_pylist([out | {"ids": ids.astype(np.int64).tobytes(), "matrix": blob(x)}], schema)

    schema = pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("name", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()), ("matrix", pa.binary()), *((c, pa.binary()) for c in (_TREE if tree else ()))])
    return written(grouped(rows, size).applyInArrow(gather, ", ".join([_BLOB, *(f"{c} binary" for c in (_TREE if tree else ()))])), name)


def _ints(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.int64)


def _rows(batches):
    """Rows of batches as dicts, one at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _ranked(blocks: DataFrame, shards: DataFrame) -> DataFrame:
    """dim, block, shard, place: the shards of each block, those first whose centres score best with its middle."""
    score = F.aggregate(F.zip_with("middle", "centre0", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    pairs = blocks.select("dim", "block", "middle").join(shards.select("dim", F.col("name").alias("shard"), "centre0"), "dim")
    order = Window.partitionBy("dim", "block").orderBy(F.desc_nulls_last("score"), "shard")
    return pairs.select("dim", "block", "shard", score.alias("score")).select("dim", "block", "shard", (F.row_number().over(order) - 1).alias("place"))


_STATE = "dim int, block long, query binary, id binary, score binary, floor binary, scored long"


def searched(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A row per block of queries: qids and, packed, the k best rows of each (query, id, score); scored: pairs whose product was taken, of `pairs`."""
    plain = lambda df: _few_alike(df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")), k)
    rows = written(plain(vectors), "whole")
    cells = fit(rows, SHARD)
    shards = _blobs(written(placed(rows, cells), "cells"), SHARD, "shards", True)
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    schema = "dim int, id long, x binary"

    def all_rows(batches):  # every query is asked, alike or not
        for batch in batches:
            for dim, at, matrix, ok in by_length(batch.column("vec")):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(ok.sum(), dim, np.int32)), batch.column("id").take(pa.array(at[ok])), pa.array(packed(whole(matrix[ok])), pa.binary())], ["dim", "id", "x"])

    asked = asked.where("id is not null and vec is not null").where("size(vec) > 0").mapInArrow(all_rows, schema)
    blocks = _blobs(written(placed(asked, cells), "asked"), QUERIES, "blocks", False).withColumnRenamed("name", "block")

    state_schema = pa.schema([("dim", pa.int32()), ("block", pa.int64()), *((c, pa.binary()) for c in ("query", "id", "score", "floor")), ("scored", pa.int64())])

    def start(batches):
        for r in _rows(batches):
            q = matrix_of(r["matrix"], r["n"], r["dim"])
            with np.errstate(over="ignore"):
                middle = q.mean(axis=0).tolist()
            none = np.zeros(0, np.int64).tobytes()
            row = {"dim": r["dim"], "block": r["block"], "query": none, "id": none, "score": none, "floor": np.full(r["n"], _LOW).tobytes(), "scored": 0, "middle": middle}
            yield pa.RecordBatch.from_pylist([row], state_schema.append(pa.field("middle", pa.list_(pa.float64()))))

    state = written(blocks.mapInArrow(start, f"{_STATE}, middle array<double>"), "state")

    def centres(batches):
        for r in _rows(batches):
            row = {"dim": r["dim"], "name": r["name"], "centre0": np.frombuffer(r["centre"])[: r["dim"]].tolist(), "radius0": float(np.frombuffer(r["radius"])[0]), "longest0": float(np.frombuffer(r["longest"])[0])}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("dim", pa.int32()), ("name", pa.int64()), ("centre0", pa.list_(pa.float64())), ("radius0", pa.float64()), ("longest0", pa.float64())]))

    bounds = written(shards.mapInArrow(centres, "dim int, name long, centre0 array<double>, radius0 double, longest0 double"), "bounds")
    order = written(_ranked(state, bounds), "order")
    most = order.agg(F.max("place")).first()[0]
    state = state.drop("middle")
    asked = blocks.select("dim", "block", F.col("n").alias("qn"), F.col("ids").alias("qids"), F.col("matrix").alias("q"))

    def open_(batches):
        for r in _rows(batches):
            q, floor = matrix_of(r["q"], r["qn"], r["dim"]), _ints(r["floor"])
            with np.errstate(over="ignore"):
                size = np.linalg.norm(q, axis=1)
            bound = upper(q, size, np.array([r["centre0"]]), np.array([r["radius0"]]), np.array([r["longest0"]]))[:, 0]
            if (bound >= floor).any():
                yield pa.RecordBatch.from_pylist([{c: r[c] for c in ("dim", "block", "shard")}], pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("shard", pa.int64())]))

    def find(batches):
        for r in _rows(batches):
            q, x = matrix_of(r["q"], r["qn"], r["dim"]), matrix_of(r["matrix"], r["n"], r["dim"])
            tree = {c: np.frombuffer(r[c], np.int64 if c == "span" else np.float64) for c in _TREE}
            tree["span"], tree["centre"] = tree["span"].reshape(-1, 4), tree["centre"].reshape(-1, r["dim"])
            i, found, score, scored = search(q, _ints(r["qids"]), _ints(r["floor"]), x, _ints(r["ids"]), tree, k)
            yield pa.RecordBatch.from_pylist([{"dim": r["dim"], "block": r["block"], "query": i.astype(np.int64).tobytes(), "id": found.astype(np.int64).tobytes(), "score": score.astype(np.int64).tobytes(), "floor": None, "scored": scored}], state_schema)

    def merge(key, left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [*left.to_pylist(), *right.to_pylist()]
        old = _ints(parts[0]["floor"])
        query, ids, score = best(*(np.concatenate([_ints(p[c]) for p in parts]) for c in ("query", "id", "score")), k)
        floor = np.maximum(old, kth_scores(query, score, len(old), k))
        return pa.Table.from_pylist([{"dim": parts[0]["dim"], "block": parts[0]["block"], "query": query.tobytes(), "id": ids.tobytes(), "score": score.tobytes(), "floor": floor.tobytes(), "scored": sum(p["scored"] for p in parts)}], state_schema)

    done, width = 0, 1
    while most is not None and done <= most:  # places 0, 1-2, 3-6, ...
        own = order.where((F.col("place") >= done) & (F.col("place") < done + width)).select("dim", "block", "shard")
        floors = asked.join(state.select("dim", "block", "floor"), ["dim", "block"])
        if done:
            near = own.join(floors, ["dim", "block"]).join(bounds.withColumnRenamed("name", "shard"), ["dim", "shard"])
            own = near.mapInArrow(open_, "dim int, block long, shard long")
        pairs = own.join(floors, ["dim", "block"]).join(shards.withColumnRenamed("name", "shard").drop("cell"), ["dim", "shard"])
        found = pairs.mapInArrow(find, _STATE)
        state = written(state.groupBy("dim", "block").cogroup(found.groupBy("dim", "block")).applyInArrow(merge, _STATE), "state")
        done, width = done + width, 2 * width
    sizes = shards.groupBy("dim").agg(F.sum("n").alias("rows"))
    return state.join(asked.select("dim", "block", "qn", "qids"), ["dim", "block"]).join(sizes, "dim", "left").withColumn("pairs", F.col("qn") * F.coalesce("rows", F.lit(0)))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id long, rank int (from 1), vec_id long, score long: each query's k best rows but its own, all if there are fewer.

    Components are floor(SCALE * x). Equal scores go to the smaller id. Vectors that are null, empty or hold null or
    non-finite components and rows of null id take no part; a query meets vectors of its own length. Equal rows (id and
    vector) count once. A score beyond 64 bits counts as the outermost 64-bit integer. Other columns are not read.
    """

    def unroll(batches):
        for r in _rows(batches):
            query, ids, score, own = (_ints(r[c]) for c in ("query", "id", "score", "qids"))
            rank = np.arange(len(query)) - np.searchsorted(query, query, side="left") + 1
            yield pa.RecordBatch.from_arrays([pa.array(own[query]), pa.array(rank.astype(np.int32)), pa.array(ids), pa.array(score)], ["query_id", "rank", "vec_id", "score"])

    return searched(vectors, queries, k, id_col, vec_col).mapInArrow(unroll, "query_id long, rank int, vec_id long, score long")
