"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Vectors of length one are projected on PROJECTIONS random directions, and a block of vectors is sorted along each of
them. Around each query, the window that is REACH deviations (of a pair just at the threshold) wide is one stretch of each
sorted order; how many of these stretches hold a vector is its count of collisions with the query. The differences of a
pair along random directions are independent, so its count is binomial: a pair is verified by its cosine when its count
is at least `needed`, which a pair just at the threshold reaches with probability RECALL, and a closer pair more often.

Counts are taken for many queries at once, in bits: each order has bit maps of its first vectors, for every MAPS-th part of it, so
a window is the difference of two of them, and the maps of a query's 32 windows are added bit by bit, 64 vectors a word.
Queries that lie together in an order share a window that covers theirs, rounded outwards; a count is thus never less
than that of the query's own windows (`Orders.collisions`), and a few more pairs are verified.

Blocks are groups of a cell (cells.py). Two blocks meet only where the windows of one reach the other in `needed`
projections or more; no pair that could be verified is lost by leaving others out. Blocks that follow one another are a
part; a task compares the blocks of two parts, and each is sent there once. It returns a row a vector (links found, and
the least vector of its component there), never pairs. Copies are one vector with a count.

Cost: a window holds a fixed share of a block that it reaches, so where blocks are not apart (directions without any
structure) work grows with the square of the number of distinct vectors, as it must with one-dimensional windows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cells import fit, grouped, placed
from .components import components
from .store import written
from .vectors import blob, by_length, matrix_of, packed, same_keys, unpacked

COSINE = 0.95
PROJECTIONS, REACH, RECALL = 32, 1.0, 0.9999
#: Vectors of a block; queries whose candidates are verified together.
BLOCK, QUERY_ROWS = 8192, 256
#: Parts of a table, where they are not larger than so many vectors (nor smaller than a block).
PARTS, PART_ROWS = 10, 131_072
#: Partitions of the comparison at most; a partition then has several tasks' blocks, one task after another.
MOST_PARTITIONS = 4096
#: Bit maps of an order, about; windows along a projection that the queries of a block share.
MAPS, WINDOWS = 256, 256
#: Components by which a pair is left out in single precision before its cosine is taken; room for rounding in that distance.
HEAD, SLACK = 16, 1e-4
#: Links, and pairs to verify, that are handled at a time.
LINKS, PAIRS = 1 << 18, 1 << 16


def needed(p: float, m: int = PROJECTIONS, recall: float = RECALL) -> int:
    """The largest count that a binomial of m trials with chance p reaches with probability `recall`."""
    tail = 0.0
    for count in range(m, -1, -1):
        tail += math.comb(m, count) * p**count * (1 - p) ** (m - count)
        if tail >= recall:
            return count
    return 0


#: The count from which on a pair is verified.
LEAST = needed(math.erf(REACH / math.sqrt(2)))


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng(20_24 + dim).standard_normal((dim, PROJECTIONS))


def window(cosine: float) -> float:
    """How far from a query its windows reach: REACH deviations of the difference of a pair with that cosine, with room for rounding."""
    return REACH * math.sqrt(2 * (1 - cosine)) + 1e-9


def projected(x: np.ndarray) -> np.ndarray:
    """Places of each row along each direction."""
    return (x / np.linalg.norm(x, axis=1)[:, None]) @ directions(x.shape[1])


class Vectors:
    """Vectors with what comparisons need: norms, places along the directions, leading components at length one."""

    def __init__(self, x: np.ndarray):
        self.x, self.norm, self.places = x, np.linalg.norm(x, axis=1), projected(x)
        self.head = np.ascontiguousarray(x[:, :HEAD] / self.norm[:, None], np.float32)
        self._shares: tuple | None = None

    def shares(self) -> tuple[np.ndarray, np.ndarray]:
        """Along each direction, places that cut the vectors into WINDOWS shares (a row a cut), and the share of each vector (a row a direction)."""
        if self._shares is None:
            n = min(WINDOWS, len(self.x))
            along = np.ascontiguousarray(self.places.T)
            edges = np.sort(along, axis=1)[:, [*(np.arange(n) * len(self.x) // n), len(self.x) - 1]].T
            self._shares = edges, np.stack([np.searchsorted(edges[:-1, k], p, "right") - 1 for k, p in enumerate(along)])
        return self._shares


class Orders:
    """A block sorted along each projection."""

    def __init__(self, x: np.ndarray, places: np.ndarray | None = None):
        p = projected(x) if places is None else places
        self.order = [np.argsort(p[:, k], kind="stable") for k in range(PROJECTIONS)]
        self.place = [p[o, k] for k, o in enumerate(self.order)]
        self.n = len(x)
        self.words, self.step = -(-self.n // 64), max(1, self.n // MAPS)
        self._first: list[np.ndarray] = []

    def collisions(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The count of each vector with a query whose window in order k is the stretch lo[k]:hi[k]; the definition."""
        return np.bincount(np.concatenate([o[a:b] for o, a, b in zip(self.order, lo, hi, strict=True)]), minlength=self.n)

    def stretches(self, p: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """The windows of queries (places p, a row each) in each order."""
        ends = [np.searchsorted(own, (p[:, k] - reach, p[:, k] + reach)) for k, own in enumerate(self.place)]
        return np.stack([e[0] for e in ends], 1), np.stack([e[1] for e in ends], 1)

    def first(self) -> list[np.ndarray]:
        """For each order the bit maps of its first 0, step, 2 step, ... vectors."""
        if not self._first:
            step = np.arange(self.n) // self.step + 1
            for o in self.order:
                own = np.zeros((step[-1] + 1, self.words * 64), np.uint8)
                own[step, o] = 1
                self._first.append(np.bitwise_or.accumulate(np.packbits(own, axis=1, bitorder="little").view(np.uint64), axis=0))
        return self._first

    def windows(self, edges: np.ndarray, reach: float) -> list[np.ndarray]:
        """For each order the bit maps of the windows of queries from each of the places `edges` (a row each) to the next."""
        lo, hi = self.stretches(edges[:-1], reach)[0] // self.step, -(-self.stretches(edges[1:], reach)[1] // self.step)
        return [np.take(first, hi[:, k], axis=0) ^ np.take(first, lo[:, k], axis=0) for k, first in enumerate(self.first())]


def at_least(maps, least: int, levels: int, spare: list[np.ndarray]) -> np.ndarray:
    """The bit map of where `least` or more of the bit maps (at most 2**levels) have a one, added in binary digits 64 places at a time.

    Maps are overwritten, and left in `spare` when they are no longer needed, from where others can be taken.
    """
    start = (1 << levels) - least  # so that the digit of 2**levels tells
    digits: list = [None] * levels  # None: still that of `start`, the same everywhere
    waiting: list = [None] * levels
    top = None

    def add(level: int, v: np.ndarray) -> None:
        nonlocal top
        while level < levels:
            if waiting[level] is None:
                waiting[level] = v
                return
            a, b, c = waiting[level], v, digits[level]
            waiting[level], t = None, spare.pop() if spare else np.empty_like(a)
            if c is None:
                (np.bitwise_or if start >> level & 1 else np.bitwise_and)(a, b, out=t)
                np.bitwise_xor(a, b, out=a)
                digits[level], v = np.invert(a, out=a) if start >> level & 1 else a, t
            else:
                np.bitwise_xor(a, b, out=t)
                np.bitwise_and(a, b, out=a)
                np.bitwise_and(t, c, out=b)
                np.bitwise_xor(t, c, out=c)
                v = np.bitwise_or(a, b, out=a)
                spare.append(t)
            spare.append(b)
            level += 1
        if top is not None:
            np.bitwise_or(top, v, out=v)
            spare.append(top)
        top = v

    for m in maps:
        add(0, m)
    for level in range(levels):
        if (v := waiting[level]) is not None:
            waiting[level], c = None, digits[level]
            if c is not None:
                add(level + 1, np.bitwise_and(v, c, out=v))
            elif start >> level & 1:
                add(level + 1, v)
    spare += [d for d in digits if d is not None]
    return top


def ones(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ones of bit maps, a row each; rows ascend."""
    flat, width = bits.view(np.uint8).reshape(-1), bits.shape[1] * 64
    some = np.flatnonzero(flat != 0)
    at = np.flatnonzero(np.unpackbits(flat[some], bitorder="little").view(bool))
    at = some[at >> 3] * 8 + (at & 7)
    row = at // width
    return row, at - row * width


def linked(x: Vectors, y: Vectors, orders: Orders, cosine: float, same: bool):
    """Row numbers (i, j) of x and y with cosine or more, in pieces; orders: of y; same: y is x, and i < j."""
    reach = window(cosine)
    low, high = (np.array([own[e] for own in orders.place]) for e in (0, -1))
    some = np.flatnonzero(((x.places >= low - reach) & (x.places <= high + reach)).sum(axis=1) >= LEAST)  # other queries reach too few projections of this block
    if not len(some):
        return
    edges, own = x.shares()
    maps = orders.windows(edges, reach)
    unit = np.ones(x.head.shape[1], np.float32)
    spare: list[np.ndarray] = []

    def taken(queries: np.ndarray):
        for k, m in enumerate(maps):
            into = spare.pop() if spare else np.empty((len(queries), orders.words), np.uint64)
            yield np.take(m, own[k, queries], axis=0, out=into, mode="clip")

    for s in range(0, len(some), QUERY_ROWS):
        queries = some[s : s + QUERY_ROWS]
        if spare and len(spare[0]) != len(queries):
            spare.clear()
        top = at_least(taken(queries), LEAST, (PROJECTIONS - 1).bit_length(), spare)
        row, col = ones(top)
        row = queries[row]
        spare.append(top)
        if same:
            row, col = row[col > row], col[col > row]
        for c in range(0, len(row), PAIRS):
            i, j = row[c : c + PAIRS], col[c : c + PAIRS]
            apart = np.take(x.head, i, axis=0)
            apart -= np.take(y.head, j, axis=0)
            apart *= apart
            near = apart @ unit <= 2 * (1 - cosine) + SLACK  # the whole distance is no less
            i, j = i[near], j[near]
            hit = np.einsum("ij,ij->i", x.x[i], y.x[j]) / (x.norm[i] * y.norm[j]) >= cosine
            if hit.any():
                yield i[hit], j[hit]


def linked_pairs(x: np.ndarray, y: np.ndarray, cosine: float, same: bool):
    """Row numbers (i, j) of x and y with cosine or more, in pieces; same: y is x, and i < j."""
    return linked(Vectors(x), Vectors(y), Orders(y), cosine, same)


def merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Takes the links (i, j) into labels: each row's is the least row of its component."""
    a, b = label[i], label[j]
    while (open_ := a != b).any():
        a, b = a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while ((up := label[label]) != label).any():
            label[:] = up
        a, b = label[a], label[b]


def scaled(matrix: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that no norm overflows or vanishes; cosines stay exactly as they are."""
    _, power = np.frexp(np.abs(matrix).max(axis=1, initial=0))
    return np.ldexp(matrix, -power[:, None])


_META = "dim int, cell int, block long, n int, lo array<double>, hi array<double>"


def blocks(reps: DataFrame, cosine: float) -> DataFrame:
    """Classes of equal vectors (rep, rows, vec) as rows of about BLOCK: dim, cell, block, n, lo, hi (of each projection, with half a window), reps, counts, matrix."""

    def prepare(batches):
        for batch in batches:
            for dim, rows, matrix, ok in by_length(batch.column("vec")):
                rows, matrix = rows[ok], matrix[ok]
                use = (matrix != 0).any(axis=1)
                take, x = pa.array(rows[use]), scaled(matrix[use])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), dim, np.int32)), batch.column("rep").take(take), batch.column("rows").take(take), pa.array(packed(x), pa.binary())], ["dim", "id", "rows", "x"])

    def gather(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        dim, cell, sub = (k.as_py() for k in key)
        x = unpacked(table.column("x").to_pylist(), dim)
        p, half = projected(x), window(cosine) / 2
        reps, counts = (table.column(c).to_numpy().astype(np.int64).tobytes() for c in ("id", "rows"))
        row = [dim, cell, (cell << 32) + sub, len(x), (p.min(axis=0) - half).tolist(), (p.max(axis=0) + half).tolist(), reps, counts, blob(x)]
        return pa.Table.from_pylist([dict(zip(schema.names, row, strict=True))], schema)

    schema = pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("reps", pa.binary()), ("counts", pa.binary()), ("matrix", pa.binary())])
    flat = written(reps.mapInArrow(prepare, "dim int, id long, rows long, x binary"), "vectors")
    cells = written(placed(flat, fit(flat, BLOCK)), "cells")
    return written(grouped(cells, BLOCK).applyInArrow(gather, f"{_META}, reps binary, counts binary, matrix binary"), "blocks")


def meeting_cells(made: DataFrame) -> DataFrame:
    """dim, cell, other (cell <= other) of cells whose boxes overlap in LEAST projections or more; the boxes of at most MOST_CELLS cells a length come to the driver."""
    box = [f(F.col(c)[k]).alias(f"{c}{k}") for c, f in (("lo", F.min), ("hi", F.max)) for k in range(PROJECTIONS)]
    several = made.groupBy("dim").agg(F.max("cell").alias("last")).where("last > 0").select("dim")
    by_dim: dict[int, list] = {}
    for r in made.join(several, "dim").groupBy("dim", "cell").agg(*box).orderBy("dim", "cell").collect():
        by_dim.setdefault(r["dim"], []).append(r)
    spark, out = made.sparkSession, made.select("dim").distinct().join(several, "dim", "left_anti").select("dim", F.lit(0).alias("cell"), F.lit(0).alias("other"))
    for dim, boxes in by_dim.items():
        cell, sides = np.array([r["cell"] for r in boxes]), np.array([list(r)[2:] for r in boxes])
        lo, hi = sides[:, :PROJECTIONS], sides[:, PROJECTIONS:]
        i, j = np.concatenate([np.stack((np.full(n := len(cell) - a, a), np.arange(a, len(cell))))[:, ((lo[a] <= hi[a:]) & (lo[a:] <= hi[a])).sum(axis=1) >= LEAST] for a in range(len(cell))], axis=1)
        table = pa.table({"dim": np.full(len(i), dim, np.int32), "cell": cell[i].astype(np.int32), "other": cell[j].astype(np.int32)})
        out = out.unionByName(spark.createDataFrame(table))
    return out


def block_pairs(made: DataFrame) -> DataFrame:
    """dim, x, y: the pairs of blocks whose boxes overlap in LEAST projections or more."""
    side = lambda s, cell: made.select("dim", F.col("cell").alias(cell), F.col("block").alias(s), F.col("lo").alias(f"lo_{s}"), F.col("hi").alias(f"hi_{s}"))
    both = meeting_cells(made).join(side("x", "cell"), ["dim", "cell"]).join(side("y", "other"), ["dim", "other"]).where("cell < other or x <= y")
    overlap = F.size(F.filter(F.arrays_zip("lo_x", "hi_x", "lo_y", "hi_y"), lambda s: (s["lo_x"] <= s["hi_y"]) & (s["lo_y"] <= s["hi_x"])))
    return both.where(overlap >= LEAST).select("dim", "x", "y")


def tasks(made: DataFrame) -> tuple[DataFrame, int]:
    """The blocks that each pair of parts needs (task long, first: whether of the pair's first part, second, and a block's columns), and how many pairs of parts there can be."""
    before = W.orderBy("block", "dim").rowsBetween(W.unboundedPreceding, -1)  # a row a block, without its vectors
    rows = made.agg(F.sum("n")).first()[0] or 0
    size = min(PART_ROWS, max(BLOCK, -(-rows // PARTS)))
    parts = written(made.select("dim", "block", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / size).alias("part")), "parts")
    n = (parts.agg(F.max("part")).first()[0] or 0) + 1
    side = lambda s: parts.select("dim", F.col("block").alias(s), F.col("part").alias(f"part_{s}"))
    pairs = written(block_pairs(made).join(side("x"), ["dim", "x"]).join(side("y"), ["dim", "y"]), "pairs")
    low, high = F.least("part_x", "part_y"), F.greatest("part_x", "part_y")
    task = F.expr("greatest(part_x, part_y) * (greatest(part_x, part_y) + 1) div 2 + least(part_x, part_y)").alias("task")
    sides = [pairs.select("dim", F.col(s).alias("block"), task, (F.col(f"part_{s}") == low).alias("first"), (F.col(f"part_{s}") == high).alias("second")) for s in "xy"]
    return sides[0].unionByName(sides[1]).distinct().join(made, ["dim", "block"]), n * (n + 1) // 2


def by_task(batches):
    """The rows of each task, as tables of blocks; batches are sorted by task."""
    own: list[pa.RecordBatch] = []
    for batch in batches:
        task = batch.column("task").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(task)) + 1).tolist(), len(task)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if own and a < b and own[0].column("task")[0].as_py() != task[a]:
                yield pa.Table.from_batches(own)
                own = []
            own += [batch.slice(a, b - a)] if a < b else []
    if own:
        yield pa.Table.from_batches(own)


def compared(task: pa.Table, cosine: float) -> pa.RecordBatch | None:
    """A row a vector with links: id, links, and the least id of its component in this task."""
    dims, numbers, first, second = (task.column(c).to_pylist() for c in ("dim", "block", "first", "second"))
    lo, hi = (np.array(task.column(c).to_pylist()) for c in ("lo", "hi"))
    at = np.cumsum([0, *task.column("n").to_pylist()])
    ids, counts = (np.concatenate([np.frombuffer(b, np.int64) for b in task.column(c).to_pylist()]) for c in ("reps", "counts"))
    order = np.argsort(ids, kind="stable")  # so that the least row is the least id
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    ids, counts, label, links = ids[order], counts[order], np.arange(len(order)), np.zeros(len(order), np.int64)
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0

    def flush() -> None:
        if kept:
            i, j = (np.concatenate(c) for c in zip(*kept, strict=True))
            kept.clear()
            np.add.at(links, i, counts[j])
            np.add.at(links, j, counts[i])
            merge(label, i, j)

    vectors: dict[int, Vectors] = {}

    def of(b: int) -> Vectors:
        if b not in vectors:
            vectors[b] = Vectors(matrix_of(task.column("matrix")[b].as_py(), int(at[b + 1] - at[b]), dims[b]))
        return vectors[b]

    for y in range(len(numbers)):
        overlap = ((lo <= hi[y]) & (lo[y] <= hi)).sum(axis=1) >= LEAST
        xs = [x for x in np.flatnonzero(overlap).tolist() if dims[x] == dims[y] and numbers[x] <= numbers[y] and (first[x] and second[y] or second[x] and first[y])]
        orders = Orders(of(y).x, of(y).places) if xs else None
        for x in xs:
            for i, j in linked(of(x), of(y), orders, cosine, x == y):
                kept.append((place[i + at[x]], place[j + at[y]]))
                waiting += len(i)
                if waiting >= LINKS:
                    flush()
                    waiting = 0
    flush()
    some = np.flatnonzero(links)
    if not len(some):
        return None
    return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(ids[label[some]])], ["id", "links", "least"])


def embedding_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A row per row of vectors: id, n_links long (other rows linked directly), component_id long, kept boolean (id = component_id).

    Vectors that are null, zero or hold null or non-finite components, and rows of null id, link with nothing; any other
    size of component is taken as it is. Vectors of different lengths never link. Equal vectors are one class with a
    count (by 128 bits). Other columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    usable = rows.where("id is not null and vec is not null").where("size(vec) > 0")
    classes = written(usable.groupBy(*same_keys("vec")).agg(F.min("id").alias("rep"), F.count("*").alias("rows")), "classes")
    reps = usable.select("id", "vec", *same_keys("vec")).join(classes, ["k1", "k2"]).where("id = rep").dropDuplicates(["k1", "k2"]).select("rep", "rows", "vec")
    made = blocks(reps, cosine)
    sent, n = tasks(made)

    def compare(batches):
        for task in by_task(batches):
            found = compared(task, cosine)
            if found is not None:
                yield found

    partial = written(sent.repartitionById(max(1, min(n, MOST_PARTITIONS)), F.pmod("task", F.lit(MOST_PARTITIONS)).cast("int")).sortWithinPartitions("task").mapInArrow(compare, "id long, links long, least long"), "links")
    links = partial.groupBy("id").agg(F.sum("links").alias("links"))
    whole = components(partial, "id", "least")
    per_class = classes.join(links.withColumnRenamed("id", "rep"), "rep", "left").join(whole.withColumnRenamed("node", "rep"), "rep", "left")
    out = rows.select("id", *same_keys("vec"), _links_with_something().alias("real")).join(per_class, ["k1", "k2"], "left")
    real = F.col("real") & F.col("rep").isNotNull() & F.col("id").isNotNull()
    component = F.when(real, F.coalesce("component", "rep")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.when(real, F.col("rows") - 1 + F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _links_with_something():
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.col("vec").isNotNull() & F.forall("vec", finite) & F.exists("vec", lambda x: x != 0)
