"""Near-duplicate documents by an LSH forest over MinHash signatures, links confirmed on full shingle sets.

Each of TREES trees orders the documents by DEPTH of their minima. Neighbours in an order that share BASE minima or more
are candidates. The depth that is asked for adapts to the region: where more than REGION documents share a prefix, pairs
must share a longer one, until REGION or fewer do; direct neighbours in the order are candidates at any density, so a
region of thousands of copies stays connected by a number of candidates in proportion to its size. Orders are made by
range partitioning on the whole key with the id, so no group of documents lands in one task.

Links are confirmed in two rounds: first each document with its most similar candidate of smaller id; then every other
candidate pair whose ends those links leave in different components. A pair inside a component can no longer change
the components, so no link is lost by leaving it out.

The longer prefix loses pairs, so documents of a region that asks for one are compared once more, exactly: a pair of
SHARE has a shingle in common among the first ones of both in any one order of all shingles, at places that leave room
for enough further ones. Rare shingles come first, so documents that share no more than a template do not meet, and
pairs inside a component are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs
from .components import components
from .store import written
from .words import SEQ_BASE_2, Words, mix, powers, ranges, raw, sequences, slices

SHINGLE, SHARE = 5, 75
TREES, BASE, DEPTH, REGION = 16, 4, 8, 32
#: Bytes of a signature kept for a first estimate, and the least share of them that must agree (four deviations below SHARE).
SKETCH, LEAST_ALIKE = 64, 0.53
#: Documents that are broadcast by id (about 100 bytes each in a task); beyond it, documents are joined by a shuffle.
IDS_BROADCAST = 1_000_000
#: Pairs (two ids each) that are broadcast to the sets of their first ends.
PAIRS_BROADCAST = 1_000_000
#: Rows of an order that one task reads, about.
ORDER_ROWS = 65_536
#: Cells that count shingles to put rare ones first (results are the same for any number), and those in a row of counts.
MOST_CELLS, CELLS_A_ROW = 1 << 24, 1 << 16
#: Shingles that a task deals out together and that a bucket stands for, about; pairs that are looked at together.
FLUSH, BUCKET_SHINGLES, PAIRS_AT_ONCE = 500_000, 1_000_000, 2_000_000


def shingle_sets(words: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each document (one for all words where it has fewer), with repeats, and n+1 offsets."""
    counts = words.counts
    per = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    at = np.concatenate(([0], np.cumsum(per)))
    out = np.empty(int(at[-1]), np.uint64)
    full = counts >= n
    if full.any():
        out[ranges(at[:-1][full], per[full])] = sequences(words.hash, n)[ranges(words.at[:-1][full], per[full])]
    for row in np.flatnonzero((counts > 0) & ~full):
        h = words.hash[words.at[row] : words.at[row + 1]]
        out[at[row]] = mix(np.array([(h * powers(SEQ_BASE_2, len(h))).sum() + np.uint64(len(h))], np.uint64))[0]
    return out, at


def signatures(docs: DataFrame) -> DataFrame:
    """id, n_shingles, k1, k2 (128-bit hash of the set), minima binary (unsigned 32-bit, tree by tree) of rows id, text."""
    factors = mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64)) | np.uint64(1)

    def run(batches):
        for part in slices(batches, "text"):
            h, at = shingle_sets(Words(part.column("text"), lower=True))
            n, k1, k2 = np.zeros(len(at) - 1, np.int64), np.zeros(len(at) - 1, np.int64), np.zeros(len(at) - 1, np.int64)
            rows = np.flatnonzero(np.diff(at) > 0)
            for row in rows.tolist():
                own = np.unique(h[at[row] : at[row + 1]])
                n[row] = len(own)
                k1[row], k2[row] = mix(own).sum().view(np.int64), mix(own ^ np.uint64(SEQ_BASE_2)).sum().view(np.int64)
            minima = np.empty((len(rows), len(factors)), np.uint32)
            if len(rows):
                first = at[:-1][rows]
                for j, f in enumerate(factors):
                    minima[:, j] = np.minimum.reduceat(h * f, first) >> np.uint64(32)
            blobs = np.full(len(at) - 1, None, object)
            blobs[rows] = [m.tobytes() for m in minima]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n), pa.array(k1), pa.array(k2), pa.array(blobs, pa.binary())], ["id", "n_shingles", "k1", "k2", "minima"])

    return docs.mapInArrow(run, "id long, n_shingles long, k1 long, k2 long, minima binary")


ORDER = ["tree", "p0", "p1", "p2", "p3", "p4", "id"]
_ENTRY = "tree int, p0 long, p1 long, p2 long, p3 long, p4 long, id long, n long, sketch binary"


def entries(signed: DataFrame) -> DataFrame:
    """A row per tree of each document: p0 is a hash of the first BASE minima, p1.. the next ones (DEPTH in all)."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            minima = np.frombuffer(b"".join(batch.column("minima").to_pylist()), np.uint32).reshape(batch.num_rows, TREES, DEPTH)
            sketch = (minima.reshape(batch.num_rows, -1)[:, :: TREES * DEPTH // SKETCH] & 255).astype(np.uint8)
            sketch = pa.array([s.tobytes() for s in sketch], pa.binary())
            for tree in range(TREES):
                m = minima[:, tree, :].astype(np.uint64)
                p0 = mix((m[:, :BASE] * powers(SEQ_BASE_2, BASE + 1)[1:]).sum(axis=1, dtype=np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, tree, np.int32)), pa.array(p0), *(pa.array(m[:, k].astype(np.int64)) for k in range(BASE, DEPTH)), batch.column("id"), batch.column("n_shingles"), sketch], ["tree", "p0", "p1", "p2", "p3", "p4", "id", "n", "sketch"])

    return signed.select("id", "n_shingles", "minima").mapInArrow(run, _ENTRY)


def neighbours(batches):
    """Candidates (a, b, alike) of one stretch of the orders, kind 0; its first and last two entries again, kind 1; as a, the ids of crowded entries, kind 2.

    An entry is crowded where more than BASE minima are asked for, or where the stretch may end inside its run.
    """
    batches = list(batches)
    n = sum(b.num_rows for b in batches)
    schema = ["kind", "a", "b", "alike", "entry"]
    if not n:
        return
    table = pa.Table.from_batches(batches)
    keys = [table.column(c).to_numpy() for c in ORDER[:-1]]
    ids, sizes = table.column("id").to_numpy(), table.column("n").to_numpy()
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(n, SKETCH)
    shared = np.zeros(n, np.int64)  # minima in common with the entry before
    same = (keys[0][1:] == keys[0][:-1]) & (keys[1][1:] == keys[1][:-1])
    shared[1:] = same * BASE
    for k in keys[2:]:
        same = same & (k[1:] == k[:-1])
        shared[1:] += same
    asked = np.full(n, DEPTH + 1)
    for depth in range(DEPTH, BASE - 1, -1):
        run = np.cumsum(shared < depth) - 1
        asked[np.bincount(run)[run] <= REGION] = depth
    crowded = np.unique(ids[(asked > BASE) | (run == 0) | (run == run[-1])])  # runs of BASE
    k = len(crowded)
    yield pa.RecordBatch.from_arrays([pa.array(np.full(k, 2, np.int32)), pa.array(crowded), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()), pa.nulls(k, pa.struct(table.schema))], schema)
    least = np.full(n, DEPTH + 1)
    for o in range(1, min(REGION, n)):
        least = np.minimum(least[:-1], shared[o:])
        pick = np.flatnonzero((least >= np.minimum(asked[:-o], asked[o:])) | ((o <= 2) & (least >= BASE)))
        if not pick.size and o > 2:
            break
        pick = pick[100 * np.minimum(sizes[pick], sizes[pick + o]) >= SHARE * np.maximum(sizes[pick], sizes[pick + o])]
        alike = (sketch[pick] == sketch[pick + o]).mean(axis=1)
        pick, alike = pick[alike >= LEAST_ALIKE], alike[alike >= LEAST_ALIKE]
        a, b = ids[pick], ids[pick + o]
        ok = a != b
        if ok.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(ok.sum(), np.int32)), pa.array(np.minimum(a, b)[ok]), pa.array(np.maximum(a, b)[ok]), pa.array(alike[ok]), pa.nulls(int(ok.sum()), pa.struct(table.schema))], schema)
    edge = table.take(sorted({*range(min(2, n)), *range(max(0, n - 2), n)})).combine_chunks()
    k = edge.num_rows
    yield pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()), pa.array(edge.to_pylist(), pa.struct(table.schema))], schema)


def candidates(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs a < b of ids, alike: the share of the sketch in common; ids of crowded entries; tables in the shared folder."""
    made = f"kind int, a long, b long, alike double, entry struct<{', '.join(c.strip().replace(' ', ':') for c in _ENTRY.split(','))}>"
    stretches = max(16, -(-signed.count() * TREES // ORDER_ROWS))
    found = written(entries(signed).repartitionByRange(stretches, *ORDER).sortWithinPartitions(*ORDER).mapInArrow(neighbours, made), "stretches")
    edges = found.where("kind = 1").select("entry.*").coalesce(1).sortWithinPartitions(*ORDER).mapInArrow(neighbours, made)  # four entries a stretch
    pairs = found.where("kind = 0").select("a", "b", "alike").unionByName(edges.where("kind = 0").select("a", "b", "alike"))
    crowded = found.where("kind = 2").select(F.col("a").alias("id")).distinct()
    return written(pairs.groupBy("a", "b").agg(F.max("alike").alias("alike")), "pairs"), written(crowded, "crowded")


def _sets(batches):
    """The ids and other columns of rows with a text, and the text's shingles, sorted, without repeats."""
    for part in slices(batches, "text"):
        h, at = shingle_sets(Words(part.column("text"), lower=True))
        rest = part.drop_columns(["text"])
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array([np.unique(h[a:b]).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], [*rest.schema.names, "set"])


def _counts(sets: DataFrame, cells: int) -> np.ndarray:
    """How many sets have a shingle in each cell, up to 65,535."""
    schema = pa.schema([("row", pa.int32()), ("counts", pa.binary())])

    def count(batches):
        for part in slices(batches, "set", 8 << 20):
            cell, n = np.unique(raw(part.column("set"))[0].view(np.uint64) & np.uint64(cells - 1), return_counts=True)
            used, (c, n) = blobs.dealt((cell // np.uint64(CELLS_A_ROW)).astype(np.int64), -(-cells // CELLS_A_ROW), [cell.astype(np.int64), n])
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), blobs.column(c), blobs.column(n)], ["row", "cell", "n"])

    def add_up(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        cell, n = blobs.joined(table, "cell"), blobs.joined(table, "n")
        sums = np.bincount(cell - key[0].as_py() * CELLS_A_ROW, n, min(cells, CELLS_A_ROW))
        return pa.Table.from_pylist([{"row": key[0].as_py(), "counts": np.minimum(sums, 65_535).astype(np.uint16).tobytes()}], schema)

    out = np.zeros(cells, np.uint16)
    for r in sets.select("set").mapInArrow(count, "row int, cell binary, n binary").groupBy("row").applyInArrow(add_up, "row int, counts binary").collect():
        out[r["row"] * CELLS_A_ROW : (r["row"] + 1) * CELLS_A_ROW] = np.frombuffer(r["counts"], np.uint16)
    return out


def meetings(shingle: np.ndarray, ids: np.ndarray, of: np.ndarray, size: np.ndarray, place: np.ndarray):
    """Pairs (a, b) of ids in different components (of) that meet at a shingle, at places of their orders that leave room for SHARE.

    At the first shingle in common the sets can share as many as the shorter rest from there on has, and no more.
    """
    order = np.lexsort((place, size, shingle))
    shingle, ids, of, size, rest = shingle[order], ids[order], of[order], size[order], (size - place)[order]
    n = len(ids)
    _, group = np.unique(shingle, return_inverse=True)
    own = np.lexsort((of, group))
    first = np.flatnonzero(np.concatenate(([True], (np.diff(group[own]) != 0) | (np.diff(of[own]) != 0))))
    each = np.diff(np.concatenate((first, [n])))
    best = np.full(group[-1] + 1, -1)  # of each group, the largest component's run
    by = np.argsort(each, kind="stable")
    best[group[own[first[by]]]] = by
    run_of = np.empty(n, np.int64)
    run_of[own] = np.repeat(np.arange(len(first)), each)
    major = run_of == best[group]
    most = np.minimum((100 + SHARE) * rest // SHARE - size, 100 * size // SHARE)  # the largest set that this can be enough for
    key = (size.max(initial=0) + 1) * group
    for left, right in ((np.flatnonzero(~major), np.arange(n)), (np.flatnonzero(major), np.flatnonzero(~major))):  # never two of the largest
        begin = np.searchsorted(right, left, side="right")
        end = np.searchsorted((key + size)[right], key[left] + np.clip(most[left], 0, size.max(initial=0)), side="right")
        count = np.maximum(end - begin, 0)
        left, begin, count = left[count > 0], begin[count > 0], count[count > 0]
        total, at = np.cumsum(count), 0
        while at < len(left):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
            p, q = np.repeat(left[at:to], count[at:to]), right[ranges(begin[at:to], count[at:to])]
            ok = (of[p] != of[q]) & (SHARE * (size[p] + size[q]) <= (100 + SHARE) * rest[q])
            p, q, at = p[ok], q[ok], to
            if len(p):
                yield np.unique(np.stack((np.minimum(ids[p], ids[q]), np.maximum(ids[p], ids[q]))), axis=1)


def crowded_pairs(texts: DataFrame, ids: DataFrame, inside: DataFrame) -> DataFrame:
    """Candidates (a, b) among texts of ids, of different components: every pair of SHARE is one. A table in the shared folder."""
    few = ids.count() <= IDS_BROADCAST
    wanted = texts.join(F.broadcast(ids) if few else ids, "id", "left_semi").join(inside, F.col("id") == F.col("node"), "left")
    sets = written(wanted.select("id", F.coalesce("component", "id").alias("of"), "text").mapInArrow(_sets, "id long, of long, set binary"), "crowd")
    shingles = (sets.agg(F.sum(F.octet_length("set"))).first()[0] or 0) // 8
    cells = min(MOST_CELLS, 1 << max(16, (2 * shingles).bit_length()))
    buckets = max(64, -(-shingles // BUCKET_SHINGLES))
    counts = sets.sparkSession.sparkContext.broadcast(_counts(sets, cells))

    def deal(batches):
        held: list[tuple] = []

        def flush():
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            used, parts = blobs.dealt(((columns[0] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), buckets, columns)
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *map(blobs.column, parts)], ["bucket", *_MET])

        for part in slices(batches, "set", 4 << 20):
            data, at = raw(part.column("set"))
            h, size = data.view(np.uint64), np.diff(at) // 8
            often, row = counts.value[(h & np.uint64(cells - 1)).astype(np.int64)], np.repeat(np.arange(len(size)), size)
            order = np.lexsort((h, often, row))  # row stays as it is
            h, often, place = h[order], often[order], np.arange(len(h)) - np.repeat(at[:-1] // 8, size)
            pick = np.flatnonzero((100 * (size[row] - place) >= SHARE * size[row]) & (often > 1))
            row = row[pick]
            held.append((h[pick], part.column("id").to_numpy()[row], part.column("of").to_numpy()[row], size[row], place[pick]))
            if sum(len(x[0]) for x in held) >= FLUSH:
                yield flush()
        if held:
            yield flush()

    def meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        columns = [blobs.joined(table, "shingle", np.uint64), *(blobs.joined(table, c) for c in _MET[1:])]
        pairs = [*meetings(*columns)] if len(columns[0]) else []
        a, b = np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return pa.table({"a": a, "b": b})

    dealt = sets.mapInArrow(deal, f"bucket int, {', '.join(f'{c} binary' for c in _MET)}")
    return written(dealt.groupBy("bucket").applyInArrow(meet, "a long, b long").distinct(), "meetings")


_MET = ("shingle", "id", "of", "size", "place")


def confirmed(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets share SHARE hundredths of their union or more. docs: id, text."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    ends = written(ends, "ends")
    few = ends.count() <= IDS_BROADCAST
    wanted = docs.join(F.broadcast(ends) if few else ends, "id", "left_semi")

    full = wanted.select("id", "text").mapInArrow(_sets, "id long, set binary")
    ends_of = pairs.select("a", "b")
    small = pairs.count() <= PAIRS_BROADCAST  # then the first join moves no sets
    left = full.withColumnsRenamed({"id": "a", "set": "set_a"}).join(F.broadcast(ends_of) if small else ends_of, "a")
    both = left.join(full.withColumnsRenamed({"id": "b", "set": "set_b"}), "b").select("a", "b", "set_a", "set_b")

    def check(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                z = np.sort(np.concatenate((x, y)), kind="stable")
                common = int((z[1:] == z[:-1]).sum())
                ok.append(100 * common >= SHARE * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(check, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: id, n_shingles long, component_id, kept boolean (id = component_id).

    Documents without words have no shingles and link with nothing. Rows that repeat an id are one node. Rows of null id
    take no part: component_id null, kept true. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = written(signatures(rows), "signatures")
    nodes = signed.where("id is not null and n_shingles > 0")
    classes = nodes.groupBy("k1", "k2").agg(F.min("id").alias("rep"))  # copies: one set
    classes = written(classes, "classes")
    own = nodes.join(classes.withColumnsRenamed({"k1": "c1", "k2": "c2"}), (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & (F.col("id") == F.col("rep")), "left_semi").dropDuplicates(["k1", "k2"])
    pairs, crowded = candidates(own)
    texts = rows.where("id is not null")
    by_id = nodes.groupBy("id").agg(F.count("*").alias("rows"), F.min("k1").alias("x"), F.max("k1").alias("y")).where("rows > 1")
    if not by_id.isEmpty():  # a link of any of an id's texts is a link of the id
        texts = texts.dropDuplicates(["id", "text"])
    several = None if by_id.where("x <> y").isEmpty() else nodes.select("id", "k1", "k2").join(classes, ["k1", "k2"]).select("id", "rep").where("id <> rep")
    best = written(pairs.groupBy("b").agg(F.max_by("a", F.struct("alike", (-F.col("a")).alias("o"))).alias("a")), "best")
    sure = written(confirmed(texts, best), "sure")
    inside = components(sure, "a", "b")
    rest = pairs.join(best, ["a", "b"], "left_anti")
    for end in "ab":
        rest = rest.join(inside.withColumnsRenamed({"node": end, "component": f"of_{end}"}), end, "left")
    rest = written(rest.where("coalesce(of_a, a) <> coalesce(of_b, b)").select("a", "b"), "rest")
    links = sure if rest.isEmpty() else written(sure.unionByName(confirmed(texts, rest)), "links")
    met = crowded_pairs(texts, crowded, inside if links is sure else components(links, "a", "b"))
    if not met.isEmpty():
        links = links.unionByName(confirmed(texts, met))
    if several is not None:
        links = links.unionByName(several.select(F.col("rep").alias("a"), F.col("id").alias("b")))
    whole = components(links, "a", "b")
    known = signed.select("id", "n_shingles", "k1", "k2").join(classes, ["k1", "k2"], "left").withColumn("rep", F.expr("if(n_shingles > 0, rep, id)"))
    joined = known.join(whole, F.col("rep") == F.col("node"), "left")
    component = F.expr("if(id is null, null, coalesce(component, rep, id))")
    return joined.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
