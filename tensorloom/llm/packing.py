"""Shortest-pack-first histogram packing of tokenised documents.

Documents are tokenised once into a table in the shared folder, with each row's place among the rows of its length in its
part. Only the histogram of lengths modulo the sequence length (at most `size` rows) comes to the driver. There, lengths
are placed longest first, each into the shortest pack that has room, updating counts of packing patterns; then the
shortest packs are cut up to fill the gaps that are left, so that all sequences but one are full. The plan has intervals
of ranks, a few for each length, whatever the number of documents; documents find their interval by rank.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import written
from .tokens import encoder
from .words import slices
from .worker import free

#: Largest table of rank offsets that is broadcast; beyond it, rows are joined by part.
OFFSETS_BROADCAST_BYTES = 64 << 20
#: Bytes of ids whose pieces are made at a time.
SLICE_BYTES = 1 << 20


def plan_packs(histogram: dict[int, int], size: int) -> list[tuple[int, int, list[tuple[int, int, int]]]]:
    """Packs for `histogram` (length -> count; 0 < length < size) as groups (count, fill, pieces) of like packs.

    A piece (length, rank, start, n) of a group's pack k is n tokens from `start` on of the document of that length
    and rank `rank` + k. Every token of every document is in exactly one piece; at most one pack is not full.
    """
    groups: list[list] = []  # [count, fill, pieces]
    by_fill: list[tuple[int, int]] = []  # (fill, index in groups) of the groups that have room, sorted

    def add(count: int, fill: int, pieces: list) -> None:
        groups.append([count, fill, pieces])
        if fill < size:
            insort(by_fill, (fill, len(groups) - 1))

    def later(pieces: list, k: int) -> list:
        return [(length, rank + k, start, n) for length, rank, start, n in pieces]

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            if by_fill and by_fill[0][0] + length <= size:
                _, i = by_fill.pop(0)
                count, fill, pieces = groups[i]
                k = min(count, left)
                groups[i] = [0, 0, []]
                if k < count:
                    add(count - k, fill, later(pieces, k))
                add(k, fill + length, [*pieces, (length, rank, 0, length)])
            else:
                k = left
                add(k, length, [(length, rank, 0, length)])
            rank, left = rank + k, left - k
    while len(by_fill) > 1 or by_fill and groups[by_fill[0][1]][0] > 1:  # cut the shortest packs to fill the fullest
        _, i = by_fill.pop()
        if by_fill:
            _, j = by_fill.pop(0)
            (m, to_fill, to), (n, from_fill, given) = groups[i], groups[j]
            k = min(m, n)
        else:  # one group: half of its packs fill the others
            m, to_fill, to = groups[i]
            k = m // 2
            n, from_fill, given, j = m - k, to_fill, later(to, k), i
            m = k
        groups[i], groups[j] = [0, 0, []], [0, 0, []]
        if k < m:
            add(m - k, to_fill, later(to, k))
        if k < n:
            add(n - k, from_fill, later(given, k))
        to, given, gap = list(to), list(given), size - to_fill
        while gap and given:
            length, rank, start, piece = given.pop()
            cut = min(gap, piece)
            if cut < piece:
                given.append((length, rank, start, piece - cut))
            to.append((length, rank, start + piece - cut, cut))
            gap -= cut
        moved = size - to_fill - gap
        add(k, to_fill + moved, to)
        if from_fill > moved:
            add(k, from_fill - moved, given)
    return [(c, f, p) for c, f, p in groups if c]


def intervals(groups: list, size: int) -> dict[int, tuple[list[int], list[list[tuple]]]]:
    """For each length: first ranks of intervals, ascending, and each interval's pieces (start, n, sequence of its first rank, offset)."""
    found: dict[int, list[tuple]] = {}
    sequence = 0
    for count, _, pieces in groups:
        offset = 0
        for length, rank, start, n in pieces:
            found.setdefault(length, []).append((rank, rank + count, start, n, sequence - rank, offset))
            offset += n
        sequence += count
    out = {}
    for length, rows in found.items():
        edges = sorted({r[0] for r in rows} | {r[1] for r in rows})
        cuts: list[list[tuple]] = [[] for _ in edges]
        for first, end, *piece in sorted(rows, key=lambda r: r[2]):
            for k in range(bisect_right(edges, first) - 1, bisect_right(edges, end - 1)):
                cuts[k].append(tuple(piece))
        out[length] = edges, cuts
    return out


def tokenised(docs: DataFrame, tokenizer: str, separator: int, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A table in the shared folder, a row per row of docs: id, ids binary with the separator (unsigned 16-bit where the
    vocabulary fits, else 32), n, whole_nth: whole sequences of the part's rows before it, part int, rest = n modulo size, and nth: how many rows of the part before it have that rest."""

    def run(batches):
        from pyspark import TaskContext

        enc = encoder(tokenizer, "library")
        kind = "<u2" if max(len(enc.bpe.table) - 1, separator) < 1 << 16 else "<u4"
        seen, part_id, end, whole = np.zeros(size, np.int64), TaskContext.get().partitionId(), np.array([separator], kind).tobytes(), 0
        for part in slices(batches, "text", keep=True):
            ids = [np.frombuffer(enc.encode(t or ""), "<u4").astype(kind).tobytes() + end for t in part.column(1).to_pylist()]
            n = np.array([len(x) for x in ids], np.int64) // np.dtype(kind).itemsize
            nth = []
            for r in (n % size).tolist():
                nth.append(int(seen[r]))
                seen[r] += 1
            wholes = np.cumsum(n // size)
            whole_nth, whole = whole + wholes - n // size, whole + int(wholes[-1])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(n), pa.array(whole_nth), pa.array(np.full(len(ids), part_id, np.int32)), pa.array((n % size).astype(np.int32)), pa.array(nth, pa.int64()), pa.array(np.full(len(ids), np.dtype(kind).itemsize, np.int32))], ["id", "ids", "n", "whole_nth", "part", "rest", "nth", "width"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return written(rows.mapInArrow(run, "id long, ids binary, n long, whole_nth long, part int, rest int, nth long, width int"), "tokens")


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, separator: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """A row per piece: id, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, and with_ids: ids binary.

    Sequences hold at most `size` tokens, pieces without gaps from offset 0; all but one are full. Null and empty texts
    have the separator alone. Rows with equal or null ids are packed each for itself. An empty table gives no rows.
    Whole sequences cut from documents of `size` tokens or more come after those of the plan.
    """
    spark = docs.sparkSession
    table = tokenised(docs, tokenizer, separator, size, id_col, text_col)
    counts = table.groupBy("part", "rest").agg(F.count("*").alias("rows"), F.sum(F.floor(F.col("n") / size)).alias("whole"))
    histogram = {r["rest"]: r["rows"] for r in counts.groupBy("rest").agg(F.sum("rows").alias("rows")).collect()}  # at most `size` rows
    groups = plan_packs({k: v for k, v in histogram.items() if k}, size)
    plan, planned = intervals(groups, size), sum(g[0] for g in groups)
    ranks = counts.withColumn("before", F.sum("rows").over(W.partitionBy("rest").orderBy("part").rowsBetween(W.unboundedPreceding, -1)))
    per_part = ranks.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("rest", F.coalesce("before", F.lit(0))))).alias("before"), F.sum("whole").alias("whole"))
    # whole sequences are numbered part by part; parts are few (one a task), so this running sum is over a small table
    parts = written(per_part.withColumn("first", F.coalesce(F.sum("whole").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("whole"), "ranks")
    size_bound = parts.count() * size * 16
    joined = table.join(F.broadcast(parts) if size_bound <= OFFSETS_BROADCAST_BYTES else parts, "part")
    sent = spark.sparkContext.broadcast((plan, planned))

    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        plan, planned = sent.value
        free()  # the tokeniser's encoder: no task of this map needs it
        for batch in slices(batches, "ids", SLICE_BYTES, keep=True):
            out: list[list] = [[] for _ in range(8)]
            for doc, ids, n, rest, nth, width, base, first in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                tokens = np.frombuffer(ids, "<u2" if width == 2 else "<u4")
                pieces = [(k * size, size, planned + first + k, 0) for k in range(n // size)]
                if rest:
                    edges, cuts = plan[rest]
                    rank = base + nth
                    pieces += [(n - rest + s, m, seq + rank, off) for s, m, seq, off in cuts[bisect_right(edges, rank) - 1]]
                for s, m, seq, off in pieces:
                    b = tokens[s : s + m].astype("<u4").tobytes()
                    for column, v in zip(out, (doc, s, m, zlib.crc32(b), n, seq, off), strict=False):
                        column.append(v)
                    if with_ids:
                        out[7].append(b)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:7]), *([pa.array(out[7], pa.binary())] if with_ids else [])], [*names, *(["ids"] if with_ids else [])])

    rows = joined.select("id", "ids", "n", "rest", "nth", "width", F.coalesce(F.element_at("before", F.col("rest")), F.lit(0)).alias("base"), (F.col("first") + F.col("whole_nth")).alias("first"))
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in names) + (", ids binary" if with_ids else "")).withColumnRenamed("id", id_col)
