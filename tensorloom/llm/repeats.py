"""Passages of `words` words or more that documents share with documents of smaller id, exactly and without pairs.

1. Anchors. Each document gives hashes of short word runs at selected positions (the two selections are in
   substring_dedup.py and suffix_dedup.py); whatever the selection, two equal windows of `words` words contain an anchor
   at the same place in both. An anchor that is met once rules its windows out; others are candidates.
2. Extension. Around each candidate, every window of `words` words that contains it is hashed (128 bits; once, where
   candidates overlap), which extends the match to the left and to the right as far as it goes.
3. Windows with equal hashes meet; those whose least doc_id is smaller than their own are repeats.

Between these steps only integers move, packed by blobs.py and dealt out by hash. Records of one hash are reduced to one
before they leave a task (a hash met twice there is a candidate already; of equal windows only the least document's is
sent), so a passage that a third of all documents share costs each task one record. No group of documents is ever
brought together and no pair is written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import blobs
from .store import written
from .words import SEQ_BASE_2, Words, sequences, slices

WORDS = 50
#: Records that a task holds before it deals them out.
FLUSH = 1_000_000
#: Text that one group of documents holds, about.
GROUP_BYTES, LEAST_GROUPS = 12 << 20, 64
#: Largest table of repeats that is broadcast to the documents; beyond it both sides are shuffled by doc_id.
SPANS_BROADCAST_BYTES = 48 << 20
#: A document's place is its copy number (0 but for rows that repeat a doc_id with another text) << COPY_BITS | word.
COPY_BITS = 40


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """id, text, carried columns and copy: rows of one id with different texts get different copy numbers, equal texts the same."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *carry)
    keyed = rows.select("id", F.xxhash64("text").alias("key")).where("id is not null")
    many = keyed.groupBy("id").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b").select("id")
    again = keyed.distinct().join(many, "id").select("id", "key", (F.row_number().over(W.partitionBy("id").orderBy("key")) - 1).alias("copy"))
    if again.isEmpty():
        return rows.withColumn("copy", F.lit(0))
    return rows.withColumn("key", F.xxhash64("text")).join(again, ["id", "key"], "left").select("id", "text", *carry, F.coalesce("copy", F.lit(0)).alias("copy"))


def group_count(rows: DataFrame) -> int:
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(LEAST_GROUPS, -(-size // GROUP_BYTES))


def group_of(groups: int):
    """The group of a document's id; hashed_group() is the same for numpy."""
    return F.pmod(F.pmod(F.pmod(F.col("id"), F.lit(PRIME)) * FACTOR, F.lit(PRIME)), F.lit(groups)).cast("int")


def hashed_group(ids: np.ndarray, groups: int) -> np.ndarray:
    return ids % PRIME * FACTOR % PRIME % groups


#: Spread ids that have a step in common.
PRIME, FACTOR = 2_147_483_647, 1_103_515_245

Candidates = Callable[[DataFrame, int], DataFrame]


def candidate_rows(ids: np.ndarray, places: np.ndarray, groups: int, rights: np.ndarray | None = None) -> pa.RecordBatch:
    """Candidate places dealt out by document. rights: how many words from there on may be shared, where that is known."""
    used, cols = blobs.dealt(hashed_group(ids, groups), groups, [ids, places] if rights is None else [ids, places, rights])
    cols = cols if rights is not None else [*cols, [b""] * len(used)]
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *map(blobs.column, cols)], ["bucket", "ids", "places", "rights"])


CANDIDATES = "bucket int, ids binary, places binary, rights binary"


def windows_of(words: Words, ids: np.ndarray, copies: np.ndarray, cand_ids: np.ndarray, cand_places: np.ndarray, cand_rights: np.ndarray, reach: int, n: int) -> tuple[np.ndarray, ...]:
    """Starts (word index in the slice) of the windows that contain a candidate, and their documents' rows.

    cand_*: candidates of these documents sorted by id and place; a window may start up to `reach` words before one, and
    ends within the words that may be shared from there on.
    """
    first_at, last_at = [], []
    for row, (doc, copy) in enumerate(zip(ids.tolist(), copies.tolist(), strict=True)):
        a, b = np.searchsorted(cand_ids, [doc, doc + 1])
        if a == b:
            continue
        own = cand_places[a:b] >> COPY_BITS == copy
        places, rights = cand_places[a:b][own] & ((1 << COPY_BITS) - 1), cand_rights[a:b][own]
        least, most = words.at[row], words.at[row + 1] - n
        if len(places) and most >= least:
            first_at.append(np.clip(places - reach, 0, None) + least)
            last_at.append(np.minimum(places + least - np.maximum(n - rights, 0), most))
    if not first_at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = np.concatenate(first_at), np.concatenate(last_at)
    ok = last >= first
    marks = np.zeros(len(words.hash) + 2, np.int64)
    np.add.at(marks, first[ok], 1)
    np.add.at(marks, last[ok] + 1, -1)
    starts = np.flatnonzero(np.cumsum(marks) > 0)
    return starts, np.searchsorted(words.at, starts, side="right") - 1


def repeated_windows(rows: DataFrame, candidates: DataFrame, groups: int, reach: int, n: int, keyed: bool) -> DataFrame:
    """Repeated windows as blobs by document group: bucket, kind, ids, places, firsts, keys.

    firsts: a smaller doc_id with that window; the least one in rows of kind 0 (settled where all documents met). Rows of
    kind 1 were known in a task of their group; keyed: both have the window's hash, so that runs() can look up the least.
    """

    def extend(key, docs: pa.Table, cands: pa.Table) -> pa.Table:
        ids, places, rights = (blobs.joined(cands, c) for c in ("ids", "places", "rights"))
        rights = rights if len(rights) else np.full(len(ids), n)
        order = np.lexsort((places, ids))
        ids, places, rights = ids[order], places[order], rights[order]
        held: list[tuple] = []
        out: list[pa.RecordBatch] = []

        def flush() -> None:
            if not held:
                return
            h1, h2, doc, place = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((doc, h2, h1))
            h1, h2, doc, place = h1[order], h2[order], doc[order], place[order]
            new = np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
            least = doc[new][np.cumsum(new) - 1]
            known = doc > least
            used, cols = blobs.dealt(hashed_group(doc[known], groups), groups, [doc[known], place[known], least[known], h1[known]])
            out.append(pa.RecordBatch.from_arrays([pa.array([1] * len(used), pa.int32()), pa.array(used, pa.int32()), *map(blobs.column, cols if keyed else [*cols[:3], [b""] * len(used)])], ["kind", "bucket", "a", "b", "c", "d"]))
            own = ~known
            used, cols = blobs.dealt((h1[own] % np.uint64(groups)).astype(np.int64), groups, [h1[own], h2[own], doc[own], place[own]])
            out.append(pa.RecordBatch.from_arrays([pa.array([0] * len(used), pa.int32()), pa.array(used, pa.int32()), *map(blobs.column, cols)], ["kind", "bucket", "a", "b", "c", "d"]))

        total = 0
        for part in slices(docs.to_batches(), "text"):
            doc, copy = part.column("id").to_numpy(zero_copy_only=False), part.column("copy").to_numpy(zero_copy_only=False).astype(np.int64)
            keep = np.flatnonzero(np.isin(doc, ids))
            if not keep.size:
                continue
            part, doc, copy = part.take(pa.array(keep)), doc[keep], copy[keep]
            words = Words(part.column("text"))
            at, row = windows_of(words, doc, copy, ids, places, rights, reach, n)
            if at.size:
                h1, h2 = sequences(words.hash, n)[at], sequences(words.hash, n, SEQ_BASE_2)[at]
                held.append((h1, h2, doc[row], (copy[row] << COPY_BITS) + at - words.at[row]))
                total += len(at)
                if total >= FLUSH:
                    flush()
                    total = 0
        flush()
        schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), *((c, pa.binary()) for c in "abcd")])
        return pa.Table.from_batches(out, schema)

    names = ["bucket", "kind", "ids", "places", "firsts", "keys"]

    def settle(table: pa.Table) -> pa.Table:
        by_kind = table.column("kind").to_numpy()
        known, sent = table.filter(pa.array(by_kind == 1)), table.filter(pa.array(by_kind == 0))
        out = [known.select(["bucket", "kind", "a", "b", "c", "d"]).rename_columns(names)]
        h1, h2 = blobs.joined(sent, "a", np.uint64), blobs.joined(sent, "b", np.uint64)
        doc, place = blobs.joined(sent, "c"), blobs.joined(sent, "d")
        if len(h1):
            order = np.lexsort((doc, h2, h1))
            h1, h2, doc, place = h1[order], h2[order], doc[order], place[order]
            new = np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
            least = doc[new][np.cumsum(new) - 1]
            more = doc > least
            used, cols = blobs.dealt(hashed_group(doc[more], groups), groups, [doc[more], place[more], least[more], h1[more]])
            out.append(pa.Table.from_arrays([pa.array(used, pa.int32()), pa.array([0] * len(used), pa.int32()), *map(blobs.column, cols if keyed else [*cols[:3], [b""] * len(used)])], names))
        return pa.concat_tables(out)

    docs = rows.where("id is not null").withColumn("bucket", group_of(groups))
    found = docs.groupBy("bucket").cogroup(candidates.groupBy("bucket")).applyInArrow(extend, "kind int, bucket int, a binary, b binary, c binary, d binary")
    return found.groupBy("bucket").applyInArrow(settle, "bucket int, kind int, ids binary, places binary, firsts binary, keys binary")


def runs(windows: DataFrame, n: int, by_first: bool) -> DataFrame:
    """A row per document with repeats: id, copy int, spans binary: packed start, end (words), first doc_id, run by run.

    by_first: a run ends where the least document changes; else runs that touch are one, and its first is the least.
    """

    def gather(table: pa.Table) -> pa.Table:
        doc, place, first = blobs.joined(table, "ids"), blobs.joined(table, "places"), blobs.joined(table, "firsts")
        if by_first:  # windows known in a task have the least document of that task; where all met, a smaller one may be known
            keys = blobs.joined(table, "keys", np.uint64)
            settled = table.filter(pa.array(table.column("kind").to_numpy() == 0))
            names, where = np.unique(blobs.joined(settled, "keys", np.uint64), return_index=True)
            if len(names):
                least = blobs.joined(settled, "firsts")[where]
                at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
                first = np.where(names[at] == keys, least[at], first)
        order = np.lexsort((place, doc))
        doc, place, first = doc[order], place[order], first[order]
        new = np.ones(len(doc), bool)
        if len(doc):
            new[1:] = (doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + (1 if by_first else n)) | (by_first & (first[1:] != first[:-1]))
        begin = np.flatnonzero(new)
        end = np.concatenate((begin[1:], [len(doc)])) - 1 if len(begin) else begin
        who, copy = doc[begin], place[begin] >> COPY_BITS
        start, stop = place[begin] & ((1 << COPY_BITS) - 1), (place[end] & ((1 << COPY_BITS) - 1)) + n
        source = np.minimum.reduceat(first, begin) if len(begin) else first
        edge = np.flatnonzero(np.concatenate(([True], (who[1:] != who[:-1]) | (copy[1:] != copy[:-1])))) if len(who) else np.zeros(0, np.int64)
        ends = np.concatenate((edge[1:], [len(who)]))
        spans = [np.stack((start[a:b], stop[a:b], source[a:b]), 1).astype("<i8").tobytes() for a, b in zip(edge, ends, strict=False)] if len(who) else []
        return pa.Table.from_arrays([pa.array(who[edge]), pa.array(copy[edge].astype(np.int32)), blobs.column(spans)], ["id", "copy", "spans"])

    return windows.groupBy("bucket").applyInArrow(gather, "id long, copy int, spans binary")


def find_repeats(rows: DataFrame, candidates: Candidates, reach: int, n: int = WORDS, by_first: bool = False) -> DataFrame:
    """runs() of numbered() rows as a table in the shared folder. reach: words of a window that may precede its anchor."""
    groups = group_count(rows)
    return written(runs(repeated_windows(rows, candidates(rows, groups), groups, reach, n, by_first), n, by_first), "repeats")


def without_repeats(rows: DataFrame, spans: DataFrame, respaced: bool = True) -> DataFrame:
    """A row per row: id, n_words, n_removed long, kept string: the words outside spans joined by one space.

    respaced=False leaves texts without repeats (and null texts) as they are.
    """
    small = (spans.agg(F.sum(F.octet_length("spans") + 64)).first()[0] or 0) <= SPANS_BROADCAST_BYTES
    keyed = spans.withColumnRenamed("id", "sid").withColumnRenamed("copy", "scopy")
    both = rows.join(F.broadcast(keyed) if small else keyed, (F.col("id") == F.col("sid")) & (F.col("copy") == F.col("scopy")), "left")
    names = [c for c in rows.columns if c not in ("id", "text", "copy")]
    schema = pa.schema([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]):
        for part in slices(batches, "text"):
            n_words, n_removed, kept = [], [], []
            for text, span in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                found = (text or b"").split()
                n_words.append(len(found))
                if span:
                    gone = 0
                    for start, stop, _ in reversed(np.frombuffer(span, "<i8").reshape(-1, 3).tolist()):
                        gone += stop - start
                        del found[start:stop]
                    n_removed.append(gone)
                    kept.append(b" ".join(found))
                else:
                    n_removed.append(0)
                    kept.append(b" ".join(found) if respaced else text)
            yield pa.RecordBatch.from_arrays([part.column("id"), *(part.column(c) for c in names), pa.array(n_words), pa.array(n_removed), pa.array(kept, pa.binary()).cast(pa.string())], ["id", *names, *schema.names])

    own = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in names)
    return both.select("id", F.col("text").cast("binary").alias("text"), *names, "spans").mapInArrow(run, f"id long, {own}n_words long, n_removed long, kept string")
