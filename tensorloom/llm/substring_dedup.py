"""Repeated passages by difference-cover anchors.

COVER is a difference cover modulo PERIOD: every difference of two places modulo PERIOD is a difference of two members.
So for equal windows at places i and j there is a shift d < PERIOD with i + d and j + d both in the cover, and windows of
50 words leave room for an anchor of 50 - PERIOD + 1 words there. Only 6 of 31 places are hashed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs
from .repeats import CANDIDATES, COPY_BITS, FLUSH, WORDS, candidate_rows, find_repeats, numbered, without_repeats
from .words import Words, sequences, slices, starts

PERIOD = 31
#: A perfect difference set modulo 31 (each non-zero difference occurs once).
COVER = (1, 5, 11, 24, 25, 27)


def cover_candidates(words: int = WORDS):
    """Places whose anchor occurs elsewhere; a few more, as anchors meet by 32 bits and a bucket, are harmless."""
    length = words - PERIOD + 1
    in_cover = np.isin(np.arange(PERIOD), COVER)

    def candidates(rows: DataFrame, groups: int) -> DataFrame:
        def anchors(batches):
            held: list[tuple] = []
            total = 0

            def flush():
                h, doc, place = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.argsort(h)
                h, doc, place = h[order], doc[order], place[order]
                new = np.concatenate(([True], h[1:] != h[:-1]))
                many = ~(new & np.concatenate((new[1:], [True])))  # met twice in this task
                cand = candidate_rows(doc[many], place[many], groups)
                k = cand.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([1] * k, pa.int32()), cand.column(0), pa.nulls(k, pa.binary()), cand.column(1), cand.column(2)], ["kind", "bucket", "prints", "ids", "places"])
                used, cols = blobs.dealt(((h[new] >> np.uint64(32)) % np.uint64(groups)).astype(np.int64), groups, [h[new] & np.uint64(0xFFFFFFFF), doc[new], place[new]])
                yield pa.RecordBatch.from_arrays([pa.array([0] * len(used), pa.int32()), pa.array(used, pa.int32()), *map(blobs.column, cols)], ["kind", "bucket", "prints", "ids", "places"])

            for part in slices(batches, "text"):
                found = Words(part.column("text"))
                counts = found.counts
                at = starts(found.at, length)
                row = np.searchsorted(found.at, at, side="right") - 1
                place = at - found.at[row]
                take = in_cover[place % PERIOD] & (counts[row] >= words)
                at, row, place = at[take], row[take], place[take]
                if at.size:
                    doc, copy = part.column("id").to_numpy(zero_copy_only=False), part.column("copy").to_numpy(zero_copy_only=False).astype(np.int64)
                    held.append((sequences(found.hash, length)[at], doc[row], (copy[row] << COPY_BITS) + place))
                    total += len(at)
                if total >= FLUSH:
                    yield from flush()
                    held.clear()
                    total = 0
            if held:
                yield from flush()

        def meet(table: pa.Table) -> pa.Table:
            kind = table.column("kind").to_numpy()
            known, sent = table.filter(pa.array(kind == 1)).select(["bucket", "ids", "places"]), table.filter(pa.array(kind == 0))
            known = known.append_column("rights", pa.nulls(known.num_rows, pa.binary()))
            prints, doc, place = blobs.joined(sent, "prints", np.uint64), blobs.joined(sent, "ids"), blobs.joined(sent, "places")
            if not len(prints):
                return known
            order = np.argsort(prints)
            prints, doc, place = prints[order], doc[order], place[order]
            new = np.concatenate(([True], prints[1:] != prints[:-1], [True]))
            many = ~(new[:-1] & new[1:])
            return pa.concat_tables([known, pa.Table.from_batches([candidate_rows(doc[many], place[many], groups)])])

        made = rows.where("id is not null").mapInArrow(anchors, "kind int, bucket int, prints binary, ids binary, places binary")
        return made.groupBy("bucket").applyInArrow(meet, CANDIDATES)

    return candidates, words - length


def substring_dedup(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: its id, n_words, n_removed long, kept string.

    A word goes when a window of `words` words that covers it occurs in a document of smaller id. Null texts have no
    words; rows of null id lose nothing and are no reason to remove; rows that repeat an id are judged each for itself
    and never against each other. Words are kept as they are and joined by one space. Other columns are not read.
    """
    if words <= PERIOD:
        raise ValueError(f"a window needs more than {PERIOD} words")
    rows = numbered(docs, id_col, text_col)
    candidates, reach = cover_candidates(words)
    return without_repeats(rows, find_repeats(rows, candidates, reach, words)).withColumnRenamed("id", id_col)


def digests(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
