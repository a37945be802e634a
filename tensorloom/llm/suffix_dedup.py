"""Repeated passages by sparse suffix arrays.

Of every 35 word grams in a row (a window of 50 words has 35 grams of 16 words) the one of least hash is retained: a
position that the content selects, so equal windows select it alike. The suffixes from retained positions are sorted by
their grams, one after another (grams are named by hashes, so suffixes with a common prefix are together, as in the order
of texts). Each is compared with its two neighbours: their longest common prefix, in grams, is the longest with any
suffix. One without a common gram is no match; another is extended to the left over all windows that contain it and to
the right as far as that prefix may go on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import CANDIDATES, COPY_BITS, WORDS, candidate_rows, find_repeats, numbered
from .words import Words, sequences, slices

GRAM = 16


def minimisers(h: np.ndarray, at: np.ndarray, gram: int, words: int) -> np.ndarray:
    """Positions of the least gram hash (the leftmost of equals) of each window of `words` words of each document."""
    span = words - gram + 1  # grams in a window
    g = sequences(h, gram)
    if len(g) < span:
        return np.zeros(0, np.int64)
    # the least of `span` neighbours from minima over blocks, forwards and backwards; ties: the smaller position
    n = len(g)
    rank = np.empty(n, np.int64)
    order = np.argsort(g, kind="stable")
    rank[order] = np.arange(n)
    pad = -n % span
    blocks = np.concatenate((rank, np.full(pad, n, np.int64))).reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: n - span + 1], ahead[span - 1 : n])
    counts = np.maximum(np.diff(at) - words + 1, 0)
    from .words import ranges

    return np.unique(order[least[ranges(at[:-1], counts)]])


#: Grams by which suffixes are sorted: all that a window may hold from its retained position on.
GRAMS = 3


def common_grams(k1: np.ndarray, k2: np.ndarray, k3: np.ndarray) -> np.ndarray:
    """How many grams each suffix but the first has in common with the one before; 0 stands for a gram beyond the text."""
    same = [k[1:] == k[:-1] for k in (k1, k2, k3)]
    second = same[0] & same[1] & (k2[1:] != 0)
    return same[0].astype(np.int64) + second + (second & same[2] & (k3[1:] != 0))


def words_shared(grams: np.ndarray, gram: int) -> np.ndarray:
    """The most words that suffixes with so many common grams share; beyond GRAMS there is no bound."""
    return np.where(grams < GRAMS, (grams + 1) * gram - 1, np.int64(1) << 30)


def suffix_candidates(words: int = WORDS, gram: int = GRAM):
    def candidates(rows: DataFrame, groups: int) -> DataFrame:
        def suffixes(batches):
            for part in slices(batches, "text"):
                found = Words(part.column("text"))
                pick = minimisers(found.hash, found.at, gram, words)
                if not pick.size:
                    continue
                row = np.searchsorted(found.at, pick, side="right") - 1
                g = sequences(found.hash, gram).view(np.int64)
                keys = []
                for k in range(GRAMS):
                    at = pick + k * gram
                    inside = at + gram <= found.at[row + 1]
                    keys.append(pa.array(np.where(inside, g[np.minimum(at, len(g) - 1)], 0)))
                doc, copy = part.column("id").to_numpy(zero_copy_only=False), part.column("copy").to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*keys, pa.array(doc[row]), pa.array((copy[row] << COPY_BITS) + pick - found.at[row])], ["k1", "k2", "k3", "id", "place"])

        def neighbours(batches):
            held, before = None, None  # the last suffix, whose next neighbour is not here yet; what it shares with the one before
            for batch in batches:
                if not batch.num_rows:
                    continue
                cols = [batch.column(c).to_numpy() for c in ("k1", "k2", "k3", "id", "place")]
                if held is not None:
                    cols = [np.concatenate((h, c)) for h, c in zip(held, cols, strict=True)]
                shared = common_grams(*cols[:3])
                # the first suffix of a partition may have a neighbour in the one before
                ahead = np.concatenate(([GRAMS if before is None else before], shared))
                most = np.maximum(ahead, np.append(shared, 0))[:-1]
                match = np.flatnonzero(most > 0)
                yield candidate_rows(cols[3][match], cols[4][match], groups, words_shared(most[match], gram))
                held, before = [c[-1:] for c in cols], int(ahead[-1])
            if held is not None:  # and so may the last in the next
                yield candidate_rows(held[3], held[4], groups, words_shared(np.array([GRAMS]), gram))

        made = rows.where("id is not null").mapInArrow(suffixes, "k1 long, k2 long, k3 long, id long, place long")
        order = ["k1", "k2", "k3", "id", "place"]
        return made.repartitionByRange(groups, *order).sortWithinPartitions(*order).mapInArrow(neighbours, CANDIDATES)

    return candidates, words - gram


def repeated_passages(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per repeated passage: id, first_id (least id of the documents that have it, smaller than id), start, end long (words, end exclusive).

    A passage is a run of windows of `words` words with the same first_id, each of which occurs in that document. Null
    and short texts have none; rows of null id take no part; rows that repeat an id are not compared with each other.
    """
    rows = numbered(docs, id_col, text_col)
    candidates, reach = suffix_candidates(words)
    spans = find_repeats(rows, candidates, reach, words, by_first=True)

    def unroll(batches):
        for batch in batches:
            found = [np.frombuffer(s, "<i8").reshape(-1, 3) for s in batch.column("spans").to_pylist()]
            all_spans = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
            ids = np.repeat(batch.column("id").to_numpy(), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(np.ascontiguousarray(all_spans[:, k])) for k in (2, 0, 1))], ["id", "first_id", "start", "end"])

    return spans.mapInArrow(unroll, "id long, first_id long, start long, end long").distinct().withColumnsRenamed({"id": id_col, "first_id": f"first_{id_col}"})


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "first_doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"))
