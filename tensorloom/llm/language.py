"""Language by prediction by partial matching: a variable-order byte context tree for each language.

A text is its UTF-8 bytes, A-Z in lower case, white space among them; the context of a byte is the ORDER bytes before it,
over word edges, fewer at the text's start. A byte not seen in a context escapes to the next shorter one with probability
distinct / (total + distinct) (method C), bytes already excluded, down to equal chances of the bytes left. Statistics are
frozen after training, so a byte in its context has a fixed code length in each language, and a text's is the sum over all
its bytes. Lengths are integers of 2**-FINE bits: sums are exact, whatever the slices. The least one names the language.

A context's bytes are among those of its suffix, so what an escape excludes is what the longer context has seen: its count
and number are kept with the context, and lengths of many bytes are found together by binary search.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import _LOWER, raw, slices
from .worker import held

ORDER, FINE = 4, 24
#: The training sample: about so many rows a language, of each text a span of so many characters, so many languages.
SAMPLE_ROWS, SAMPLE_CHARS, LANGUAGES = 400, 20_000, 500
#: Bytes of a worker's table of code lengths, and of those of a block of text.
TABLE_BYTES, BLOCK_BYTES = 32 << 20, 8 << 20
_DEPTH = np.uint64(8 * (ORDER + 1))


def _low(order: int) -> np.uint64:
    """A mask of so many bytes."""
    return np.uint64((1 << 8 * order) - 1)


def grams(data: np.ndarray, at: np.ndarray, block: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place of the first, a key a byte) of blocks of the texts: how many bytes of context there are, they, and the byte."""
    for a in range(0, len(data), block):
        b = min(a + block, len(data))
        text = np.zeros(ORDER + b - a, np.uint64)
        before = min(a, ORDER)
        text[ORDER - before :] = _LOWER[data[a - before : b]]
        keys = text[ORDER:].copy()
        for k in range(1, ORDER + 1):
            keys |= text[ORDER - k : len(text) - k] << np.uint64(8 * k)
        depth = np.full(b - a, ORDER, np.uint64)
        starts = at[np.searchsorted(at, a - ORDER) : np.searchsorted(at, b)]
        for j in range(ORDER - 1, -1, -1):  # the nearest start counts
            near = starts + (j - a)
            near = near[(near >= 0) & (near < b - a)]
            depth[near] = j
            keys[near] &= _low(j + 1)
        yield a, keys | depth << _DEPTH


class Order(NamedTuple):
    """Contexts of one length, sorted: counts and numbers of the bytes after them, and of those after their suffix but not after them; grams with counts."""

    contexts: np.ndarray
    total: np.ndarray
    distinct: np.ndarray
    left_total: np.ndarray
    left_distinct: np.ndarray
    grams: np.ndarray
    counts: np.ndarray


def _tree(keys: np.ndarray, counts: np.ndarray) -> list[Order]:
    """The orders from 0 on, of different keys with their counts."""
    tree: list[Order] = []
    for k in range(ORDER + 1):
        deep = keys >> _DEPTH >= k
        own, of = np.unique(keys[deep] & _low(k + 1), return_inverse=True)
        count = np.bincount(of, counts[deep], len(own))
        contexts, of = np.unique(own >> np.uint64(8), return_inverse=True)
        total, distinct = np.bincount(of, count, len(contexts)), np.bincount(of, minlength=len(contexts)).astype(float)
        left = [np.zeros(len(contexts))] * 2
        if k:
            up = tree[-1]
            suffix = np.searchsorted(up.contexts, contexts & _low(k - 1))
            seen = np.bincount(of, up.counts[np.searchsorted(up.grams, own & _low(k))], len(contexts))
            left = [up.total[suffix] - seen, up.distinct[suffix] - distinct]
        tree.append(Order(contexts, total, distinct, *left, own, count))
    return tree


def train(texts: dict[str, list[str]]) -> dict[str, list[Order]]:
    """The context tree of each language's texts."""
    model = {}
    for lang, rows in texts.items():
        keys, counts = np.zeros(0, np.uint64), np.zeros(0)
        for _, more in grams(*raw(pa.array(rows, pa.large_string())), 1 << 22):
            keys, of = np.unique(np.concatenate((keys, more)), return_inverse=True)
            counts = np.bincount(of, np.concatenate((counts, np.ones(len(more)))), len(keys))
        model[lang] = _tree(keys, counts)
    return model


def _find(among: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted array, and whether each is there."""
    if not len(among):
        return np.zeros(len(what), np.int64), np.zeros(len(what), bool)
    at = np.minimum(np.searchsorted(among, what), len(among) - 1)
    return at, among[at] == what


def code_lengths(tree: list[Order], keys: np.ndarray) -> np.ndarray:
    """Bits of each byte after its context."""
    bits = np.zeros(len(keys))
    open_, above = np.arange(len(keys)), np.full(len(keys), -1)  # bytes not yet coded; their context one longer, if it was met
    for k in range(ORDER, -1, -1):
        have = keys[open_] >> _DEPTH >= k
        gram = keys[open_] & _low(k + 1)
        node, known = _find(tree[k].contexts, gram >> np.uint64(8))
        known &= have
        total, distinct = tree[k].total[node], tree[k].distinct[node]
        if (fell := above >= 0).any():
            total[fell], distinct[fell] = tree[k + 1].left_total[above[fell]], tree[k + 1].left_distinct[above[fell]]
        at, found = _find(tree[k].grams, gram)
        found &= known
        out = known & ~found & (distinct > 0)
        bits[open_[found]] -= np.log2(tree[k].counts[at[found]] / (total + distinct)[found])
        bits[open_[out]] -= np.log2(distinct[out] / (total + distinct)[out])
        open_, above = open_[~found], np.where(known, node, -1)[~found]
    seen = int(tree[0].distinct.sum())
    bits[open_] += math.log2(max(1, 256 - seen))
    return bits


class Coder:
    """Code lengths of texts in each language; those of keys met lately are kept in a table of a fixed size, a place a key."""

    def __init__(self, model: dict[str, list[Order]], table_bytes: int = TABLE_BYTES, block_bytes: int = BLOCK_BYTES):
        self.langs = sorted(model)
        self.trees = [model[x] for x in self.langs]
        wide = 8 * max(1, len(self.langs))
        self.shift = np.uint64(64 - max(1, int(math.log2(max(2, table_bytes // wide)))))
        places = 1 << 64 - int(self.shift)
        self.keys = np.full(places, (1 << 64) - 1, np.uint64)
        self.bits = np.zeros((places, len(self.langs)), np.int64)
        self.block = max(16, block_bytes // wide)

    def _lengths(self, keys: np.ndarray) -> np.ndarray:
        place = keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift
        bits = self.bits[place]
        if (miss := np.flatnonzero(self.keys[place] != keys)).size:
            new, of = np.unique(keys[miss], return_inverse=True)
            own = np.stack([np.rint(np.ldexp(code_lengths(t, new), FINE)).astype(np.int64) for t in self.trees], axis=1)
            bits[miss] = own[of]
            place = new * np.uint64(0x9E3779B97F4A7C15) >> self.shift
            _, last = np.unique(place[::-1], return_index=True)  # one key a place
            last = len(place) - 1 - last
            self.keys[place[last]], self.bits[place[last]] = new[last], own[last]
        return bits

    def texts(self, column: pa.Array) -> np.ndarray:
        """Code lengths of each text in each language, in 2**-FINE bits."""
        data, at = raw(column)
        total = np.zeros((len(at) - 1, len(self.langs)), np.int64)
        for a, keys in grams(data, at, self.block):
            sums = np.zeros((len(keys) + 1, len(self.langs)), np.int64)
            np.cumsum(self._lengths(keys), axis=0, out=sums[1:])
            first, end = np.searchsorted(at, a, side="right") - 1, np.searchsorted(at, a + len(keys))  # rows with bytes here
            inside = np.clip(at[first : end + 1] - a, 0, len(keys))
            total[first:end] += sums[inside[1:]] - sums[inside[:-1]]
        return total


def has_letter(text: str | None) -> bool:
    return bool(text) and (any(map(str.isalpha, text[:64])) or any(map(str.isalpha, text)))


def sample(labelled: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id") -> dict[str, list[str]]:
    """About `rows` texts of each lang value, chosen by a hash of the id; at most twice as many of each come to the driver.

    Of a text longer than SAMPLE_CHARS characters, a span of that length from a place by a hash of the id, so texts of any
    length are learned from. A language none of whose rows has a hash low enough gives the rows of the lowest.
    """
    usable = labelled.where("lang is not null and text is not null and length(text) > 0")
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().orderBy("lang").limit(LANGUAGES + 1).collect()}
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not counts:
        return {}
    grain = 1 << 30
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(grain, math.ceil(grain * rows / n)))])
    chance = F.pmod(F.xxhash64(F.lit(17), F.col(id_col)), F.lit(grain))
    start = F.pmod(F.xxhash64(F.lit(18), F.col(id_col)), F.greatest(F.length("text") - SAMPLE_CHARS + 1, F.lit(1))) + 1
    span = F.col("text").substr(start.cast("int"), F.lit(SAMPLE_CHARS)).alias("text")
    out: dict[str, list[str]] = {}
    for r in usable.where(chance < share[F.col("lang")]).select("lang", span).limit(2 * rows * len(counts)).collect():
        out.setdefault(r["lang"], []).append(r["text"])
    if missed := sorted(set(counts) - set(out)):
        for r in usable.where(F.col("lang").isin(missed)).select("lang", span, chance.alias("chance")).groupBy("lang").agg(F.min_by("text", "chance").alias("text")).collect():
            out[r["lang"]] = [r["text"]]
    return out


def predict(docs: DataFrame, model: dict[str, list[Order]], id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """A row per row of docs: its id, the columns in `carry`, lang_pred string, score double (the chance of that language among all, all alike before).

    Null texts, texts without a letter and an empty model give 'und' and 0. Equal code lengths go to the first language
    by name. Repeated rows and null ids are kept; columns that are not carried are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its size has the bound of the training sample
    name = uuid.uuid4().hex

    def run(batches):
        coder = held(("language", name), lambda: Coder(sent.value))
        for part in slices(batches, "text", keep=True):
            texts = part.column(1)
            data, at = raw(texts)
            low = _LOWER[data]
            ascii_letter = np.concatenate(([0], np.cumsum((low >= 97) & (low <= 122))))
            letters = ascii_letter[at[1:]] > ascii_letter[at[:-1]]
            for i in np.flatnonzero(~letters):
                letters[i] = has_letter(texts[i].as_py())
            if coder.langs:
                bits = np.ldexp(coder.texts(texts).astype(np.float64), -FINE)
                best = bits.argmin(axis=1)
                score = 1 / np.exp2(bits.min(axis=1, keepdims=True) - bits).sum(axis=1)
                lang = np.array(coder.langs, object)[best]
            else:
                lang, score, letters = np.full(len(texts), "und", object), np.zeros(len(texts)), np.zeros(len(texts), bool)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.where(letters, lang, "und"), pa.string()), pa.array(np.where(letters, score, 0.0)), *part.columns[2:]], ["id", "lang_pred", "score", *part.schema.names[2:]])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"carried_{c}") for c in carry))
    own = "".join(f", `carried_{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    out = rows.mapInArrow(run, f"id long, lang_pred string, score double{own}")
    return out.select(F.col("id").alias(id_col), *(F.col(f"carried_{c}").alias(c) for c in carry), "lang_pred", "score")


def identify(docs: DataFrame, fold: int = 4, held: int = 2) -> DataFrame:
    """predict() for all docs after training on rows whose crc32(doc_id as text) mod `fold` is not `held`; held_out is true for the others."""
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(fold))
    model = train(sample(docs.where(remainder != held)))
    return predict(docs, model).select("doc_id", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(fold)) == held, F.lit(False)).alias("held_out"), "lang_pred", "score")
