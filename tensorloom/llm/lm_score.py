"""Language-model scores from a log-frequency Bloom filter.

Counting. Each task counts words and word pairs of its training texts and deals the sums out by hash; a bucket adds them
up. A count c becomes the level 1 + floor(log(c) / log(BASE)), and the bucket's segment of the filter takes one entry
for each level up to it; a reader probes level 1, 2, ... until one is missing and takes the mean count of the last one
found. Segments are sized for RATE false positives a probe.

Scoring. Texts are read once, whatever the size of the model. Up to BROADCAST_BYTES the filter and the exact word counts
are broadcast. A larger model stays where it was built, as no worker could hold it: texts are dealt out in slices, each
slice sends its distinct words and pairs once to their buckets, the buckets probe their segments and send levels (and
the words' exact counts) back. Both ways make the same probes, so the scores are the same.

Model: p(w | v) = m * min(1, c(vw) / c(v)) + (1 - m) * p1(w) with m = MIX where v was seen, else 0;
p1(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1)). All three counts come from the filter. The word before the first is the end.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs
from .store import written
from .words import SEQ_BASE, Words, mix, slices
from .worker import held

BASE, MIX, RATE = 1.5, 0.5, 1 / 64
#: No 64-bit count has a higher level.
LEVELS = 2 + int(math.log(2**63) / math.log(BASE))
PROBES = round(math.log2(1 / RATE))
BITS = math.log(1 / RATE) / math.log(2) ** 2
BROADCAST_BYTES = 10 << 20
#: Text of a slice, about; of a task's share of slices.
SLICE_TEXT, TASK_TEXT = 8 << 20, 32 << 20
#: Tokens that a task counts together; text that a bucket stands for, about.
FLUSH, BUCKET_BYTES, LEAST_BUCKETS = 1_000_000, 8 << 20, 64
#: The hash of the end of a text, a token like any word.
END = np.uint64(0x5DEECE66D1CE4E5B)
_STEP, _PAIR, _ALL = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25), (1 << 64) - 1


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words and an end of each text, of the token before each, and n+1 offsets of texts."""
    words = Words(column, lower=True)
    hashes = np.insert(words.hash, words.at[1:], END)
    at = words.at + np.arange(len(words.at))
    before = np.concatenate(([END], hashes[:-1]))
    return hashes, before, at


def pair_keys(before: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(SEQ_BASE) ^ (hashes + _PAIR))


def in_bucket(pairs: np.ndarray) -> np.ndarray:
    """What tells the pairs of a bucket apart: 32 bits, whose collisions are far rarer than the filter's own errors. Ascending for ascending pairs."""
    return pairs >> np.uint64(32)


def level(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(BASE) + 1e-12).astype(np.int64)


def _mean_counts() -> np.ndarray:
    """The mean of the counts of each level; 0 for level 0."""
    levels = np.arange(1, LEVELS + 1)
    low, high = np.ceil(BASE ** (levels - 1) - 1e-9), np.ceil(BASE**levels - 1e-9) - 1
    return np.concatenate(([0.0], np.maximum((low + np.maximum(high, low)) / 2, 1.0)))


MEAN_COUNTS = _mean_counts()


def _places(keys: np.ndarray, lev: int, size: int) -> list[np.ndarray]:
    """PROBES bit numbers below size (under 2**32) for each key at a level."""
    h = mix(keys + np.uint64(lev * int(_STEP) & _ALL))
    a, b, size = h >> np.uint64(32), (h & np.uint64(0xFFFFFFFF)) | np.uint64(1), np.uint64(size)
    return [(((a + np.uint64(i) * b) & np.uint64(0xFFFFFFFF)) * size) >> np.uint64(32) for i in range(PROBES)]


def fill(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The segment (bytes) that holds the levels of the counts, as large as RATE asks for."""
    levels = level(counts)
    size = max(64, math.ceil(BITS * int(levels.sum()))) + 7 & ~7
    if size >= 1 << 32:
        raise ValueError("a bucket's segment has at most 2**32 bits: make more buckets")
    bits = np.zeros(size, bool)
    for k in range(1, int(levels.max(initial=0)) + 1):
        for place in _places(keys[levels >= k], k, size):
            bits[place] = True
    return np.packbits(bits, bitorder="little")


def levels_of(keys: np.ndarray, bits: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The level of each key in its segment (which begins at byte `first` and has `size` bits)."""
    out = np.zeros(len(keys), np.int64)
    left, k = np.flatnonzero(size > 0), 1
    while left.size and k <= LEVELS:
        at, bits_in = first[left], size[left].astype(np.uint64)
        h = mix(keys[left] + np.uint64(k * int(_STEP) & _ALL))
        a, b = h >> np.uint64(32), (h & np.uint64(0xFFFFFFFF)) | np.uint64(1)
        keep = None
        for i in range(PROBES):
            place = (((a + np.uint64(i) * b) & np.uint64(0xFFFFFFFF)) * bits_in) >> np.uint64(32)
            found = (bits[at + (place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
            keep = found if keep is None else keep & found
            if i in (0, 1, PROBES - 1):  # most that are missing leave at the first bits
                left, at, bits_in, a, b, keep = left[keep], at[keep], bits_in[keep], a[keep], b[keep], None
        out[left] = k
        k += 1
    return out


class Known:
    """Levels of words already met in a worker, at most MOST of them."""

    MOST, STEP = 400_000, 20_000

    def __init__(self):
        self.words, self.found = np.zeros(0, np.uint64), np.zeros(0, np.int8)
        self.later: list[tuple[np.ndarray, np.ndarray]] = []

    def levels(self, words: np.ndarray, find) -> np.ndarray:
        """Of sorted words; those not met before by find()."""
        at = np.minimum(np.searchsorted(self.words, words), max(len(self.words) - 1, 0))
        have = self.words[at] == words if len(self.words) else np.zeros(len(words), bool)
        out = np.zeros(len(words), np.int64)
        out[have] = self.found[at[have]]
        new = words[~have]
        out[~have] = found = find(new)
        if len(self.words) < self.MOST:
            self.later.append((new, found.astype(np.int8)))
            if sum(len(w) for w, _ in self.later) >= self.STEP:
                known, first = np.unique(np.concatenate([self.words, *(w for w, _ in self.later)]), return_index=True)
                self.words, self.found, self.later = known, np.concatenate([self.found, *(f for _, f in self.later)])[first], []
        return out


class Model:
    """A table in the shared folder, a row per bucket: n, words, counts (exact), word_bits, pair_bits; and its totals."""

    def __init__(self, table: DataFrame, buckets: int):
        self.table, self.buckets = table, buckets
        r = table.agg(F.sum("n"), F.sum("distinct"), F.sum(F.octet_length("pair_bits") + F.octet_length("word_bits") + 12 * F.col("distinct"))).first()
        self.tokens, self.distinct, self.size = (int(x or 0) for x in r)


def fit(rows: DataFrame, text_col: str = "text") -> Model:
    """Counts of words and word pairs of all rows' texts (null: empty), as a filter."""
    rows = rows.select(F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-total // BUCKET_BYTES))

    def count(batches):
        held: list[tuple] = []
        n = 0

        def flush():
            words, before = (np.concatenate(x) for x in zip(*held, strict=True))
            for kind, keys in ((0, words), (1, pair_keys(before, words))):
                keys, counts = np.unique(keys, return_counts=True)
                bucket = (keys % np.uint64(buckets)).astype(np.int64)
                used, (k, c) = blobs.dealt(bucket, buckets, [in_bucket(keys) if kind else keys, counts], [blobs.pack_sorted, blobs.pack])
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([kind] * len(used), pa.int32()), blobs.column(k), blobs.column(c)], ["bucket", "kind", "keys", "counts"])

        for part in slices(batches, "text"):
            words, before, _ = tokens(part.column(0))
            held.append((words, before))
            n += len(words)
            if n >= FLUSH:
                yield from flush()
                held.clear()
                n = 0
        if held:
            yield from flush()

    def add_up(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()
        sums = []
        for kind in (0, 1):
            own = table.filter(pa.array(kinds == kind))
            keys, of = np.unique(blobs.joined(own, "keys", np.uint64, ascending=True), return_inverse=True)
            counts = np.zeros(len(keys), np.int64)
            np.add.at(counts, of, blobs.joined(own, "counts"))
            sums.append((keys, counts))
        (words, counts), (pairs, pair_counts) = sums
        row = [key[0].as_py(), int(counts.sum()), len(words), words.tobytes(), blobs.pack(counts), fill(words, counts).tobytes(), fill(pairs, pair_counts).tobytes()]
        return pa.Table.from_pylist([dict(zip(schema.names, row, strict=True))], schema)

    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64()), ("distinct", pa.int64()), ("words", pa.binary()), ("counts", pa.binary()), ("word_bits", pa.binary()), ("pair_bits", pa.binary())])
    made = rows.mapInArrow(count, "bucket int, kind int, keys binary, counts binary").groupBy("bucket").applyInArrow(add_up, "bucket int, n long, distinct long, words binary, counts binary, word_bits binary, pair_bits binary")
    return Model(written(made, "counts"), buckets)


def _segments(parts: list[tuple[int, bytes]], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All segments' bytes, and each bucket's first byte and number of bits (0: not here)."""
    first, size, at = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64), 0
    for bucket, b in parts:
        first[bucket], size[bucket] = at, 8 * len(b)
        at += len(b)
    return np.frombuffer(b"".join(b for _, b in parts), np.uint8), first, size


SUMS = ("n_tokens", "n_known", "base_score", "score")
_NUMBERS = "n_tokens long, n_known long, base_score double, score double"


class Tokens:
    """Tokens of a slice of texts: their distinct words and pairs, ascending, and which each token has; at: the n+1 offsets of the texts."""

    def __init__(self, columns: list[pa.Array]):
        parts = [tokens(c) for c in columns]
        hashes, before = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        lengths = np.concatenate([np.diff(p[2]) for p in parts])
        self.at = np.concatenate(([0], np.cumsum(lengths)))
        self.words, self.of = np.unique(hashes, return_inverse=True)
        self.pairs, self.one, self.of_pair = np.unique(pair_keys(before, hashes), return_index=True, return_inverse=True)

    def sums(self, counts: np.ndarray, levels: np.ndarray, pair_levels: np.ndarray, n: int, v: int) -> list[pa.Array]:
        """SUMS of each text, from the words' exact counts and levels and the pairs' levels."""
        below, seen, of = n + 0.5 * (v + 1), MEAN_COUNTS[levels], self.of
        p1 = (seen + 0.5) / below
        history = seen[of[self.one - 1]]  # the token before; before the first comes an end, which is also the last
        own = p1[of[self.one]]
        mixed = np.where(history > 0, MIX * np.minimum(1.0, MEAN_COUNTS[pair_levels] / np.maximum(history, 1e-300)) + (1 - MIX) * own, own)
        add = lambda x: np.add.reduceat(x, self.at[:-1])  # every text has its end
        return [pa.array(np.diff(self.at)), pa.array(add((counts > 0).astype(np.int64)[of])), pa.array(add(np.log10((counts + 0.5) / below)[of])), pa.array(add(np.log10(mixed)[self.of_pair]))]


def _probe(keys: np.ndarray, names: np.ndarray, buckets: int, segments: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Levels of keys, which have other names in their segments."""
    bits, first, size = segments
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    return levels_of(names, bits, first[bucket], size[bucket])


def _by_broadcast(rows: DataFrame, model: Model) -> DataFrame:
    buckets, n, v = model.buckets, model.tokens, model.distinct
    own = model.table.select("bucket", "words", "counts", "word_bits", "pair_bits").collect()  # BROADCAST_BYTES at most
    words = np.concatenate([np.frombuffer(r["words"], np.uint64) for r in own] or [np.zeros(0, np.uint64)])
    counts = np.concatenate([blobs.unpack(r["counts"]) for r in own] or [np.zeros(0, np.int64)])
    order = np.argsort(words)
    sent = rows.sparkSession.sparkContext.broadcast((words[order], counts[order], *(_segments([(r["bucket"], r[c]) for r in own], buckets) for c in ("word_bits", "pair_bits"))))
    name = uuid.uuid4().hex

    def run(batches):
        words, counts, word_filter, pair_filter = sent.value
        known_words = held(("words", name), Known)
        for part in slices(batches, "text", keep=True):
            t = Tokens([part.column(1)])
            count = np.zeros(len(t.words), np.int64)
            if len(words):
                i = np.minimum(np.searchsorted(words, t.words), len(words) - 1)
                count = np.where(words[i] == t.words, counts[i], 0)
            levels = known_words.levels(t.words, lambda new: _probe(new, new, buckets, word_filter))
            yield pa.RecordBatch.from_arrays([part.column(0), *t.sums(count, levels, _probe(t.pairs, in_bucket(t.pairs), buckets, pair_filter), n, v)], ["id", *SUMS])

    return rows.mapInArrow(run, f"id long, {_NUMBERS}")


def _by_buckets(rows: DataFrame, model: Model) -> DataFrame:
    buckets, n, v = model.buckets, model.tokens, model.distinct
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = rows.withColumn("slice", F.expr(f"cast(pmod(xxhash64(id, text), {max(1, -(-total // SLICE_TEXT))}) as int)"))
    dealt = dealt.repartition(max(1, -(-total // TASK_TEXT)), "slice")  # one shuffle of texts, read by both sides below

    def in_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bucket = (keys % np.uint64(buckets)).astype(np.int64)
        return bucket, np.argsort(bucket, kind="stable")

    def texts(table: pa.Table) -> Tokens:
        return Tokens([b.column(b.schema.get_field_index("text")) for b in slices(iter(table.to_batches()), "text", keep=True)])

    def send(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        t, out = texts(table), {}
        for name, keys in (("words", t.words), ("pairs", t.pairs)):
            used, (packed,) = blobs.dealt(in_order(keys)[0], buckets, [in_bucket(keys) if name == "pairs" else keys], [blobs.pack_sorted])
            for bucket, b in zip(used, packed, strict=True):
                out.setdefault(bucket, {"slice": key[0].as_py(), "bucket": bucket})[name] = b
        return pa.Table.from_pylist(list(out.values()), sent_schema)

    def probe(key: tuple[pa.Scalar, ...], asked: pa.Table, segment: pa.Table) -> pa.Table:
        own = segment.to_pylist()
        out = {"slice": asked.column("slice"), "bucket": asked.column("bucket")}
        for name in ("words", "pairs"):
            parts = [blobs.unpack_sorted(b or b"") for b in asked.column(name).to_pylist()]
            keys, of = np.unique(np.concatenate(parts or [np.zeros(0, np.uint64)]), return_inverse=True)
            at = np.cumsum([0, *map(len, parts)])
            bits = np.frombuffer(own[0]["word_bits" if name == "words" else "pair_bits"], np.uint8) if own else np.zeros(0, np.uint8)
            one = np.zeros(len(keys), np.int64)
            levels = levels_of(keys, bits, one, one + 8 * len(bits))[of]
            found = {"levels" if name == "words" else "pair_levels": levels}
            if name == "words":
                exact = np.zeros(len(keys), np.int64)
                if own:
                    known, counts = np.frombuffer(own[0]["words"], np.uint64), blobs.unpack(own[0]["counts"])
                    i = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
                    exact = np.where(known[i] == keys, counts[i], 0) if len(known) else exact
                found["counts"] = exact[of]
            out |= {c: blobs.column([blobs.pack(x[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]) for c, x in found.items()}
        return pa.table(out).select(back_schema.names).cast(back_schema)

    def total_up(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.Table.from_pylist([], done_schema)
        t, answers, found = texts(table), answers.sort_by("bucket"), []
        for name, keys in (("counts", t.words), ("levels", t.words), ("pair_levels", t.pairs)):
            x = np.empty(len(keys), np.int64)
            x[in_order(keys)[1]] = blobs.joined(answers, name)  # an answer of another length is an error
            found.append(x)
        ids = [b.column(b.schema.get_field_index("id")) for b in table.to_batches()]
        return pa.Table.from_arrays([pa.chunked_array(ids, pa.int64()).combine_chunks(), *t.sums(*found, n, v)], schema=done_schema)

    sent_schema = pa.schema([("slice", pa.int32()), ("bucket", pa.int32()), ("words", pa.binary()), ("pairs", pa.binary())])
    back_schema = pa.schema([("slice", pa.int32()), ("bucket", pa.int32()), ("counts", pa.binary()), ("levels", pa.binary()), ("pair_levels", pa.binary())])
    done_schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    asked = dealt.groupBy("slice").applyInArrow(send, "slice int, bucket int, words binary, pairs binary")
    segments = model.table.select("bucket", "words", "counts", "word_bits", "pair_bits")
    answers = asked.groupBy("bucket").cogroup(segments.groupBy("bucket")).applyInArrow(probe, "slice int, bucket int, counts binary, levels binary, pair_levels binary")
    return dealt.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(total_up, f"id long, {_NUMBERS}")


def score(rows: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A row per row of rows: id, n_tokens, n_known, train_tokens long, base_score, score double.

    Null and empty texts are the end alone. Repeated rows and null ids are kept; other columns are not read. Beyond
    `broadcast_bytes` of model, probes are made where its segments are; the scores are the same.
    """
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = (_by_broadcast if model.size <= broadcast_bytes else _by_buckets)(rows, model)
    return out.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def held_out_scores(docs: DataFrame, fold: int = 5, held: int = 1, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Scores of all docs after learning from those whose crc32(doc_id as text) mod `fold` is not `held`; held_out is true for the others."""
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(fold))
    scored = score(docs, fit(docs.where(remainder != held)), broadcast_bytes=broadcast_bytes)
    return scored.select("doc_id", F.coalesce(remainder == held, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
