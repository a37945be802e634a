"""Secrets in whole texts: fixed patterns, and values in a credential context whose guess cost is high.

The guess cost of a value is the least sum, over all ways to cut it into words, dates, repeats, keyboard walks and
brute-force spans, of the log10 guesses of its segments (a dynamic programme over end positions, the minimum over every
segmentation, for values of any length). Words are COMMON, then the words of four letters or more in the public BPE vocabulary, most frequent first, so prose after "login is" stays cheap.
"""

from __future__ import annotations

import json
import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

KINDS = ("assign", "access", "hex", "guess")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that have 24 characters or more
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: A value of 6 characters or fewer never takes 10^LEAST_COST guesses. Words that make what follows ": ", "=" or "is" a credential value; after "bearer" a space will do.
_CONTEXT_WORDS = ("passphrase", "passcode", "password", "passwd", "pwd", "credential", "login", "bearer", "secret", "token", "private key", "private_key", "access key", "access_key", "api key", "apikey", "api_key")
_CONTEXT = re.compile(rf"""(?<![A-Za-z0-9])(?:(?:{"|".join(map(re.escape, _CONTEXT_WORDS))})s?["']?\s{{0,3}}(?:\bis\b|[:=]+>?)\s{{0,3}}|bearer\s{{1,3}}(?!is\b))["']?([^\s"'<>,;]{{7,}})""", re.I | re.A)
#: Frequent parts of passwords, most frequent first.
COMMON = """password admin welcome letmein qwerty monkey dragon master login access secret shadow summer winter spring autumn
sunshine princess football baseball iloveyou trustno hello freedom whatever michael jordan hunter ranger buster soccer
charlie thomas george andrew jessica pepper daniel ginger joshua maggie cookie flower silver orange purple yellow banana
computer internet server system test user guest root default change temp demo example sample public private token key
love money lucky happy angel mustang corvette ferrari mercedes google apple samsung windows linux pass word the and for
you with this that from have""".split()
#: Rows of a keyboard.
KEYBOARD = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
#: Letters of the vocabulary's words.
WORD_LETTERS = range(4, 21)
_LEET = str.maketrans("430157@$!", "aeoistasi")
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:(?:19|20)\d\d)")
_BESIDE = {a + b for row in KEYBOARD for a, b in [*zip(row, row[1:], strict=False), *zip(row[1:], row, strict=False)]}
#: Characters of a date, and of the shortest repeat or walk.
DATE_LENGTHS, RUN_LEAST = range(4, 11), 3
#: log10 guesses: of a date, of the start of a repeat or walk, for each further segment.
DATE_COST, RUN_COST, SEGMENT_COST = math.log10(365 * 120), math.log10(50), math.log10(2)
#: A value is a secret from so many log10 guesses on.
LEAST_COST = 10.0


@lru_cache(1)
def _ranks() -> tuple[dict[str, int], int]:
    """The rank of each word, and the letters of the longest."""
    from .queries import tokenizer_path

    with open(tokenizer_path(), encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    tokens = (t.removeprefix("\u0120").lower() for t in sorted(vocabulary, key=vocabulary.get))  # the byte for a space
    words = dict.fromkeys([*COMMON, *(t for t in tokens if len(t) in WORD_LETTERS and t.isascii() and t.isalpha())])
    return {w: i + 1 for i, w in enumerate(words)}, max(map(len, words))


def _brute(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() else 33)


class _Runs:
    """Starts within a run (a repeat or a keyboard walk) that can still be the cheapest for a later end.

    The cost to an end grows by the log of the length, so of two starts the later one is cheaper for near ends only and an
    earlier one that costs as much never is. Starts that nothing can make cheapest any more leave, so long runs stay linear.
    """

    def __init__(self):
        self.first, self.open = 0, []

    def least(self, end: int, costs: list[float]) -> float:
        """The least cost of a segment from a start to the end, of RUN_LEAST characters or more. costs: before each place."""
        at = end - RUN_LEAST
        if at >= self.first:
            own = costs[at]
            while self.open and costs[self.open[-1]] >= own:
                self.open.pop()
            self.open.append(at)
        cost = lambda i: costs[i] + math.log10(end - i)
        while len(self.open) > 1 and cost(self.open[-1]) >= cost(self.open[-2]):
            self.open.pop()
        return RUN_COST + min(map(cost, self.open)) if self.open else math.inf

    def restart(self, at: int) -> None:
        self.first, self.open = at, []


def guess_cost(value: str) -> float:
    """log10 of the guesses that the cheapest of all segmentations of the value takes; a value of any length."""
    n, low = len(value), value.lower()
    if len(low) != n:  # a few letters become two
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(_LEET)
    best, before = [0.0] + [math.inf] * n, [0.0] * (n + 1)  # before: with the cost of one more segment
    ranks, longest = _ranks()
    repeat, walk = _Runs(), _Runs()
    for i in range(n + 1):
        if i:  # segments that end here
            best[i] = min(best[i], best[i - 1] + _brute(value[i - 1]))  # brute force, one more character
            for runs, goes_on in ((repeat, i > 1 and low[i - 1] == low[i - 2]), (walk, i > 1 and low[i - 2 : i] in _BESIDE)):
                if not goes_on:
                    runs.restart(i - 1)
                best[i] = min(best[i], runs.least(i, before))
            before[i] = best[i] + SEGMENT_COST
        for j in range(i + 1, min(n, i + longest) + 1):  # a word from here, as it is or with digits for letters
            if (rank := ranks.get(plain[i:j])) is not None:
                part = value[i:j]
                cost = before[i] + math.log10(rank + 1) + (part != part.lower()) * math.log10(2) + (plain[i:j] != low[i:j]) * math.log10(4)
                best[j] = min(best[j], cost)
        if i < n and "0" <= value[i] <= "3":
            for j in range(i + DATE_LENGTHS[0], min(n, i + DATE_LENGTHS[-1]) + 1):  # every date from here
                if _DATE.fullmatch(value, i, j):
                    best[j] = min(best[j], before[i] + DATE_COST)
    return best[n]


def find_secrets(text: str | None) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, log10 guesses of a credential value) by start, then in the order of KINDS; code points, end exclusive.

    Every value of 7 characters or more in a credential context is scored, whole, however long: it is a guess span from
    LEAST_COST on, or where it reaches beyond an assign span. Time and memory are linear in the value's length.
    """
    if not text:
        return []
    found, low = [], text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        found += [("assign", m.start(), m.end(), guess_cost(m[2])) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), None) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end(), None) for m in _HEX.finditer(text)]
    if any(w in low for w in _CONTEXT_WORDS):
        taken = sorted((s, e) for k, s, e, _ in found if k == "assign")
        at = 0
        while m := _CONTEXT.search(text, at):
            start, end = m.span(1)
            at = start  # a value may begin with the context of another
            over = [(s, e) for s, e in taken if s < end and start < e]
            if any(s <= start and end <= e for s, e in over):
                continue
            cost = guess_cost(m[1])
            if over or cost >= LEAST_COST:  # the rest of an assigned value is as secret as its start
                taken.append((start, end))
                found.append(("guess", start, end, cost))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: its id, spans array<struct<kind, start, end, cost>> by start, then kind.

    Null and empty texts have no spans; very long texts and values are read whole, a text at a time; repeated rows and
    null ids are kept; other columns are not read.
    """
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cost", pa.float64())]))

    def run(batches):
        for part in slices(batches, "text"):
            rows = [[dict(zip(("kind", "start", "end", "cost"), s, strict=True)) for s in find_secrets(t)] for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, spans)], ["id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, spans array<struct<kind: string, start: long, end: long, cost: double>>").withColumnRenamed("id", id_col)


def digests(scanned: DataFrame) -> DataFrame:
    """Counts and joined spans of scan()'s rows."""
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return scanned.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"), count("guess"))


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in text replaced by a mark, and n_chars to match where it is a column; clean texts stay as they are."""
    names, at = docs.columns, docs.columns.index("text")

    def clean(text):
        if text is None:
            return None
        out, end = [], 0
        for _, s, e, _ in find_secrets(text):
            if s >= end:
                out += [text[end:s], mark]
            end = max(end, e)
        return "".join(out) + text[end:] if out else text

    def run(batches):
        for part in slices(batches, "text"):
            yield part.set_column(at, part.schema.field(at), pa.array([clean(t) for t in part.column(at).to_pylist()], part.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(names) if "n_chars" in names else out
