"""Byte-level BPE by a streaming transducer with bounded lookahead.

The encoding of a prefix extends a shorter one: the encoding of text[:i] is that of text[:i-k] followed by one token of k
bytes, and it is the only such token that stands next to its left neighbour without a merge across them. So the
transducer keeps, for each of the last `lookahead` positions, the last token of the prefix that ends there. `lookahead`
is computed from the merge list: no later token can begin further back than the longest token is long. A token is stable,
and leaves the buffer, once every position that a later token can begin at descends from it; what stays is bounded by
the lookahead and not by the length of the text.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from itertools import islice

import numpy as np
import regex

#: White space of the pre-tokenizer's pattern (fixed values): the Unicode property White_Space.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"
_ASCII = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
#: The same for texts of Latin-1 characters, whose letters, numbers and white space are these (fixed values).
_LETTER, _NUMBER, _BLANK = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff", "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe", "\\t-\\r \\x85\\xa0"
_LATIN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_BLANK}{_LETTER}{_NUMBER}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
#: Longest piece (characters) whose ids are kept, and how many pieces a generation keeps.
KEEP_BYTES, KEEP_PIECES = 64, 350_000
#: Bytes after which the transducer looks for stable tokens.
CHUNK = 512
#: Characters of a text above which pieces are found and encoded one after another, so many ids or pieces at a time.
LONG_TEXT, BLOCK = 1 << 16, 1 << 14


def byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in a vocabulary file: itself where printable, else the next code from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A vocabulary file of the tokenizers library, read without it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        chars = byte_chars()
        text = lambda s: bytes(chars[c] for c in s)
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.ids = {text(s): i for s, i in file["model"]["vocab"].items() if s not in self.special}
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.table = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(file["model"]["merges"]):
            a, b = map(text, pair.split(" ") if isinstance(pair, str) else pair)
            self.merges[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        self.lookahead = 0  # bytes; from _prepare()
        self._ends: dict[bytes, int] = {}  # length of the longest token with such last two bytes
        self._beside: dict[int, bool] = {}
        self.peak = 0  # most positions that the transducer has held

    def merged(self, piece: bytes) -> list[int]:
        """The definition: merge the pair of least rank, leftmost first, until none is left."""
        ids = [self.ids[piece[i : i + 1]] for i in range(len(piece))]
        while len(ids) > 1:
            rank, at, new = min(((*self.merges[p], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.merges), default=(0, 0, -1), key=lambda x: (x[0], x[2]))
            if new < 0:
                break
            ids[new : new + 2] = [at]
        return ids

    def _prepare(self) -> None:
        """Runs the merge list on each token's bytes: only tokens that their own bytes become are ever emitted, and the longest
        of them is all the lookahead that is needed. Also finds how long such a token with a given end can be."""
        self.own = {b: i for b, i in self.ids.items() if self.merged(b) == [i]}
        self.lookahead = max(map(len, self.own), default=1)
        for b in self.own:
            self._ends[b[-2:]] = max(self._ends.get(b[-2:], 1), len(b))

    def beside(self, left: int, right: int) -> bool:
        """Whether the two tokens stand next to each other without a merge across them."""
        key = left << 32 | right
        if (known := self._beside.get(key)) is None:
            if len(self._beside) >= 2 * KEEP_PIECES:
                self._beside.clear()
            known = self._beside[key] = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def transduce(self, piece: bytes):
        """The ids of one piece, each as soon as it is stable."""
        if not self._ends:
            self._prepare()
        own, ends, known, longest = self.own.get, self._ends.get, self._beside.get, self.lookahead
        last: list[int] = [-1]  # of the prefix that ends at base + i; for base it is known to be emitted
        base, n = 0, len(piece)
        for end in range(1, n + 1):
            for begin in range(max(base, end - ends(piece[max(0, end - 2) : end], 1)), end):
                if (token := own(piece[begin:end])) is None:
                    continue
                before = last[begin - base]
                if before < 0 or (fits := known(before << 32 | token)) or (fits is None and self.beside(before, token)):
                    last.append(token)
                    break
            else:
                raise ValueError("a byte has no token")
            if end - base >= CHUNK + longest and end % CHUNK == 0:
                self.peak = max(self.peak, len(last))
                stable, out = self._stable(last, base, end)
                if stable > base:
                    yield from out
                    last, base = last[stable - base :], stable
        self.peak = max(self.peak, len(last))
        out, at = [], n
        while at > base:
            out.append(last[at - base])
            at -= len(self.bytes_of[out[-1]])
        yield from reversed(out)

    def _stable(self, last: list[int], base: int, end: int) -> tuple[int, list[int]]:
        """The last boundary that all positions still open descend from, and the tokens from base up to it."""
        path, at = [end], end
        while at > base:
            at -= len(self.bytes_of[last[at - base]])
            path.append(at)
        boundaries, stable = set(path), end
        for p in range(max(base, end - self.lookahead + 1), end):
            while p not in boundaries:
                p -= len(self.bytes_of[last[p - base]])
            stable = min(stable, p)
        return stable, [last[p - base] for p in reversed(path) if base < p <= stable]


def _little_endian(ids) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Kept(dict):
    """Little-endian ids of pieces already seen. Two generations bound it: when this one is full it becomes the old one,
    and pieces that are met again come back from there, so frequent pieces stay and memory does not grow with the corpus."""

    def __init__(self, miss):
        super().__init__()
        self.miss, self.old = miss, {}

    def __missing__(self, piece: str) -> bytes:
        if (found := self.old.get(piece)) is None:
            found = self.miss(piece)
            if len(piece) > KEEP_BYTES:
                return found
        if len(self) >= KEEP_PIECES:
            self.old = dict(self)
            self.clear()
        self[piece] = found
        return found


class Encoder:
    """Encodes whole texts. engine: 'transducer', or 'library' for ids of each new piece from the tokenizers library."""

    def __init__(self, path: str, engine: str = "transducer"):
        self.bpe = Bpe(path)
        if engine == "library":
            from tokenizers import Tokenizer

            self._model = Tokenizer.from_file(path).model
            self._shown = str.maketrans({b: c for c, b in byte_chars().items()})
        self.kept = _Kept(self._by_transducer if engine == "transducer" else self._by_library)
        self._find, self._find_latin, self._find_ascii = regex.compile(_PATTERN, regex.V0), re.compile(_LATIN), re.compile(_ASCII)
        self._engine = engine
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.bpe.special, key=len, reverse=True))) + ")") if self.bpe.special else None
        self._markers = tuple(self.bpe.special)

    def _by_transducer(self, piece: str) -> bytes:
        return _little_endian(self.bpe.transduce(piece.encode()))

    def _by_library(self, piece: str) -> bytes:
        shown = piece.encode().decode("latin-1").translate(self._shown)
        return _little_endian([t.id for t in self._model.tokenize(shown)])

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.kept.__getitem__, self._pattern(text).findall(text)))

    def _pattern(self, text: str):
        """The pattern that finds the pieces: the simplest that does for the text's characters."""
        if text.isascii():
            return self._find_ascii
        try:
            for i in range(0, len(text), LONG_TEXT):
                text[i : i + LONG_TEXT].encode("latin-1")
        except UnicodeEncodeError:
            return self._find
        return self._find_latin

    def _long(self, text: str, first: int, last: int):
        """Ids of text[first:last], a block at a time; of a piece longer than a block, as the transducer emits them."""
        block: list[bytes] = []
        for m in self._pattern(text).finditer(text, first, last):
            piece = m.group()
            if len(piece) > BLOCK and self._engine == "transducer":
                yield b"".join(block)
                block.clear()
                ids = self.bpe.transduce(piece.encode())
                while some := list(islice(ids, BLOCK)):
                    yield _little_endian(some)
            else:
                block.append(self.kept[piece])
            if len(block) >= BLOCK:
                yield b"".join(block)
                block.clear()
        yield b"".join(block)

    def blocks(self, text: str):
        """The ids of a text as little-endian unsigned 32-bit integers, in blocks. Special tokens' strings become their ids.

        What is held besides the text are a block and the transducer's buffer, however long the text is.
        """
        some = self._special and any(m in text for m in self._markers)
        if len(text) <= LONG_TEXT and not some:
            yield self._plain(text)
            return
        at = 0
        for m in self._special.finditer(text) if some else ():
            yield from self._long(text, at, m.start())
            yield self.bpe.special[m.group()].to_bytes(4, "little")
            at = m.end()
        yield from self._long(text, at, len(text))

    def encode(self, text: str) -> bytes:
        """All of blocks()."""
        return b"".join(self.blocks(text))


class Decoder:
    """Bytes to text one token at a time: a state machine over UTF-8 lead and continuation bytes."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe

    def decode(self, ids: np.ndarray, step: int = 1 << 16):
        """Pieces of the text of ids."""
        return self.blocks(ids[i : i + step].astype("<u4").tobytes() for i in range(0, len(ids), step))

    def blocks(self, blocks):
        """Pieces of the text of blocks of little-endian ids; a character cut by a block's end waits for its other bytes. Broken bytes become U+FFFD."""
        import codecs

        machine, table = codecs.getincrementaldecoder("utf-8")("replace"), self.bpe.table
        for block in blocks:
            if out := machine.decode(b"".join(map(table.__getitem__, np.frombuffer(block, "<u4").tolist()))):
                yield out
        if out := machine.decode(b"", True):
            yield out
