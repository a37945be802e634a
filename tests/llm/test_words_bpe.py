import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tensorloom.llm import blobs
from tensorloom.llm.bpe import Decoder, Encoder
from tensorloom.llm.queries import tokenizer_path
from tensorloom.llm.tokens import digests, encode_decode
from tensorloom.llm.words import Words, sequences, slices, starts


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\t\n\x0b\x1c\xa0日", max_size=20)), max_size=8))
def test_words_are_those_of_split(texts):
    w = Words(pa.array(texts, pa.string()), lower=True)
    found = [(t or "").encode().lower().split() for t in texts]
    assert w.counts.tolist() == [len(f) for f in found]
    by_word = {}
    for h, word in zip(w.hash.tolist(), [x for f in found for x in f], strict=True):
        assert by_word.setdefault(word, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_sequences():
    h = np.random.default_rng(1).integers(0, 2**63, 40).astype(np.uint64)
    two = np.concatenate((h, h))
    s = sequences(two, 7)
    assert len(s) == 74 and (s[:34] == s[40:74]).all() and len(set(s[:40].tolist())) == 40
    assert starts(np.array([0, 3, 3, 10]), 3).tolist() == [0, 3, 4, 5, 6, 7]


def test_slices_cover_all_rows():
    texts = ["x" * n for n in (5, 0, 50, 3, 3, 3, 100)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    parts = list(slices(iter([batch, batch.slice(2, 0), batch.slice(3)]), "text", most=10))
    assert [t for p in parts for t in p.column(0).to_pylist()] == texts + texts[3:]
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(0).to_pylist()) <= 10 for p in parts)


@given(st.lists(st.integers(-(2**62), 2**62), max_size=50))
def test_blobs(values):
    x = np.array(values, np.int64)
    assert (blobs.unpack(blobs.pack(x)) == x).all()
    u = x.view(np.uint64)
    assert (blobs.unpack(blobs.pack(u), np.uint64) == u).all()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def encoders():
    return [Encoder(tokenizer_path(), e) for e in ("transducer", "library")]


HARD = ["", " ", "a" * 3000, "ab" * 700, "=-" * 900, " " * 700 + "x", "\n\n \t x", "é" * 700, "😀🏳️‍🌈 漢字", "I'll don't 'S", "<|endoftext|>a <|endoftext|>", "\x1c a\x1d", "\x85\xa0x", "a​b", "١٢٣ ² Ⅷ", "a\r\n b  c   "]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
@example("aaaa" * 400)
@example("".join(map(chr, range(256))) * 2)
@example(" ".join(map(chr, range(256))))
def test_ids_are_the_librarys(library, encoders, text):
    want = library.encode(text, add_special_tokens=False).ids
    for e in encoders:
        assert np.frombuffer(e.encode(text), "<u4").tolist() == want
    assert "".join(Decoder(encoders[0].bpe).decode(np.array(want, "<u4"), step=3)) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("k", range(len(HARD)))
def test_hard_texts(library, encoders, k):
    test_ids_are_the_librarys.hypothesis.inner_test(library, encoders, HARD[k])


def test_buffer_is_bounded(library):
    rng = np.random.default_rng(5)
    for letters in ("ab", "etaoinshr", "=-_"):
        bpe = Encoder(tokenizer_path()).bpe
        text = "".join(rng.choice(list(letters), 30_000))
        assert list(bpe.transduce(text.encode())) == library.encode(text, add_special_tokens=False).ids
        assert bpe.peak < 2000


@pytest.mark.parametrize("k", [0, 1])
def test_long_texts_in_blocks(library, encoders, k, monkeypatch):
    """Blocks of ids of texts of any length are the library's; what is held does not grow with the text."""
    from tensorloom.llm import bpe

    rng = random.Random(8)
    texts = ["".join(rng.choice(HARD) for _ in range(60)), "x" * 40_000, " ".join(HARD) * 9, "<|endoftext|>" * 5 + "tail " * 300, "a  " * 999]
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    monkeypatch.setattr(bpe, "LONG_TEXT", 50)
    monkeypatch.setattr(bpe, "BLOCK", 16)
    for t, w in zip(texts, want, strict=True):
        blocks = list(encoders[k].blocks(t))
        assert b"".join(blocks) == w and (k or max(map(len, blocks)) <= 4 * 16 * bpe.KEEP_BYTES)
        assert "".join(bpe.Decoder(encoders[k].bpe).blocks(blocks)) == library.decode(list(np.frombuffer(w, "<u4")), skip_special_tokens=False)


def test_broken_bytes(library, encoders):
    ids = np.array([encoders[0].bpe.ids[b"\xf0"], encoders[0].bpe.ids[b"\x9f"], encoders[0].bpe.ids[b"a"], encoders[0].bpe.ids[b"\xff"]], "<u4")
    assert "".join(Decoder(encoders[0].bpe).decode(ids)) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_query(spark, docs, texts, library):
    rows = digests(encode_decode(docs(texts), tokenizer_path())).collect()
    assert len(rows) == len(texts)
    import hashlib

    want = sorted(((i, len(ids := library.encode(t or "", add_special_tokens=False).ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts), key=repr)
    assert sorted(map(tuple, rows), key=repr) == want
    assert encode_decode(docs([]), tokenizer_path()).count() == 0
