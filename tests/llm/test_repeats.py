import random

import pytest

from tensorloom.llm.substring_dedup import COVER, PERIOD, digests, substring_dedup
from tensorloom.llm.suffix_dedup import repeated_passages


def brute(rows, n=50):
    """Per row: words, removed places, and for each window start the least smaller document."""
    firsts = {}
    for doc, text in rows:
        if doc is not None:
            w = (text or "").encode().split()
            for i in range(len(w) - n + 1):
                k = tuple(w[i : i + n])
                firsts[k] = min(firsts.get(k, doc), doc)
    out = []
    for doc, text in rows:
        w = (text or "").encode().split()
        first = {i: m for i in range(len(w) - n + 1) if doc is not None and (m := firsts[tuple(w[i : i + n])]) < doc}
        gone = {j for i in first for j in range(i, i + n)}
        out.append((doc, w, gone, first))
    return out


def test_cover():
    assert all(any((i + d) % PERIOD in COVER and (j + d) % PERIOD in COVER for d in range(PERIOD)) for i in range(PERIOD) for j in range(PERIOD))


@pytest.fixture(scope="module", params=[0, 1])
def rows(request, texts):
    if request.param == 0:
        return texts
    rng = random.Random(9)
    word = lambda: rng.choice("abc")
    pool = [[word() for _ in range(rng.randint(48, 60))] for _ in range(6)]
    return [(i, " ".join([w for _ in range(rng.randint(1, 4)) for w in [*rng.choice(pool), *(word() for _ in range(rng.randint(0, 3)))]])) for i in range(90)]


def test_substring_dedup(docs, rows):
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup(docs(rows)).collect()), key=repr)
    want = sorted(((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()) for d, w, gone, _ in brute(rows)), key=repr)
    assert got == want and any(x[2] for x in want)


def test_suffix_dedup(docs, rows):
    got = {(r["doc_id"], r["first_doc_id"], r["start"], r["end"]) for r in repeated_passages(docs(rows)).collect()}
    want = set()
    for doc, _, _, first in brute(rows):
        for i in sorted(first):
            if first.get(i - 1) != first[i]:
                j = i
                while first.get(j + 1) == first[i]:
                    j += 1
                want.add((doc, first[i], i, j + 50))
    assert got == want and want


def test_edges(docs):
    assert substring_dedup(docs([])).count() == 0 and repeated_passages(docs([])).count() == 0
    w = [str(i) for i in range(50)]
    rows = [(1, " ".join(w)), (2, " ".join(w)), (3, " ".join(w[:49])), (4, None)]
    assert {r["doc_id"]: r["n_removed"] for r in digests(substring_dedup(docs(rows))).collect()} == {1: 0, 2: 50, 3: 0, 4: 0}
    with pytest.raises(ValueError):
        substring_dedup(docs(rows), words=31)


def test_small_groups(docs, texts, monkeypatch):
    """The same result when tasks deal out often, and spans are joined by a shuffle."""
    from tensorloom.llm import repeats, substring_dedup as s

    monkeypatch.setattr(repeats, "FLUSH", 200)
    monkeypatch.setattr(s, "FLUSH", 200)
    monkeypatch.setattr(repeats, "SPANS_BROADCAST_BYTES", 0)
    test_substring_dedup(docs, texts)


def test_common_prefixes_of_neighbours():
    """The longest common prefix of a suffix with any other is that with a neighbour in the order, and bounds the windows exactly."""
    import numpy as np

    from tensorloom.llm.suffix_dedup import GRAMS, common_grams, words_shared

    rng = np.random.default_rng(3)
    k = rng.integers(0, 3, (400, 3))  # 0: beyond the text
    k[k[:, 1] == 0, 2] = 0
    k[:, 0] += 1
    k = k[np.lexsort(k.T[::-1])]
    shared = common_grams(*k.T)
    both = np.maximum(np.concatenate(([0], shared)), np.concatenate((shared, [0])))
    for i in range(0, 400, 7):
        best = max(next((c for c in range(3) if a[c] != b[c] or a[c] == 0), 3) for j, b in enumerate(k) if j != i for a in [k[i]])
        assert both[i] == best
    assert words_shared(np.arange(GRAMS + 1), 16).tolist() == [15, 31, 47, 1 << 30]
