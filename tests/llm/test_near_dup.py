import random

import numpy as np
import pytest

from tensorloom.llm import near_dup
from tensorloom.llm.components import components
from tensorloom.llm.near_dup import near_duplicates


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and a != b and x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return sorted(((d, len(s), None if d is None else root(d), d is None or root(d) == d) for d, s in sets), key=repr)


def found(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()), key=repr)


def test_matches_brute_force(docs, texts):
    got, want = found(near_duplicates(docs(texts))), brute(texts)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert got == want


def test_recall_at_the_threshold(docs):
    rng = random.Random(3)
    rows, pairs = [], 0
    for i in range(120):
        w = [f"w{rng.randrange(10**9)}" for _ in range(104)]
        other = list(w)
        other[50:53] = ["x", "y", "z"]  # 7 of 100 shingles differ
        other[20] = "q"
        other[80] = f"r{i}"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(other))]
        x, y = shingles(rows[-1][1]), shingles(rows[-2][1])
        pairs += len(x & y) / len(x | y) >= 0.75
    want = brute(rows)
    got = found(near_duplicates(docs(rows)))
    linked = sum(not w[3] for w in want)
    assert sum(not g[3] for g in got) >= 0.95 * linked
    assert all(w[2] == g[2] or g[2] == g[0] for g, w in zip(got, want, strict=True))


@pytest.mark.parametrize("template", [75, 82])
def test_dense_region(docs, template, monkeypatch):
    """Documents that share a template and are no near duplicates by it alone: all pairs that are get found, by brute force."""
    monkeypatch.setattr(near_dup, "ORDER_ROWS", 1024)  # regions cut by stretches
    rng = random.Random(template)
    word = lambda: f"w{rng.randrange(10**9)}"
    shared, rows = [word() for _ in range(2 * template)], []
    for i in range(200):
        w = shared + [word() for _ in range(200 - 2 * template + rng.randrange(8))]
        rows.append((2 * i, " ".join(w)))
        other = w[: 200 - 2 - i % 20] + [word() for _ in range(len(w) - 200 + 2 + i % 20)]
        rows.append((2 * i + 1, " ".join(other)))
    rng.shuffle(rows)
    want = brute(rows)
    assert 150 < sum(not w[3] for w in want) <= 200
    assert found(near_duplicates(docs(rows))) == want


def test_meetings():
    """Every pair of SHARE meets, whatever the order of shingles; none inside a component."""
    rng = np.random.default_rng(5)
    core = rng.choice(10_000, 60, replace=False)
    sets = [np.unique(np.concatenate((rng.permutation(core)[: rng.integers(45, 60)], rng.integers(10_000, 11_000, rng.integers(0, 15))))) for _ in range(150)]
    of = rng.integers(0, 40, 150)
    of[:60] = 0
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(150), size)
    got = {tuple(p) for m in near_dup.meetings(np.concatenate(sets).astype(np.uint64), owner, of[owner], size[owner], np.concatenate([np.arange(k) for k in size])) for p in m.T.tolist()}
    near = {(a, b) for b in range(150) for a in range(b) if 100 * (c := len(np.intersect1d(sets[a], sets[b]))) >= 75 * (size[a] + size[b] - c)}
    assert {p for p in near if of[p[0]] != of[p[1]]} <= got and len(near) > 500
    assert all(of[a] != of[b] for a, b in got)


def test_empty(docs):
    assert near_duplicates(docs([])).count() == 0
    assert found(near_duplicates(docs([(1, None), (2, ""), (2, "")]))) == [(1, 0, 1, True), (2, 0, 2, True), (2, 0, 2, True)]


def test_by_shuffle(docs, texts, monkeypatch):
    monkeypatch.setattr(near_dup, "IDS_BROADCAST", 0)
    monkeypatch.setattr(near_dup, "PAIRS_BROADCAST", 0)
    monkeypatch.setattr(near_dup, "ORDER_ROWS", 64)
    test_matches_brute_force(docs, texts)


@pytest.mark.parametrize("limit", [500_000, 0])
@pytest.mark.parametrize("n,m", [(1, 0), (50, 30), (300, 280), (200, 1500)])
def test_components(spark, monkeypatch, n, m, limit):
    from tensorloom.llm import components as c

    monkeypatch.setattr(c, "LINKS_A_TASK", limit)
    rng = np.random.default_rng(n)
    links = [(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2))]
    if n == 300:
        links += [(i, i + 1) for i in range(400, 520)]  # a long chain
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    want = {x: root(x) for a, b in links if a != b for x in (a, b)}
    df = spark.createDataFrame([*links, (None, 1)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(df, "a", "b").collect()}
    assert got == want
