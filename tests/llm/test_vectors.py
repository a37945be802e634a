import math

import numpy as np
import pytest

from tensorloom.llm import ball_search, embedding_dedup
from tensorloom.llm.ball_search import build_tree, top_k
from tensorloom.llm.embedding_dedup import embedding_duplicates, needed


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    out = [(int(i), rng.normal(0, 1, 16).tolist()) for i in range(0, 900, 3)]
    centre = rng.normal(0, 1, 16)
    for i in range(250):  # a dense group, some pairs at the threshold
        out.append((2000 + i, (centre + rng.normal(0, 0.16, 16)).tolist()))
    out += [(3000 + i, out[4][1]) for i in range(5)] + [(3010, (2 * np.array(out[4][1])).tolist())]
    out += [(4000, None), (4001, [0.0] * 16), (4002, [math.nan] * 16), (4003, [1.0] * 15 + [None]), (4004, [math.inf] + [1.0] * 15), (4005, []), (4006, [1.0, 2.0]), (4007, [2.0, 4.0]), (None, out[4][1])]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, id long, rep string")


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def brute_links(rows, cosine=0.95):
    ok = [(i, np.array(v)) for i, v in rows if i is not None and usable(v) and np.linalg.norm(v) > 0]
    links = {i: set() for i, _ in ok}
    for i, x in ok:
        for j, y in ok:
            if i != j and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                links[i].add(j)
    comp = {}
    for i in sorted(links):
        if i not in comp:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in comp:
                    comp[k] = i
                    todo += links[k]
    return links, comp


def check(spark, rows):
    links, comp = brute_links(rows)
    got = {r["vec_id"]: r for r in embedding_duplicates(frame(spark, rows)).collect()}
    assert set(got) == {i for i, _ in rows}
    true = sum(map(len, links.values()))
    assert true and sum(r["n_links"] for r in got.values()) >= 0.999 * true
    for i, r in got.items():
        want = len(links.get(i, ()))
        assert r["n_links"] <= want and r["component_id"] == comp.get(i, i) and r["kept"] == (i is None or comp.get(i, i) == i)


def test_links(spark, rows):
    check(spark, rows)


def test_links_over_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    monkeypatch.setattr(embedding_dedup, "QUERY_ROWS", 16)
    check(spark, rows)


def test_no_links(spark):
    assert embedding_duplicates(frame(spark, [])).count() == 0
    only = [(1, None), (2, [0.0, 0.0]), (2, [0.0, 0.0])]
    assert sorted(map(tuple, embedding_duplicates(frame(spark, only)).collect())) == [(1, 0, 1, True), (2, 0, 2, True), (2, 0, 2, True)]


def test_needed_count():
    assert needed(1.0, 32) == 32 and 20 < needed(0.98758, 32, 0.9995) < 31


def brute_top(rows, queries, k):
    whole = {(i, tuple(math.floor(64 * x) for x in v)) for i, v in rows if i is not None and usable(v)}
    out = []
    for q, x in {(i, tuple(math.floor(64 * c) for c in v)) for i, v in queries if i is not None and usable(v)}:
        found = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), j) for j, y in whole if j != q and len(y) == len(x))[:k]
        out += [(q, r, j, -s) for r, (s, j) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("shard,leaf,block", [(16_384, 256, 512), (50, 8, 7)])
def test_top_k(spark, rows, monkeypatch, shard, leaf, block):
    for name, value in (("SHARD", shard), ("LEAF", leaf), ("QUERIES", block)):
        monkeypatch.setattr(ball_search, name, value)
    ties = rows + [(5000 + i, [0.1] * 16) for i in range(60)]  # more ties than places
    queries = [r for r in ties if r[0] is not None and r[0] % 20 == 0]
    got = sorted(map(tuple, top_k(frame(spark, ties), frame(spark, queries)).collect()))
    assert got == brute_top(ties, queries, 20)


def test_top_k_edges(spark):
    few = [(0, [1.0, 2.0]), (20, [0.5, 0.5]), (21, None)]
    assert sorted(map(tuple, top_k(frame(spark, few), frame(spark, few[:2])).collect())) == brute_top(few, few[:2], 20)
    one = [(0, [1.0])]
    assert top_k(frame(spark, one), frame(spark, one)).count() == 0
    assert top_k(frame(spark, []), frame(spark, [])).count() == 0
    big = [(i, [float(2**24 + i), 1.0]) for i in range(30)]  # sums beyond what doubles hold
    assert sorted(map(tuple, top_k(frame(spark, big), frame(spark, big[:3])).collect())) == brute_top(big, big[:3], 20)


def test_balls_hold_their_rows():
    x = np.random.default_rng(1).normal(0, 9, (3000, 5))
    order, t = build_tree(x)
    assert sorted(order) == list(range(3000))
    for (start, end, left, right), r, c in zip(t["span"], t["radius"], t["centre"], strict=True):
        assert (np.linalg.norm(x[order[start:end]] - c, axis=1) <= r).all()
        assert left < 0 or (t["span"][left][0], t["span"][left][1], t["span"][right][1]) == (start, t["span"][right][0], end)


def clustered(n: int, dim: int = 64, seed: int = 5) -> np.ndarray:
    """Vectors around centres, some of them near copies of each other."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (n // 100, dim))
    x = centres[rng.integers(0, len(centres), n)] + rng.normal(0, 0.35, (n, dim))
    near = rng.permutation(n)[: n // 5]
    x[near[1::2]] = x[near[::2]] + rng.normal(0, 0.25, (len(near) // 2, dim))  # cosines around the threshold
    return x


def test_links_of_64_dimensions(spark, monkeypatch):
    x = clustered(3000)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 500)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    link = np.triu(unit @ unit.T >= 0.95, 1)
    got = {r["vec_id"]: r for r in embedding_duplicates(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])).collect()}
    true = (link | link.T).sum(axis=1)
    assert link.sum() > 100 and all(got[i]["n_links"] <= true[i] for i in range(3000))
    assert sum(r["n_links"] for r in got.values()) >= 0.9 * true.sum()


def test_share_of_pairs_verified():
    """Windows leave out most pairs; those that link are all among the rest."""
    x = clustered(3000)
    orders = embedding_dedup.Orders(x)
    lo, hi = orders.stretches(embedding_dedup.projected(x), embedding_dedup.window(0.95))
    verified = sum(int((orders.collisions(lo[i], hi[i]) >= embedding_dedup.LEAST).sum()) - 1 for i in range(len(x)))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    links = int((unit @ unit.T >= 0.95).sum()) - len(x)
    found = sum(len(i) for i, _ in embedding_dedup.linked_pairs(x, x, 0.95, True))
    assert found == links // 2
    print(f"verified {verified / (len(x) * (len(x) - 1)):.5f} of all pairs, {links // 2} links")
    assert verified < 0.05 * len(x) * (len(x) - 1)


def test_search_prunes(spark, monkeypatch):
    """On clustered vectors most products are never taken, and the results are exact."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(ball_search, "SHARD", 500)
    monkeypatch.setattr(ball_search, "QUERIES", 64)
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(4000, seed=6))]
    t = frame(spark, rows)
    asked = t.where("vec_id % 20 = 0")
    scored, pairs = ball_search.searched(t, asked).agg(F.sum("scored"), F.sum("pairs")).first()
    print(f"scored {scored / pairs:.3f} of all pairs")
    assert pairs == 4000 * 200 and scored < 0.5 * pairs
    x = np.floor(64 * np.array([v for _, v in rows])).astype(np.int64)
    got: dict = {}
    for r in top_k(t, asked).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, 4000, 20):
        s = x @ x[q]
        best = [i for i in np.lexsort((np.arange(4000), -s)) if i != q][:20]
        assert sorted(got[q]) == [(k, i, s[i]) for k, i in enumerate(best, 1)]


def test_counts_in_bits():
    """Bit maps of windows give every pair that the windows of its own query give, and sums in bits are sums."""
    rng = np.random.default_rng(3)
    bits = rng.random((32, 5, 192)) < 0.4
    for least in (1, 12, 16, 32):
        maps = [np.packbits(b, axis=1, bitorder="little").view(np.uint64) for b in bits]
        row, col = embedding_dedup.ones(embedding_dedup.at_least(maps, least, 5, []))
        assert list(zip(row, col, strict=True)) == list(zip(*np.nonzero(bits.sum(axis=0) >= least), strict=True))
    x, y = embedding_dedup.Vectors(clustered(700)), clustered(1000, seed=6)
    orders, reach = embedding_dedup.Orders(y), embedding_dedup.window(0.95)
    edges, own = x.shares()
    maps = orders.windows(edges, reach)
    row, col = embedding_dedup.ones(embedding_dedup.at_least([np.take(m, c, axis=0) for m, c in zip(maps, own, strict=True)], embedding_dedup.LEAST, 5, []))
    found, (lo, hi) = set(zip(row.tolist(), col.tolist(), strict=True)), orders.stretches(x.places, reach)
    wanted = {(i, j) for i in range(700) for j in np.flatnonzero(orders.collisions(lo[i], hi[i]) >= embedding_dedup.LEAST).tolist()}
    assert wanted and wanted <= found and len(found) < 2 * len(wanted)


def test_blocks_are_sent_once_a_task(spark, monkeypatch):
    """A block goes to each pair of parts once, however many blocks it meets there, and all pairs of blocks meet in one task."""
    for name, value in (("BLOCK", 50), ("PARTS", 3)):
        monkeypatch.setattr(embedding_dedup, name, value)
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(1200))]
    reps = frame(spark, rows).selectExpr("vec_id as rep", "1L as rows", "embedding as vec")
    made = embedding_dedup.blocks(reps, 0.95)
    sent, n = embedding_dedup.tasks(made)
    got = sent.select("task", "block").collect()
    assert made.count() > 20 and len(set(got)) == len(got) <= 3 * made.count() + 3 and n <= 10
    together = {(t, a, b) for t, a in got for u, b in got if t == u}
    assert {(r["x"], r["y"]) for r in embedding_dedup.block_pairs(made).collect()} <= {(a, b) for _, a, b in together}
