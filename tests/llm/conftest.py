import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, copy int, key string, bucket int"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table from (doc_id, text, lang); further columns have names that operators use inside."""

    def make(rows):
        full = [(r[0], r[1], (r[2] if len(r) > 2 else "en"), "s", None if r[1] is None else len(r[1]), 7, 9, "k", 3) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def texts():
    """Rows with shared passages, near and exact copies, nulls, empty, short and long texts, repeated rows, ids with two texts."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7)))
    body = lambda n: [word() for _ in range(n)]
    passage, other = body(70), body(55)
    rows = []
    for i in range(60):
        w = body(rng.randint(60, 200))
        if i % 4 == 0:
            w[20:20] = passage[: rng.randint(40, 70)]
        if i % 7 == 0:
            w[5:5] = other
        rows.append((i * 3, " ".join(w)))
    base = rows[10][1].split()
    for i in range(80):  # a group of near copies larger than a region
        w = list(base)
        for _ in range(3):
            w[rng.randrange(len(w))] = word()
        rows.append((1000 + i, " ".join(w)))
    rows += [(2000 + i, rows[5][1]) for i in range(6)]  # exact copies
    rows += [(3000, None), (3001, ""), (3002, " \t\n "), (3003, "one"), (3004, "one two three"), (3005, "One\x0btwo\rthree"), (None, rows[5][1]), (3006, "naïve  café — 日本  x"), (3007, "é" * 4000)]
    rows += [(3010, " ".join(body(3000) + passage)), (3010, " ".join(body(3000) + passage)), (3011, " ".join(body(80))), (3011, " ".join(body(30) + other + body(30))), (3012, " ".join(passage * 4))]
    rng.shuffle(rows)
    return rows
