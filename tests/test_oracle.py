"""Every catalogue query with SQL gives what DuckDB gives on the same tables."""

import decimal

import duckdb
import pytest

from tensorloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return 0.0 if isinstance(v, float) and v == 0 else round(v, 8) if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(catalogue.SQL))
def test_matches_sql(spark, sf, con, name):
    df = catalogue.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    found = con.execute(catalogue.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", [q for q in catalogue.QUERIES if q not in catalogue.SQL])
def test_others_run(spark, sf, name):
    rows = catalogue.QUERIES[name](spark, sf).collect()
    assert rows
    if name.endswith("_cover"):
        assert all(r["exact"] for r in rows)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
