"""Every registered query of the layout engine against its SQL twin in DuckDB."""

import math

import duckdb
import pytest

from quire.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0 if math.isfinite(v) else str(v)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cur = duck.execute(registry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    at = [cols.index(c) for c in df.columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(plain(v) for v in r) for r in df.collect()), key=repr)
    assert len(got) == len(want) and len(got) > 0
    assert got == want


def test_queries_without_sql(spark):
    """They run, have rows, and are the ones that tests/test_operators.py holds to brute force."""
    only = sorted(set(registry.queries()) - set(registry.oracle_sql()))
    assert len(only) == 16
    for name in only:
        assert registry.queries()[name](spark, SF).count() > 0, name
