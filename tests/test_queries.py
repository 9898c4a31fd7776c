"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from pickwise.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0 if math.isfinite(v) else str(v)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, data, con, name):
    df = registry.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    r = con.execute(registry.ORACLE_SQL[name])
    theirs = [d[0] for d in r.description]
    assert sorted(theirs) == cols
    want = sorted((tuple(plain(row[theirs.index(c)]) for c in cols) for row in r.fetchall()), key=repr)
    got = sorted((tuple(plain(row[c]) for c in cols) for row in df.collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0


def test_entry():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
