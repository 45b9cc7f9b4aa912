"""Every registered query outside the corpus part runs on the smallest tables, and agrees with its DuckDB equivalent."""

import decimal

import duckdb
import pytest

from tideline.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f")
    return v


def rows_of(rows, columns):
    return sorted(repr([plain(r[c]) for c in columns]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, con, name):
    df = catalog.QUERIES[name](spark, sf)
    got = df.collect()
    if name in catalog.ORACLE:
        found = con.execute(catalog.ORACLE[name])
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(df.columns)
        want = [dict(zip(columns, r, strict=True)) for r in found.fetchall()]
        assert rows_of(got, sorted(columns)) == rows_of(want, sorted(columns))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
