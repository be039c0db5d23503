"""Every query with SQL against DuckDB over the smallest tables."""

import glob
import os

import duckdb
import pytest

from tessitura.plans import catalog

D = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(rows):
    return sorted(str(tuple(None if x != x else round(x, 4) + 0.0 if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, D)
    want = duck.sql(SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    assert plain(tuple(r) for r in df.select(*cols).collect()) == plain(want.project(", ".join(f'"{c}"' for c in cols)).fetchall())


def test_entry_imports():
    import __spark_entry__ as e

    assert set(SQL) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
