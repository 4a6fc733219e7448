"""Every query of the catalogue against its SQL in DuckDB, on the smallest driver tables."""

import math
import os

import duckdb
import pytest

from ragloom import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalog.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(rows):
    def value(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 6) + 0.0
        return float(x) if isinstance(x, int) and not isinstance(x, bool) else str(x) if x is not None else None

    return sorted((tuple(map(value, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, name):
    found = catalog.queries()[name](spark, DATA)
    columns = sorted(found.columns)
    expected = db.execute(SQL[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == columns
    rows = [tuple(r[names.index(c)] for c in columns) for r in expected.fetchall()]
    assert plain(tuple(r[c] for c in columns) for r in found.collect()) == plain(rows)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_other_queries_run(spark, name):
    found = catalog.queries()[name](spark, DATA)
    assert found.count() > 0 and len(set(found.columns)) == len(found.columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
