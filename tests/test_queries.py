"""Every registered query runs; those with an oracle agree with it on the small tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from fairlead.bindings import BASE_TABLES

from conftest import SF

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in BASE_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canon(v):
    if v is None or v != v:
        return "~"
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())
    if name not in SQL:
        return
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    want = sorted(tuple(canon(r[i]) for i in order) for r in cur.fetchall())
    assert got == want


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
