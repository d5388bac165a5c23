"""The subpackage's queries on the smallest tables: every one runs, and where it has SQL that gives the same columns and rows."""

import os

import pytest

from annoloom.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def text(x):
    return f"{x:.9g}" if isinstance(x, float) else str(x)


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    import duckdb

    df = QUERIES[name](spark, DATA)
    got = sorted(tuple(text(x) for x in r) for r in df.collect())
    assert df.columns and got
    if name in ORACLES:
        con = duckdb.connect()
        con.execute("set timezone = 'UTC'")
        for f in os.listdir(DATA):
            con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
        result = con.execute(ORACLES[name])
        columns = [d[0] for d in result.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == sorted(tuple(text(r[columns.index(c)]) for c in df.columns) for r in result.fetchall())
