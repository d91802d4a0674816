"""Every query that has SQL is held against it on the smallest tables."""

import os

import pytest

DATA = "/root/testdata/sf0.001"


def _names():
    from lodestone import queries

    return sorted(queries.ORACLES)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", _names())
def test_equals_sql(spark, name):
    import duckdb

    from lodestone import queries

    con = duckdb.connect()
    for table in ("embeddings", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DATA}/{table}.parquet')")
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), con.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    key = lambda d: d[columns].sort_values(columns).to_numpy().tolist()
    assert key(got) == key(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    if os.path.isdir(DATA):
        assert e.entry(spark).count() == 10
