"""Queries of the corpus operators that SQL can express give what DuckDB gives."""

import pytest

from registrum.llm.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"create view {table} as select * from read_parquet('{DIR}/{table}.parquet')")
    r = con.execute(ORACLES[name])
    columns = [c[0] for c in r.description]
    df = QUERIES[name](spark, DIR)
    assert sorted(df.columns) == sorted(columns)
    assert sorted((tuple(x) for x in df.select(*columns).collect()), key=repr) == sorted(r.fetchall(), key=repr)
