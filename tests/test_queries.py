"""Every registered query with SQL gives what DuckDB gives on the smallest tables."""

import datetime
import decimal
from pathlib import Path

import pytest

from registrum.plans.registry import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = [p.stem for p in Path(DIR).glob("*.parquet")]


def plain(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, decimal.Decimal | float | int):
        return repr(round(float(v), 6))
    if isinstance(v, list | tuple):
        return repr([plain(x) for x in v])
    if isinstance(v, datetime.date):
        return v.isoformat()
    return repr(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    r = duck.execute(ORACLES[name])
    columns = [c[0] for c in r.description]
    assert sorted(columns) == sorted(df.columns)
    expect = sorted(tuple(plain(row[columns.index(c)]) for c in sorted(columns)) for row in r.fetchall())
    assert sorted(tuple(map(plain, row)) for row in df.select(*[f"`{c}`" for c in sorted(columns)]).collect()) == expect
