"""The training-data queries that SQL can say, against DuckDB on the same tables."""

import glob
import os

import duckdb
import pytest

from lexiloom.llm import queries, sql


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_same_as_sql(spark, data, duck, name):
    df = queries.queries()[name](spark, data)
    cols = sorted(df.columns)
    res = duck.execute(sql.SQL[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == cols
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    assert got == sorted((tuple(r[names.index(c)] for c in cols) for r in res.fetchall()), key=repr) and got
