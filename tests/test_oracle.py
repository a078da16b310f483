"""Every registered query with SQL against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

import factloom.plans as plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def rows(data, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([norm(r[i]) for i in order] for r in data), key=lambda r: [(x is None, str(type(x)), str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, name):
    df = plans.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    assert got
    if name not in plans.SQL:
        return
    want = con.sql(plans.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(got, df.columns) == rows(want.fetchall(), want.columns)
