"""Every query against its SQL at the smallest scale."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from maskloom.plans.oracles import ORACLE_SQL
from maskloom.plans.queries import QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rounded(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = Counter(tuple(rounded(r[c]) for c in columns) for r in df.collect())
    assert got
    res = duck.execute(ORACLE_SQL[name])  # every query of the engine has SQL
    there = [d[0] for d in res.description]
    assert sorted(there) == columns
    assert got == Counter(tuple(rounded(r[there.index(c)]) for c in columns) for r in res.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
