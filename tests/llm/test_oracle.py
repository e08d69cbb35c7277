"""Every query of the training-data operators that has SQL against its SQL."""

import glob
import os
import re
from collections import Counter

import duckdb
import pytest

from maskloom.llm import licenses, sharding, suffix
from maskloom.llm.queries import ORACLE_SQL, QUERIES

from test_filters import WRAPPED

DIR = "/root/testdata/sf0.001"


def rounded(v):
    return round(v, 9) if isinstance(v, float) else v


def compare(df, con, sql):
    columns = sorted(df.columns)
    got = Counter(tuple(rounded(r[c]) for c in columns) for r in df.collect())
    res = con.execute(sql)
    there = [d[0] for d in res.description]
    assert sorted(there) == columns
    assert got == Counter(tuple(rounded(r[there.index(c)]) for c in columns) for r in res.fetchall())
    return got


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    assert compare(QUERIES[name](spark, DIR), con, ORACLE_SQL[name])


def test_small_tables(spark):
    """Tables of few rows: walks of one network step and of many, copies, empty and null texts."""
    for n in (1, 2, 5, 17):
        rows = [(k, None if k % 5 == 4 else "" if k % 5 == 3 else "é" * (k % 3) + "some words that stand in all of these texts, fifty bytes and more") for k in range(n)]
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        con = duckdb.connect()
        con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
        assert sum(compare(sharding.shard(docs, 3, 9), con, sharding.oracle_sql(3, 9)).values()) == n
        assert sum(compare(suffix.remove_repeats(docs), con, suffix.ORACLE_SQL).values()) == n


def test_windows_in_sql(spark):
    """Wrapped notices, whole and with words put between, and random words of the templates."""
    import random

    r = random.Random(3)
    vocabulary = [w for ts in licenses.TEMPLATES.values() for t in ts for w in t.split()]
    texts = [*WRAPPED.values(), *(re.sub("\n", "\nlorem ipsum ", t) for t in WRAPPED.values()), None, "", "Cc by-nc\n4.0"]
    texts += ["".join(r.choice(vocabulary) + r.choice([" ", " ", "\n", " x "]) for _ in range(r.randrange(0, 400))) for _ in range(20)]
    texts += [re.sub(" ", lambda m: r.choice([" ", "\n", " q "]), r.choice(ts)) for ts in licenses.TEMPLATES.values() for _ in range(4)]
    rows = list(enumerate(texts))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = compare(licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), windows=True).drop("matches"), con, licenses.windows_sql())
    assert len(got) == len(rows)
