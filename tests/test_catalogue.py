"""Every query of the catalogue against its SQL, at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from quarry.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def spelled(v):
    return "%.9g" % v if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows(spark, sf, con, name):
    df = catalogue.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    cur = con.execute(catalogue.SQL[name])
    theirs = [d[0] for d in cur.description]
    assert sorted(theirs) == cols
    want = sorted(tuple(spelled(r[theirs.index(c)]) for c in cols) for r in cur.fetchall())
    assert sorted(tuple(spelled(r[c]) for c in cols) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs_without_sql(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["question_id", "id", "score", "rank"]
    assert set(catalogue.QUERIES) <= set(entry.queries())
