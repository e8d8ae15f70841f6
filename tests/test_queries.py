"""All registered queries against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# models are fitted, which takes long; their operators have tests of their own
SLOW = {"ml_lda", "ml_topic_tokens"}
NAMES = [n for n in entry.queries() if n not in SLOW and not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def canonical(v):
    if isinstance(v, float):
        return round(v, 8) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(canonical, v))
    return v


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = duck.sql(sql)
    names = sorted(found.columns)
    assert sorted(df.columns) == names
    order = [found.columns.index(n) for n in names]
    expected = sorted((tuple(canonical(r[k]) for k in order) for r in found.fetchall()), key=repr)
    assert sorted((tuple(canonical(r[n]) for n in names) for r in rows), key=repr) == expected


def test_entry(spark):
    assert entry.entry(spark).count() > 0
