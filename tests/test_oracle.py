"""Every relational query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from quarry.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    cursor = duck.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    got = sorted(tuple(plain(v) for v in r) for r in df.select(*names).collect())
    assert got == sorted(tuple(plain(v) for v in r) for r in cursor.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["o_orderkey", "o_totalprice", "c_name", "c_mktsegment"] and df.count() > 0


def test_ordered_results(spark):
    ranged = [r["event_id"] for r in QUERIES["clustering_range_scan"](spark, FOLDER).collect()]
    assert ranged == sorted(ranged)
    page = [r["p_partkey"] for r in QUERIES["list_records_page"](spark, FOLDER).collect()]
    assert page == sorted(page)
    assert [r["n"] for r in QUERIES["hot_keys_top5"](spark, FOLDER).collect()] == sorted((r["n"] for r in QUERIES["hot_keys_top5"](spark, FOLDER).collect()), reverse=True)
