"""Every registered query against its DuckDB oracle on the smallest supplied
tables (the same comparison the driver makes at sf0.01)."""

import datetime as dt
import math
from collections import Counter

import duckdb
import pytest

from sample_data import SF001

from __spark_entry__ import entry, oracle_sql, queries

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return v


def _bag(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.count() > 0 and df.columns == ["l_shipdate", "l_returnflag", "l_linestatus", "l_quantity"]


@pytest.mark.parametrize("key", sorted(queries()))
def test_query_matches_oracle(spark, duck, key):
    df = queries()[key](spark, SF001)
    rows = [tuple(r) for r in df.collect()]
    sql = oracle_sql().get(key)
    if sql is None:
        assert isinstance(rows, list)
        return
    res = duck.execute(sql)
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _bag(df.columns, rows) == _bag(dcols, res.fetchall())
