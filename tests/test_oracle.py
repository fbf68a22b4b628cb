"""Every registered query equals its DuckDB oracle SQL on the smallest data."""

import datetime as dt
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
QUERIES = entry.queries()
ORACLE = entry.oracle_sql()


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return f"{round(float(v), 6):.6f}"
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    return str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con(small_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{small_dir}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_query_has_oracle():
    own = {k for k in QUERIES if not k.startswith("op") and k != "pipeline"}
    assert set(ORACLE) <= set(QUERIES) and own <= set(ORACLE)
    assert len(own) >= 100


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_oracle(spark, small_dir, con, key):
    df = QUERIES[key](spark, small_dir)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    cur = con.execute(ORACLE[key])
    d_cols = [d[0] for d in cur.description]
    d_rows = cur.fetchall()
    assert sorted(s_cols) == sorted(d_cols)
    assert _rows(s_cols, s_rows) == _rows(d_cols, d_rows)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["webhook_id", "request_no", "first_height", "last_height", "n_blocks"]
    assert df.count() > 0
