"""Queries with oracle SQL equal it on the smallest data; those without are tested in their own files."""

import duckdb
import pytest

import __spark_entry__ as entry
from chainlake.llm import queries

TABLES = ["documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    return f"{v:.9f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, small_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{small_dir}/{t}.parquet')")
    got = queries.QUERIES[name](spark, small_dir)
    cur = con.execute(queries.ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted(tuple(map(_norm, r)) for r in cur.fetchall())
    assert sorted(tuple(map(_norm, r)) for r in got.select(*names).collect()) == want


def test_all_registered():
    names = set(entry.queries())
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
