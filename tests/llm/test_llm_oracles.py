"""Queries with SQL against DuckDB over whole tables; every query's rows and columns."""

import pytest

from riskloom.llm.queries import QUERIES, SQL
from tools.check_oracles import frame_digest


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, duck, name):
    out = QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in out.collect()]
    rel = duck.execute(SQL[name])
    cols, want = [d[0] for d in rel.description], rel.fetchall()
    assert sorted(cols) == sorted(out.columns)
    assert frame_digest(out.columns, rows)[0] == frame_digest(cols, want)[0]


def test_all_queries_are_registered():
    from __spark_entry__ import oracle_sql, queries

    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(queries())
    assert set(SQL) <= set(oracle_sql())
