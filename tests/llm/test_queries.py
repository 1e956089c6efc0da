import math
import sys

import duckdb
import pytest

from lexloom.llm import queries

SF = "/root/testdata/sf0.001"


def test_every_operator_has_its_query():
    names = set(queries.queries())
    assert {n.partition("_")[0] for n in names} >= {f"op{i}" for i in range(1, 14)} and set(queries.oracle_sql()) <= names


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_gives_the_same_rows(spark, name):
    base = duckdb.connect()
    for table in ("documents", "pages", "labels"):
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    own = queries.queries()[name](spark, SF)
    found = base.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(own.columns)
    mine = sorted((tuple(r[c] for c in columns) for r in own.collect()), key=str)
    known = sorted(found.fetchall(), key=str)
    assert len(mine) == len(known)
    for a, b in zip(mine, known, strict=True):
        assert all(math.isclose(x, y, abs_tol=0.011) if isinstance(x, float) else x == y for x, y in zip(a, b, strict=True))


def test_a_missing_library_leaves_the_other_queries(monkeypatch):
    monkeypatch.setitem(sys.modules, "ahocorasick", None)
    monkeypatch.delitem(sys.modules, "lexloom.llm.tokencount", raising=False)
    import __spark_entry__

    assert {"op2_viterbi_counts", "op7_simhash", "bm25_topk"} <= set(__spark_entry__.queries())
