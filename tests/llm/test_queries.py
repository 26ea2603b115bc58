"""Registered queries of the text operators over the smallest tables, against their oracle SQL or their promises."""

import duckdb
import pytest

from tesselon.llm import queries

QUERIES, ORACLE = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(name, spark, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    result = db.execute(ORACLE[name])
    names = sorted(d[0] for d in result.description)
    assert sorted(df.columns) == names
    rows = result.fetchall()
    columns = [d[0] for d in result.description]
    theirs = sorted(repr([r[columns.index(n)] for n in names]) for r in rows)
    assert sorted(repr([r[n] for n in names]) for r in df.collect()) == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_one_row_for_each_document(name, spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = QUERIES[name](spark, sf_dir).select("doc_id")
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_one_query_for_each_operator():
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 11)] == [1] * 10
