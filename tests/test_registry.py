"""Every registered query that has oracle SQL gives the same rows as DuckDB over the same tables."""

import math

import duckdb
import pytest

from tesselon.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return repr(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(name, spark, sf_dir, db):
    df = QUERIES[name](spark, sf_dir)
    got = df.collect()
    result = db.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    ours = sorted(tuple(cell(r[n]) for n in order) for r in got)
    theirs = sorted(tuple(cell(r[names.index(n)]) for n in order) for r in result.fetchall())
    assert ours == theirs and ours


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
