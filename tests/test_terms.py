"""Terms counted text by text: the same as by Catalyst, and cells of a text without a shuffle."""

import pytest
from pyspark.sql import functions as F

from tesselon.functions import text as T
from tesselon.operators import bm25, terms, vectors

WORDS = ["passwordToken", "HTMLResponse2", "a", "_", "__", "$x", "snake_case_name", "A1b", "AB", "Ab9", "the", "toThe", "x" * 60, "aB" * 30, "12ab", "naïve", "A_1_22", "Token", "token", "TOKEN"]
TEXTS = [(1, " ".join(WORDS)), (2, "auth token\nAuth authToken"), (3, ""), (4, None), (5, "12 34"), (None, "null id token")]


def corpus(spark, rows):
    return spark.createDataFrame(rows, "id long, text string")


def plain(c):
    return sorted(map(str, T.term_rows(c, "text", "id").groupBy("id", "term").agg(F.count("*").alias("tf")).collect()))


@pytest.mark.parametrize("more", [[], [(2, "token again"), (None, "null")]])
def test_same_terms_and_cells(spark, more):
    c = corpus(spark, TEXTS + more)
    assert sorted(map(str, bm25.postings(c).collect())) == plain(c)
    tf = T.term_rows(c, "text", "id").groupBy("id", "term").agg(F.count("*").alias("tf")).withColumn("h", T.fnv1a32(F.col("term")))
    want = {}
    for r in tf.withColumn("x", 1 + F.log("tf")).collect():
        key = (r.id, r.h % vectors.DIMENSIONS)
        want[key] = want.get(key, 0.0) + (-r.x if r.h >> vectors.SIGN_BIT & 1 else r.x)
    got = {(r.id, r.idx): r.val for r in vectors.hashed_sparse(c).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_cells_without_a_shuffle(spark):
    """Terms are neither dealt out nor made rows where each id has one text."""
    plan = vectors.hashed_sparse(corpus(spark, TEXTS))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_wanted_terms(spark):
    c = corpus(spark, TEXTS)
    wanted = ["password", "token", "absent"]
    got = sorted(map(str, terms.counts_of(c, wanted).collect()))
    rows = T.term_rows(c, "text", "id").withColumn("q", F.when(F.col("term").isin(wanted), F.col("term")))
    assert got == sorted(map(str, rows.groupBy("id", "q").agg(F.count("*").alias("tf")).collect()))


def test_what_a_task_remembers_is_bounded(monkeypatch):
    monkeypatch.setattr(terms, "SPELLINGS", 3)
    of = terms.Remembered(terms.word_terms)
    assert [of[w] for w in WORDS] == [terms.word_terms(w) for w in WORDS] and len(of) <= 3


def test_retrieval_reads_texts_no_more_than_once_for_each_use(spark, sf_dir):
    """Hits, first lines and edges are written once: what ranks them reads no table again."""
    from tesselon.plans import registry

    plan = registry.queries()["retrieve_hybrid"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan
