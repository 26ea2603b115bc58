"""Inverted index and BM25 over a chunk corpus (id, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.checkpoints import checkpointed
from . import terms as terms_of

# Parameters of the scoring formula.
K1, B = 1.2, 0.75


def postings(corpus: DataFrame) -> DataFrame:
    """(id, term, tf). Terms are counted within each text; one shuffle on (id, term) sums up those of an id."""
    return terms_of.counts(corpus).groupBy("id", "term").agg(F.sum("tf").alias("tf"))


def corpus_frequency(corpus: DataFrame) -> DataFrame:
    """document_frequency of the postings of a corpus, where no postings are wanted: terms are made distinct within each
    text, so only sums by term are shuffled. If an id has several texts, pairs of id and term are made distinct first."""
    rows = corpus.select("id", F.explode(T.distinct_terms(F.col("text"))).alias("term"))
    if not corpus.groupBy("id").count().where("count > 1").isEmpty():
        rows = rows.distinct()
    return document_frequency(rows)


def lengths(corpus: DataFrame) -> DataFrame:
    """(id, len) of every document, those without terms too."""
    w = corpus.select("id", F.explode_outer(T.words(F.col("text"))).alias("w"))
    return w.groupBy("id").agg(F.coalesce(F.sum(F.size(T.word_terms(F.col("w")))), F.lit(0)).cast("long").alias("len"))


def stored_lengths(index: DataFrame, corpus: DataFrame) -> DataFrame:
    """The same from postings of the corpus: texts are not split into terms again."""
    of = index.groupBy("id").agg(F.sum("tf").alias("len"))
    return corpus.select("id").distinct().join(of, "id", "left").select("id", F.coalesce("len", F.lit(0)).cast("long").alias("len"))


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"))


def statistics(lens: DataFrame) -> DataFrame:
    return lens.agg(F.count("*").alias("n"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avgdl"))


def idf(df, n):
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def matches(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """Scores of (query_id, id) for queries (query_id, query): one pass over the corpus that keeps query terms only.

    Query terms are a bounded table (queries are few and short) and are sent to every task. A document makes rows of
    those terms and one of all others together; its length is their sum.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct(T.tokenize(F.col("query")))).alias("term"))
    wanted = sorted(r["term"] for r in terms.select("term").distinct().collect())
    counts = terms_of.counts_of(corpus, wanted).groupBy("id", "q").agg(F.sum("tf").alias("tf"))
    # used three times below; plans with lambdas are not recognized as equal, so it is written once instead
    counts = checkpointed(counts)
    lens = counts.groupBy("id").agg(F.sum("tf").alias("len"))
    hits = counts.where("q IS NOT NULL").withColumnRenamed("q", "term")
    n = corpus.agg(F.count("*").alias("n")).withColumn("_k", F.lit(1))
    total = lens.agg(F.coalesce(F.sum("len"), F.lit(0)).alias("total")).withColumn("_k", F.lit(1)).join(F.broadcast(n), "_k")
    df = document_frequency(hits).withColumn("_k", F.lit(1)).join(F.broadcast(total), "_k").drop("_k")  # one row per query term
    scored = hits.join(F.broadcast(df), "term").join(lens, "id")
    length = F.col("len") / F.when(F.col("total") == 0, 1.0).otherwise(F.col("total") / F.col("n"))
    gain = idf(F.col("df"), F.col("n")) * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * length))
    scored = scored.select("id", "term", gain.alias("gain"))
    return scored.join(F.broadcast(terms), "term").groupBy("query_id", "id").agg(F.sum("gain").alias("score")).where("score > 0")


def search(corpus: DataFrame, queries: DataFrame, limit: int = 100) -> DataFrame:
    """Best `limit` documents of each query: (query_id, id, score, rank)."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return matches(corpus, queries).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


# --- persisted index ---------------------------------------------------------------------------------------
def search_index(index: DataFrame, lens: DataFrame, queries: DataFrame, limit: int = 100) -> DataFrame:
    """The same over stored postings (sorted by term, so the scan reads the row groups of the query's terms)."""
    terms = queries.select("query_id", F.explode(F.array_distinct(T.tokenize(F.col("query")))).alias("term"))
    total = statistics(lens).withColumn("_k", F.lit(1))
    hit = index.join(F.broadcast(terms.select("term").distinct()), "term")
    df = document_frequency(hit).withColumn("_k", F.lit(1)).join(F.broadcast(total), "_k").drop("_k")
    scored = hit.join(F.broadcast(df), "term").join(lens, "id")
    length = F.col("len") / F.when(F.col("avgdl") == 0, 1.0).otherwise(F.col("avgdl"))
    gain = idf(F.col("df"), F.col("n")) * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * length))
    scored = scored.select("id", "term", gain.alias("gain")).join(F.broadcast(terms), "term")
    scored = scored.groupBy("query_id", "id").agg(F.sum("gain").alias("score")).where("score > 0")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
