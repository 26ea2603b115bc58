"""Candidates of queries: seeds for expansion, and the merge of lexical, semantic, name and graph hits.

Hits are (query_id, id, score); expansion adds depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scale as S
from ..functions import text as T

# Seeds per source, name terms of a query, and the weight of lexical seeds.
SEEDS, NAME_TERMS, LEXICAL_SEED, NAME_BOOST = 12, 16, 0.9, 1.05
SOURCES = ("lexical", "semantic", "name", "graph")


def parse(queries: DataFrame) -> DataFrame:
    """queries (query_id, query) with tokens and identifiers."""
    return queries.withColumn("tokens", T.tokenize(F.col("query"))).withColumn("identifiers", T.identifiers(F.col("query")))


def name_terms(queries: DataFrame) -> DataFrame:
    """(query_id, name): the first NAME_TERMS different terms, identifiers before tokens."""
    p = parse(queries)
    low = F.array_distinct(F.transform(F.concat("identifiers", "tokens"), F.lower))
    return p.select("query_id", F.explode(F.slice(low, 1, NAME_TERMS)).alias("name"))


def first(hits: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return hits.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def seeds(lexical: DataFrame, semantic: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, id, score): best hits of both indexes, exact names at 1, the best SEEDS of all."""
    w = Window.partitionBy("query_id")
    top = first(lexical, SEEDS)
    x = S.min_max(F.col("score"), F.min("score").over(w), F.max("score").over(w))
    a = top.select("query_id", "id", (F.lit(LEXICAL_SEED) * x).alias("score"))
    b = first(semantic, SEEDS).select("query_id", "id", S.clamp01(F.col("score")).alias("score"))
    c = names.select("query_id", "id", F.lit(1.0).alias("score"))
    return first(a.union(b).union(c).groupBy("query_id", "id").agg(F.max("score").alias("score")), SEEDS)


def merge(lexical: DataFrame, semantic: DataFrame, names: DataFrame, graph: DataFrame) -> DataFrame:
    """(query_id, id, sources, lexical, semantic, graph, depth) with null for a signal that a candidate lacks.

    An exact name raises the lexical signal to 1.05 times the query's best (1 without lexical hits). Sources stand
    in the order they were met: lexical, semantic, name (as lexical), graph.
    """
    best = lexical.groupBy("query_id").agg(F.max("score").alias("best"))
    named = names.select("query_id", "id").distinct().join(best, "query_id", "left").select("query_id", "id", F.coalesce(F.col("best") * NAME_BOOST, F.lit(1.0)).alias("score"))
    rows = (
        lexical.select("query_id", "id", "score", F.lit(0).alias("s"), F.lit(0).alias("depth"))
        .union(semantic.select("query_id", "id", S.clamp01(F.col("score")), F.lit(1), F.lit(0)))
        .union(named.select("query_id", "id", "score", F.lit(2), F.lit(0)))
        .union(graph.select("query_id", "id", "score", F.lit(3), F.col("depth").cast("int")))
    )

    def top(*of):
        return F.max(F.when(F.col("s").isin(*of), F.col("score")))

    met = F.array_sort(F.collect_set("s"))
    labels = F.array_distinct(F.transform(met, lambda s: F.when(s == 1, "semantic").when(s == 3, "graph").otherwise("lexical")))
    return rows.groupBy("query_id", "id").agg(
        labels.alias("sources"), top(0, 2).alias("lexical"), top(1).alias("semantic"), top(3).alias("graph"), F.min("depth").alias("depth")
    )
