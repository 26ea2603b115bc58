"""The engine's model over the input tables: corpus, vectors, graph, history, telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G

#: Queries that the registered searches ask.
QUERIES = {
    1: "apache license version and the general public license",
    2: "where does the passwordToken come from",
    3: "oneth resh thehand clown idiot",
    4: "elle queeau dansLeMent vers",
}
#: The moment from which recency counts: 2024-06-01 00:00 UTC.
NOW_MS = 1717200000000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"({k}, '{q}')" for k, q in QUERIES.items())
    return spark.sql(f"SELECT CAST(query_id AS INT) AS query_id, query FROM VALUES {rows} AS t(query_id, query)")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat_ws("\n", "text", "source", "lang").alias("text"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(name, prefix, key, label, kind):
        t = table(spark, sf_dir, name)
        return t.select(F.concat(F.lit(prefix + ":"), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("kind"), F.col(label).alias("name"))

    return (
        of("region", "reg", "r_regionkey", "r_name", "repository")
        .union(of("nation", "nat", "n_nationkey", "n_name", "directory"))
        .union(of("customer", "cus", "c_custkey", "c_name", "file"))
        .union(of("supplier", "sup", "s_suppkey", "s_name", "module"))
        .union(of("part", "part", "p_partkey", "p_name", "class"))
    )


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    def edge(df, a, b, kind):
        return df.select(a.alias("src"), F.lit(kind).alias("kind"), b.alias("dst"), F.lit(1.0).alias("weight"))

    def ident(prefix, key):
        return F.concat(F.lit(prefix + ":"), F.col(key).cast("string"))

    nation, customer, supplier = (table(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    bought = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    return (
        edge(nation, ident("reg", "n_regionkey"), ident("nat", "n_nationkey"), "contains")
        .union(edge(customer, ident("nat", "c_nationkey"), ident("cus", "c_custkey"), "contains"))
        .union(edge(supplier, ident("nat", "s_nationkey"), ident("sup", "s_suppkey"), "contains"))
        .union(edge(items, ident("part", "l_partkey"), ident("sup", "l_suppkey"), "imports"))
        .union(edge(bought, ident("cus", "o_custkey"), ident("part", "l_partkey"), "calls"))
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.merged_edges(raw_edges(spark, sf_dir))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a repository: one per page, its path from the address."""
    p = table(spark, sf_dir, "pages")
    path = F.regexp_replace("url", "^[a-z]+://[^/]*/", "")
    return p.select(F.col("page_id").alias("id"), path.alias("path"), F.size(F.split("html", "\n")).cast("long").alias("loc"), F.sha1("html").alias("hash"), F.col("html").alias("text"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("path"), F.col("user_id").cast("string").alias("author"), (F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")) / 1000).cast("long").alias("at_ms"), "value")


SQL_QUERIES = "q(query_id, query) AS (VALUES " + ", ".join(f"({k}::INTEGER, '{v}')" for k, v in QUERIES.items()) + ")"

SQL_CORPUS = "corpus AS (SELECT doc_id AS id, concat_ws(chr(10), text, source, lang) AS text FROM documents)"

SQL_NODES = """nodes AS (
  SELECT 'reg:' || r_regionkey AS id, 'repository' AS kind, r_name AS name FROM region
  UNION ALL SELECT 'nat:' || n_nationkey, 'directory', n_name FROM nation
  UNION ALL SELECT 'cus:' || c_custkey, 'file', c_name FROM customer
  UNION ALL SELECT 'sup:' || s_suppkey, 'module', s_name FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'class', p_name FROM part)"""

SQL_EDGES = """raw AS (
  SELECT 'reg:' || n_regionkey AS src, 'contains' AS kind, 'nat:' || n_nationkey AS dst, 1e0 AS weight FROM nation
  UNION ALL SELECT 'nat:' || c_nationkey, 'contains', 'cus:' || c_custkey, 1e0 FROM customer
  UNION ALL SELECT 'nat:' || s_nationkey, 'contains', 'sup:' || s_suppkey, 1e0 FROM supplier
  UNION ALL SELECT 'part:' || l_partkey, 'imports', 'sup:' || l_suppkey, 1e0 FROM lineitem
  UNION ALL SELECT 'cus:' || o_custkey, 'calls', 'part:' || l_partkey, 1e0 FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
edges AS (SELECT src, kind, dst, sum(weight) AS weight, count(*) AS n FROM raw WHERE src <> dst GROUP BY ALL)"""

SQL_PAGES = """files AS (SELECT page_id AS id, regexp_replace(url, '^[a-z]+://[^/]*/', '') AS path,
  len(string_split(html, chr(10)))::BIGINT AS loc, sha1(html) AS hash, html AS text FROM pages)"""

SQL_EVENTS = "history AS (SELECT event_type AS path, user_id::VARCHAR AS author, epoch_us(ts) // 1000 AS at_ms, value FROM events)"


def sql_tokens(source: str, to: str) -> str:
    """Common table expressions that tokenize source(id, text) into to(id, term), without lookahead."""
    from ..functions.text import STOPWORDS

    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    split = r"regexp_extract_all(regexp_replace(regexp_replace(w, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([A-Z])([0-9])', '\1 \2', 'g'), '[A-Z]{2,}|[A-Z][a-z0-9]*|[a-z0-9]+')"
    return rf"""
{to}_w AS (SELECT id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z_$][A-Za-z0-9_$]*|\d+')) AS w FROM {source}),
{to}_p AS (SELECT id, w, lower(w) AS l, {split} AS p FROM {to}_w WHERE NOT regexp_full_match(w, '\d+') AND lower(w) NOT IN ({stop})),
{to} AS (
  SELECT id, l AS term FROM {to}_p WHERE length(l) >= 2 AND (len(p) <= 1 OR length(l) <= 48)
  UNION ALL
  SELECT id, x AS term FROM (SELECT id, lower(unnest(p)) AS x FROM {to}_p WHERE len(p) > 1)
  WHERE length(x) >= 2 AND NOT regexp_full_match(x, '\d+') AND x NOT IN ({stop}))"""
