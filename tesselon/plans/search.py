"""Registered queries: text, lexical and vector search, candidates, ranking, packing."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bm25, candidates, expand, pack, rank, vectors
from ..sources.checkpoints import checkpointed
from . import tables as D
from .tables import SQL_CORPUS, SQL_QUERIES, sql_tokens

LIMIT = 100
SQL_BM25 = f"""{SQL_QUERIES}, {SQL_CORPUS}, {sql_tokens('corpus', 'tok')},
qin AS (SELECT query_id AS id, query AS text FROM q), {sql_tokens('qin', 'qtok')},
qt AS (SELECT DISTINCT id AS query_id, term FROM qtok),
tf AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY ALL),
len AS (SELECT corpus.id, count(tok.id) AS len FROM corpus LEFT JOIN tok USING (id) GROUP BY ALL),
st AS (SELECT count(*) AS n, coalesce(avg(len), 0) AS avgdl FROM len),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
sc AS (SELECT query_id, tf.id, sum(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * (tf * 2.2e0) /
    (tf + 1.2e0 * (0.25e0 + 0.75e0 * len / CASE WHEN avgdl = 0 THEN 1 ELSE avgdl END))) AS score
  FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN len ON len.id = tf.id, st GROUP BY ALL),
lex AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM sc WHERE score > 0 QUALIFY rank <= {LIMIT})"""


def bm25_topk(spark, sf):
    got = bm25.search(D.corpus(spark, sf), D.queries(spark), LIMIT)
    return got.select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


def bm25_stored(spark, sf):
    """The same search over stored postings and lengths."""
    c = D.corpus(spark, sf)
    index = checkpointed(bm25.postings(c).repartition("term").sortWithinPartitions("term"))
    got = bm25.search_index(index, checkpointed(bm25.stored_lengths(index, c)), D.queries(spark), LIMIT)
    return got.select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


def hashed_vectors(spark, sf):
    """Cells of the unit vectors that are not 0."""
    v = vectors.hashed_embedding(D.corpus(spark, sf)).select(F.col("id").alias("doc_id"), F.posexplode("v").alias("idx", "val"))
    return v.where("val <> 0").select("doc_id", "idx", F.round(F.col("val").cast("double"), 5).alias("val"))


def token_tf(spark, sf):
    return bm25.postings(D.corpus(spark, sf)).select(F.col("id").alias("doc_id"), "term", "tf")


def df_idf(spark, sf):
    c = D.corpus(spark, sf)
    df = bm25.corpus_frequency(c).withColumn("_k", F.lit(1))
    n = c.agg(F.count("*").alias("n")).withColumn("_k", F.lit(1))
    return df.join(F.broadcast(n), "_k").select("term", "df", F.round(bm25.idf(F.col("df"), F.col("n")), 6).alias("idf"))


def doc_length_stats(spark, sf):
    return bm25.statistics(bm25.lengths(D.corpus(spark, sf))).select("n", F.round("avgdl", 6).alias("avgdl"))


def query_parse(spark, sf):
    c = D.table(spark, sf, "conversations").where("role = 'user'")
    p = candidates.parse(c.select("conv_id", "turn", F.col("text").alias("query")))
    return p.select("conv_id", "turn", F.array_join("tokens", " ").alias("tokens"), F.array_join("identifiers", " ").alias("identifiers"))


def token_estimate(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


def snippet(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", T.snippet(F.col("text"), 240).alias("snippet"))


def truncate_lines(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", F.sha1(T.truncate_lines(F.col("text"), 600)).alias("digest"))


def identifier_parts(spark, sf):
    w = D.corpus(spark, sf).select(F.explode(F.regexp_extract_all("text", F.lit(T.WORD), F.lit(0))).alias("word")).distinct()
    return w.select("word", F.array_join(T.split_identifier(F.col("word")), " ").alias("parts"))


def knn_exact(spark, sf, block: int = 4096):
    """Every vector whose id is divisible by 50, against all vectors, in blocks of queries."""
    v = D.vectors(spark, sf)
    asked = v.where("id % 50 = 0 AND v IS NOT NULL")
    blocks = max(1, math.ceil(asked.count() / block))
    out = None
    for b in range(blocks):
        own = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        got = vectors.nearest(v, [(r["id"], list(r["v"])) for r in own.orderBy("id").collect()], 10)
        out = got if out is None else out.union(got)
    return out.select("query_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


SQL_NORM = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings)"


def hashed_embedding(spark, sf):
    c = vectors.hashed_sparse(D.corpus(spark, sf))
    return c.select(F.col("id").alias("doc_id"), "idx", F.round("val", 6).alias("val"))


SQL_FNV = "(list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(term, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: ((xor(h, c)::HUGEINT * 16777619) % 4294967296)::BIGINT))"


def _chunks(spark, sf):
    return D.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.sha1("text").alias("hash"))


def _stored(spark, sf):
    """A store of vectors of an earlier state: odd texts have changed, every seventh id has gone."""
    d = D.table(spark, sf, "documents")
    old = F.when(F.col("n_chars") % 2 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return d.select((F.col("doc_id") + F.when(F.col("doc_id") % 7 == 3, 1_000_000_000).otherwise(0)).alias("id"), F.sha1(old).alias("hash"))


SQL_STORED = """chunks AS (SELECT doc_id AS id, sha1(text) AS hash FROM documents),
stored AS (SELECT doc_id + CASE WHEN doc_id % 7 = 3 THEN 1000000000 ELSE 0 END AS id, sha1(CASE WHEN n_chars % 2 = 1 THEN text || '!' ELSE text END) AS hash FROM documents)"""


def vec_cache_misses(spark, sf):
    return vectors.cache_misses(_chunks(spark, sf), _stored(spark, sf)).select("id", "hash")


def vec_prune(spark, sf):
    return vectors.pruned(_stored(spark, sf), _chunks(spark, sf)).select("id", "hash")


# --- candidates --------------------------------------------------------------------------------------------
def _lexical(spark, sf):
    return checkpointed(bm25.search(D.corpus(spark, sf), D.queries(spark), LIMIT).select("query_id", F.col("id").cast("string").alias("id"), "score"))


def _semantic(spark, sf):
    """Vectors stand for documents of the same number; each query asks for the vector of its own number."""
    v = D.vectors(spark, sf)
    asked = v.where(F.col("id").isin(*D.QUERIES)).orderBy("id").collect()
    got = vectors.nearest(v, [(r["id"], list(r["v"])) for r in asked], LIMIT)
    return got.select(F.col("query_id").cast("int").alias("query_id"), F.col("id").cast("string").alias("id"), "score")


def _names(spark, sf):
    terms = candidates.name_terms(D.queries(spark))
    d = D.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.substring_index("text", " ", 1).alias("name"))
    return d.withColumn("_n", F.lower("name")).join(F.broadcast(terms.withColumnRenamed("name", "_n")), "_n").select("query_id", "id")


def _graph(spark, sf):
    """Expansion hits of a fixed form: each document passes 0.6 of its length rank to the query of its number."""
    d = D.table(spark, sf, "documents")
    return d.select((F.pmod("doc_id", F.lit(4)) + 1).cast("int").alias("query_id"), F.col("doc_id").cast("string").alias("id"), (F.lit(0.6) * F.col("n_chars") / (F.col("n_chars") + 1000)).alias("score"), (F.pmod("doc_id", F.lit(2)) + 1).cast("int").alias("depth"))


SQL_HITS = f"""{SQL_BM25}, {SQL_NORM},
lexical AS (SELECT query_id, id::VARCHAR AS id, score FROM lex),
sem AS (SELECT a.id::INTEGER AS query_id, b.id::VARCHAR AS id, list_dot_product(a.e, b.e) / (CASE WHEN a.n = 0 THEN 1 ELSE a.n END * CASE WHEN b.n = 0 THEN 1 ELSE b.n END) AS score, b.id AS bid
  FROM v a, v b WHERE a.id IN ({', '.join(map(str, D.QUERIES))})),
semantic AS (SELECT query_id, id, score FROM sem QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, bid) <= {LIMIT}),
piece AS (SELECT query_id, query, generate_subscripts(s, 1) AS k, regexp_replace(unnest(s), '^\\.+|\\.+$', '', 'g') AS p FROM (SELECT *, regexp_split_to_array(query, '[^A-Za-z0-9_$.]+') AS s FROM q)),
idt AS (SELECT query_id, lower(p) AS name, min(k) AS k, 0 AS g FROM piece WHERE length(p) >= 3 AND regexp_full_match(p, '[A-Za-z_$][A-Za-z0-9_$.]*') GROUP BY ALL),
nterm AS (SELECT DISTINCT query_id, name FROM (SELECT query_id, name FROM idt UNION ALL SELECT id, term FROM qtok)),
names AS (SELECT query_id, doc_id::VARCHAR AS id FROM documents JOIN nterm ON lower(split_part(text, ' ', 1)) = name),
graph AS (SELECT (doc_id % 4 + 1)::INTEGER AS query_id, doc_id::VARCHAR AS id, 0.6e0 * n_chars / (n_chars + 1000) AS score, (doc_id % 2 + 1)::INTEGER AS depth FROM documents)"""


def name_match(spark, sf):
    return _names(spark, sf).select("query_id", F.col("id").alias("doc_id"))


def seed_select(spark, sf):
    got = candidates.seeds(_lexical(spark, sf), _semantic(spark, sf), _names(spark, sf))
    return got.select("query_id", "id", F.round("score", 6).alias("score"))


SQL_SEEDS = """
l12 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS r FROM lexical QUALIFY r <= 12),
s12 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS r FROM semantic QUALIFY r <= 12),
a AS (SELECT query_id, id, 0.9e0 * CASE WHEN hi - lo < 1e-12 THEN 0.5e0 ELSE (score - lo) / (hi - lo) END AS score
  FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM l12)),
u AS (SELECT * FROM a UNION ALL SELECT query_id, id, greatest(0e0, least(1e0, score)) FROM s12 UNION ALL SELECT query_id, id, 1e0 FROM names),
m AS (SELECT query_id, id, max(score) AS score FROM u GROUP BY ALL)
SELECT query_id, id, round(score, 6) AS score FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(m.score, 9) DESC, id) <= 12"""


def _merged(spark, sf):
    return candidates.merge(_lexical(spark, sf), _semantic(spark, sf), _names(spark, sf), _graph(spark, sf))


SQL_MERGED = f"""{SQL_HITS},
best AS (SELECT query_id, max(score) AS best FROM lexical GROUP BY ALL),
named AS (SELECT DISTINCT query_id, id, coalesce(best * 1.05e0, 1e0) AS score FROM names LEFT JOIN best USING (query_id)),
rows_ AS (SELECT query_id, id, score, 0 AS s, 0 AS depth FROM lexical
  UNION ALL SELECT query_id, id, greatest(0e0, least(1e0, score)), 1, 0 FROM semantic
  UNION ALL SELECT query_id, id, score, 2, 0 FROM named
  UNION ALL SELECT query_id, id, score, 3, depth FROM graph),
cand AS (SELECT query_id, id, list_sort(list(DISTINCT s)) AS met, max(score) FILTER (s IN (0, 2)) AS lexical, max(score) FILTER (s = 1) AS semantic,
  max(score) FILTER (s = 3) AS graph, min(depth) AS depth FROM rows_ GROUP BY ALL)"""


def candidate_merge(spark, sf):
    c = _merged(spark, sf)
    return c.select("query_id", "id", F.array_join("sources", ",").alias("sources"), *[F.round(s, 6).alias(s) for s in ("lexical", "semantic", "graph")], "depth")


SQL_SIGNALS = f"""{SQL_MERGED},
sig AS (SELECT query_id, id, lexical, semantic, graph, n_chars::DOUBLE / (n_chars + 500) AS centrality, CASE WHEN doc_id % 5 <> 0 THEN 1e0 / (1 + doc_id % 9) END AS recency
  FROM cand LEFT JOIN documents ON id = doc_id::VARCHAR)"""


def _signals(spark, sf):
    d = D.table(spark, sf, "documents")
    d = d.select(F.col("doc_id").cast("string").alias("id"), (F.col("n_chars") / (F.col("n_chars") + 500)).alias("centrality"), F.when(F.col("doc_id") % 5 != 0, F.lit(1.0) / (1 + F.col("doc_id") % 9)).alias("recency"))
    return _merged(spark, sf).drop("sources", "depth").join(d, "id", "left")


_SIGNALS = ["lexical", "semantic", "graph", "centrality", "recency"]


def rank_weighted(spark, sf):
    got = rank.best(rank.weighted(_signals(spark, sf), _SIGNALS), 20)
    return got.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def rank_rrf(spark, sf):
    got = rank.best(rank.reciprocal(_signals(spark, sf), _SIGNALS), 20)
    return got.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def _sql_share() -> str:
    own = ", ".join(f"CASE WHEN count({s}) OVER w > 0 THEN {rank.WEIGHTS[s]}e0 ELSE 0e0 END AS w_{s}" for s in _SIGNALS)
    return f"sh AS (SELECT *, {own} FROM sig WINDOW w AS (PARTITION BY query_id)), tot AS (SELECT *, {' + '.join('w_' + s for s in _SIGNALS)} AS w_all FROM sh)"


def _sql_weighted() -> str:
    parts = []
    for s in _SIGNALS:
        if s in rank.QUERY_SIGNALS:
            x = f"CASE WHEN {s} IS NULL THEN 0e0 WHEN max({s}) OVER w - min({s}) OVER w < 1e-12 THEN 1e0 ELSE ({s} - min({s}) OVER w) / (max({s}) OVER w - min({s}) OVER w) END"
        else:
            x = f"CASE WHEN {s} IS NULL THEN 0e0 ELSE greatest(0e0, least(1e0, {s})) END"
        parts.append(f"w_{s} / w_all * ({x})")
    return f"""WITH {SQL_SIGNALS}, {_sql_share()}, sco AS (SELECT query_id, id, {' + '.join(parts)} AS score FROM tot WINDOW w AS (PARTITION BY query_id))
SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(sco.score, 9) DESC, id)::INTEGER AS rank FROM sco QUALIFY rank <= 20"""


def _sql_rrf() -> str:
    parts = [f"w_{s} / w_all * 61e0 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY round({s}, 9) DESC NULLS LAST, id))" for s in _SIGNALS]
    return f"""WITH {SQL_SIGNALS}, {_sql_share()}, sco AS (SELECT query_id, id, {' + '.join(parts)} AS score FROM tot)
SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(sco.score, 9) DESC, id)::INTEGER AS rank FROM sco QUALIFY rank <= 20"""


def topk_per_query(spark, sf):
    d = D.table(spark, sf, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"))
    return rank.best(d, 5).select("query_id", "id", "score", "rank")


# --- packing -----------------------------------------------------------------------------------------------
def trim_to_budget(spark, sf):
    d = D.table(spark, sf, "documents").select("source", F.col("doc_id").alias("i"), T.token_estimate(F.col("text")).alias("tokens"))
    return pack.trim(d, 12_000, "source").select("source", F.col("i").alias("doc_id"), "tokens", "used")


def _ranked_items(spark, sf):
    d = D.table(spark, sf, "documents")
    full = T.token_estimate(F.col("text"))
    is_file = F.col("doc_id") % 3 == 0
    r = rank.best(d.select(F.col("source").alias("query_id"), F.col("doc_id").alias("id"), F.pmod(F.col("doc_id") * 7919, F.lit(1009)).cast("double").alias("score"), full.alias("full"), is_file.alias("is_file")), 50)
    return r.select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.col("id").cast("string").alias("id"), F.pmod("id", F.lit(40)).cast("string").alias("file"), "is_file",
        F.lit(None).cast("string").alias("parent"), "full", F.ceil(F.col("full") / 8).cast("long").alias("card"), F.when(F.col("is_file"), F.lit(12)).cast("long").alias("mention"),
    )


def pack_context(spark, sf):
    return pack.pack(_ranked_items(spark, sf))


def retrieve_hybrid(spark, sf):
    """End to end: lexical, semantic and name hits, seeds, expansion over shared first lines, fusion, best 20.

    Hits, seeds, first lines and edges are written once: each is used several times below.
    """
    lexical, semantic, names = _lexical(spark, sf), checkpointed(_semantic(spark, sf)), checkpointed(_names(spark, sf))
    seeds = checkpointed(candidates.seeds(lexical, semantic, names))
    d = checkpointed(D.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.sha1(F.substring_index("text", "\n", 1)).alias("first")))
    heads = d.groupBy("first").agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1")
    e = checkpointed(d.join(heads, "first").where("id <> head").select(F.col("id").alias("src"), F.lit("references").alias("kind"), F.col("head").alias("dst"), F.lit(1.0).alias("weight")))
    found = expand.expand(d.select("id"), e, seeds).select("query_id", "id", "score", "depth")
    c = candidates.merge(lexical, semantic, names, found)
    return rank.best(rank.weighted(c, ["lexical", "semantic", "graph"]), 20).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


QUERIES = {f.__name__: f for f in (
    bm25_topk, bm25_stored, hashed_vectors, token_tf, df_idf, doc_length_stats, query_parse, token_estimate, snippet, truncate_lines, identifier_parts, knn_exact, hashed_embedding,
    vec_cache_misses, vec_prune, name_match, seed_select, candidate_merge, rank_weighted, rank_rrf, topk_per_query, trim_to_budget, pack_context, retrieve_hybrid,
)}

_MARK = T.TRUNCATION_MARK.replace("\n", "' || chr(10) || '")
ORACLE = {
    "bm25_topk": f"WITH {SQL_BM25} SELECT query_id, id AS doc_id, round(score, 6) AS score, rank::INTEGER AS rank FROM lex",
    "token_tf": f"WITH {SQL_CORPUS}, {sql_tokens('corpus', 'tok')} SELECT id AS doc_id, term, count(*) AS tf FROM tok GROUP BY ALL",
    "df_idf": f"WITH {SQL_CORPUS}, {sql_tokens('corpus', 'tok')}, d AS (SELECT term, count(DISTINCT id) AS df FROM tok GROUP BY ALL), n AS (SELECT count(*) AS n FROM corpus) SELECT term, df, round(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)), 6) AS idf FROM d, n",
    "doc_length_stats": f"WITH {SQL_CORPUS}, {sql_tokens('corpus', 'tok')}, l AS (SELECT corpus.id, count(tok.id) AS len FROM corpus LEFT JOIN tok USING (id) GROUP BY ALL) SELECT count(*) AS n, round(avg(len), 6) AS avgdl FROM l",
    "token_estimate": "SELECT doc_id, ceil(length(coalesce(text, '')) / 3.6e0)::BIGINT AS tokens FROM documents",
    "snippet": "SELECT doc_id, CASE WHEN length(text) > 240 THEN text[1:240] || '…' ELSE text END AS snippet FROM documents",
    "truncate_lines": f"""WITH t AS (SELECT doc_id, text, text[1:600] AS h FROM documents), l AS (SELECT *, 600 - length(list_last(string_split(h, chr(10)))) - 1 AS cut_at FROM t)
SELECT doc_id, sha1(CASE WHEN length(text) <= 600 THEN text WHEN contains(h, chr(10)) AND cut_at > 300 THEN h[1:cut_at] || '{_MARK}' ELSE h || '{_MARK}' END) AS digest FROM l""",
    "identifier_parts": r"""WITH c AS (SELECT concat_ws(chr(10), text, source, lang) AS text FROM documents), w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*|\d+')) AS word FROM c)
SELECT word, array_to_string(regexp_extract_all(regexp_replace(regexp_replace(word, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([A-Z])([0-9])', '\1 \2', 'g'), '[A-Z]{2,}|[A-Z][a-z0-9]*|[a-z0-9]+'), ' ') AS parts FROM w""",
    "knn_exact": f"""WITH {SQL_NORM}, s AS (SELECT a.id AS query_id, b.id AS vec_id, list_dot_product(a.e, b.e) / (CASE WHEN a.n = 0 THEN 1 ELSE a.n END * CASE WHEN b.n = 0 THEN 1 ELSE b.n END) AS score FROM v a, v b WHERE a.id % 50 = 0)
SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s.score, 9) DESC, vec_id)::INTEGER AS rank FROM s QUALIFY rank <= 10""",
    "hashed_embedding": f"""WITH {SQL_CORPUS}, {sql_tokens('corpus', 'tok')}, tf AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY ALL), vocab AS (SELECT term, {SQL_FNV} AS h FROM (SELECT DISTINCT term FROM tf))
SELECT id AS doc_id, (h % 256)::INTEGER AS idx, round(sum(CASE WHEN (h >> 16) & 1 = 1 THEN -1e0 ELSE 1e0 END * (1 + ln(tf))), 6) AS val FROM tf JOIN vocab USING (term) GROUP BY ALL""",
    "hashed_vectors": f"""WITH {SQL_CORPUS}, {sql_tokens('corpus', 'tok')}, tf AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY ALL), vocab AS (SELECT term, {SQL_FNV} AS h FROM (SELECT DISTINCT term FROM tf)),
cell AS (SELECT id, (h % 256)::INTEGER AS idx, sum(CASE WHEN (h >> 16) & 1 = 1 THEN -1e0 ELSE 1e0 END * (1 + ln(tf))) AS x FROM tf JOIN vocab USING (term) GROUP BY ALL),
unit AS (SELECT id, idx, (x / sqrt(sum(x * x) OVER (PARTITION BY id)))::FLOAT AS x FROM cell)
SELECT id AS doc_id, idx, round(x::DOUBLE, 5) AS val FROM unit WHERE x <> 0""",
    "vec_cache_misses": f"WITH {SQL_STORED} SELECT id, hash FROM chunks ANTI JOIN stored USING (id, hash)",
    "vec_prune": f"WITH {SQL_STORED} SELECT id, hash FROM stored SEMI JOIN chunks USING (id)",
    "name_match": f"WITH {SQL_HITS} SELECT query_id, id AS doc_id FROM names",
    "seed_select": f"WITH {SQL_HITS}, {SQL_SEEDS}",
    "candidate_merge": f"""WITH {SQL_MERGED} SELECT query_id, id, array_to_string(list_filter([CASE WHEN list_contains(met, 0) THEN 'lexical' END, CASE WHEN list_contains(met, 1) THEN 'semantic' END,
  CASE WHEN list_contains(met, 2) AND NOT list_contains(met, 0) THEN 'lexical' END, CASE WHEN list_contains(met, 3) THEN 'graph' END], lambda x: x IS NOT NULL), ',') AS sources,
  round(lexical, 6) AS lexical, round(semantic, 6) AS semantic, round(graph, 6) AS graph, depth::INTEGER AS depth FROM cand""",
    "rank_weighted": _sql_weighted(),
    "rank_rrf": _sql_rrf(),
    "topk_per_query": "SELECT source AS query_id, doc_id AS id, n_chars::DOUBLE AS score, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id)::INTEGER AS rank FROM documents QUALIFY rank <= 5",
    "trim_to_budget": """WITH t AS (SELECT source, doc_id, ceil(length(coalesce(text, '')) / 3.6e0)::BIGINT AS tokens FROM documents), u AS (SELECT *, (sum(tokens) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS used FROM t)
SELECT source, doc_id, tokens, used FROM u WHERE used <= 12000""",
}


def _sql_query_parse() -> str:
    stop = ", ".join(f"'{w}'" for w in T.STOPWORDS)
    split = r"regexp_extract_all(regexp_replace(regexp_replace(w, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([A-Z])([0-9])', '\1 \2', 'g'), '[A-Z]{2,}|[A-Z][a-z0-9]*|[a-z0-9]+')"
    return rf"""WITH c AS (SELECT row_number() OVER () AS id, conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE role = 'user'),
w AS (SELECT id, generate_subscripts(s, 1) AS k, unnest(s) AS w FROM (SELECT id, regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*|\d+') AS s FROM c)),
p AS (SELECT id, k, lower(w) AS l, {split} AS p FROM w WHERE NOT regexp_full_match(w, '\d+') AND lower(w) NOT IN ({stop})),
t AS (SELECT id, k, 0 AS j, l AS term FROM p WHERE length(l) >= 2 AND (len(p) <= 1 OR length(l) <= 48)
  UNION ALL SELECT id, k, j, x FROM (SELECT id, k, generate_subscripts(p, 1) AS j, lower(unnest(p)) AS x FROM p WHERE len(p) > 1) WHERE length(x) >= 2 AND NOT regexp_full_match(x, '\d+') AND x NOT IN ({stop})),
tok AS (SELECT id, string_agg(term, ' ' ORDER BY k, j) AS tokens FROM t GROUP BY id),
x AS (SELECT id, generate_subscripts(s, 1) AS k, regexp_replace(unnest(s), '^\.+|\.+$', '', 'g') AS p FROM (SELECT id, regexp_split_to_array(text, '[^A-Za-z0-9_$.]+') AS s FROM c)),
y AS (SELECT id, min(k) AS k, min_by(p, k) AS p FROM x WHERE length(p) >= 3 AND regexp_full_match(p, '[A-Za-z_$][A-Za-z0-9_$.]*') GROUP BY id, lower(p)),
idn AS (SELECT id, string_agg(p, ' ' ORDER BY k) AS identifiers FROM y GROUP BY id)
SELECT conv_id, turn, coalesce(tokens, '') AS tokens, coalesce(identifiers, '') AS identifiers FROM c LEFT JOIN tok USING (id) LEFT JOIN idn USING (id)"""


ORACLE["query_parse"] = _sql_query_parse()
ORACLE["bm25_stored"] = ORACLE["bm25_topk"]


def _sql_pack(budget: pack.Budget) -> str:
    """The ladder as one step for each rank: what is left, files given whole, files with code, items inside."""
    return f"""WITH RECURSIVE d AS (SELECT source AS query_id, doc_id, ceil(length(coalesce(text, '')) / 3.6e0)::BIGINT AS tokens, ((doc_id * 7919) % 1009)::DOUBLE AS score, doc_id % 3 = 0 AS is_file FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, (doc_id % 40)::VARCHAR AS file, ceil(tokens / 8e0)::BIGINT AS card FROM d QUALIFY rank <= 50),
st AS (SELECT DISTINCT query_id, 0::BIGINT AS rank, {budget.content}::BIGINT AS rest, []::VARCHAR[] AS whole, []::VARCHAR[] AS coded, NULL::VARCHAR AS form, 0::BIGINT AS cost FROM r
  UNION ALL
  SELECT query_id, rank, rest - CASE WHEN form IS NULL THEN 0 ELSE cost END, CASE WHEN form = 'full' THEN list_append(whole, file) ELSE whole END, CASE WHEN form = 'code' THEN list_append(coded, file) ELSE coded END, form, cost
  FROM (SELECT *, CASE form WHEN 'full' THEN tokens WHEN 'code' THEN tokens WHEN 'mention' THEN 12 ELSE card END AS cost FROM
    (SELECT r.query_id, r.rank, rest, whole, coded, r.file, r.tokens, r.card, CASE WHEN list_contains(whole, r.file) THEN NULL
      WHEN is_file AND NOT list_contains(coded, r.file) AND tokens <= least({budget.file_tokens}, rest) THEN 'full'
      WHEN is_file AND card <= least({budget.tokens}, rest) THEN 'compressed' WHEN is_file AND 12 <= rest THEN 'mention'
      WHEN NOT is_file AND tokens <= least({budget.symbol_tokens}, rest) THEN 'code' WHEN NOT is_file AND card <= least({budget.tokens}, rest) THEN 'card' END AS form
     FROM st JOIN r ON r.query_id = st.query_id AND r.rank = st.rank + 1 WHERE rest > {pack.LEFT_OVER})))
SELECT query_id, rank::INTEGER AS rank, form, cost AS tokens FROM st WHERE form IS NOT NULL"""


ORACLE["pack_context"] = _sql_pack(pack.Budget())


def _sql_retrieve() -> str:
    from .graphs import sql_best_first

    three = ["lexical", "semantic", "graph"]
    parts = []
    for s in three:
        share = f"CASE WHEN count({s}) OVER w > 0 THEN {rank.WEIGHTS[s]}e0 ELSE 0e0 END"
        total = " + ".join(f"CASE WHEN count({x}) OVER w > 0 THEN {rank.WEIGHTS[x]}e0 ELSE 0e0 END" for x in three)
        x = f"CASE WHEN {s} IS NULL THEN 0e0 WHEN max({s}) OVER w - min({s}) OVER w < 1e-12 THEN 1e0 ELSE ({s} - min({s}) OVER w) / (max({s}) OVER w - min({s}) OVER w) END"
        parts.append(f"{share} / ({total}) * ({x})")
    hits = SQL_HITS[: SQL_HITS.rindex(",\ngraph AS")]
    merged = SQL_MERGED[len(SQL_HITS) :]
    seeds, last = SQL_SEEDS.rsplit("\nSELECT", 1)
    # a query has at most 12 seeds, and what a step can look at is a star of documents with one first line
    return f"""WITH RECURSIVE {hits},{seeds},
start AS (SELECT{last.replace("round(score, 6) AS score", "score")}),
fl AS (SELECT doc_id::VARCHAR AS id, split_part(text, chr(10), 1) AS first FROM documents),
nodes AS (SELECT id FROM fl), heads AS (SELECT first, min(id) AS head FROM fl WHERE first IS NOT NULL GROUP BY first HAVING count(*) > 1),
edges AS (SELECT id AS src, 'references' AS kind, head AS dst FROM fl JOIN heads USING (first) WHERE id <> head),
{sql_best_first(expand.Limits())}, graph AS (SELECT query_id, id, score, depth FROM found){merged},
sco AS (SELECT query_id, id, {' + '.join(parts)} AS score FROM cand WINDOW w AS (PARTITION BY query_id))
SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(sco.score, 9) DESC, id)::INTEGER AS rank FROM sco QUALIFY rank <= 20"""


ORACLE["retrieve_hybrid"] = _sql_retrieve()
