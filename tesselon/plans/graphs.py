"""Registered queries: graph merge, statistics, corpus signals, expansion, explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import expand, graph, metrics, report
from ..sources.checkpoints import checkpointed
from . import tables as D
from .tables import SQL_EDGES, SQL_EVENTS, SQL_NODES

def sql_best_first(limits: expand.Limits) -> str:
    """Common table expressions that close one node of each query a step: nodes(id), edges(src, kind, dst) and
    start(query_id, id, score) -> found(query_id, id, score, depth)."""
    kinds = ", ".join(f"('{k}', {v}e0)" for k, v in limits.kinds.items())
    return f"""kw(kind, k) AS (VALUES {kinds}),
adj AS (SELECT src AS id, dst AS other, kind FROM edges UNION ALL SELECT dst, src, kind FROM edges),
nb AS (SELECT id, count(*) AS degree, list({{'o': other, 'k': coalesce(k, {expand.OTHER_KIND}e0)}}) AS ns FROM adj LEFT JOIN kw USING (kind) GROUP BY id),
bfs AS (SELECT query_id, 0 AS step, list({{'m': -score, 'id': id, 't': 0, 'd': 0}}) AS q, NULL::STRUCT(m DOUBLE, id VARCHAR, t INTEGER, d INTEGER) AS b, []::VARCHAR[] AS done
  FROM (SELECT query_id, id, max(score)::DOUBLE AS score FROM start SEMI JOIN nodes USING (id) GROUP BY ALL) GROUP BY query_id
  UNION ALL
  SELECT query_id, step + 1, list_filter(list_concat(q, CASE WHEN best.d >= {limits.depth} OR -best.m < {limits.least}e0 OR (best.d > 0 AND degree > {limits.hub}) OR ns IS NULL THEN []
      ELSE list_transform(list_filter(ns, lambda n: NOT list_contains(closed, n.o)), lambda n: {{'m': best.m * {limits.decay}e0 * n.k, 'id': n.o, 't': step + 1, 'd': best.d + 1}}) END), lambda x: x.id <> best.id),
    best, list_append(closed, best.id)
  FROM (SELECT query_id, step, q, list_min(q) AS best, done AS closed FROM bfs WHERE len(q) > 0 AND step < {limits.budget}) s LEFT JOIN nb ON nb.id = s.best.id),
found AS (SELECT query_id, b.id AS id, -b.m AS score, b.d AS depth FROM bfs WHERE b IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY -b.m DESC, b.id) <= {limits.nodes})"""


SEED = "nat:3"
#: The packed part of the graph: what customers call stays, those who call it do not.
CHOSEN = "kind IN ('class', 'module')"


def edge_merge(spark, sf):
    e = graph.merged_edges(D.raw_edges(spark, sf), D.nodes(spark, sf))
    return e.select("src", "kind", "dst", "weight", "n")


def graph_stats(spark, sf):
    return graph.statistics(D.nodes(spark, sf), D.edges(spark, sf))


def degree_fan(spark, sf):
    return graph.degrees(D.edges(spark, sf)).select("id", "degree", F.col("fan_in").cast("long").alias("fan_in"), F.col("fan_out").cast("long").alias("fan_out"))


def _ranks(spark, sf):
    return metrics.pagerank(D.nodes(spark, sf), D.raw_edges(spark, sf).where("src <> dst"))


def pagerank(spark, sf):
    return _ranks(spark, sf).select("id", F.round("rank", 9).alias("rank"))


def centrality(spark, sf):
    return metrics.centrality(_ranks(spark, sf)).select("id", F.round("centrality", 6).alias("centrality"))


def _sql_ranks() -> str:
    rounds = [f"{SQL_NODES}, {SQL_EDGES}", """w AS MATERIALIZED (SELECT src, dst, sum(greatest(weight, 1e-9)) AS w FROM edges GROUP BY ALL),
o AS MATERIALIZED (SELECT src, sum(w) AS t FROM w GROUP BY ALL), sh AS MATERIALIZED (SELECT w.src, dst, w / t AS s FROM w JOIN o ON w.src = o.src),
n AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM nodes), r0 AS MATERIALIZED (SELECT id, 1e0 / n AS r FROM nodes, n)"""]
    for k in range(1, 26):
        p = f"r{k - 1}"
        rounds.append(f"""d{k} AS MATERIALIZED (SELECT coalesce(sum(r), 0) AS d FROM {p} ANTI JOIN o ON {p}.id = o.src),
i{k} AS MATERIALIZED (SELECT dst, sum(r * s) AS i FROM sh JOIN {p} ON sh.src = {p}.id GROUP BY ALL),
r{k} AS MATERIALIZED (SELECT id, (1 - 0.85e0) / n + 0.85e0 * (coalesce(i, 0) + d / n) AS r FROM {p} LEFT JOIN i{k} ON id = dst, d{k}, n)""")
    return ",\n".join(rounds)


def _files(spark, sf):
    """Customers as files: fan_in is what they buy, exports their orders over a value, some are entry points."""
    c = D.table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("cus:"), F.col("c_custkey").cast("string")).alias("id"), F.concat(F.lower("c_mktsegment"), F.lit("/"), F.when(F.col("c_custkey") % 11 == 0, "index").otherwise("part"), F.lit("/m"), F.col("c_custkey").cast("string"), F.lit(".ts")).alias("path"), "c_acctbal")
    o = D.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("fan_in"), F.sum((F.col("o_totalprice") > 200000).cast("int")).alias("exports"))
    d = c.join(o, "c_custkey", "left")
    return d.select("id", "path", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("exports", F.lit(0)).alias("exports"), (F.col("c_acctbal") > 9000).cast("int").alias("entrypoint"))


SQL_FILES = """files AS (SELECT 'cus:' || c_custkey AS id, lower(c_mktsegment) || '/' || CASE WHEN c_custkey % 11 = 0 THEN 'index' ELSE 'part' END || '/m' || c_custkey || '.ts' AS path,
  coalesce(fan_in, 0) AS fan_in, coalesce(exports, 0) AS exports, (c_acctbal > 9000)::INTEGER AS entrypoint
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS fan_in, sum((o_totalprice > 200000)::INTEGER) AS exports FROM orders GROUP BY ALL) ON o_custkey = c_custkey)"""


def _sql_path_score(path: str) -> str:
    base = f"regexp_replace(regexp_extract({path}, '[^/]*$'), '^(.+)\\.[^.]*$', '\\1')"
    return (
        f"greatest(0e0, least(1e0, 0.5e0 + CASE WHEN {base} IN ('index', 'main', 'app', 'server') THEN 0.3e0 ELSE 0e0 END + CASE WHEN starts_with({path}, 'src/') THEN 0.1e0 ELSE 0e0 END"
        f" - greatest(len(string_split({path}, '/')) - 2, 0) * 0.05e0 - CASE WHEN regexp_matches({path}, '(^|/)(tests?|__tests__|__mocks__|spec|specs|fixtures?|mocks?|examples?|stories)(/|$)')"
        f" OR regexp_matches({path}, '\\.(test|spec|stories)\\.[^/]+$') THEN 0.5e0 ELSE 0e0 END))"
    )


def _sql_scaled(x: str, log: bool = False) -> str:
    v = f"ln(1 + greatest({x}::DOUBLE, 0e0))" if log else x
    return f"CASE WHEN max({v}) OVER () - min({v}) OVER () < 1e-12 THEN 0.5e0 ELSE ({v} - min({v}) OVER ()) / (max({v}) OVER () - min({v}) OVER ()) END"


def importance(spark, sf):
    return metrics.importance(_files(spark, sf)).select("id", F.round("importance", 6).alias("importance"), F.round("dependency", 6).alias("dependency"))


def usage(spark, sf):
    parts = D.nodes(spark, sf).where("kind = 'class'")
    return metrics.usage(parts, D.edges(spark, sf)).select("id", F.round("usage", 6).alias("usage"))


def _history(spark, sf):
    return D.events(spark, sf).groupBy("path").agg(F.count("*").alias("commit_count"), F.max("at_ms").alias("last_commit_at"))


def activity(spark, sf):
    files = D.events(spark, sf).select("path").distinct().union(spark.sql("SELECT 'never' AS path")).withColumn("id", F.concat(F.lit("file:"), "path"))
    return metrics.activity(files, _history(spark, sf)).select("id", F.round("activity", 6).alias("activity"))


def recency(spark, sf):
    h = D.events(spark, sf).groupBy(F.concat("path", F.lit("/"), "author").alias("id")).agg(F.max("at_ms").alias("last_modified_at"))
    return metrics.recency(h, D.NOW_MS).select("id", F.round("recency", 6).alias("recency"))


def git_history(spark, sf):
    """Commit counts, last commit and authors of each path."""
    h = D.events(spark, sf)
    by = h.groupBy("path", "author").agg(F.count("*").alias("n"), F.max("at_ms").alias("at_ms"))
    authors = F.array_sort(F.collect_list(F.concat_ws(":", "author", F.col("n").cast("string"))))
    return by.groupBy("path").agg(F.sum("n").alias("commit_count"), F.max("at_ms").alias("last_commit_at"), F.array_join(authors, ",").alias("authors"))


def path_score(spark, sf):
    from ..functions import text as T

    p = _files(spark, sf).select("path").union(D.pages(spark, sf).select("path"))
    return p.distinct().select("path", F.round(T.path_score(F.col("path")), 6).alias("score"))


def expand_hop1(spark, sf):
    seeds = D.nodes(spark, sf).where(F.col("id") == SEED).select(F.lit(1).alias("query_id"), "id", F.lit(0.8).alias("score"))
    limits = expand.Limits(depth=1, budget=1_000_000, nodes=1_000_000)
    got = expand.expand(D.nodes(spark, sf), checkpointed(D.edges(spark, sf)), seeds, limits)
    return got.select("id", F.round("score", 6).alias("score"), "depth")


def expand_best_first(spark, sf):
    s = D.nodes(spark, sf).where("kind = 'directory'").select(F.substring_index("id", ":", -1).cast("int").alias("query_id"), "id", F.lit(1.0).alias("score"))
    got = expand.expand(D.nodes(spark, sf), checkpointed(D.edges(spark, sf)), s)
    return got.select("query_id", "id", F.round("score", 6).alias("score"), "depth")


def top_imported(spark, sf):
    return report.top_imported(graph.degrees(D.edges(spark, sf))).select("id", F.col("fan_in").cast("long").alias("fan_in"))


def external_deps(spark, sf):
    return report.externals(D.edges(spark, sf), D.nodes(spark, sf).where("kind = 'module'"))


def dependency_summary(spark, sf):
    return report.dependencies(D.edges(spark, sf), D.nodes(spark, sf).where(CHOSEN))


def explain_relations(spark, sf):
    return report.relations(D.edges(spark, sf), "part:7")


def recommend_callers(spark, sf):
    return report.outside_callers(D.edges(spark, sf), D.nodes(spark, sf).where(CHOSEN))


QUERIES = {f.__name__: f for f in (
    edge_merge, graph_stats, degree_fan, pagerank, centrality, importance, usage, activity, recency, git_history, path_score, expand_hop1,
    expand_best_first, top_imported, external_deps, dependency_summary, explain_relations, recommend_callers,
)}

_EDGES = f"WITH {SQL_NODES}, {SQL_EDGES}"
_CHOSEN = f"ch AS (SELECT id FROM nodes WHERE {CHOSEN})"
_FAN = """dg AS (SELECT id, count(*) AS degree, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM (
  SELECT src AS id, 0 AS i, (kind = 'imports')::INTEGER AS o FROM edges UNION ALL SELECT dst, (kind = 'imports')::INTEGER, 0 FROM edges) GROUP BY ALL)"""
ORACLE = {
    "edge_merge": f"{_EDGES} SELECT src, kind, dst, weight, n FROM edges",
    "graph_stats": f"{_EDGES} SELECT 'node' AS what, kind, count(*) AS n FROM nodes GROUP BY ROLLUP (kind) UNION ALL SELECT 'edge', kind, count(*) FROM edges GROUP BY ROLLUP (kind)",
    "degree_fan": f"{_EDGES}, {_FAN} SELECT id, degree, fan_in, fan_out FROM dg",
    "pagerank": f"WITH {_sql_ranks()} SELECT id, round(r, 9) AS rank FROM r25",
    "centrality": f"WITH {_sql_ranks()} SELECT id, round({_sql_scaled('(r * n)', log=True)}, 6) AS centrality FROM r25, n",
    "importance": f"""WITH {SQL_FILES}, a AS (SELECT *, {_sql_scaled('fan_in', log=True)} AS d, {_sql_scaled('exports', log=True)} AS e FROM files),
b AS (SELECT *, 0.35e0 * d + 0.20e0 * e + 0.25e0 * entrypoint + 0.20e0 * {_sql_path_score('path')} AS raw FROM a) SELECT id, round({_sql_scaled('raw')}, 6) AS importance, round(d, 6) AS dependency FROM b""",
    "usage": f"""{_EDGES}, u AS (SELECT id, coalesce(sum(weight), 0) AS x FROM nodes LEFT JOIN edges ON dst = id AND edges.kind IN ('calls', 'references') WHERE nodes.kind = 'class' GROUP BY ALL)
SELECT id, round({_sql_scaled('x', log=True)}, 6) AS usage FROM u""",
    "activity": f"WITH {SQL_EVENTS}, f AS (SELECT path, count(*) AS x FROM history GROUP BY ALL UNION ALL SELECT 'never', 0) SELECT 'file:' || path AS id, round({_sql_scaled('x', log=True)}, 6) AS activity FROM f",
    "recency": f"""WITH {SQL_EVENTS}, f AS (SELECT path || '/' || author AS id, max(at_ms) AS t FROM history GROUP BY ALL), g AS (SELECT id, ({D.NOW_MS} - t) / 86400000e0 AS age FROM f)
SELECT id, round(CASE WHEN age <= 0 THEN 1e0 ELSE pow(2e0, -age / 30e0) END, 6) AS recency FROM g""",
    "git_history": f"""WITH {SQL_EVENTS}, a AS (SELECT path, author, count(*) AS n, max(at_ms) AS at_ms FROM history GROUP BY ALL)
SELECT path, sum(n)::BIGINT AS commit_count, max(at_ms) AS last_commit_at, string_agg(author || ':' || n, ',' ORDER BY author || ':' || n) AS authors FROM a GROUP BY ALL""",
    "path_score": f"WITH {SQL_FILES}, p AS (SELECT path FROM files UNION SELECT regexp_replace(url, '^[a-z]+://[^/]*/', '') FROM pages) SELECT path, round({_sql_path_score('path')}, 6) AS score FROM p",
    "expand_hop1": f"""{_EDGES}, kw(kind, k) AS (VALUES {', '.join(f"('{k}', {v}e0)" for k, v in expand.KIND_WEIGHTS.items())}),
nb AS (SELECT dst AS id, kind FROM edges WHERE src = '{SEED}' UNION ALL SELECT src, kind FROM edges WHERE dst = '{SEED}')
SELECT '{SEED}' AS id, 0.8e0 AS score, 0 AS depth UNION ALL SELECT id, round(max(0.8e0 * 0.6e0 * coalesce(k, 0.5e0)), 6), 1 FROM nb LEFT JOIN kw USING (kind) GROUP BY id""",
    "expand_best_first": f"""WITH RECURSIVE {SQL_NODES}, {SQL_EDGES}, start AS (SELECT split_part(id, ':', 2)::INTEGER AS query_id, id, 1e0 AS score FROM nodes WHERE kind = 'directory'),
{sql_best_first(expand.Limits())} SELECT query_id, id, round(score, 6) AS score, depth FROM found""",
    "top_imported": f"{_EDGES}, {_FAN} SELECT id, fan_in FROM dg WHERE fan_in > 0 ORDER BY fan_in DESC, id LIMIT 8",
    "external_deps": f"{_EDGES} SELECT dst AS id, count(*) AS uses FROM edges WHERE dst IN (SELECT id FROM nodes WHERE kind = 'module') GROUP BY ALL ORDER BY uses DESC, id LIMIT 12",
    "dependency_summary": f"{_EDGES}, {_CHOSEN} SELECT src, dst, weight FROM edges WHERE kind = 'imports' AND src IN (FROM ch) AND dst IN (FROM ch) ORDER BY weight DESC, src, dst LIMIT 14",
    "explain_relations": f"""{_EDGES} SELECT kind, 'out' AS direction, dst AS node, weight FROM edges WHERE kind <> 'contains' AND src = 'part:7'
UNION ALL SELECT kind, 'in', src, weight FROM edges WHERE kind <> 'contains' AND dst = 'part:7' ORDER BY 1, 2, 3 LIMIT 24""",
    "recommend_callers": f"""{_EDGES}, {_CHOSEN} SELECT dst AS id, count(*) AS callers, first(src ORDER BY weight DESC, src) AS caller FROM edges
WHERE kind = 'calls' AND dst IN (FROM ch) AND src NOT IN (FROM ch) GROUP BY dst ORDER BY callers DESC, id LIMIT 5""",
}
