"""Registered queries: repository roll-ups, snapshot differences, telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import report
from . import tables as D
from .tables import SQL_EVENTS, SQL_PAGES


def languages(spark, sf):
    d = D.table(spark, sf, "documents").select(F.col("lang").alias("language"), F.size(F.split("text", "\n")).cast("long").alias("loc"))
    return report.languages(d)


def layout(spark, sf):
    return report.layout(D.pages(spark, sf))


def role_for(spark, sf):
    names = "src lib source test tests __tests__ test-utils spec doc docs documentation example examples script scripts tool tools bin packages apps services config configs public assets static e2e integration other"
    d = D.table(spark, sf, "documents").select(F.col("source").alias("dir")).union(D.table(spark, sf, "nation").select(F.lower("n_name"))).distinct()
    own = spark.sql("SELECT explode(split('" + names + "', ' ')) AS dir")
    return d.union(own).select("dir", T.role_for(F.col("dir")).alias("role"))


def hotspots(spark, sf):
    h = D.events(spark, sf).groupBy(F.concat("path", F.lit("/u"), "author").alias("path")).agg(F.count("*").alias("commit_count"))
    c = D.events(spark, sf).groupBy(F.concat("path", F.lit("/u"), "author").alias("path")).agg(F.round(F.sum("value"), 4).alias("centrality"))
    return report.hotspots(h, c)


def ownership(spark, sf):
    c = D.events(spark, sf).select(F.col("path").alias("dir"), "author", F.lit(1).alias("n"))
    return report.ownership(c).withColumn("share", F.round("share", 6))


def _previous(spark, sf):
    """An earlier state of the pages: some changed, some under another name."""
    p = D.pages(spark, sf).select("id", F.col("id").cast("string").alias("path"), "hash")
    gone = F.when(F.col("id") % 13 == 0, F.concat("path", F.lit(".old"))).otherwise(F.col("path"))
    return p.select(gone.alias("path"), F.when(F.col("id") % 5 == 0, F.sha1(F.concat("hash", F.lit("x")))).otherwise(F.col("hash")).alias("hash"))


def snapshot_diff(spark, sf):
    now = D.pages(spark, sf).select(F.col("id").cast("string").alias("path"), "hash")
    return report.snapshot_diff(_previous(spark, sf), now).groupBy("change").agg(F.count("*").alias("n"))


def stale_count(spark, sf):
    return report.stale(_previous(spark, sf), D.pages(spark, sf).select(F.col("id").cast("string").alias("path")))


def telemetry_summary(spark, sf):
    e = D.events(spark, sf).select(F.col("path").alias("name"), F.when(F.col("value") > 1, F.col("value")).alias("duration_ms"))
    got = report.telemetry(e)
    return got.select("name", "count", *[F.round(c, 4).alias(c) for c in ("total_ms", "max_ms", "avg_ms")])


QUERIES = {f.__name__: f for f in (languages, layout, role_for, hotspots, ownership, snapshot_diff, stale_count, telemetry_summary)}

_ROLE = "CASE " + " ".join(f"WHEN regexp_matches(dir, '{p}') THEN '{r}'" for p, r in T.ROLES) + " ELSE 'source' END"
_PREVIOUS = f"""{SQL_PAGES}, prev AS (SELECT CASE WHEN id % 13 = 0 THEN id || '.old' ELSE id::VARCHAR END AS path, CASE WHEN id % 5 = 0 THEN sha1(hash || 'x') ELSE hash END AS hash FROM files),
cur AS (SELECT id::VARCHAR AS path, hash FROM files), fo AS (SELECT coalesce(prev.path, cur.path) AS path, prev.hash AS old, cur.hash AS new FROM prev FULL JOIN cur ON prev.path = cur.path)"""
_NAMES = "src lib source test tests __tests__ test-utils spec doc docs documentation example examples script scripts tool tools bin packages apps services config configs public assets static e2e integration other"
ORACLE = {
    "languages": "SELECT lang AS language, count(*) AS files, sum(len(string_split(text, chr(10))))::BIGINT AS loc FROM documents GROUP BY ROLLUP (lang)",
    "layout": f"WITH {SQL_PAGES}, d AS (SELECT CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '.' END AS dir, count(*) AS files FROM files GROUP BY ALL) SELECT dir, files, {_ROLE} AS role FROM d",
    "role_for": f"WITH d AS (SELECT source AS dir FROM documents UNION SELECT lower(n_name) FROM nation), e AS (SELECT dir FROM d UNION ALL SELECT unnest(string_split('{_NAMES}', ' '))) SELECT dir, {_ROLE} AS role FROM e",
    "hotspots": f"""WITH {SQL_EVENTS}, h AS (SELECT path || '/u' || author AS path, count(*) AS n, round(sum(value), 4) AS c FROM history GROUP BY ALL),
a AS (SELECT path, 'churn' AS why, n::DOUBLE AS value FROM h ORDER BY n DESC, path LIMIT 6), b AS (SELECT path, 'central' AS why, c AS value FROM h ANTI JOIN a USING (path) ORDER BY c DESC, path LIMIT 10)
SELECT path, why, value FROM (SELECT * FROM a UNION ALL SELECT * FROM b) QUALIFY row_number() OVER (ORDER BY CASE WHEN why = 'churn' THEN 0 ELSE 1 END, value DESC, path) <= 10""",
    "ownership": f"""WITH {SQL_EVENTS}, b AS (SELECT path AS dir, author, count(*) AS n FROM history GROUP BY ALL)
SELECT dir, first(author ORDER BY n DESC, author) AS owner, round(max(n) / sum(n)::DOUBLE, 6) AS share, count(*) AS authors, sum(n)::BIGINT AS commits FROM b GROUP BY dir ORDER BY commits DESC, dir LIMIT 8""",
    "snapshot_diff": f"WITH {_PREVIOUS} SELECT CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' WHEN old <> new THEN 'changed' ELSE 'unchanged' END AS change, count(*) AS n FROM fo GROUP BY ALL",
    "stale_count": f"WITH {_PREVIOUS} SELECT count(*) AS stale FROM fo WHERE old IS NULL OR new IS NULL",
    "telemetry_summary": f"""WITH {SQL_EVENTS}, e AS (SELECT path AS name, CASE WHEN value > 1 THEN value END AS d FROM history)
SELECT name, count(*) AS count, round(coalesce(sum(d), 0), 4) AS total_ms, round(coalesce(max(d), 0), 4) AS max_ms, round(coalesce(sum(d), 0) / count(*), 4) AS avg_ms FROM e GROUP BY ALL""",
}
