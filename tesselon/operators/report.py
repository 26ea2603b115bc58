"""Roll-ups of a repository, snapshot differences, telemetry, explanations and recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Sizes of the lists in a report.
TOP, EXTERNALS, CHURN, HOTSPOTS, RELATIONS = 8, 12, 6, 10, 24


def languages(files: DataFrame) -> DataFrame:
    """(language, files, loc) with the total as language null."""
    return files.rollup("language").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"))


def top_directory(path="path"):
    return F.when(F.col(path).contains("/"), F.substring_index(path, "/", 1)).otherwise(".")


def layout(files: DataFrame) -> DataFrame:
    """(dir, files, role): first path segments, most files first."""
    d = files.select(top_directory().alias("dir")).groupBy("dir").agg(F.count("*").alias("files"))
    return d.withColumn("role", T.role_for(F.col("dir"))).orderBy(F.desc("files"), "dir")


def top_imported(degrees: DataFrame, limit: int = TOP) -> DataFrame:
    return degrees.where("fan_in > 0").orderBy(F.desc("fan_in"), "id").limit(limit)


def externals(edges: DataFrame, modules: DataFrame, limit: int = EXTERNALS) -> DataFrame:
    """(id, uses): edges into external modules."""
    d = edges.join(modules.select(F.col("id").alias("dst")), "dst", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("uses"))
    return d.orderBy(F.desc("uses"), "id").limit(limit)


def hotspots(history: DataFrame, central: DataFrame) -> DataFrame:
    """(path, why, value): the files with most commits, then central files that are not among them, ten in all."""
    a = history.orderBy(F.desc("commit_count"), "path").limit(CHURN).select("path", F.lit("churn").alias("why"), F.col("commit_count").cast("double").alias("value"))
    b = central.join(a.select("path"), "path", "left_anti").orderBy(F.desc("centrality"), "path").limit(HOTSPOTS).select("path", F.lit("central").alias("why"), F.col("centrality").alias("value"))
    order = F.when(F.col("why") == "churn", 0).otherwise(1)
    w = Window.orderBy(order, F.desc("value"), "path")  # at most CHURN + HOTSPOTS rows
    return a.union(b).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= HOTSPOTS).drop("_r")


def ownership(commits: DataFrame, limit: int = TOP) -> DataFrame:
    """commits (dir, author, n) -> (dir, owner, share, authors, commits) of the directories with most commits."""
    by = commits.groupBy("dir", "author").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("dir").orderBy(F.desc("n"), "author")
    lead = by.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("dir", F.col("author").alias("owner"), F.col("n").alias("own"))
    total = by.groupBy("dir").agg(F.sum("n").alias("commits"), F.count("*").alias("authors"))
    d = total.join(lead, "dir").select("dir", "owner", (F.col("own") / F.col("commits")).alias("share"), "authors", "commits")
    return d.orderBy(F.desc("commits"), "dir").limit(limit)


def snapshot_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change): added, removed, changed (other hash) or unchanged."""
    p = previous.select("path", F.col("hash").alias("old"))
    c = current.select("path", F.col("hash").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed").otherwise("unchanged")
    return p.join(c, "path", "full_outer").select("path", change.alias("change"))


def stale(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Number of paths that only one side has; edited files do not count."""
    d = previous.select("path", F.lit(1).alias("a")).join(current.select("path", F.lit(1).alias("b")), "path", "full_outer")
    return d.where("a IS NULL OR b IS NULL").agg(F.count("*").alias("stale"))


def telemetry(events: DataFrame) -> DataFrame:
    """(name, count, total_ms, max_ms, avg_ms) of events (name, duration_ms); the average is over all events."""
    d = events.groupBy("name").agg(F.count("*").alias("count"), F.coalesce(F.sum("duration_ms"), F.lit(0.0)).alias("total_ms"), F.coalesce(F.max("duration_ms"), F.lit(0.0)).alias("max_ms"))
    return d.withColumn("avg_ms", F.col("total_ms") / F.col("count"))


def dependencies(edges: DataFrame, chosen: DataFrame, limit: int = 14) -> DataFrame:
    """Imports among chosen files, heaviest first."""
    ids = chosen.select("id")
    e = edges.where("kind = 'imports'").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return e.orderBy(F.desc("weight"), "src", "dst").limit(limit).select("src", "dst", "weight")


def relations(edges: DataFrame, node: str, limit: int = RELATIONS) -> DataFrame:
    """(kind, direction, node, weight): edges at a node besides containment."""
    e = edges.where("kind <> 'contains'")
    out = e.where(F.col("src") == node).select("kind", F.lit("out").alias("direction"), F.col("dst").alias("node"), "weight")
    into = e.where(F.col("dst") == node).select("kind", F.lit("in").alias("direction"), F.col("src").alias("node"), "weight")
    return out.union(into).orderBy("kind", "direction", "node").limit(limit)


def outside_callers(edges: DataFrame, chosen: DataFrame, limit: int = 5) -> DataFrame:
    """(id, callers, caller): of each chosen node its callers that are not chosen, and the heaviest of them."""
    calls = edges.where("kind = 'calls'").join(chosen.select(F.col("id").alias("dst")), "dst", "left_semi").join(chosen.select(F.col("id").alias("src")), "src", "left_anti")
    best = F.min_by("src", F.struct(-F.col("weight"), F.col("src")))
    return calls.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers"), best.alias("caller")).orderBy(F.desc("callers"), "id").limit(limit)
