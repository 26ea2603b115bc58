"""Bounded best-first expansion of seeds over a graph.

Step one collects, by joins per hop, every edge that a search of the given depth can look at (hubs are entered but
not left, unless they are seeds; of a node only as many neighbours as the budget has visits). Step two runs the exact
search of each query over its own small neighbourhood. A node closes at its best score, at the depth of that path,
which may be larger than its smallest depth.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import both_ways

# How much of a score passes over an edge of each kind; other kinds pass OTHER_KIND.
KIND_WEIGHTS = {"calls": 1.0, "inheritance": 0.9, "composition": 0.8, "imports": 0.7, "references": 0.6, "exports": 0.5, "contains": 0.4}
OTHER_KIND = 0.5


@dataclass(frozen=True)
class Limits:
    depth: int = 2
    budget: int = 300
    least: float = 0.05
    decay: float = 0.6
    hub: int = 64
    nodes: int = 150
    kinds: dict = field(default_factory=lambda: dict(KIND_WEIGHTS))


def best_first(seeds: list[tuple[str, float]], around: dict[str, list[tuple[str, str]]], degree: dict[str, int], limits: Limits) -> list[tuple[str, float, int, str | None]]:
    """(id, score, depth, via) of the visited nodes, best first.

    around: neighbours (id, kind) of a node in edge-id order; degree: of the whole graph.
    """
    start: dict[str, float] = {}
    for node, score in seeds:
        if node in degree:
            start[node] = max(score, start.get(node, float("-inf")))
    queue = [(-score, node, n, 0, None) for n, (node, score) in enumerate(sorted(start.items()))]
    heapq.heapify(queue)
    tick, done, visited = len(queue), {}, 0
    while queue and visited < limits.budget:
        minus, node, _, depth, via = heapq.heappop(queue)
        score = -minus
        if node in done and done[node][0] >= score:
            continue
        done[node] = (score, depth, via)
        visited += 1
        if depth >= limits.depth or score < limits.least or (depth > 0 and degree[node] > limits.hub):
            continue
        for other, kind in around.get(node, ()):
            passed = score * limits.decay * limits.kinds.get(kind, OTHER_KIND)
            if passed > 0 and not (other in done and done[other][0] >= passed):
                heapq.heappush(queue, (-passed, other, tick, depth + 1, node))
                tick += 1
    ranked = sorted(((n, s, d, v) for n, (s, d, v) in done.items()), key=lambda x: (-x[1], x[0]))
    return ranked[: limits.nodes]


def nearest(step: DataFrame, limits: Limits) -> DataFrame:
    """Of each node's neighbours those that a search can still visit: it takes them by the kind that passes most, then
    by id, and each takes one visit of the budget, be it before or by then. All edges to such a neighbour stay."""
    passed = F.lit(OTHER_KIND)
    for kind, weight in limits.kinds.items():
        passed = F.when(F.col("kind") == kind, float(weight)).otherwise(passed)
    by = step.groupBy("query_id", "id", "other").agg(F.max(passed).alias("_p"), F.collect_list(F.struct("kind", "edge")).alias("_e"))
    first = Window.partitionBy("query_id", "id").orderBy(F.desc("_p"), "other")
    by = by.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= limits.budget)
    return by.select("query_id", "id", "other", F.inline("_e"))


def neighbourhood(edges: DataFrame, seeds: DataFrame, limits: Limits) -> DataFrame:
    """(query_id, id, other, kind, edge): adjacency that the searches of the seeds may look at."""
    adjacency = both_ways(edges)
    degree = adjacency.groupBy("id").agg(F.count("*").alias("degree"))
    hubs = degree.where(F.col("degree") > limits.hub).select("id")
    reached = seeds.select("query_id", "id").distinct()
    frontier, parts = reached, []
    for hop in range(limits.depth):
        if hop:
            frontier = frontier.join(hubs, "id", "left_anti")
        step = nearest(frontier.join(adjacency, "id").select("query_id", "id", "other", "kind", "edge"), limits)
        parts.append(step)
        new = step.select("query_id", F.col("other").alias("id")).distinct()
        frontier = new.join(reached, ["query_id", "id"], "left_anti")
        reached = reached.union(frontier)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def expand(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, limits: Limits | None = None) -> DataFrame:
    """seeds (query_id, id, score) -> (query_id, id, score, depth, via)."""
    limits = limits or Limits()
    known = seeds.join(nodes.select("id"), "id", "left_semi").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    near = neighbourhood(edges, known, limits) if limits.depth > 0 else None
    degree = both_ways(edges).groupBy("id").agg(F.count("*").alias("degree"))
    rows = known.select("query_id", "id", F.lit(None).cast("string").alias("other"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("edge"), "score", F.lit(0).cast("long").alias("degree"))
    if near is not None:
        ends = near.join(degree.withColumnRenamed("id", "other"), "other")
        rows = rows.union(ends.select("query_id", "id", "other", "kind", "edge", F.lit(None).cast("double").alias("score"), "degree"))
    query = dict(seeds.dtypes)["query_id"]

    def run(key, table):
        starts, around, degree_of = [], {}, {}
        for r in sorted(table.to_pylist(), key=lambda x: (x["edge"] or "", x["id"])):
            if r["other"] is None:
                starts.append((r["id"], r["score"]))
            else:
                around.setdefault(r["id"], []).append((r["other"], r["kind"]))
                degree_of[r["other"]] = r["degree"]
        for node, _ in starts:
            degree_of.setdefault(node, len(around.get(node, ())))
        got = best_first(starts, around, degree_of, limits)
        columns = list(zip(*got)) if got else [()] * 4
        kinds = (pa.string(), pa.float64(), pa.int32(), pa.string())
        ids = pa.array([key[0].as_py()] * len(got), table.schema.field("query_id").type)
        return pa.table([ids, *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["query_id", "id", "score", "depth", "via"])

    return rows.groupBy("query_id").applyInArrow(run, f"query_id {query}, id string, score double, depth int, via string")
