"""Typed weighted graph: node and edge merge, adjacency, degrees, statistics.

nodes: id, kind, name, file, ...; edges: src, dst, kind, weight, and optional variant, resolution, seq. Merged edges
carry n, the number of parallel edges, and are ordered everywhere by their id src|kind|dst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts of the edges for each shuffle partition.
PARTS = 2


def edge_id(src="src", kind="kind", dst="dst"):
    return F.concat_ws("|", F.col(src), F.col(kind), F.col(dst))


def merged_nodes(raw: DataFrame, order: str = "seq") -> DataFrame:
    """First writer of an id wins."""
    w = Window.partitionBy("id").orderBy(order)
    return raw.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", order)


def merged_edges(raw: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Sum of weights by (src, kind, dst); the first edge (by seq) gives variant and resolution.

    Self-loops go, and so do edges with an end that is not in nodes. Edges are dealt before they are summed, as nearly all
    differ: a hash table for each split of the input would hold the whole split. Ends are looked for afterwards, so that
    no task sorts for a join beside its hash table.
    """
    spark = raw.sparkSession
    parts = PARTS * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    e = raw.where("src <> dst").repartition(parts, "src", "kind", "dst")
    extra = [c for c in ("variant", "resolution") if c in e.columns]
    firsts = [F.min_by(c, "seq").alias(c) for c in extra if "seq" in e.columns]
    e = e.groupBy("src", "kind", "dst").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"), *firsts)
    if nodes is not None:
        ids, columns = nodes.select("id"), e.columns
        e = e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*columns)
    return e


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, kind, n): counts of nodes and edges by kind, and their totals (kind null)."""
    n = nodes.rollup("kind").agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), "kind", "n")
    e = edges.rollup("kind").agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), "kind", "n")
    return n.union(e)


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree, fan_in, fan_out): edges at a node, and its distinct import neighbours."""
    imports = F.col("kind") == "imports"
    out = edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.when(imports, 1).otherwise(0).alias("o"))
    into = edges.select(F.col("dst").alias("id"), F.when(imports, 1).otherwise(0).alias("i"), F.lit(0).alias("o"))
    return out.union(into).groupBy("id").agg(F.count("*").alias("degree"), F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Adjacency (id, other, kind, weight, edge) in both directions."""
    e = edges.withColumn("edge", edge_id())
    out = e.select(F.col("src").alias("id"), F.col("dst").alias("other"), "kind", "weight", "edge")
    return out.union(e.select(F.col("dst").alias("id"), F.col("src").alias("other"), "kind", "weight", "edge"))


def by_name(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """Nodes whose name equals a wanted name, regardless of case; names: (query_id, name), a bounded table."""
    want = names.select("query_id", F.lower("name").alias("_n")).distinct()
    return nodes.withColumn("_n", F.lower("name")).join(F.broadcast(want), "_n").drop("_n")
