"""Extension: micro-batches of changed documents keep a postings store current (not an operator of the survey).

Each batch replaces the postings of the documents it brings; the store keeps one folder per batch and reads take the
newest rows of each document, so a batch that is run again after a failure gives the same store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import bm25


def write_batch(path: str):
    def run(batch: DataFrame, epoch: int) -> None:
        w = Window.partitionBy("id").orderBy(F.desc("at"))
        newest = batch.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").persist()
        newest.select("id", "at").withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/docs/epoch={epoch}")
        bm25.postings(newest.select("id", "text")).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/postings/epoch={epoch}")
        newest.unpersist()

    return run


def start(stream: DataFrame, path: str, checkpoint: str, lateness: str = "1 hour"):
    """stream (id, at timestamp, text) -> a query that keeps path current; repeats within the lateness are dropped."""
    once = stream.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["id", "at"])
    return once.writeStream.foreachBatch(write_batch(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """Postings (id, term, tf) of the newest version of each document."""
    newest = spark.read.parquet(f"{path}/docs").groupBy("id").agg(F.max_by("epoch", "at").alias("epoch"))
    return spark.read.parquet(f"{path}/postings").join(newest, ["id", "epoch"], "left_semi").select("id", "term", "tf")
