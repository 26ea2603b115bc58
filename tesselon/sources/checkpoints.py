"""Lineage cuts in the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """Write df to the folder of spark.checkpoint.dir. A local session that names none gets a folder of its own; a
    cluster is refused, as its executors would not see such a folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.match(r"local($|\[)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tesselon-checkpoint-"))
    return df.checkpoint()


def checkpointed_by(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The same in n partitions by keys; later groups and joins by these keys read it in place. Adaptive plans do not
    tell a checkpoint how they are dealt, so this one is made without them."""
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    had = conf.get(name)
    conf.set(name, "false")
    try:
        return checkpointed(df.repartition(n, *keys))
    finally:
        conf.set(name, had)
