"""Dense vectors: normalization, exact search, the hashed local embedding, and cache maintenance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import terms as terms_of

# Width of the hashed embedding and the bit that gives the sign.
DIMENSIONS, SIGN_BIT = 256, 16
#: Queries that are scored against a batch at once.
STEP = 128


def normalized(v):
    """Unit vector in double; a zero vector stays zero."""
    wide = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(wide, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def nearest(vectors: DataFrame, queries: list[tuple[int, list[float]]], limit: int = 10) -> DataFrame:
    """Exact cosine search of a few query vectors over vectors (id, v): (query_id, id, score, rank).

    Queries are given values of bounded number. Every task scores its batches as matrix products and keeps the best
    `limit` of each query over all of them, so at most limit rows per task and query are shuffled.
    """
    q = np.array([v for _, v in queries], np.float64)
    norm = np.sqrt((q * q).sum(1, keepdims=True))
    q = q / np.where(norm == 0, 1, norm)
    names = np.array([i for i, _ in queries], np.int64)
    width = q.shape[1] if len(queries) else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.float64), np.zeros(0, object)) for _ in names]
        kind = None
        for batch in batches:
            ids = batch.column(0)
            kind = ids.type
            cells = batch.column(1)
            fits = np.array(cells.value_lengths().fill_null(0)) == width
            if not fits.any():
                continue
            keep = pa.array(fits)
            m = np.asarray(cells.filter(keep).flatten(), np.float64).reshape(-1, width)
            own = np.array(ids.filter(keep).to_pylist(), object)
            size = np.sqrt((m * m).sum(1, keepdims=True))
            unit = m / np.where(size == 0, 1, size)
            for k, (had, of) in enumerate(best):  # the best so far and those of this batch that may belong to them
                if k % STEP == 0:
                    score = unit @ q[k : k + STEP].T
                s = score[:, k % STEP]
                if len(s) > limit:
                    near = np.flatnonzero(np.round(s, 9) >= np.round(s[np.argpartition(-s, limit - 1)[:limit]].min(), 9)) if limit else np.zeros(0, np.int64)
                else:
                    near = np.arange(len(s))
                s, i = np.concatenate([had, s[near]]), np.concatenate([of, own[near]])
                order = sorted(range(len(s)), key=lambda j: (-round(s[j], 9), i[j]))[:limit]
                best[k] = s[order], i[order]
        if kind is not None:
            rows = [len(s) for s, _ in best]
            ids = [x for _, i in best for x in i.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, rows)), pa.array(ids, kind), pa.array(np.concatenate([s for s, _ in best]) if best else np.zeros(0))], ["query_id", "id", "score"])

    kind = dict(vectors.dtypes)["id"]
    found = vectors.select("id", "v").where("v IS NOT NULL").mapInArrow(run, f"query_id long, id {kind}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def hashed_sparse(corpus: DataFrame) -> DataFrame:
    """Local embedding of (id, text) as sparse cells (id, idx, val) before normalization.

    A text makes its own cells, without a shuffle. If an id has several texts, their terms are counted together first.
    """
    if not terms_of.repeats(corpus):
        return terms_of.hashed(corpus, DIMENSIONS, SIGN_BIT)
    terms = terms_of.counts(corpus).groupBy("id", "term").agg(F.sum("tf").alias("tf"))
    h = T.fnv1a32(F.col("term"))
    cell = terms.select("id", "tf", h.alias("h"))
    sign = F.when(F.shiftright("h", SIGN_BIT).bitwiseAND(F.lit(1)) == 1, -1.0).otherwise(1.0)
    cell = cell.select("id", (F.col("h") % DIMENSIONS).cast("int").alias("idx"), (sign * (1 + F.log("tf"))).alias("x"))
    return cell.groupBy("id", "idx").agg(F.sum("x").alias("val"))


def hashed_embedding(corpus: DataFrame) -> DataFrame:
    """(id, v): unit vectors of DIMENSIONS floats; texts without terms are zero vectors.

    Map and norm are aggregated first, and each is named twice below so that the optimizer keeps them as columns:
    inside the lambda they would be computed again for each cell.
    """
    entry = F.struct("idx", "val")
    cells = hashed_sparse(corpus).groupBy("id").agg(F.map_from_entries(F.collect_list(entry)).alias("m"), F.sqrt(F.sum(F.col("val") * F.col("val"))).alias("norm"))
    norm = F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(DIMENSIONS - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)) / norm)
    zero = F.array_repeat(F.lit(0.0), DIMENSIONS)
    out = corpus.select("id").join(cells.select("id", F.when(F.col("m").isNotNull(), dense).alias("v")), "id", "left")
    return out.select("id", F.coalesce("v", zero).cast("array<float>").alias("v"))


def cache_misses(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks whose (id, hash) has no stored vector."""
    return chunks.join(vectors.select("id", "hash"), ["id", "hash"], "left_anti")


def pruned(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Vectors whose id still exists."""
    return vectors.join(chunks.select("id"), "id", "left_semi")
