"""Shared pieces of the text operators: reading, checkpoints, byte-level hashing and the keyed exchange.

Texts are handled as UTF-8 byte strings. Hashes are 64-bit polynomial hashes computed with prefix sums over
whole chunks, so a word, a shingle or a window costs a few vector operations and no Python call.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import re
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:  # only the GNU C library has malloc_trim
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim
except (OSError, AttributeError):
    _libc = None

#: Bytes of text handled at once by the vector code.
CHUNK_BYTES = 1 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by a path that only Spark has to understand."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of text that travel to Python at once, unless the session says otherwise: a batch of long texts stays small.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small on both sides, unless the session sets their size itself."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_ROWS))


def release() -> None:
    """Give memory that a finished group or batch no longer needs back to the system, as workers stay alive."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def trimmed(f):
    """f, a function of one to three grouped tables, with memory given back after each call."""

    def call(*args):
        try:
            return f(*args)
        finally:
            release()

    # Spark counts the arguments of what it is given
    return {1: lambda a: call(a), 2: lambda a, b: call(a, b), 3: lambda a, b, c: call(a, b, c)}[f.__code__.co_argcount]


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of documents, whatever other columns they have."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of spark.checkpoint.dir. Where the session names none, a local session (tests) gets a
    folder of its own; a cluster is refused, as its executors would not see such a folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not re.match(r"local($|\[)", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tesselon-checkpoint-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and cut its lineage there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def drop_finished(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished rounds: it does so when the driver's JVM finds them unused."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bytes of text in a group of documents, uncompressed, so that what a task holds does not depend on the file format.
GROUP_BYTES = 4 << 20


def partitions(docs: DataFrame) -> int:
    """Number of document groups and of hash-range buckets: one for every GROUP_BYTES of text, whatever the session's
    shuffle partitions. The bytes are summed in a pass over the text column."""
    size = docs.agg(F.sum(F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + 16)).first()[0]
    return max(1, -(-int(size or 0) // GROUP_BYTES))


def buckets_of(spark: SparkSession, n: int) -> int:
    """Hash-range buckets for n groups: as many, or the session's shuffle partitions if those are more."""
    return max(n, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Groups or buckets that a task handles, one after the other.
TASK_GROUPS = 4


def tasks_of(spark: SparkSession, n: int) -> int:
    """Tasks for n groups or buckets. Each task whose rows are checkpointed writes two files (data and checksum), and on
    a local file system without Hadoop's native library the executor starts a process for each, to set its mode. Not
    fewer than the session's shuffle partitions: Spark would deal the rows anew before a cogroup."""
    return min(n, buckets_of(spark, -(-n // TASK_GROUPS)))


def doc_key(df: DataFrame, n: int):
    """The group of a document: uniform in doc_id, so no source, copy group or text length is concentrated."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")


def ascii_lower(col):
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, UPPER.lower())


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks_of(texts: list[bytes], limit: int = CHUNK_BYTES):
    """(first, last) ranges of texts of about limit bytes; a longer text stands alone."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > limit:
            yield first, i
            first, total = i, 0
        total += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


# --- hashing -----------------------------------------------------------------------------------------------
_RNG = np.random.default_rng(20240917)
BYTE_RANDOM = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = 0x9E3779B97F4A7C15
_R_INVERSE = pow(_R, -1, 1 << 64)
MULTIPLIERS = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_tables: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on 64-bit words."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, 0 to n."""
    if len(_tables[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 4096)
        for k, base in enumerate((_R, _R_INVERSE)):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            _tables[k] = np.multiply.accumulate(t)
    return _tables[0], _tables[1]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """H with (H[e] - H[s]) * base**-s a hash of buf[s:e]."""
    up, _ = powers(len(buf))
    h = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE_RANDOM[buf] * up[: len(buf)], out=h[1:])
    return h


def span_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(h))
    return mix((h[ends] - h[starts]) * down[starts] + (ends - starts).astype(np.uint64))


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z, and the number of words of each text."""
    buf = LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    gap = _SEPARATOR[buf]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    words = span_hash(prefix_hash(buf), starts, ends)
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    return words, np.diff(np.searchsorted(starts, offsets))


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word runs of the given size and their number in each text; a shorter text is one run."""
    ends = np.cumsum(counts)
    starts = ends - counts
    number = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    first = np.repeat(starts - np.concatenate([[0], np.cumsum(number)[:-1]]), number) + np.arange(number.sum())
    out = np.zeros(len(first), np.uint64)
    left = np.repeat(ends, number) - first
    for k in range(size):
        inside = left > k
        at = np.minimum(first + k, max(len(words) - 1, 0))
        out += np.where(inside, words[at] * MULTIPLIERS[k], np.uint64(0)) if len(words) else np.uint64(0)
    return mix(out + np.minimum(left, size).astype(np.uint64)), number


def split_counts(values: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    return np.split(values, np.cumsum(counts)[:-1]) if len(counts) else []


def crc_mod(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string"))


# --- keyed exchange ----------------------------------------------------------------------------------------
def bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where sorted 64-bit keys pass from one range bucket to the next (buckets + 1 positions)."""
    bounds = [(b << 64) // buckets for b in range(1, buckets)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(bounds, np.uint64)), [len(keys)]]).astype(np.int64)


EMIT = "b int, g int, payload binary"
REPLY = "g int, b int, payload binary"
_EMIT_TYPE = pa.schema([("b", pa.int32()), ("g", pa.int32()), ("payload", pa.binary())])
_REPLY_TYPE = pa.schema([("g", pa.int32()), ("b", pa.int32()), ("payload", pa.binary())])


def emit(g: int, keys: np.ndarray, buckets: int, wire: np.dtype, **values: np.ndarray) -> pa.Table:
    """Rows that carry sorted unique keys and their values to the range buckets."""
    edges = bucket_edges(keys, buckets)
    rows: tuple[list, list, list] = ([], [], [])
    for b in np.flatnonzero(np.diff(edges)):
        lo, hi = edges[b], edges[b + 1]
        out = np.zeros(hi - lo, wire)
        out["key"] = keys[lo:hi].astype(wire["key"])
        for k, v in values.items():
            out[k] = v[lo:hi]
        rows[0].append(int(b))
        rows[1].append(g)
        rows[2].append(out.tobytes())
    return pa.table([pa.array(x, t) for x, t in zip(rows, _EMIT_TYPE.types)], schema=_EMIT_TYPE)


def replies(table: pa.Table, wire: np.dtype, reduce) -> pa.Table:
    """Join what came to one bucket, reduce it, and send each sender the values of its keys, in its order."""
    parts = [np.frombuffer(x, wire) for x in table.column("payload").to_pylist()]
    merged = np.concatenate(parts)
    out = reduce(merged)
    ends = np.cumsum([len(p) for p in parts])
    cells = [out[e - len(p) : e].tobytes() for p, e in zip(parts, ends)]
    return pa.table([table.column("g").combine_chunks(), table.column("b").combine_chunks(), pa.array(cells, pa.binary())], schema=_REPLY_TYPE)


def gathered(table: pa.Table, dtype) -> np.ndarray:
    """All replies to one sender, in the order of its sorted keys."""
    got = sorted(zip(table.column("b").to_pylist(), table.column("payload").to_pylist()))
    return np.frombuffer(b"".join(x for _, x in got), dtype)


# --- copies ------------------------------------------------------------------------------------------------
def text_classes(docs: DataFrame) -> DataFrame:
    """One row per distinct text: h (md5 of the text, null as empty) and rep (its smallest doc_id; null last)."""
    h = F.md5(F.coalesce("text", F.lit("")))
    return docs.select(h.alias("h"), "doc_id").groupBy("h").agg(F.min("doc_id").alias("rep"))


def md5_hex(text: bytes) -> str:
    return hashlib.md5(text).hexdigest()


# --- components --------------------------------------------------------------------------------------------
def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v): rows (node, label) with label the smallest node reachable.

    Alternates large-star and small-star contraction. Both group by node with partial aggregation, so a node
    with very many neighbours is a sum of partial minima; each round is written to the checkpoint folder. Rounds go on
    to the fixed point (each contracts, so their number grows with the logarithm of the longest path).
    """
    def minimum(e):
        return e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))

    spark = edges.sparkSession
    e = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v")
    e = checkpointed(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    previous = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(minimum(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small = large.join(minimum(large), "u")
        e = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        e = checkpointed(e.where("u <> v").distinct())
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == previous:
            break
        previous = state
        del both, large, small
        drop_finished(spark)
    nodes = e.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return nodes.union(roots.join(nodes, "node", "left_anti"))
