"""Benchmark decontamination by the q-gram lemma (op 10).

A benchmark piece (a whole item up to PIECE bytes, else any window of PIECE bytes of it) of length L leaks into a document
if some region of the document is within k = L // 10 edits of it, both lower-cased (A-Z) and with every white space
byte as a blank. By the q-gram lemma such a region shares at least L - q + 1 - k * q of the piece's q-grams, all on
diagonals that differ by at most k. Shared q-grams are therefore counted in overlapping diagonal bands of twice
the step k + 1; bands that reach the bound are verified by a banded alignment. Of the windows of an item every
STRIDE-th is indexed, with the bound lowered by the q-grams in which the windows up to STRIDE // 2 away may differ
from it; what reaches that bound is aligned with the bytes those windows share and then with each of them.

Pieces too short for the bound get the largest k that keeps it positive; items under q bytes and null items are
never matched. Null and empty texts hold nothing. An item counts once for a document however often it occurs;
repeated items count as one id. Repeated documents give equal rows; other columns are ignored or passed through.
Documents are searched whole, in pieces of a bounded number of texts; a text of any length is held by one task.

The items go to the tasks in blocks of at most BLOCK_BYTES (or one longer item). A benchmark of one block is one pass
over the documents. For more blocks each pass writes only the documents with hits to the checkpoint folder, and the
hits are joined at the end, so driver and tasks hold one block at a time whatever the size of the benchmark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import LOWER, bounded_batches, checkpointed, chunks_of, text_rows, texts_of

Q = 8
PIECE, STRIDE = 256, 16
EDITS = 0.1
BLOCK_BYTES = 8 << 20
_TABLE_BITS = 22

_NORMAL = LOWER.copy()
_NORMAL[[0, 9, 10, 11, 12, 13]] = 32


def normal(text: bytes) -> np.ndarray:
    return _NORMAL[np.frombuffer(text, np.uint8)]


def starts_of(text: bytes) -> list[int]:
    """Starts of the indexed pieces."""
    return [*range(0, len(text) - PIECE, STRIDE), max(len(text) - PIECE, 0)]


def grams(buf: np.ndarray) -> np.ndarray:
    """All q-grams of a byte array as 64-bit words."""
    if len(buf) < Q:
        return np.zeros(0, np.uint64)
    return np.ndarray((len(buf) - Q + 1,), "<u8", np.ascontiguousarray(buf), 0, (1,)).astype(np.uint64)


def _slot(g: np.ndarray) -> np.ndarray:
    return (g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _TABLE_BITS)


def alignment(piece: np.ndarray, region: np.ndarray, most: int) -> int:
    """Least edits between the piece and any part of the region, or most + 1 if it is more than most.

    The region is a band around one diagonal, so the whole table is the band. Rows run over the piece; a row's
    insertions are a running minimum.
    """
    step = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, np.int64)
    for c in piece:
        new = np.minimum(row + 1, np.concatenate([[most + 1], row[:-1] + (region != c)]))
        row = np.minimum.accumulate(new - step) + step
        if row.min() > most:
            return most + 1
    return int(min(row.min(), most + 1))


class Index:
    """Postings of the q-grams of all pieces."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.item, self.piece, self.whole, self.start = [], [], [], []
        for number, text in items:
            whole = normal(text)
            if len(whole) >= Q:
                for s in starts_of(whole):
                    self.item.append(number)
                    self.piece.append(whole[s : s + PIECE])
                    self.whole.append(whole)
                    self.start.append(s)
        lens = np.array([len(p) for p in self.piece], np.int64)
        self.lens = lens
        self.edits = np.minimum((lens * EDITS).astype(np.int64), np.maximum((lens - Q) // Q, 0))
        self.slack = np.array([STRIDE // 2 if len(w) > PIECE else 0 for w in self.whole], np.int64)
        self.bound = lens - Q + 1 - self.edits * Q - self.slack
        own = [grams(p) for p in self.piece]
        g = np.concatenate(own) if own else np.zeros(0, np.uint64)
        which = np.repeat(np.arange(len(own)), [len(x) for x in own]) if own else np.zeros(0, np.int64)
        at = np.concatenate([np.arange(len(x)) for x in own]) if own else np.zeros(0, np.int64)
        order = np.argsort(g, kind="stable")
        self.which, self.at = which[order], at[order]
        self.keys, self.first, self.count = np.unique(g[order], return_index=True, return_counts=True)
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[_slot(self.keys)] = True

    def candidates(self, buf: np.ndarray) -> list[tuple[int, int, int]]:
        """(piece, first, last) regions of buf whose diagonal band reaches the piece's bound."""
        g = grams(buf)
        at = np.flatnonzero(self.table[_slot(g)])
        if not len(at) or not len(self.keys):
            return []
        g = g[at]
        key = np.minimum(np.searchsorted(self.keys, g), len(self.keys) - 1)
        same = self.keys[key] == g
        at, key = at[same], key[same]
        n = self.count[key]
        posting = np.repeat(self.first[key] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        piece = self.which[posting]
        diagonal = np.repeat(at, n) - self.at[posting] + PIECE
        band = diagonal // (self.edits[piece] + 1)
        width = np.int64(len(buf) + 2 * PIECE + 2)
        # band b covers the steps b and b + 1: a step's hits count for its own band and the one before
        steps, count = np.unique(piece * width + band, return_counts=True)
        after = np.concatenate([np.where(steps[1:] == steps[:-1] + 1, count[1:], 0), [0]]) if len(steps) else count
        out = []
        for shift, total in ((0, count + after),):
            good = total >= self.bound[steps // width]
            out += list(zip((steps[good] // width).tolist(), (steps[good] % width - shift).tolist()))
        regions = []
        for p, b in out:
            s = int(self.edits[p]) + 1
            first = b * s - PIECE
            more = int(self.slack[p])
            regions.append((p, first - s - more, first + 2 * s + int(self.lens[p]) + s + more))
        return regions

    def least(self, piece: int, region: np.ndarray, most: int) -> int:
        """Least edits between the region and the piece or a window up to STRIDE // 2 away, or most + 1."""
        whole, more = self.whole[piece], int(self.slack[piece])
        a, z = max(self.start[piece] - more, 0), min(self.start[piece] + more, len(whole) - int(self.lens[piece]))
        windows = [whole[s : s + self.lens[piece]] for s in range(a, z + 1)]
        text = region.tobytes()
        if any(w.tobytes() in text for w in windows):
            return 0
        # no window has fewer edits than the part that all share
        if more and alignment(whole[z : a + self.lens[piece]], region, most) > most:
            return most + 1
        best = most + 1
        for w in windows:
            if best:
                best = min(best, alignment(w, region, best - 1))
        return best

    def leaks(self, texts: list[bytes]) -> list[list[tuple[int, int]]]:
        """For each text the items found in it with their least edits, by item."""
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        for lo, hi in chunks_of(texts):
            # a zero byte between texts, which no normal text has, keeps q-grams inside them
            parts = [normal(t) for t in texts[lo:hi]]
            lens = np.array([len(p) + 1 for p in parts])
            buf = np.zeros(int(lens.sum()), np.uint8)
            ends = np.cumsum(lens)
            for p, e in zip(parts, ends.tolist()):
                buf[e - 1 - len(p) : e - 1] = p
            best: dict[tuple[int, int], int] = {}
            for piece, first, last in self.candidates(buf):
                middle = min(max((first + last) // 2, 0), len(buf) - 1)
                for doc in {int(np.searchsorted(ends, x, side="right")) for x in (min(max(first, 0), len(buf) - 1), middle, min(last, len(buf) - 1))}:
                    a, z = max(first, int(ends[doc] - lens[doc])), min(last, int(ends[doc]) - 1)
                    item, most = self.item[piece], int(self.edits[piece])
                    if z - a < self.lens[piece] - most or best.get((doc, item), most + 1) == 0:
                        continue
                    most = min(most, best.get((doc, item), most + 1) - 1)
                    d = self.least(piece, buf[a:z], most)
                    if d <= most:
                        best[doc, item] = d
            for (doc, item), d in sorted(best.items()):
                out[lo + doc].append((item, d))
        return out


def blocks(benchmark: DataFrame) -> tuple[int, Iterator[list[tuple[int, bytes]]]]:
    """Number of blocks of bounded size, and the items of each, which is collected when its turn comes."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    # a byte of an item over PIECE is in PIECE // STRIDE pieces
    times = F.when(F.octet_length("text") > PIECE, PIECE // STRIDE).otherwise(2)
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") * times / 2 + 64), F.lit(0))).first()[0]
    n = max(1, math.ceil(2 * total / BLOCK_BYTES)) if total > BLOCK_BYTES else 1

    def one(k: int) -> list[tuple[int, bytes]]:
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        return sorted((r["item_id"], r["text"].encode()) for r in own.collect())

    return n, (one(k) for k in range(n))


_HITS = "doc_id long, h string, ids array<long>, least_edits long"


def _hits(docs: DataFrame, items: list[tuple[int, bytes]]) -> DataFrame:
    """(doc_id, h, ids, least_edits) of the documents (doc_id, h, text) that hold some of the items."""

    def run(rows):
        index = Index(items)
        for batch in rows:
            got = index.leaks(texts_of(batch.column(2)))
            some = pa.array([k for k, x in enumerate(got) if x], pa.int64())
            ids = pa.array([sorted({i for i, _ in x}) for x in got if x], pa.list_(pa.int64()))
            least = pa.array([min(e for _, e in x) for x in got if x], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(1).take(some), ids, least], ["doc_id", "h", "ids", "least_edits"])

    return docs.mapInArrow(run, _HITS)


def _all_hits(docs: DataFrame, benchmark_blocks) -> DataFrame | None:
    """Hits of all blocks by document; each block is a pass that ends in the checkpoint folder."""
    found = None
    for items in benchmark_blocks:
        own = checkpointed(_hits(docs, items))
        found = own if found is None else found.union(own)
    if found is None:
        return None
    return found.groupBy("doc_id", "h").agg(F.array_distinct(F.flatten(F.collect_set("ids"))).alias("ids"), F.min("least_edits").alias("least_edits"))


def _hash(text: str):
    return F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_items, item_ids (comma-joined, ascending), least_edits (null without items), contaminated."""
    d = text_rows(docs)
    n_blocks, each = blocks(benchmark)
    if n_blocks == 1:
        items = next(each)

        def run(rows):
            index = Index(items)
            for batch in rows:
                got = index.leaks(texts_of(batch.column(1)))
                ids = pa.array([sorted({i for i, _ in x}) for x in got], pa.list_(pa.int64()))
                least = pa.array([min((e for _, e in x), default=None) for x in got], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), ids, least], ["doc_id", "ids", "least_edits"])

        d = d.mapInArrow(run, "doc_id long, ids array<long>, least_edits long")
    else:
        hits = _all_hits(d.select("doc_id", _hash("text").alias("h"), "text"), each).withColumnRenamed("doc_id", "_id").withColumnRenamed("h", "_h")
        d = d.select("doc_id", _hash("text").alias("h"))
        d = d.join(hits, d["doc_id"].eqNullSafe(hits["_id"]) & (d["h"] == hits["_h"]), "left").select("doc_id", F.coalesce("ids", F.array().cast("array<long>")).alias("ids"), "least_edits")
    ids = F.array_join(F.transform(F.array_sort("ids"), lambda x: x.cast("string")), ",")
    n = F.size("ids").cast("long")
    return d.select("doc_id", n.alias("n_items"), ids.alias("item_ids"), "least_edits", (n > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a benchmark item, with all their columns."""
    bounded_batches(docs.sparkSession)
    n_blocks, each = blocks(benchmark)
    if n_blocks == 1:
        items = next(each)

        def run(rows):
            index = Index(items)
            for batch in rows:
                got = index.leaks(texts_of(batch.column(batch.schema.get_field_index("text"))))
                yield batch.filter(pa.array([not x for x in got], pa.bool_()))

        return docs.mapInArrow(run, docs.schema)
    hits = _all_hits(text_rows(docs).select("doc_id", _hash("text").alias("h"), "text"), each).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"))
    return docs.join(hits, docs["doc_id"].cast("long").eqNullSafe(hits["_id"]) & (_hash("text") == hits["_h"]), "left_anti")
