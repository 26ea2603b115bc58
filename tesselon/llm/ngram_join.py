"""N-gram Jaccard join by T-occurrence search (op 3).

Documents are sets of word shingles; two link when 100 * |intersection| >= 75 * |union|. Steps:

1. Exact copies are one class each (md5 of the text); only the class's smallest doc_id is compared.
2. Every shingle gets its document frequency: shingles travel as packed sorted arrays to hash-range buckets, and
   the buckets send the frequencies back. A document whose shared shingles (frequency over 1) are fewer than
   75 % of its set has no partner and stops here.
3. Of the others, the rarest shared shingles (prefix filter: any linked pair shares one) are grouped; connected
   groups are coarse clusters that hold every linked pair. Clusters within BLOCK_BYTES are searched whole. A larger
   one is cut by hash into blocks, and every block is searched with a few documents of the cluster, the hubs, added.
   What that does not connect with the cluster's largest component then visits the other blocks and is searched against
   their own documents, unless no size in the cluster lets it link: an overlap is at most the shared shingles, so
   sizes n and m need 3 * (n + m) <= 7 * shared. So each pair of a cluster is compared, connected already or ruled out;
   the members of a large group of near copies do not meet in one task, and the work on it grows with its size. (A
   cluster of many unconnected documents that could link by size costs documents times blocks.)
4. A T-occurrence search over inverted lists finds the links: DivideSkip sets the longest lists aside by its cost
   rule, merges the short ones from a heap, and probes the long ones by binary search.
5. Links of all blocks are contracted to components.

Frequencies use 32-bit keys inside a bucket: a collision can only raise a frequency, which keeps a document
longer, never drops one. Sets are compared by 64-bit shingle hashes.

Null, empty and blank texts have no shingles and link with nothing: their component is their own id. Rows with
null doc_id take no part (0 shingles, null component). Rows that repeat a doc_id are one node: each row has the size of
its own set, and all that have shingles share the component of every link that one of them has. Ties go to the
smaller doc_id. A text of any length is one set, held whole by one task. Other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textcore import (
    EMIT, REPLY, buckets_of, checkpointed, chunks_of, components, doc_key, emit, free_name, gathered, md5_hex, partitions, replies,
    shingle_hashes, split_counts, tasks_of, text_classes, text_rows, texts_of, trimmed, word_hashes,
)

SHINGLE = 5
#: Packed shingles of a coarse cluster that one block may hold.
BLOCK_BYTES = 1 << 20
#: Documents of a cluster over a block that all of its blocks get.
HUBS = 4
_WIRE = np.dtype([("key", "<u4"), ("n", "u1")])


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    for lo, hi in chunks_of(texts):
        own, number = shingle_hashes(*word_hashes(texts[lo:hi]), SHINGLE)
        out += [np.unique(x) for x in split_counts(own, number)]
    return out


def class_rows(right: pa.Table) -> tuple[set, pa.Table]:
    """Ids of class representatives sent along (b = -1), and the other rows."""
    b = right.column("b").to_numpy()
    mine = {x.decode() for x in right.filter(pa.array(b == -1)).column("payload").to_pylist()}
    return mine, right.filter(pa.array(b != -1))


def representatives(left: pa.Table, mine: set) -> tuple[list[int], list[str], list[bytes]]:
    """(doc_id, md5, text) of the rows that stand for their class, each class once, in a fixed order."""
    ids, texts = left.column("doc_id").to_pylist(), texts_of(left.column("text"))
    found: dict[tuple[int, str], bytes] = {}
    for i, t in zip(ids, texts):
        h = md5_hex(t)
        if f"{i}:{h}" in mine:
            found[i, h] = t
    order = sorted(found)
    return [i for i, _ in order], [h for _, h in order], [found[x] for x in order]


def sent_classes(docs: DataFrame, n: int) -> DataFrame:
    """Representatives as rows that a group of documents gets along with its replies."""
    c = text_classes(docs).where("rep IS NOT NULL").select(F.col("rep").alias("doc_id"), "h")
    payload = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("h")).cast("binary")
    return c.select(doc_key(c, n).alias("g"), F.lit(-1).alias("b"), payload.alias("payload"))


def keyed(docs: DataFrame, n: int, tasks: int | None = None) -> DataFrame:
    """Rows with their group of n, dealt to as many tasks or the given number."""
    d = text_rows(docs).where("doc_id IS NOT NULL")
    # a fixed number of partitions: the optimizer would join small ones to large tasks
    return d.select(doc_key(d, n).alias("g"), "doc_id", "text").repartition(tasks or n, "g")


def _frequencies(merged: np.ndarray) -> np.ndarray:
    order = np.argsort(merged["key"], kind="stable")
    key = merged["key"][order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    total = np.minimum(np.add.reduceat(merged["n"][order].astype(np.int64), first), 255)
    out = np.zeros(len(merged), np.uint8)
    out[order] = np.repeat(total, np.diff(np.concatenate([first, [len(key)]])))
    return out


def needed(n: int) -> int:
    """Least overlap of a set of n with any set it links to: 75 % of n, rounded up."""
    return -(-3 * n // 4)


SETS = "doc_id long, h string, n_shingles long, shared binary, prefix array<long>"
_SETS_TYPE = pa.schema([("doc_id", pa.int64()), ("h", pa.string()), ("n_shingles", pa.int64()), ("shared", pa.binary()), ("prefix", pa.list_(pa.int64()))])
#: n_shingles of the rows that only name a class which a repeated doc_id has.
_NAMED = -1


def repeated(left: pa.Table) -> list[tuple[int, str]]:
    """(doc_id, md5) of the different texts of doc_ids that have more than one."""
    held: dict[int, set[str]] = {}
    ids = left.column("doc_id").to_pylist()
    if len(set(ids)) == len(ids):
        return []
    for i, t in zip(ids, texts_of(left.column("text"))):
        held.setdefault(i, set()).add(md5_hex(t))
    return sorted((i, h) for i, own in held.items() if len(own) > 1 for h in own)


def prepared(docs: DataFrame) -> DataFrame:
    """One row per class: its set size and, if it may have partners, its shared shingles and rarest ones. Of a doc_id
    with several texts also a row for each of them, without a set."""
    n = partitions(docs)
    buckets = buckets_of(docs.sparkSession, n)
    d, classes = keyed(docs, n, tasks_of(docs.sparkSession, n)), sent_classes(docs, n)

    def send(key, left, right):
        mine, _ = class_rows(right)
        _, _, texts = representatives(left, mine)
        sets = shingle_sets(texts)
        keys, count = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_counts=True)
        return emit(key[0].as_py(), keys, buckets, _WIRE, n=np.minimum(count, 255))

    def answer(table):
        return replies(table, _WIRE, _frequencies)

    def finish(key, left, right):
        mine, rest = class_rows(right)
        ids, hs, texts = representatives(left, mine)
        sets = shingle_sets(texts)
        keys = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
        df = gathered(rest, np.uint8)
        shared, prefixes = [], []
        for own in sets:
            f = df[np.searchsorted(keys, own)]
            common = f > 1
            least = needed(len(own))
            if not len(own) or common.sum() < least:
                shared.append(None)
                prefixes.append(None)
                continue
            few, of = own[common], f[common]
            rare = few[np.lexsort((few, of))][: len(own) - least + 1 - int((~common).sum())]
            shared.append(few.tobytes())
            prefixes.append(rare.astype(np.int64).tolist())
        more = repeated(left)
        none = [None] * len(more)
        columns = (ids + [i for i, _ in more], hs + [h for _, h in more], [len(s) for s in sets] + [_NAMED] * len(more), shared + none, prefixes + none)
        return pa.table([pa.array(x, t) for x, t in zip(columns, _SETS_TYPE.types)], schema=_SETS_TYPE)

    sent = d.groupBy("g").cogroup(classes.groupBy("g")).applyInArrow(trimmed(send), EMIT)
    back = sent.repartition(tasks_of(docs.sparkSession, buckets), "b").groupBy("b").applyInArrow(trimmed(answer), REPLY)
    return d.groupBy("g").cogroup(back.unionByName(classes).groupBy("g")).applyInArrow(trimmed(finish), SETS)


# --- T-occurrence search -----------------------------------------------------------------------------------
def heap_merge(lists: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents in at least `least` of some sorted lists, and their number of lists.

    A heap holds the lists by length; the two shortest are merged and put back, until one is left.
    """
    heap = [(len(x), k, x) for k, x in enumerate(lists)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, k, a = heapq.heappop(heap)
        both = np.concatenate([a, heap[0][2]])
        both.sort(kind="stable")  # finds the two runs and merges them
        heapq.heapreplace(heap, (len(both), k, both))
    merged = heap[0][2] if heap else np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1]])) if len(merged) else merged
    count = np.diff(np.append(first, len(merged)))
    return merged[first[count >= least]], count[count >= least]


def slices(postings: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The given runs of postings, joined."""
    base = np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
    return postings[base + np.arange(int(length.sum()))] if len(length) else postings[:0]


#: Shortest lists whose last documents are compared before the lists are merged.
GUESSES = 4
#: Cost of a probe against a step of the merge, in the rule that sets lists aside.
PROBE = 0.01


def divide_skip(lists: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents in at least `least` of some sorted lists, none empty, and their number of lists (DivideSkip).

    least / (PROBE * log2(longest) + 1) of the longest lists, at most least - 1, are set aside. A document must then be in
    least - (set aside) of the short ones, which are merged by a heap; the long ones are probed for what that gives.
    """
    none = np.zeros(0, np.int64)
    if len(lists) < least or not lists:
        return none, none
    length = np.array([len(x) for x in lists])
    order = np.argsort(length, kind="stable")
    aside = min(int(least / (PROBE * np.log2(max(length.max(), 1)) + 1)), least - 1)
    short, long = order[: len(order) - aside].tolist(), order[len(order) - aside :].tolist()
    found, count = heap_merge([lists[k] for k in short], least - aside)
    if not len(found):
        return none, none
    if long:  # all lists as one sorted array of (list, document), so that all are probed by one call of binary search
        width = int(max(found[-1], *(lists[k][-1] for k in long)) + 1)
        keys = np.concatenate([lists[k] + i * width for i, k in enumerate(long)])
        asked = ((np.arange(len(long)) * width)[:, None] + found).ravel()
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        count = count + (keys[at] == asked).reshape(len(long), -1).sum(0)
    good = count >= least
    return found[good], count[good]


def partnered(sizes: np.ndarray, lens: np.ndarray, visitor: np.ndarray) -> np.ndarray:
    """Which documents some other one could link to by its size, given the number of their shared shingles (lens).

    Partners are all documents or, if some are visitors, a visitor's are the others and theirs the visitors.
    """
    out = np.zeros(len(sizes), bool)
    for asks in (True, False) if visitor.any() else (False,):
        own = visitor == asks
        others = np.sort(sizes[~own] if visitor.any() else sizes)
        n, least, most = sizes[own], -(-3 * sizes[own] // 4), 7 * lens[own] // 3 - sizes[own]
        count = np.searchsorted(others, most, "right") - np.searchsorted(others, least)
        out[own] = count > (0 if visitor.any() else (n <= most).astype(np.int64))
    return out


def linked(ids: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], label: np.ndarray | None = None, visitor: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between some documents, as pairs of ids.

    Documents with the same label are connected already. Each document is searched against the ones before it, in
    order of size; those connected with it are left out of its lists, as no link to them could connect anything. If
    there are visitors, only they are searched, against all the others.
    """
    ids, sizes = np.asarray(ids), np.asarray(sizes, np.int64)
    visits = visitor is not None
    visitor = np.asarray(visitor, bool) if visits else np.zeros(len(ids), bool)
    if visits and not visitor.any():
        return []
    order = np.lexsort((ids, sizes))
    order = order[partnered(sizes, np.array([len(s) for s in sets], np.int64), visitor)[order]]
    ids, sizes, sets, visitor = ids[order], sizes[order], [sets[i] for i in order], visitor[order]
    lens = np.array([len(s) for s in sets], np.int64)
    if len(ids) < 2:
        return []
    part = np.arange(len(ids)) if label is None else np.unique(label[order], return_inverse=True)[1]
    part = part.copy()
    tokens, token = np.unique(np.concatenate(sets), return_inverse=True)
    doc = np.repeat(np.arange(len(sets)), lens)
    by = np.lexsort((doc, token))
    by = by[~visitor[doc[by]]]
    postings = doc[by]
    start = np.searchsorted(token[by], np.arange(len(tokens)))
    filled = np.bincount(token[by], minlength=len(tokens)) if visits else np.zeros(len(tokens), np.int64)
    own_at = np.concatenate([[0], np.cumsum(lens)])
    out = []

    def join(q: int, c: int) -> None:
        if part[q] != part[c]:
            out.append((int(ids[q]), int(ids[c])))
            part[part == part[q]] = part[c]

    for q in np.flatnonzero(visitor).tolist() if visits else range(len(ids)):
        own = token[own_at[q] : own_at[q + 1]]
        n = int(sizes[q])
        lowest, least = int(np.searchsorted(sizes, needed(n))), needed(n)
        # those before it; a visitor also meets larger ones, up to the size that its shared shingles allow
        end = int(np.searchsorted(sizes, 7 * len(own) // 3 - n, "right")) if visits else q
        held = own[filled[own] > 0]
        if lowest < end and len(held) >= least:
            # the documents that stand last in the shortest lists are likely to link, which settles all that are
            # connected with them
            by_length = held[np.argsort(filled[held], kind="stable")[:GUESSES]]
            for guess in np.unique(postings[start[by_length] + filled[by_length] - 1])[::-1].tolist():
                if lowest <= guess < end and part[guess] != part[q]:
                    common = len(np.intersect1d(sets[q], sets[guess], assume_unique=True))
                    if 7 * common >= 3 * (n + int(sizes[guess])):
                        join(q, guess)
            merged = slices(postings, start[held], filled[held])
            of = np.repeat(np.arange(len(held)), filled[held])
            open_ = (merged >= lowest) & (merged < end) & (part[merged] != part[q])
            merged, of = merged[open_], of[open_]
            cut = np.flatnonzero(of[1:] != of[:-1]) + 1
            lists = np.split(merged, cut) if len(merged) else []
            found, count = divide_skip(lists, least)
            for c in found[7 * count >= 3 * (n + sizes[found])].tolist():
                join(q, c)
        if not visits:
            filled[own] += 1
    return out


_EDGE_TYPE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _search(table: pa.Table) -> pa.Table:
    sets = [np.frombuffer(x, np.uint64) for x in table.column("shared").to_pylist()]
    label, visitor = (table.column(c).to_numpy(zero_copy_only=False) if c in table.column_names else None for c in ("part", "visitor"))
    got = linked(table.column("doc_id").to_numpy(), table.column("n_shingles").to_numpy(), sets, label, visitor)
    return pa.table([pa.array([e[k] for e in got], pa.int64()) for k in (0, 1)], schema=_EDGE_TYPE)


def searched(rows: DataFrame) -> DataFrame:
    """Edges of the links inside each key's rows (key, doc_id, n_shingles, shared and perhaps part and visitor)."""
    return rows.groupBy("key").applyInArrow(trimmed(lambda table: _search(table)), "u long, v long")


def linkable(member: DataFrame) -> DataFrame:
    """The doc_ids of member (label, doc_id, n: set size, s: shared shingles) that a size in their cluster lets link.
    The sizes of a cluster are gathered in bands of 2 %, whose number is bounded."""
    band = member.groupBy("label", F.floor(F.log2("n") * 32).alias("band")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    bands = band.groupBy("label").agg(F.collect_list(F.struct("lo", "hi")).alias("bands"))
    fits = F.exists("bands", lambda x: (4 * x["hi"] >= 3 * F.col("n")) & (3 * (F.col("n") + x["lo"]) <= 7 * F.col("s")))
    return member.join(bands, "label").where(fits).select("doc_id").distinct()


def labels(sets: DataFrame, same: DataFrame) -> DataFrame:
    """(node, label) of the components of all links between the rows of `prepared` and of the edges `same`."""
    able = sets.where("shared IS NOT NULL")
    rare = able.select("doc_id", F.explode("prefix").alias("token"))
    first = rare.groupBy("token").agg(F.min("doc_id").alias("m"), F.max("doc_id").alias("most")).where("m < most").select("token", "m")
    coarse = components(rare.join(first, "token").where("doc_id <> m").select(F.col("doc_id").alias("u"), F.col("m").alias("v")).distinct())
    coarse = coarse.select(F.col("node").alias("doc_id"), "label")
    able = able.select("doc_id", "n_shingles", "shared")
    size = able.select("doc_id", F.octet_length("shared").alias("bytes")).join(coarse, "doc_id").groupBy("label").agg(F.sum("bytes").alias("bytes"))
    size = checkpointed(size.select("label", "bytes", F.ceil(F.col("bytes") / F.lit(BLOCK_BYTES)).cast("int").alias("blocks")))
    total, most = size.agg(F.coalesce(F.sum(F.when(F.col("blocks") <= 1, F.col("bytes"))), F.lit(0)), F.coalesce(F.max("blocks"), F.lit(0))).first()
    bins = max(1, -(-int(total) // BLOCK_BYTES))
    large = size.where("blocks > 1").select("label", "blocks")
    # clusters of one block: several share a key
    single = able.join(coarse.join(large, "label", "left_anti") if most > 1 else coarse, "doc_id")
    found = searched(single.select(F.pmod(F.xxhash64("label"), F.lit(bins)).alias("key"), "doc_id", "n_shingles", "shared"))
    if most <= 1:
        return components(found.union(same))

    def key(block):
        return F.xxhash64("label", block)

    member = coarse.join(large, "label").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.col("blocks")).cast("int"))
    sized = able.select("doc_id", F.col("n_shingles").alias("n"), (F.octet_length("shared") / 8).alias("s"))
    fit = linkable(member.select("label", "doc_id").join(sized, "doc_id")).withColumn("open", F.lit(True))
    member = checkpointed(member.join(fit, "doc_id", "left").withColumn("open", F.coalesce("open", F.lit(False))))
    # what no size in the cluster lets link is no hub
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id")
    hub = member.where("open").withColumn("r", F.row_number().over(order)).where(F.col("r") <= HUBS).select("label", "blocks", "doc_id", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    placed = member.select("label", "doc_id", "block").union(hub.select("label", "doc_id", "block")).distinct()
    inner = searched(able.join(placed, "doc_id").select(key(F.col("block")).alias("key"), "doc_id", "n_shingles", "shared"))
    part = components(found.union(inner).union(same))
    member = member.join(part.select(F.col("node").alias("doc_id"), F.col("label").alias("part")), "doc_id", "left").withColumn("part", F.coalesce("part", "doc_id"))
    counts = member.groupBy("label", "part").agg(F.count("*").alias("n")).groupBy("label").agg(F.max_by("part", F.struct("n", "part")).alias("main"))
    member = checkpointed(member.join(counts, "label"))
    away = member.where("part <> main AND open").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("to <> block")
    # only blocks of clusters that have such documents are searched again
    home = member.where("open").join(member.where("part <> main AND open").select("label").distinct(), "label", "left_semi")
    rows = home.select("doc_id", "part", key(F.col("block")).alias("key"), F.lit(False).alias("visitor"))
    rows = rows.union(away.select("doc_id", "part", key(F.col("to")).alias("key"), F.lit(True).alias("visitor")))
    across = searched(able.join(rows, "doc_id").select("key", "doc_id", "n_shingles", "shared", "part", "visitor"))
    # links between components, which are then contracted
    of = member.select("doc_id", "part")
    joined = across.join(of.select(F.col("doc_id").alias("u"), F.col("part").alias("a")), "u").join(of.select(F.col("doc_id").alias("v"), F.col("part").alias("b")), "v")
    over = components(joined.select(F.col("a").alias("u"), F.col("b").alias("v")))
    every = part.select("node", F.col("label").alias("part")).union(over.select("node", F.col("node").alias("part"))).distinct()
    every = every.join(over.select(F.col("node").alias("part"), F.col("label").alias("top")), "part", "left")
    return every.groupBy("node").agg(F.min(F.coalesce("top", "part")).alias("label"))


def _grouped(docs: DataFrame) -> DataFrame:
    """doc_id, h, n_shingles, component_id for every row of docs."""
    sets = checkpointed(prepared(docs))
    classes = sets.where(F.col("n_shingles") != _NAMED)
    # a doc_id with several texts is one node: its id links with the class of each text that has shingles
    same = sets.where(F.col("n_shingles") == _NAMED).select(F.col("doc_id").alias("u"), "h")
    same = same.join(classes.where("n_shingles > 0").select("h", F.col("doc_id").alias("v")), "h").select("u", "v")
    label = labels(classes, same)
    info = classes.select("doc_id", "h", "n_shingles").join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    info = info.select("h", "n_shingles", F.coalesce("label", "doc_id").alias("label"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("h"))
    d = d.join(info, "h", "left")
    size = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.coalesce("n_shingles", F.lit(0))).cast("long")
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("label")).otherwise(F.col("doc_id"))
    return d.select("doc_id", "h", size.alias("n_shingles"), component.alias("component_id"))


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    return _grouped(docs).drop("h")


def kept(docs: DataFrame) -> DataFrame:
    """docs with one document of each group (its smallest doc_id; of rows that repeat it, the one whose text has the
    smallest md5), all columns. Rows with null doc_id stay."""
    chosen = _grouped(docs).where("doc_id = component_id").groupBy(F.col("doc_id").alias("_kept")).agg(F.min("h").alias("_h"))
    h = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))
    # joined by id alone (an equality with h would be a key too), rows with their texts already lie as the window needs them
    out = docs.join(chosen, (docs["doc_id"] == chosen["_kept"]) & (h >= chosen["_h"]) & (h <= chosen["_h"]), "left_semi")
    row = free_name(docs, "row")
    out = out.withColumn(row, F.row_number().over(Window.partitionBy("doc_id").orderBy("doc_id"))).where(F.col(row) == 1).drop(row)
    return out.unionByName(docs.where("doc_id IS NULL"))


def oracle() -> str:
    """The same rows from a join of all shingles and a closure over the links."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)),
b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.v FROM r JOIN b ON r.y = b.u)
SELECT x AS doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(y) AS component_id FROM r LEFT JOIN n ON n.doc_id = x GROUP BY x
"""
