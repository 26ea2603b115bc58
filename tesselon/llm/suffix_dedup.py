"""Suffix-array dedup (op 2): remove every byte covered by a 50-byte string that also starts in an earlier document.

Equal strings have to meet in one shard, so shards are made by content:

1. Exact copies are one class each (md5 of the text); copies other than the first lose everything, if they have
   50 bytes, and only the first takes part in what follows.
2. Anchors: in every 50-byte window the 20-byte strings with the smallest hash. Equal windows have equal anchors at
   equal places. Anchors travel as packed sorted keys to hash-range buckets, which send back how many documents
   hold them; an anchor of one document only is dropped. (32-bit keys in a bucket: a collision keeps an anchor
   that is not needed, it never drops one.)
3. Each remaining anchor has a context, the at most 80 bytes that hold all its windows. A group of documents sends
   each different context once, with the smallest doc_id that holds it, to the shard of its anchor's hash; the places
   of its members stay with the group, so what a very common passage sends grows with the groups that hold it and not
   with the documents. In the shard equal contexts are one. Where an anchor has several different contexts, they are
   cut into pieces around the strings of 40 bytes that equal windows must share, equal pieces are one again, and of
   what is still different the suffix array is induced (suffix.py); permuted common prefixes cut it into groups of
   equal 50-byte windows. The smallest doc_id of a group decides for all its windows.
4. Covered ranges go back to the documents, are joined, and cut out of the bytes.

Hashes route strings and tell which ones to compare; contexts and pieces are taken as equal only after their bytes
were compared. Without that step (merge=False) the suffix arrays decide alone, with the same rows.

Documents are "smaller" by doc_id; rows that repeat a doc_id do not remove each other's bytes. Null text is empty.
Rows with null doc_id take no part and lose nothing. Texts under 50 bytes lose nothing. A text of any length is held
whole by one task. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngram_join import _WIRE, _frequencies, class_rows, keyed, representatives, sent_classes
from .suffix import different, permuted_common_prefixes, suffix_array
from .textcore import EMIT, MULTIPLIERS, REPLY, bucket_edges, buckets_of, chunks_of, emit, gathered, md5_hex, mix, partitions, prefix_hash, replies, span_hash, texts_of, trimmed

SPAN = 50
GRAM = 20
_SLIDE = SPAN - GRAM + 1  # places of an anchor in a window
BEFORE = SPAN - GRAM  # context bytes before an anchor; after its start come SPAN
#: Bytes of contexts whose suffix array is built at once.
SHARD_BYTES = 2 << 20
#: Groups of documents for each shard: what groups send to shards is packed apart, which costs groups times shards.
SHARD_GROUPS = 4
#: Step of the places at which windows are told apart before they are sorted.
GRID = 10


def _sliding(h: np.ndarray, width: int, best) -> np.ndarray:
    """best over h[i : i + width] for all i that have it."""
    done, out = 1, h
    while done * 2 <= width:
        out = best(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return best(out[:-rest], out[rest:]) if rest else out


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, key) of the anchors of some texts."""
    lens = np.array([len(t) for t in texts], np.int64)
    none = np.zeros(0, np.int64)
    if not len(texts) or lens.sum() + len(texts) <= SPAN:
        return none, none, none.astype(np.uint64)
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    h = prefix_hash(buf)
    start = np.arange(len(buf) - GRAM + 1)
    key = span_hash(h, start, start + GRAM)
    least = _sliding(key, _SLIDE, np.minimum)
    first = np.cumsum(lens + 1) - lens - 1
    inside = np.zeros(len(least) + 1, np.int32)  # windows that lie in one text
    long = lens >= SPAN
    np.add.at(inside, first[long], 1)
    np.add.at(inside, (first + lens - SPAN + 1)[long], -1)
    least[np.cumsum(inside[:-1]) == 0] = 0
    # the windows that hold place p start at p - _SLIDE + 1 .. p
    padded = np.concatenate([np.zeros(_SLIDE - 1, np.uint64), least, np.zeros(len(key) - len(least), np.uint64)])
    at = np.flatnonzero(_sliding(padded, _SLIDE, np.maximum) == key)
    text = np.searchsorted(first, at, side="right") - 1
    # least hashes are small ones: mixed again, they spread over all ranges
    return text, at - first[text], mix(key[at])


def all_anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = []
    for lo, hi in chunks_of(texts):
        text, place, key = anchors(texts[lo:hi])
        parts.append((text + lo, place, key))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else anchors([])


def runs(starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """starts[i] .. starts[i] + length[i] - 1, joined."""
    return np.repeat(starts - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(int(length.sum()))


def _packed(*arrays: np.ndarray) -> bytes:
    head = np.array([len(a) for a in arrays], np.int64).tobytes()
    raw = head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(cell: bytes, *kinds) -> list[np.ndarray]:
    raw = pa.decompress(cell[8:], int(np.frombuffer(cell[:8], np.int64)[0]), codec="zstd", asbytes=True)
    counts = np.frombuffer(raw[: 8 * len(kinds)], np.int64)
    out, at = [], 8 * len(kinds)
    for k, n in zip(kinds, counts.tolist()):
        size = np.dtype(k).itemsize * n
        out.append(np.frombuffer(raw[at : at + size], k))
        at += size
    return out


def distinct(key: np.ndarray, before: np.ndarray, start: np.ndarray, length: np.ndarray, buf: np.ndarray, digest: np.ndarray, merge: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Number of each context among the different ones, and a place that holds each of those, ordered by key.

    Contexts are buf[start : start + length] around an anchor that begins `before` bytes into them. Equal digests only
    tell what to compare: contexts are one if their bytes are equal. Without merge every context is its own.
    """
    order = np.lexsort((digest, key))
    if not len(order):
        return order, order
    k, d = key[order], digest[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])])
    model = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    odd = (length[order] != length[model]) | (before[order] != before[model])
    odd[~odd] = different(buf, start[order][~odd], start[model][~odd], length[order][~odd])
    new |= odd if merge else True
    number = np.zeros(len(key), np.int64)
    group = np.cumsum(new) - 1
    if odd.any():  # those after an odd one of the same digest still belong to the model
        group_of_model = np.zeros(len(key), np.int64)
        group_of_model[order[new]] = group[new]
        group = np.where(new, group, group_of_model[model])
    number[order] = group
    return number, order[new]


def digests(buf: np.ndarray, start: np.ndarray, length: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Hashes of contexts that lie in buf in ascending order."""
    out = np.zeros(len(start), np.uint64)
    for lo in range(0, len(start), 8192):
        hi = min(lo + 8192, len(start))
        first = int(start[lo])
        h = prefix_hash(buf[first : int((start[lo:hi] + length[lo:hi]).max())])
        at = start[lo:hi] - first
        out[lo:hi] = span_hash(h, at, at + length[lo:hi]) + before[lo:hi].astype(np.uint64)
    return out


#: What a group of documents sends to a shard: number of its first context; of each: key, length before the anchor, length, smallest id; bytes.
_KINDS = ("<i8", "<u8", "u1", "u1", "<i8", "u1")
#: What it keeps for itself: of the members that hold a context under its smallest id: context, text, start; of the others: text, start, end.
_OWN = ("<i8", "<i4", "<i4", "<i4", "<i4", "<i4")


def contexts(texts: list[bytes], ids: list[int], shared, merge: bool = True):
    """The different contexts of shared anchors in the order of their keys: key, before, length, least id, bytes; and
    what stays with the group. A member that is not the smallest of its context here loses all of it in any case."""
    text, place, key = all_anchors(texts)
    keep = shared(key)
    text, place, key = text[keep], place[keep], key[keep]
    order = np.lexsort((place, text))
    text, place, key = text[order], place[order], key[order]
    lens = np.array([len(t) for t in texts], np.int64)
    before = np.minimum(place, BEFORE)
    length = before + np.minimum(lens[text] - place, SPAN)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    at = (np.cumsum(lens) - lens)[text] + place - before
    number, one = distinct(key, before, at, length, buf, digests(buf, at, length, before), merge)
    who = np.array(ids, np.int64)[text]
    least = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(least, number, who)
    first = who == least[number]
    start = place - before
    by = np.argsort(number[first], kind="stable")
    own = [number[first][by], text[first][by], start[first][by], text[~first], start[~first], (start + length)[~first]]
    return [key[one], before[one], length[one], least, buf[runs(at[one], length[one])]], own


def by_shard(g: int, c: list[np.ndarray], own: list[np.ndarray], shards: int) -> pa.Table:
    """Rows for the shards of the keys, and one (b below -1) that comes back as it is."""
    key, before, length, least, data = c
    edges = bucket_edges(key, shards)
    byte = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
    rows: tuple[list, list, list] = ([-g - 2], [g], [_packed(*(np.asarray(x).astype(k) for x, k in zip(own, _OWN)))])
    for b in np.flatnonzero(np.diff(edges)).tolist():
        i, j = edges[b], edges[b + 1]
        parts = ([i], key[i:j], before[i:j], length[i:j], least[i:j], data[byte[i] : byte[j]])
        rows[0].append(b)
        rows[1].append(g)
        rows[2].append(_packed(*(np.asarray(x).astype(k) for x, k in zip(parts, _KINDS))))
    return pa.table([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.binary())], names=["b", "g", "payload"])


def earliest(data: np.ndarray, length: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every 50-byte window of some contexts (context, offset) the smallest id that holds the same window.

    least is the smallest id of each context. A suffix array of the contexts, each closed by a symbol below all
    bytes, is cut where the common prefix of neighbours is under 50.
    """
    n = len(length)
    first = np.cumsum(length + 1) - length - 1
    s = np.zeros(int(length.sum()) + n, np.uint8)
    s[runs(first, length)] = data + 1  # UTF-8 has no byte 255
    sa = suffix_array(s, 256)
    common = permuted_common_prefixes(s, sa, SPAN)
    context = np.repeat(np.arange(n), length + 1)
    offset = np.arange(len(s)) - first[context]
    window = offset <= length[context] - SPAN
    group = np.cumsum(common[sa] < SPAN)
    kept = window[sa]
    at, group = sa[kept], group[kept]
    cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    low = np.minimum.reduceat(least[context[at]], cut) if len(cut) else np.zeros(0, np.int64)
    low = np.repeat(low, np.diff(np.concatenate([cut, [len(at)]])))
    return context[at], offset[at], low


def cut(data, before, length, key) -> tuple[np.ndarray, ...]:
    """Pieces of contexts: (context, start, end, group, content).

    A 50-byte window around the anchor holds the string of SPAN - GRID bytes at exactly one grid place that starts
    less than GRID bytes after it. A piece is such a string, its core, with what its windows need on both sides.
    Windows can only be equal if their cores are: pieces of one anchor, place and core are a group. Pieces with the
    same content and core place have the same content number.
    """
    size = SPAN - GRID
    base = np.cumsum(length) - length
    out = []
    for first in range(0, len(key), 8192):
        own = np.arange(first, min(first + 8192, len(key)))
        h = prefix_hash(data[base[own[0]] : base[own[-1]] + length[own[-1]]])
        for left in range(0, BEFORE + 1, GRID):
            core = before[own] - left
            lo, hi = np.maximum(core - GRID + 1, 0), np.minimum(core + SPAN, length[own])
            ok = (core >= 0) & (core + size <= length[own]) & (hi - lo >= SPAN)
            some, core, lo, hi = own[ok], core[ok], lo[ok], hi[ok]
            at = base[some] - base[own[0]]
            group = mix(span_hash(h, at + core, at + core + size) + (key[some] ^ MULTIPLIERS[left]))
            content = mix(span_hash(h, at + lo, at + hi) + group * MULTIPLIERS[40] + (core - lo).astype(np.uint64))
            out.append((some, lo, hi, group, content))
    return tuple(np.concatenate(x) for x in zip(*out))


def earlier_ranges(data, before, length, key, least, merge: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, begin, end) of windows that another context of the same anchor holds under a smaller id."""
    none = np.zeros(0, np.int64)
    if not len(key):
        return none, none, none
    base = np.cumsum(length) - length
    context, lo, hi, group, content = cut(data, before, length, key)
    if not len(context):
        return none, none, none
    order = np.lexsort((content, group))
    context, lo, hi, group, content = (x[order] for x in (context, lo, hi, group, content))
    starts = np.concatenate([[True], (content[1:] != content[:-1]) | (group[1:] != group[:-1])])
    # equal hashes are one content only if the bytes agree with those of the piece before
    same = np.flatnonzero(~starts)
    size = (hi - lo)[same]
    odd = size != (hi - lo)[same - 1]
    odd |= different(data, base[context[same]] + lo[same], base[context[same - 1]] + lo[same - 1], np.where(odd, 0, size))
    starts[same[odd]] = True
    if not merge:
        starts[:] = True
    first = np.flatnonzero(starts)
    number = np.cumsum(starts) - 1
    low = np.minimum.reduceat(least[context], first)
    # one content in a group: all its windows have the smallest id of its contexts
    lost = low[number] < least[context]
    out = [(context[lost], lo[lost], hi[lost])]
    # several contents: their windows are compared by a suffix array
    g = group[first]
    several = np.concatenate([[False], g[1:] == g[:-1]])
    several[:-1] |= several[1:].copy()
    chosen = np.flatnonzero(several)
    members = np.diff(np.concatenate([first, [len(context)]]))
    sizes = (hi - lo)[first]
    i = 0
    while i < len(chosen):  # whole groups up to the bound
        j = i + max(1, int(np.searchsorted(np.cumsum(sizes[chosen[i:]] + 1), SHARD_BYTES)))
        while j < len(chosen) and g[chosen[j]] == g[chosen[j - 1]]:
            j += 1
        some = chosen[i:j]
        at = first[some]
        c, offset, window_low = earliest(data[runs(base[context[at]] + lo[at], sizes[some])], sizes[some], low[some])
        better = window_low < low[some][c]
        c, offset, window_low = some[c[better]], offset[better], window_low[better]
        piece = runs(first[c], members[c])
        repeated = members[c]
        begin = lo[piece] + np.repeat(offset, repeated)
        lost = np.repeat(window_low, repeated) < least[context[piece]]
        out.append((context[piece][lost], begin[lost], begin[lost] + SPAN))
        i = j
    return tuple(np.concatenate(x) for x in zip(*out))


def resolve(table: pa.Table, merge: bool = True) -> pa.Table:
    """Of one shard, the ranges that the smallest members of each sender's contexts lose: (context, start, end)."""
    if table.column("b")[0].as_py() < 0:  # what a group of documents keeps for itself
        return table.select(["g", "b", "payload"])
    gs = table.column("g").to_pylist()
    parts = [_unpacked(x, *_KINDS) for x in table.column("payload").to_pylist()]
    key, before, length, ids, data = (np.concatenate(x) for x in list(zip(*parts))[1:])
    before, length = before.astype(np.int64), length.astype(np.int64)
    count = [len(p[1]) for p in parts]
    sender = np.repeat(np.arange(len(gs)), count)
    mine = np.concatenate([p[0][0] + np.arange(k) for p, k in zip(parts, count)])
    # equal contexts of all senders are one
    base = np.cumsum(length) - length
    context, one = distinct(key, before, base, length, data, digests(data, base, length, before), merge)
    least = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(least, context, ids)
    # a sender that is not the smallest of its context loses all of it
    whole = ids > least[context]
    out = [(sender[whole], mine[whole], np.zeros(int(whole.sum()), np.int64), length[whole])]
    # the smallest ones lose the windows that other contexts of the anchor hold earlier
    distinct_key = key[one]
    several = np.concatenate([[False], distinct_key[1:] == distinct_key[:-1]])
    several[:-1] |= several[1:].copy()
    chosen = np.flatnonzero(several)
    smallest = np.flatnonzero(~whole)
    smallest = smallest[np.argsort(context[smallest], kind="stable")]
    from_context = np.searchsorted(context[smallest], np.arange(len(one) + 1))
    rows = one[chosen]
    c, lo, hi = earlier_ranges(data[runs(base[rows], length[rows])], before[rows], length[rows], distinct_key[chosen], least[chosen], merge)
    c = chosen[c]
    m = from_context[c + 1] - from_context[c]
    who = smallest[runs(from_context[c], m)]
    out.append((sender[who], mine[who], np.repeat(lo, m), np.repeat(hi, m)))
    sender, mine, begin, end = (np.concatenate(x) for x in zip(*out))
    order = np.lexsort((begin, mine, sender))
    sender, mine, begin, end = sender[order], mine[order], begin[order], end[order]
    cells, to = [], []
    for k in np.unique(sender).tolist():
        i, j = np.searchsorted(sender, [k, k + 1])
        cells.append(_packed(mine[i:j].astype("<i8"), begin[i:j].astype("u1"), end[i:j].astype("u1")))
        to.append(k)
    b = table.column("b")[0].as_py()
    return pa.table([pa.array([gs[k] for k in to], pa.int32()), pa.array([b] * len(to), pa.int32()), pa.array(cells, pa.binary())], names=["g", "b", "payload"])


def lost_ranges(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, begin, end) from what came back to a group of documents."""
    none = np.zeros(0, np.int64)
    b = rows.column("b").to_numpy()
    cells = rows.column("payload").to_pylist()
    kept = [_unpacked(cells[i], *_OWN) for i in np.flatnonzero(b < 0).tolist()]
    if not kept:
        return none, none, none
    context, text, start, *others = kept[0]
    got = [_unpacked(cells[i], "<i8", "u1", "u1") for i in np.flatnonzero(b >= 0).tolist()]
    c, lo, hi = (np.concatenate(x).astype(np.int64) for x in zip(*got)) if got else (none,) * 3
    at = np.searchsorted(context, c)
    m = np.searchsorted(context, c, side="right") - at
    who = runs(at, m)
    own = (text[who], start[who] + np.repeat(lo, m), start[who] + np.repeat(hi, m))
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(own, others))


def union_of(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by half-open ranges."""
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], begin[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    return begin[first], reach[np.concatenate([first[1:] - 1, [len(begin) - 1]])]


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_RESULT_TYPE = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def dedup(docs: DataFrame, keep: bool = False, merge: bool = True) -> DataFrame:
    """One row per row of docs; with keep also kept (the remaining bytes). Without merge no context is joined with an
    equal one before the suffix arrays, which then decide alone; the rows are the same."""
    n = partitions(docs)
    buckets = buckets_of(docs.sparkSession, n)
    shards = buckets_of(docs.sparkSession, -(-n // SHARD_GROUPS))
    d, classes = keyed(docs, n), sent_classes(docs, n)
    schema = _RESULT_TYPE.append(pa.field("kept", pa.binary())) if keep else _RESULT_TYPE

    def send(key, left, right):
        mine, _ = class_rows(right)
        _, _, texts = representatives(left, mine)
        text, _, k = all_anchors(texts)
        order = np.lexsort((text, k))
        k, text = k[order], text[order]
        own = np.concatenate([[True], (k[1:] != k[:-1]) | (text[1:] != text[:-1])]) if len(k) else np.zeros(0, bool)
        keys, count = np.unique(k[own], return_counts=True)
        return emit(key[0].as_py(), keys, buckets, _WIRE, n=np.minimum(count, 255))

    def answer(table):
        return replies(table, _WIRE, _frequencies)

    def surround(key, left, right):
        mine, rest = class_rows(right)
        ids, _, texts = representatives(left, mine)
        df = gathered(rest, np.uint8)

        def shared(k):
            distinct, place = np.unique(k, return_inverse=True)
            return df[place] > 1 if len(distinct) else np.zeros(0, bool)

        return by_shard(key[0].as_py(), *contexts(texts, ids, shared, merge), shards)

    def finish(key, left, right):
        mine, rest = class_rows(right)
        ids, hs, texts = representatives(left, mine)
        number, begin, end = lost_ranges(rest)
        order = np.argsort(number, kind="stable")
        number, begin, end = number[order], begin[order], end[order]
        edge = np.searchsorted(number, np.arange(len(ids) + 1))
        rows: list[tuple] = []
        result: dict[tuple, tuple] = {}
        for k, (i, h, t) in enumerate(zip(ids, hs, texts)):
            spans: list[tuple[int, int]] = []
            if edge[k + 1] > edge[k]:
                lo, hi = union_of(begin[edge[k] : edge[k + 1]], end[edge[k] : edge[k + 1]])
                spans = list(zip(lo.tolist(), hi.tolist()))
            left_over, at = [], 0
            for a, z in spans:
                left_over.append(t[at:a])
                at = z
            left_over.append(t[at:])
            result[i, h] = (spans, b"".join(left_over))
        for i, t in zip(left.column("doc_id").to_pylist(), texts_of(left.column("text"))):
            spans, rest_of = result.get((i, md5_hex(t))) or (([(0, len(t))], b"") if len(t) >= SPAN else ([], t))
            row = (i, len(t), len(t) - len(rest_of), len(spans), hashlib.sha256(rest_of).hexdigest())
            rows.append((*row, rest_of) if keep else row)
        columns = list(zip(*rows)) if rows else [()] * len(schema)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    sent = d.groupBy("g").cogroup(classes.groupBy("g")).applyInArrow(trimmed(send), EMIT)
    back = sent.repartition(buckets, "b").groupBy("b").applyInArrow(trimmed(answer), REPLY)
    around = d.groupBy("g").cogroup(back.unionByName(classes).groupBy("g")).applyInArrow(trimmed(surround), EMIT)
    lost = around.repartition(buckets, "b").groupBy("b").applyInArrow(trimmed(lambda table: resolve(table, merge)), REPLY)
    out = d.groupBy("g").cogroup(lost.unionByName(classes).groupBy("g")).applyInArrow(trimmed(finish), RESULT + ", kept binary" * keep)
    alone = docs.where("doc_id IS NULL").select(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("t"))
    size = F.octet_length("t").cast("long")
    alone = alone.select(F.lit(None).cast("long").alias("doc_id"), size.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("t", 256).alias("kept_sha256"), *([F.col("t").alias("kept")] if keep else []))
    return out.unionByName(alone)


def oracle() -> str:
    """The same rows from all 50-byte windows, written as hexadecimal digits."""
    return """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
w AS (SELECT doc_id, unnest(generate_series(0, length(hx) // 2 - 50)) AS i, hx FROM h WHERE length(hx) >= 100),
k AS (SELECT doc_id, i, hash(substr(hx, 2 * i + 1, 100)) AS a, md5(substr(hx, 2 * i + 1, 100)) AS m FROM w),
f AS (SELECT a, m, min(doc_id) AS d FROM k GROUP BY ALL),
lost AS (SELECT doc_id, i FROM k JOIN f USING (a, m) WHERE d < doc_id),
cut AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM
  (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM lost)),
runs AS (SELECT doc_id, min(i) AS s, max(i) + 50 AS e FROM cut GROUP BY doc_id, run),
gap AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS s, s AS e FROM (SELECT doc_id, s, e FROM runs UNION ALL SELECT doc_id, length(hx) // 2, length(hx) // 2 FROM h)),
kept AS (SELECT doc_id, string_agg(substr(hx, 2 * gap.s + 1, 2 * (gap.e - gap.s)), '' ORDER BY gap.s) AS t FROM gap JOIN h USING (doc_id) WHERE gap.e > gap.s GROUP BY doc_id),
sums AS (SELECT doc_id, sum(e - s) AS removed, count(*) AS spans FROM runs GROUP BY doc_id)
SELECT h.doc_id, (length(hx) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(t, ''))) AS kept_sha256
FROM h LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
