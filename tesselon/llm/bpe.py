"""Byte-level BPE: a pair occurrence index (op 8) and counting by a whole-token shortcut (op 5).

The vocabulary file is a parameter. Documents with null text count as empty. Repeated rows give equal rows;
other columns of the input are ignored. Special strings inside a text (added tokens of the file) become their
own token, as the library does by default.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import pretokens
from .textcore import release, text_rows

#: Distinct pre-tokens that a task keeps before it starts its table anew.
TABLE_TYPES = 600_000
#: Characters of text handled at once by a task.
BATCH_CHARS = 12_000_000
_SHIFT = np.int64(1 << 20)


def byte_letters() -> dict[int, str]:
    """The printable letter for each byte: itself where printable, else the next letters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Vocabulary:
    """Ids, merges in rank order and added tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        ids = whole["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in whole["model"]["merges"]]
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        self.byte_id = np.array([ids[letters[b]] for b in range(256)], np.int64)
        left, right, made = (np.array(x, np.int64) for x in zip(*((ids[a], ids[b], ids[a + b]) for a, b in pairs)))
        self.left, self.right, self.made = left, right, made
        key = left * _SHIFT + right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int64)
        self.bytes = {i: bytes(back[c] for c in s) for s, i in ids.items()}
        self.added = {x["content"]: x["id"] for x in whole.get("added_tokens", [])}
        for s, i in self.added.items():
            self.bytes[i] = s.encode()
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def rank(self, key: np.ndarray) -> np.ndarray:
        """Ranks of pair keys, -1 where the pair is not merged."""
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)


def encode_words(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, joined, and the number of ids of each.

    Every pair of neighbouring symbols that some merge knows is kept in an index from its rank to all its
    positions. Ranks are taken in ascending order; merging a pair everywhere makes new pairs left and right of
    it, which are added to the lists of their ranks. A new pair contains the new symbol, so its rank is higher.
    """
    lens = np.fromiter(map(len, words), np.int64, len(words))
    n = int(lens.sum())
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
    # one closing cell per word keeps pairs inside words
    sym = np.full(n + len(words) + 1, -1, np.int64)
    word = np.repeat(np.arange(len(words)), lens)
    cell = np.arange(n) + word + 1
    sym[cell] = v.byte_id[np.frombuffer(b"".join(words), np.uint8)]
    nxt = np.arange(1, len(sym) + 1, dtype=np.int32)
    prv = np.arange(-1, len(sym) - 1, dtype=np.int32)
    nxt[-1] = 0
    index: dict[int, list[np.ndarray]] = defaultdict(list)
    queue: list[int] = []

    def add(at: np.ndarray) -> None:
        rank = v.rank(sym[at] * _SHIFT + sym[nxt[at]])
        known = rank >= 0
        if not known.any():
            return
        at, rank = at[known], rank[known]
        if len(rank) > 1:
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            firsts = rank[np.concatenate([[0], cut])].tolist()
            lists = np.split(at, cut) if len(cut) else [at]
        else:
            firsts, lists = [int(rank[0])], [at]
        for r, x in zip(firsts, lists):
            if r not in index:
                heapq.heappush(queue, r)
            index[r].append(x)

    inner = cell[(sym[cell] >= 0) & (sym[cell + 1] >= 0)]
    add(inner)
    while queue:
        r = heapq.heappop(queue)
        found = index.pop(r)
        at = found[0] if len(found) == 1 else np.concatenate(found)
        a, b, made = v.left[r], v.right[r], v.made[r]
        second = nxt[at]
        live = (sym[at] == a) & (sym[second] == b)
        if not live.all():
            at = at[live]
        if a == b or len(found) > 1:
            at = np.unique(at)
        if not len(at):
            continue
        if a == b and len(at) > 1:  # of overlapping pairs the first, third and so on
            joined = np.concatenate([[False], nxt[at[:-1]] == at[1:]])
            place = np.arange(len(at))
            start = np.maximum.accumulate(np.where(joined, 0, place))
            at = at[(place - start) % 2 == 0]
        second = nxt[at]
        after = nxt[second]
        sym[at], sym[second] = made, -2
        nxt[at], prv[after] = after, at
        before = prv[at]
        before = before[sym[before] >= 0]
        follows = at[sym[after] >= 0]
        if len(before) and len(follows):
            add(np.unique(np.concatenate([before, follows])))
        elif len(before):
            add(np.unique(before))
        elif len(follows):
            add(follows)
    kept = sym[cell] >= 0
    return sym[cell[kept]], np.bincount(word[kept], minlength=len(words))


class Types:
    """Distinct pre-tokens of a task with what was computed for each of them once."""

    def __init__(self, v: Vocabulary, work):
        self.v, self.work, self.rows = v, work, []
        self.ids: defaultdict = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.special = [self.ids[("special", i)] for i in self.v.added.values()]
        self.rows = [None] * len(self.ids)
        self.of_special = dict(zip(self.v.added, self.special))

    def split(self, text: str) -> list[int]:
        get = self.ids.__getitem__
        if self.v.special is None or not any(s in text for s in self.v.added):
            return list(map(get, pretokens(text)))
        out: list[int] = []
        for k, part in enumerate(self.v.special.split(text)):
            out += [self.of_special[part]] if k % 2 else map(get, pretokens(part))
        return out

    def settle(self) -> None:
        """Compute the rows of the types seen since the last time."""
        if len(self.rows) < len(self.ids):
            new = list(self.ids)[len(self.rows) :]
            self.rows += self.work([x.encode() for x in new])


def batches(rows, types_of, out_of):
    """Run texts in slices of bounded size; tables of types start anew when they get large."""
    types = types_of()
    for batch in rows:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        done: list[tuple] = []
        first = 0
        while first < len(texts):
            last, total = first, 0
            held = []
            while last < len(texts) and (total == 0 or total + len(texts[last] or "") <= BATCH_CHARS):
                held.append(np.array(types.split(texts[last] or ""), np.int32))
                total += len(texts[last] or "") + 1
                last += 1
            types.settle()
            done += [out_of(types, seen, texts[first + k] or "") for k, seen in enumerate(held)]
            if len(types.ids) > TABLE_TYPES:
                types = types_of()
            first = last
        yield ids, done
        release()


# --- op 8 --------------------------------------------------------------------------------------------------
def encode_decode(docs: DataFrame, vocabulary: str, keep: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per row; with keep also ids (array) and decoded (text).

    Null text is empty: no tokens, the digests of an empty string.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep

    def run(rows):
        v = Vocabulary(vocabulary)

        def work(words):
            ids, n = encode_words(words, v)
            whole, at, out = ids.tolist(), 0, []
            for k in n.tolist():
                own = whole[at : at + k]
                out.append((k, ",".join(map(str, own)), b"".join([v.bytes[i] for i in own]), own if keep else None))
                at += k
            return out

        def types():
            t = Types(v, work)
            t.rows = [(1, str(i), v.bytes[i], [i]) for i in v.added.values()]
            return t

        def out(t, seen, _):
            own = [t.rows[i] for i in seen.tolist()]
            decoded = b"".join([r[2] for r in own]).decode("utf-8", "replace")
            row = (
                sum([r[0] for r in own]),
                hashlib.sha256(",".join([r[1] for r in own]).encode()).hexdigest(),
                hashlib.sha256(decoded.encode()).hexdigest(),
            )
            return (*row, [i for r in own for i in r[3]], decoded) if keep else row

        kinds = [pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32()), pa.string()] * keep
        names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * keep
        for ids, done in batches(rows, types, out):
            columns = list(zip(*done)) if done else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", *names])

    return text_rows(docs).mapInArrow(run, schema)


# --- op 5 --------------------------------------------------------------------------------------------------
def whole_tokens(v: Vocabulary) -> set[str]:
    """Vocabulary strings that the merges bring back to one token when they stand alone.

    The proof runs the merges over every string of the vocabulary; only strings that are valid UTF-8 can be
    pre-tokens.
    """
    plain = [b for i, b in v.bytes.items() if i not in set(v.added.values())]
    _, n = encode_words(plain, v)
    out = set()
    for b, k in zip(plain, n.tolist()):
        if k == 1:
            try:
                out.add(b.decode("utf-8"))
            except UnicodeDecodeError:
                continue
    return out


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) per row.

    A pre-token that is a proven whole token counts as one without a merge; the others are merged, each once per
    task. Null text is empty: zero bytes, zero tokens. The proven set is bounded by the vocabulary (50 thousand
    strings) and sent to the tasks as a broadcast.
    """
    proven = docs.sparkSession.sparkContext.broadcast(frozenset(whole_tokens(Vocabulary(vocabulary))))

    def run(rows):
        v = Vocabulary(vocabulary)
        single = proven.value

        def work(words):
            alone = [w.decode() in single for w in words]
            _, n = encode_words([w for w, one in zip(words, alone) if not one], v)
            rest = iter(n.tolist())
            return [1 if one else next(rest) for one in alone]

        def types():
            t = Types(v, work)
            t.rows = [1] * len(v.added)
            return t

        def out(t, seen, text):
            if not hasattr(t, "n") or len(t.n) < len(t.rows):
                t.n = np.array(t.rows, np.int64)
            return len(text.encode()), int(t.n[seen].sum())

        for ids, done in batches(rows, types, out):
            columns = [pa.array(c, pa.int64()) for c in zip(*done)] if done else [pa.array([], pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", "n_bytes", "n_tokens"])

    out = text_rows(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
