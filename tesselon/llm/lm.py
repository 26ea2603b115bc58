"""Language-model scoring with a gated recurrent network (op 4).

Counts of all training tokens (words and one end per document; documents whose crc32(doc_id) mod 7 is not 2) are
summed over the whole corpus in hash-range buckets, which send each group of documents the counts of its words. The
base score is the add-one unigram log10 probability from those counts.

The model is a gated recurrent unit over token classes with a class-factored output softmax,
p(w | h) = p(class | h) * p(w | class, h). The HEAD most frequent tokens stand in classes of WIDTH with a softmax of
their own; every other token is in the class of its count's power of two, inside which it has its add-one share of
the class, and an unseen token is the class of its own, so the probabilities of a text are proper. Class sizes and
shares come from the counts of the whole corpus. The weights are fitted in numpy by truncated backpropagation
through time on all training documents, in ROUNDS passes (one) whatever the size of the input: in each of them every group
of documents goes once over all of its own from the common weights, and the groups' weights are averaged by
their tokens. Texts are turned to classes once and kept as such for the rounds and the scoring. Scoring covers every row
and whole texts: long texts run in windows with the state carried from one to the next.

Null and empty texts are the end token alone. Rows with null doc_id are scored and count as training rows. Without
training rows every token is unseen. Repeated rows count as often as they occur and give equal rows. Words are
recognized by 64-bit hashes; of equally frequent ones those with the smaller hash come first in the head. A text of any
length is scored whole. Rows that repeat both a doc_id and a length are in one group. Other columns are ignored.
"""

from __future__ import annotations

import copy
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import checkpointed, chunks_of, crc_mod, emit, gathered, partitions, replies, split_counts, tasks_of, text_rows, texts_of, trimmed, word_hashes

HEAD, WIDTH, BINS = 4096, 64, 40
HIDDEN, WINDOW, STREAMS = 16, 16, 1024
#: Passes over all training documents, and updates of a group in a round before it takes more streams.
ROUNDS, UPDATES, RATE = 1, 45, 0.06
#: Steps of the token counts for each power of two.
STEPS_OF_COUNT = 32
#: Rows whose class probabilities are computed at once.
ROWS = 2048
#: Pieces in which weights are averaged.
PARTS = 32
#: Documents scored side by side, and steps whose outputs are computed at once.
BATCH_DOCS, BATCH_BYTES, STEPS = 4096, 16 << 20, 32
END = np.uint64(0xE0D0C0B0A0908070)
_WIRE = np.dtype([("key", "<u8"), ("n", "<u4")])
_COUNTS = "g int, b int, payload binary, tokens long, kinds long, head array<struct<k:long,c:long>>, bins array<struct<mass:long,share:long>>"


def token_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """Hashes of each text's words, then the end."""
    out: list[np.ndarray] = []
    for lo, hi in chunks_of(texts):
        words, n = word_hashes(texts[lo:hi])
        out += [np.append(x, END) for x in split_counts(words, n)]
    return out


def bin_of(count: np.ndarray) -> np.ndarray:
    """0 for unseen tokens, else 1 + log2 of the count."""
    return np.where(count > 0, 1 + np.floor(np.log2(np.maximum(count, 1))).astype(np.int64), 0)


# --- the network -------------------------------------------------------------------------------------------
def _sigmoid(x):
    """Logistic function in place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)


def _exponential(x):
    """exp of the rows in place, and their sums. Logits start at 0 or below and stay far from the bound."""
    np.minimum(x, 60, out=x)
    np.exp(x, out=x)
    return x @ np.ones(x.shape[1], x.dtype) + np.float32(1e-30)


def _softmax(x, count):
    """Softmax of the rows in place, divided by count."""
    x *= (1 / (_exponential(x) * count))[:, None]


class Network:
    """Classes 0 .. C-1 hold head tokens, the others are count bins; inputs are tokens, bins and the start."""

    def __init__(self, head_counts: np.ndarray, mass: np.ndarray, hidden: int = HIDDEN, seed: int = 1):
        rng = np.random.default_rng(seed)
        n = len(head_counts)
        self.head, self.hidden = n, hidden
        self.groups = -(-n // WIDTH)
        self.inputs = n + len(mass) + 1
        padded = np.full(self.groups * WIDTH, -30.0)
        padded[:n] = np.log(head_counts + 1.0)
        sums = np.array([np.exp(padded[k * WIDTH : (k + 1) * WIDTH]).sum() for k in range(self.groups)])
        totals = np.log(np.concatenate([sums, mass + 1.0]))
        padded[:n] -= padded[:n].max(initial=0)
        f = np.float32
        self.p = {
            "x": rng.normal(0, 0.1, (self.inputs, 3 * hidden)).astype(f),
            "u": (rng.normal(0, 1, (hidden, 3 * hidden)) / np.sqrt(hidden)).astype(f),
            "c": np.zeros((hidden, self.groups + len(mass)), f),
            "cb": (totals - totals.max()).astype(f),
            "w": np.zeros((max(self.groups, 1), hidden, WIDTH), f),
            "wb": padded.reshape(-1, WIDTH).astype(f) if self.groups else np.zeros((1, WIDTH), f),
        }

    def step(self, h: np.ndarray, x: np.ndarray) -> np.ndarray:
        k = self.hidden
        a = self.p["x"][x]
        b = h @ self.p["u"]
        gate = a[:, : 2 * k] + b[:, : 2 * k]
        _sigmoid(gate)
        z, r = gate[:, :k], gate[:, k:]
        new = np.tanh(a[:, 2 * k :] + r * b[:, 2 * k :])
        return new + z * (h - new)

    def classes(self, t: np.ndarray) -> np.ndarray:
        """Class of each token (below head: a head token, else a bin)."""
        return np.where(t < self.head, t // WIDTH, t - self.head + self.groups)

    def output(self, h: np.ndarray, t: np.ndarray) -> np.ndarray:
        """log p of tokens t from states h, up to the share inside a bin."""
        c = self.classes(t)
        out = np.empty(len(t), h.dtype)
        for lo in range(0, len(t), ROWS):
            some = slice(lo, lo + ROWS)
            logits = h[some] @ self.p["c"]
            logits += self.p["cb"]
            own = logits[np.arange(len(logits)), c[some]]
            out[some] = own - np.log(_exponential(logits))
        inner = np.flatnonzero(t < self.head)
        inner = inner[np.argsort(c[inner].astype(np.int16), kind="stable")]
        edges = np.searchsorted(c[inner], np.arange(self.groups + 1))
        for k in np.flatnonzero(np.diff(edges)).tolist():
            some = inner[edges[k] : edges[k + 1]]
            own = h[some] @ self.p["w"][k] + self.p["wb"][k]
            at = own[np.arange(len(some)), t[some] % WIDTH]
            out[some] += at - np.log(_exponential(own))
        return out

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of whole token sequences; the state goes on from window to window."""
        total = np.zeros(len(docs))
        order = np.argsort([-len(d) for d in docs], kind="stable")
        for at in range(0, len(docs), BATCH_DOCS):
            own = order[at : at + BATCH_DOCS]
            lens = np.array([len(docs[i]) for i in own])
            flat = np.concatenate([docs[i] for i in own])
            first = np.cumsum(lens) - lens
            h = np.zeros((len(own), self.hidden), np.float32)
            x = np.full(len(own), self.inputs - 1)
            for t0 in range(0, int(lens[0]), STEPS):
                states, targets, who = [], [], []
                for t in range(t0, min(t0 + STEPS, int(lens[0]))):
                    live = int(np.searchsorted(-lens, -t))
                    h = self.step(h[:live], x[:live])
                    x = flat[first[:live] + t]
                    states.append(h)
                    targets.append(x)
                    who.append(live)
                got = self.output(np.concatenate(states), np.concatenate(targets))
                rows = np.concatenate([np.arange(n) for n in who])
                total[own[: who[0]]] += np.bincount(rows, got, minlength=who[0])
        return total

    def train(self, docs: list[np.ndarray], rate: float = RATE) -> None:
        """One pass of truncated backpropagation: windows of WINDOW steps over parallel streams, the state carried
        over. Every token is a target; the end of the last stream is padded with -1."""
        docs = [d for d in docs if len(d)]
        if not docs:
            return
        whole = np.concatenate(docs).astype(np.int64)
        begins = np.zeros(len(whole), bool)
        begins[np.cumsum([0] + [len(d) for d in docs[:-1]])] = True
        streams = max(1, min(STREAMS, len(whole) // (UPDATES * WINDOW)))
        length = -(-len(whole) // streams)
        pad = streams * length - len(whole)
        t = np.append(whole, np.full(pad, -1)).reshape(streams, length).T
        s = np.append(begins, np.ones(pad, bool)).reshape(streams, length).T.copy()
        s[0] = True
        x = np.where(s, self.inputs - 1, np.concatenate([t[:1], t[:-1]]))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        n = 0
        h = np.zeros((streams, self.hidden), np.float32)
        for at in range(0, length, WINDOW):
            h, grad = self._window(h, x[at : at + WINDOW], t[at : at + WINDOW], s[at : at + WINDOW])
            n += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            for k, g in grad.items():
                g *= min(1.0, 5.0 / (norm + 1e-9))
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                self.p[k] -= (rate / (1 + n / 2000) * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-6)).astype(np.float32)

    def _window(self, h, x, t, start):
        # one column for each stream: the gates are then contiguous
        k, p = self.hidden, self.p
        u, table = np.ascontiguousarray(p["u"].T), np.ascontiguousarray(p["x"].T)
        kept = []
        fresh = start.any(1)
        h = np.ascontiguousarray(h.T)
        states = np.empty((len(x), x.shape[1], k), h.dtype)
        for i in range(len(x)):
            if fresh[i]:
                h = h * ~start[i]
            a, b = table.take(x[i], 1), u @ h
            gate = a[: 2 * k]
            gate += b[: 2 * k]
            _sigmoid(gate)
            z, r, q = gate[:k], gate[k:], b[2 * k :]
            new = r * q
            new += a[2 * k :]
            np.tanh(new, out=new)
            kept.append((h, z, r, q, new))
            h = h - new
            h *= z
            h += new
            states[i] = h.T
        states = states.reshape(-1, k)
        real = np.flatnonzero(t.ravel() >= 0)
        target = t.ravel()[real]
        back = np.zeros_like(states)
        states = states[real]
        count = np.float32(max(len(target), 1))
        grad = {n: np.zeros_like(w) for n, w in p.items()}
        c = self.classes(target)
        own_back = np.empty_like(states)
        for lo in range(0, len(states), ROWS):  # rows that stay in the processor's cache
            some = slice(lo, lo + ROWS)
            at = states[some]
            prob = at @ p["c"]
            prob += p["cb"]
            _softmax(prob, count)
            prob[np.arange(len(prob)), c[some]] -= 1 / count
            grad["c"] += at.T @ prob
            grad["cb"] += prob.sum(0)
            own_back[some] = prob @ p["c"].T
        inner = np.flatnonzero(target < self.head)
        inner = inner[np.argsort(c[inner].astype(np.int16), kind="stable")]
        edges = np.searchsorted(c[inner], np.arange(self.groups + 1))
        for j in np.flatnonzero(np.diff(edges)).tolist():
            some = inner[edges[j] : edges[j + 1]]
            at = states[some]
            e = at @ p["w"][j] + p["wb"][j]
            _softmax(e, count)
            e[np.arange(len(some)), target[some] % WIDTH] -= 1 / count
            grad["w"][j], grad["wb"][j] = at.T @ e, e.sum(0)
            own_back[some] += e @ p["w"][j].T
        back[real] = own_back
        back = back.reshape(len(x), -1, k)
        carry = np.zeros_like(h)
        into = np.empty((3 * k, x.size), h.dtype)
        db = np.empty((3 * k, x.shape[1]), h.dtype)
        for i in range(len(x) - 1, -1, -1):
            before, z, r, q, new = kept[i]
            d = back[i].T + carry
            dz, dr, dn = db[:k], db[k : 2 * k], db[2 * k :]
            # before - new, times z (1 - z); 1 - new^2, times 1 - z; q r (1 - r)
            other = 1 - z
            np.subtract(before, new, out=dz)
            dz *= z
            dz *= d
            dz *= other
            np.multiply(new, new, out=dn)
            np.subtract(1, dn, out=dn)
            dn *= other
            dn *= d
            np.subtract(1, r, out=dr)
            dr *= r
            dr *= q
            dr *= dn
            into[:, i * x.shape[1] : (i + 1) * x.shape[1]] = db
            dn *= r
            grad["u"] += before @ db.T
            d *= z
            d += p["u"] @ db
            if fresh[i]:
                d *= ~start[i]
            carry = d
        tokens = x.ravel()
        for j in range(3 * k):
            grad["x"][:, j] = np.bincount(tokens, into[j], minlength=self.inputs)
        return h.T, grad

    def weights(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def take(self, flat: np.ndarray) -> None:
        at = 0
        for k in sorted(self.p):
            size = self.p[k].size
            self.p[k] = flat[at : at + size].reshape(self.p[k].shape).astype(np.float32)
            at += size


# --- counts of the corpus ----------------------------------------------------------------------------------
def _keyed(docs: DataFrame, n: int) -> DataFrame:
    held = F.coalesce(crc_mod() % 7 == 2, F.lit(False)).alias("held_out")
    d = text_rows(docs)
    return d.select(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(n)).cast("int").alias("g"), "doc_id", "text", held).repartition(tasks_of(d.sparkSession, n), "g")


def corpus_counts(d: DataFrame, n: int) -> DataFrame:
    """Counts of training tokens: replies to each group, and per bucket its totals, frequent tokens and bins."""

    def send(key, table):
        own = token_hashes(texts_of(table.column("text")))
        train = ~table.column("held_out").combine_chunks().to_numpy(zero_copy_only=False)
        whole = np.concatenate(own)
        weight = np.repeat(train, [len(x) for x in own])
        keys, place = np.unique(whole, return_inverse=True)
        return emit(key[0].as_py(), keys, n, _WIRE, n=np.bincount(place, weight, minlength=len(keys)).astype(np.int64))

    def answer(table):
        kept = {}

        def total(merged):
            keys, place = np.unique(merged["key"], return_inverse=True)
            c = np.bincount(place, merged["n"], minlength=len(keys)).astype(np.int64)
            kept["keys"], kept["c"] = keys, c
            return c[place].astype("<u8")

        out = replies(table, _WIRE, total)
        keys, c = kept["keys"], kept["c"]
        top = np.lexsort((keys, -c))[:HEAD]
        top = top[c[top] > 0]
        head = [{"k": int(k), "c": int(x)} for k, x in zip(keys[top].astype(np.int64), c[top])]
        bins = bin_of(c)
        seen = c > 0
        bins = [{"mass": int(x), "share": int(y)} for x, y in zip(np.bincount(bins[seen], c[seen], minlength=BINS), np.bincount(bins[seen], c[seen] + 1, minlength=BINS))]
        rest = [None] * (out.num_rows - 1)
        first = lambda v, e: pa.array([v] + [e] * len(rest))
        entry = pa.list_(pa.struct([("k", pa.int64()), ("c", pa.int64())]))
        pair = pa.list_(pa.struct([("mass", pa.int64()), ("share", pa.int64())]))
        return (
            out.append_column("tokens", first(int(c.sum()), 0)).append_column("kinds", first(int(seen.sum()), 0))
            .append_column("head", pa.array([head, *rest], entry)).append_column("bins", pa.array([bins, *rest], pair))
        )

    return d.groupBy("g").applyInArrow(trimmed(send), "b int, g int, payload binary").repartition(tasks_of(d.sparkSession, n), "b").groupBy("b").applyInArrow(trimmed(answer), _COUNTS)


def fitted(rows: DataFrame, network: Network, turn: int, fan: int = 16) -> Network:
    """The network after round `turn`: each group's pass over all its training documents, averaged by tokens;
    fan sums of weights are made before the last one."""

    def passes(batches):
        def one(g, own):
            net = copy.deepcopy(network)
            # in an order of their own, as rows come in any
            docs = [np.frombuffer(t, np.uint16) for _, _, t in sorted(own)]
            net.train(docs, RATE / (1 + turn))
            tokens = sum(map(len, docs))
            parts = [(x * float(tokens)).tobytes() for x in np.array_split(net.weights().astype(np.float64), PARTS)]
            return pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([g] * PARTS, pa.int32()), pa.array([tokens] * PARTS, pa.int64()), pa.array(parts, pa.binary())], ["part", "g", "tokens", "payload"])

        # the rows of a group are next to each other
        last, own = None, []
        for batch in batches:
            for g, i, t in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if g != last and own:
                    yield one(last, own)
                    own = []
                last = g
                own.append((i is not None, i or 0, t))
        if own:
            yield one(last, own)

    def total(table):
        """Sum of the weights of some groups, times their tokens, in the order of the groups."""
        order = np.argsort(table.column("g").to_numpy(), kind="stable").tolist()
        n, payload = table.column("tokens").to_numpy(), table.column("payload").to_pylist()
        whole = sum(np.frombuffer(payload[k], np.float64) for k in order)
        first = [table.column(c).combine_chunks().slice(0, 1) for c in ("part", "some", "g")]
        return pa.table([*first, pa.array([int(n.sum())]), pa.array([whole.tobytes()], pa.binary())], names=["part", "some", "g", "tokens", "payload"])

    train = rows.where("NOT held_out").select("g", "doc_id", "tokens")
    shape = "part int, some int, g int, tokens long, payload binary"
    trained = train.mapInArrow(passes, "part int, g int, tokens long, payload binary").withColumn("some", F.pmod("g", F.lit(fan)).cast("int"))
    trained = trained.select("part", "some", "g", "tokens", "payload")
    # sums of sums, so that no task holds the weights of all groups
    some = trained.groupBy("part", "some").applyInArrow(trimmed(total), shape).withColumn("g", F.col("some"))
    # bounded: PARTS pieces of one set of weights
    got = some.groupBy("part").applyInArrow(trimmed(total), shape).collect()
    out = copy.deepcopy(network)
    if got:
        out.take(np.concatenate([np.frombuffer(r["payload"], np.float64) / max(r["tokens"], 1) for r in sorted(got, key=lambda r: r["part"])]))
    return out


def score(docs: DataFrame) -> DataFrame:
    n = partitions(docs)
    d = _keyed(docs, n)
    counts = checkpointed(corpus_counts(d, n))
    tokens, kinds = counts.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    # bounded: HEAD tokens and BINS sums; steps of the count tell first where the HEAD most frequent ones end, so that no
    # bucket sends all of its own
    frequent = counts.select(F.inline("head")).withColumn("step", F.floor(F.log2("c") * STEPS_OF_COUNT))
    last, above = 0, 0
    for r in frequent.groupBy("step").agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():
        last, above = r["step"], above + r["n"]
        if above >= HEAD:
            break
    head = frequent.where(F.col("step") >= last).orderBy(F.desc("c"), "k").limit(HEAD).collect()
    sums = {r["pos"]: (r["mass"], r["share"]) for r in counts.select(F.posexplode("bins").alias("pos", "x")).groupBy("pos").agg(F.sum("x.mass").alias("mass"), F.sum("x.share").alias("share")).collect()}
    mass, share = (np.array([sums.get(k, (0, 0))[i] for k in range(BINS)], np.float64) for i in (0, 1))
    key = np.array([r["k"] for r in head], np.int64).astype(np.uint64)
    c = np.array([r["c"] for r in head], np.int64)
    own = bin_of(c)
    np.subtract.at(mass, own, c)
    np.subtract.at(share, own, c + 1)
    share[0] = 1  # all unseen tokens are one
    used = int(np.flatnonzero(share)[-1]) + 1
    mass, share = mass[:used], share[:used]
    by_key = np.argsort(key)
    keys, place = key[by_key], by_key

    def classed(hashes: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Model tokens, and log of the share of a token inside its bin (0 for head tokens)."""
        at = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
        known = keys[at] == hashes if len(keys) else np.zeros(len(hashes), bool)
        bins = bin_of(count)
        t = np.where(known, place[at] if len(keys) else 0, len(keys) + bins)
        return t, np.where(known | (bins == 0), 0.0, np.log((count + 1) / np.maximum(share[np.minimum(bins, used - 1)], 1)))

    floor = float(tokens + kinds + 1)

    def classes(key, left, right):
        own = token_hashes(texts_of(left.column("text")))
        whole = np.concatenate(own) if own else np.zeros(0, np.uint64)
        distinct, at = np.unique(whole, return_inverse=True)
        count = gathered(right, "<u8").astype(np.int64)
        lens = np.array([len(x) for x in own], np.int64)
        doc = np.repeat(np.arange(len(own)), lens)
        t, inside = classed(distinct, count)
        base = np.bincount(doc, np.log10((count[at] + 1) / floor), minlength=len(own))
        known = np.bincount(doc, count[at] > 0, minlength=len(own)).astype(np.int64)
        share = np.bincount(doc, inside[at], minlength=len(own))
        model = [x.tobytes() for x in np.split(t.astype(np.uint16)[at], np.cumsum(lens)[:-1])] if own else []
        g = pa.array(np.full(len(own), key[0].as_py(), np.int32))
        held = left.column("held_out").combine_chunks()
        return pa.table({"g": g, "doc_id": left.column("doc_id").combine_chunks(), "tokens": pa.array(model, pa.binary()), "held_out": held, "n_tokens": pa.array(lens), "n_known": pa.array(known), "base_score": pa.array(base), "inside": pa.array(share)})

    kinds_of = "g int, doc_id long, tokens binary, held_out boolean, n_tokens long, n_known long, base_score double, inside double"
    rows = checkpointed(d.groupBy("g").cogroup(counts.select("g", "b", "payload").groupBy("g")).applyInArrow(trimmed(classes), kinds_of))
    network = Network(c, mass)
    for turn in range(ROUNDS):
        network = fitted(rows, network, turn, math.ceil(math.sqrt(n)))

    def scored(batches):
        def finish(own):
            table = pa.Table.from_batches(own)
            model = network.score([np.frombuffer(x, np.uint16).astype(np.int64) for x in table.column("tokens").to_pylist()]) + table.column("inside").to_numpy()
            return table.select(["doc_id", "held_out", "n_tokens", "n_known", "base_score"]).append_column("score", pa.array(model / np.log(10))).to_batches()

        # many documents side by side
        own, n_rows, n_bytes = [], 0, 0
        for batch in batches:
            own.append(batch)
            n_rows += batch.num_rows
            n_bytes += batch.nbytes
            if n_rows >= BATCH_DOCS or n_bytes >= BATCH_BYTES:
                yield from finish(own)
                own, n_rows, n_bytes = [], 0, 0
        if n_rows:
            yield from finish(own)

    out = rows.select("doc_id", "tokens", "held_out", "n_tokens", "n_known", "base_score", "inside").mapInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"), "base_score", "score")
