"""Toxicity by non-negative positive-unlabelled learning (op 9).

A linear classifier over hashed presence features (whole words and their first four and five bytes) is fitted in
numpy from confirmed toxic documents (P) and unlabelled documents (U) by the class-prior-corrected risk

    R(f) = prior * E_P[loss(f, +1)] + max(0, E_U[loss(f, -1)] - prior * E_P[loss(f, -1)])

where, whenever the second term turns negative, the step goes against its gradient (the non-negative correction).
Labels, languages, sources and ids are never features.

Fitting reads a bounded sample: at most POSITIVES toxic and UNLABELLED other rows of the training part, by the
smallest hash of their id. The prior is the share of toxic rows among all labelled training rows. Scoring covers
every row and whole texts. Null and empty texts have no features and get the score of the bias alone. Without any
confirmed toxic row the classifier is the prior. Repeated rows give equal rows and count once in the sample (of texts under
one id, the one with the smallest md5); ties of the hash go by id. Texts of any length are scored whole. Other columns
are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import LOWER, bounded_batches, checkpointed, chunks_of, crc_mod, prefix_hash, release, span_hash, texts_of

#: Bounds of the training sample.
POSITIVES, UNLABELLED = 4000, 8000
BITS = 20
THRESHOLD = 0.3
PREFIXES = (4, 5)
#: Least log likelihood ratio of a feature.
EVIDENCE = 8.0

_WORD = np.ones(256, bool)
_WORD[:48] = _WORD[58:97] = _WORD[123:128] = False


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs of some texts, with repetitions; a feature is an index below 2**BITS."""
    buf = LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    inside = _WORD[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    h = prefix_hash(buf)
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    doc = np.searchsorted(offsets, starts, side="right") - 1
    rows, cols = [doc], [span_hash(h, starts, ends) >> np.uint64(64 - BITS)]
    for k in PREFIXES:
        longer = ends - starts > k
        s = starts[longer]
        rows.append(doc[longer])
        cols.append((span_hash(h, s, s + k) ^ np.uint64(0x5851F42D4C957F2D << 1 & 2**64 - 1)) >> np.uint64(64 - BITS))
    return np.concatenate(rows), np.concatenate(cols).astype(np.int64)


def present(texts: list[bytes]) -> list[np.ndarray]:
    """Distinct features of each text."""
    out: list[np.ndarray] = []
    for lo, hi in chunks_of(texts):
        rows, cols = features(texts[lo:hi])
        pair = np.unique(rows * (1 << BITS) + cols)
        out += np.split((pair & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(pair >> BITS, np.arange(1, hi - lo)))
    return out


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = 600, rate: float = 0.03, lasso: float = 1e-3):
    """(features, weights, bias) of the classifier.

    A feature takes part if at least three positives have it and the likelihood ratio of its rate among positives
    against its rate among unlabelled rows passes EVIDENCE (natural logarithm); the others keep weight 0.
    """
    if not positive or not unlabelled or not 0 < prior < 1:
        p = min(max(prior, 1e-6), 1 - 1e-6)
        return np.zeros(0, np.int64), np.zeros(0), float(np.log(p / (1 - p)))
    seen, n = np.unique(np.concatenate(positive), return_counts=True)
    everywhere, counts = np.unique(np.concatenate(unlabelled), return_counts=True)
    at = np.minimum(np.searchsorted(everywhere, seen), max(len(everywhere) - 1, 0))
    common = np.where(everywhere[at] == seen, counts[at], 0) if len(everywhere) else np.zeros(len(seen))
    expected = np.maximum(common, 1) / len(unlabelled) * len(positive)
    evidence = n * np.log(n / expected) - (n - expected)
    kept = seen[(n >= 3) & (n > expected) & (evidence >= EVIDENCE)]

    def matrix(own):
        rows, cols = [], []
        for i, x in enumerate(own):
            at = np.minimum(np.searchsorted(kept, x), max(len(kept) - 1, 0))
            at = at[kept[at] == x] if len(kept) else at[:0]
            cols.append(at)
            rows.append(np.full(len(at), i))
        return np.concatenate(rows), np.concatenate(cols), len(own)

    p, u = matrix(positive), matrix(unlabelled)
    w, bias = np.zeros(len(kept)), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)

    def margin(x):
        return np.clip(np.bincount(x[0], w[x[1]], minlength=x[2]) + bias, -50, 50)

    def back(x, g):
        return np.concatenate([np.bincount(x[1], g[x[0]], minlength=len(kept)), [g.sum()]])

    for t in range(1, rounds + 1):
        sp, su = 1 / (1 + np.exp(-margin(p))), 1 / (1 + np.exp(-margin(u)))
        # logistic loss: loss(f, +1) has slope s - 1, loss(f, -1) has slope s
        toxic = back(p, prior * (sp - 1) / p[2])
        other = back(u, su / u[2]) - back(p, prior * sp / p[2])
        risk = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
        g = toxic + other if risk >= 0 else -other
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-6)
        w -= step[:-1]
        bias -= float(step[-1])
        shrink = lasso * rate / (np.sqrt(v[:-1] / (1 - 0.999**t)) + 1e-6)
        w = np.sign(w) * np.maximum(np.abs(w) - shrink, 0)
    used = np.flatnonzero(w)
    return kept[used], w[used], bias


def margins(texts: list[bytes], index: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    dense = np.zeros(1 << BITS, np.float64)
    dense[index] = weights
    out = np.full(len(texts), bias)
    for lo, hi in chunks_of(texts):
        rows, cols = features(texts[lo:hi])
        hit = dense[cols] != 0
        pair = np.unique(rows[hit] * (1 << BITS) + cols[hit])
        out[lo:hi] += np.bincount(pair >> BITS, dense[pair & ((1 << BITS) - 1)], minlength=hi - lo)
    return out


def training_rows(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int) -> DataFrame:
    """(doc_id, positive) of the bounded sample: rows of the training part with the smallest hashes."""
    train = crc_mod() % 4 != 2
    toxic = labels.where(train & (F.col("toxic") == 1)).select("doc_id").distinct()
    p = toxic.orderBy(F.xxhash64("doc_id"), "doc_id").limit(positives).select("doc_id", F.lit(True).alias("positive"))
    u = docs.where(train).select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(unlabelled)
    return p.union(u.select("doc_id", F.lit(False).alias("positive")))


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED):
    """Fit the classifier; labels come only from rows whose crc32(doc_id) mod 4 is not 2."""
    bounded_batches(docs.sparkSession)
    labelled = labels.where((crc_mod() % 4 != 2) & F.col("toxic").isNotNull())
    prior = labelled.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]

    def run(rows):
        for batch in rows:
            own = present(texts_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int32()))], ["positive", "f"])

    chosen = training_rows(docs.select("doc_id"), labels, positives, unlabelled)
    # at most positives + unlabelled ids of 9 bytes; of rows that repeat an id, the text with the smallest md5
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("positive", "doc_id")
    sample = sample.agg(F.min_by("text", F.md5(F.coalesce("text", F.lit("")))).alias("text")).select("positive", "text")
    rows = checkpointed(sample.mapInArrow(run, "positive boolean, f array<int>"))
    # what the classifier can use, at most 2**BITS features, is chosen before anything is gathered
    count = rows.agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u")).first()
    per = rows.select("positive", F.explode("f").alias("f")).groupBy("f").agg(F.count_if("positive").alias("n"), F.count_if(~F.col("positive")).alias("c"))
    expected = F.greatest(F.col("c"), F.lit(1)) / float(max(count["u"], 1)) * float(count["p"])
    # a little below the bound, which fit applies
    useful = per.where((F.col("n") >= 3) & (F.col("n") > expected) & (F.col("n") * F.log(F.col("n") / expected) - (F.col("n") - expected) >= EVIDENCE - 0.01))
    used = np.sort(np.array([r["f"] for r in useful.select("f").collect()], np.int32))

    def reduced(batches):
        for batch in batches:
            cells = [x if x is not None else [] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.intersect1d(np.array(x, np.int32), used) for x in cells], pa.list_(pa.int32()))], ["positive", "f"])

    got = rows.mapInArrow(reduced, "positive boolean, f array<int>").toArrow()
    kind = got.column("positive").to_pylist()
    own = [x for chunk in got.column("f").chunks if len(chunk) for x in np.split(chunk.flatten().to_numpy(), np.cumsum(chunk.value_lengths().to_numpy())[:-1])]
    del got
    order = sorted(range(len(own)), key=lambda i: (len(own[i]), zlib.crc32(own[i])))
    out = fit([own[i] for i in order if kind[i]], [own[i] for i in order if not kind[i]], prior or 0.0)
    del own
    release()
    return out


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    index, weights, bias = train(docs, labels)

    def run(rows):
        for batch in rows:
            s = 1 / (1 + np.exp(-np.clip(margins(texts_of(batch.column(1)), index, weights, bias), -50, 50)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(crc_mod() % 4 == 2, F.lit(False))
    return d.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows predicted toxic, with all their columns."""
    index, weights, bias = train(docs, labels)

    def run(rows):
        for batch in rows:
            m = margins(texts_of(batch.column(batch.schema.get_field_index("text"))), index, weights, bias)
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(m, -50, 50))) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
