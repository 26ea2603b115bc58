"""Operators over the whole corpus: suffix dedup, n-gram join, language model, toxicity, decontamination, pipeline."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tesselon.llm import decontamination, lm, ngram_join, suffix, suffix_dedup, textcore, toxicity

from .conftest import EDGES, frame

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def vocabulary(n=400, seed=5):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n)]


def corpus(seed=7, n=60):
    """Copies, near copies, shared passages, ties and the edge rows."""
    r, v = random.Random(seed), vocabulary()
    passage = " ".join(r.choice(v) for _ in range(40))
    rows = list(EDGES)
    for i in range(n):
        words = [r.choice(v) for _ in range(r.randint(1, 150))]
        if i % 3 == 0:
            words[len(words) // 2 : len(words) // 2] = passage.split()
        rows.append((100 + i, " ".join(words)))
        for k in range(i % 4):
            near = list(words)
            for _ in range(k):
                near[r.randrange(len(near))] = r.choice(v)
            rows.append((1000 + 10 * i + k, " ".join(near)))
    return rows


# --- suffix arrays -----------------------------------------------------------------------------------------
@pytest.mark.parametrize("small", [1024, 0])
def test_suffix_array_and_prefixes(small, monkeypatch):
    monkeypatch.setattr(suffix, "SMALL", small)
    r = random.Random(1)
    for t in range(150):
        n, k = r.randint(1, 80), r.choice([2, 3, 5, 200])
        s = np.array([r.randrange(k) for _ in range(n)] if t % 5 else ([1, 0] * 40)[:n], np.uint8)
        order = sorted(range(n), key=lambda i: s[i:].tolist())
        sa = suffix.suffix_array(s, max(k, 2))
        assert sa.tolist() == order
        common = suffix.permuted_common_prefixes(s, sa, 20)
        for a, b in zip(order, order[1:]):
            length = 0
            while max(a, b) + length < n and length < 20 and s[a + length] == s[b + length]:
                length += 1
            assert common[b] == length


def brute_dedup(rows):
    texts = [((t or "").encode(), i) for i, t in rows]
    first = {}
    for b, i in texts:
        if i is not None:
            for k in range(len(b) - 49):
                w = b[k : k + 50]
                first[w] = min(i, first.get(w, i))
    out = []
    for b, i in texts:
        cover = np.zeros(len(b), bool)
        if i is not None:
            for k in range(len(b) - 49):
                if first[b[k : k + 50]] < i:
                    cover[k : k + 50] = True
        spans = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        left = np.frombuffer(b, np.uint8)[~cover].tobytes()
        out.append((i, len(b), int(cover.sum()), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def test_suffix_dedup_matches_brute_force(make):
    rows = corpus(n=40)
    assert sorted(map(tuple, suffix_dedup.dedup(make(rows)).collect()), key=repr) == brute_dedup(rows)


def test_suffix_arrays_alone_give_the_same_rows(make):
    """Nothing is decided by hashes: without joining equal contexts first, only time changes."""
    rows = corpus(n=25)
    assert sorted(map(tuple, suffix_dedup.dedup(make(rows), merge=False).collect()), key=repr) == brute_dedup(rows)


def test_equal_digests_of_different_contexts_stay_apart():
    buf = np.frombuffer(b"aaaabbbbaaaabbbbaaaacccc", np.uint8)
    start, length = np.arange(0, 24, 4), np.full(6, 4)
    number, one = suffix_dedup.distinct(np.ones(6, np.uint64), np.zeros(6, np.int64), start, length, buf, np.zeros(6, np.uint64))
    held = [bytes(buf[s : s + 4]) for s in start]
    assert all(bytes(buf[start[one[number[k]]] :][:4]) == held[k] for k in range(6))
    assert len({number[k] for k in (0, 2, 4)}) == 1


@pytest.mark.parametrize("shard", [suffix_dedup.SHARD_BYTES, 150])
def test_windows_of_one_anchor_in_several_arrays(shard, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    r = random.Random(4)
    left, right = (["".join(r.choice("ab") for _ in range(30)) for _ in range(6)] for _ in range(2))
    own = sorted({(k, a, c) for k in (1, 2) for a in left for c in right[:4]})
    r.shuffle(own)
    own.sort(key=lambda x: x[0])
    texts = [(a + f"anchor-{k}-of-20-bytes"[:20].ljust(20, ".") + c).encode() for k, a, c in own]
    key = np.array([k for k, _, _ in own], np.uint64)
    least = np.array(r.sample(range(1000), len(own)))
    data, n = np.frombuffer(b"".join(texts), np.uint8), np.full(len(own), 80)
    c, lo, hi = suffix_dedup.earlier_ranges(data, np.full(len(own), 30), n, key, least)
    got = np.zeros((len(own), 80), bool)
    for i, a, z in zip(c, lo, hi):
        got[i, a:z] = True
    for i, t in enumerate(texts):
        cover = np.zeros(80, bool)
        for w in range(31):
            if any(least[j] < least[i] and texts[j][w : w + 50] == t[w : w + 50] for j in range(len(own)) if key[j] == key[i]):
                cover[w : w + 50] = True
        assert (got[i] == cover).all()


def test_anchors_spread_over_all_ranges():
    """Their hashes are the least of many, but no range of keys gets more than its share."""
    r = random.Random(3)
    texts = [bytes(r.choices(b"abcdefghij ", k=2000)) for _ in range(100)]
    _, _, key = suffix_dedup.all_anchors(texts)
    share = np.diff(textcore.bucket_edges(np.sort(key), 16)) / len(key)
    assert len(key) > 5000 and share.min() > 0.8 / 16 and share.max() < 1.2 / 16


def test_suffix_dedup_of_nothing(none):
    assert suffix_dedup.dedup(none).collect() == []


# --- n-gram join -------------------------------------------------------------------------------------------
def brute_groups(rows):
    """Row by row (doc_id, set size, component): rows of one doc_id are a node, empty ones link with nothing."""
    own = []
    for i, t in rows:
        w = WORDS.findall((t or "").encode().lower())
        own.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w and i is not None else frozenset()))
    root = {i: i for i, _ in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = sorted({(i, s) for i, s in own if s}, key=lambda x: x[0])
    for k, (a, x) in enumerate(nodes):
        for b, y in nodes[:k]:
            if 100 * len(x & y) >= 75 * len(x | y):
                u, v = sorted((find(a), find(b)))
                root[v] = u
    return sorted(((i, len(s), find(i) if s else i) for i, s in own), key=repr)


def repeated_rows():
    """Rows that repeat a doc_id with copies, near copies and other texts; (5, A), (5, B) link 3 with 7."""
    words = vocabulary()
    a, b = " ".join(words[:40]), " ".join(words[50:90])
    near = " ".join([*words[50:89], "other"])
    return [(3, a), (5, a), (5, b), (7, near), (7, near), (8, ""), (8, b), (9, "alone with few"), (9, None), (2, "two words"), (2, "three words here")]


@pytest.mark.parametrize("block", [ngram_join.BLOCK_BYTES, 4000, 400])
def test_groups_match_brute_force(make, block, monkeypatch):
    """Also with blocks so small that clusters are cut and searched across."""
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", block)
    rows = corpus() + [(10_000 + i, t) for i, t in repeated_rows()]
    got = sorted(map(tuple, ngram_join.groups(make(rows)).collect()), key=repr)
    expected = brute_groups(rows)
    assert got == expected
    assert sum(1 for i, _, c in expected if c != i) > 20


def test_repeated_ids_are_one_node(make):
    got = sorted(map(tuple, ngram_join.groups(make(repeated_rows())).collect()))
    assert got == brute_groups(repeated_rows())
    assert {c for i, n, c in got if i in (3, 5, 7) or (i, n) == (8, 36)} == {3}
    kept = sorted((r.doc_id, r.text or "") for r in ngram_join.kept(make(repeated_rows())).collect())
    assert [i for i, _ in kept] == [2, 3, 8, 9] and (8, "") in kept


@pytest.mark.parametrize("seed", range(3))
def test_search_over_labelled_parts(seed):
    """The forest connects what all links connect, also where some documents are connected beforehand."""
    r = np.random.default_rng(seed)
    base = [np.unique(r.integers(0, 2**63, 60, dtype=np.uint64)) for _ in range(6)]
    sets = []
    for k in range(120):
        own = base[k % 6]
        sets.append(np.unique(np.concatenate([r.permutation(own)[: len(own) - r.integers(0, 14)], r.integers(0, 2**63, r.integers(0, 9), dtype=np.uint64)])))
    ids, sizes = np.arange(120), np.array([len(s) for s in sets])
    label = np.array([k if k % 5 else k % 6 for k in range(120)])
    links = [(a, b) for a in range(120) for b in range(a) if 7 * len(np.intersect1d(sets[a], sets[b])) >= 3 * (sizes[a] + sizes[b])]

    def parts(pairs):
        root = list(range(120))
        for a, b in pairs:
            x, y = root[a], root[b]
            root = [min(x, y) if z in (x, y) else z for z in root]
        return root

    assert parts(ngram_join.linked(ids, sizes, sets)) == parts(links)
    given = [(a, int(np.flatnonzero(label == label[a])[0])) for a in range(120)]
    assert parts([*ngram_join.linked(ids, sizes, sets, label), *given]) == parts([*links, *given])


def family(n=240):
    """Copies of one text with a word of their own in every 100th place or, each third, so often that they link with none."""
    words = vocabulary()[:200]
    rows = []
    for i in range(n):
        own = list(words)
        for p in range(i % 25, 200, 25 if i % 3 == 0 else 100):
            own[p] = f"own{i}x{p}"
        rows.append((i, " ".join(own)))
    return rows


def test_a_family_costs_in_proportion(make, monkeypatch):
    """Members that no size lets link do not go to all blocks of their cluster."""
    rows, sent = family(), []
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 8000)
    search = ngram_join.searched

    def counted(table):
        sent.append(table.count())
        return search(table)

    monkeypatch.setattr(ngram_join, "searched", counted)
    got = sorted(map(tuple, ngram_join.groups(make(rows)).collect()))
    expected = sorted(brute_groups(rows))
    assert got == expected and sum(c == i for i, _, c in expected) > 40
    assert len(sent) == 3 and sum(sent) < 4 * len(rows)


def test_several_groups_share_a_task(make, spark, monkeypatch):
    """What is checkpointed has a file for several groups, and the rows stay those of brute force."""
    rows = corpus() + [(10_000 + i, t) for i, t in repeated_rows()]
    monkeypatch.setattr(textcore, "GROUP_BYTES", 10_000)
    groups, files = textcore.partitions(make(rows)), []

    def checkpointed(df):
        files.append(df.rdd.getNumPartitions())
        return textcore.checkpointed(df)

    monkeypatch.setattr(ngram_join, "checkpointed", checkpointed)
    got = sorted(map(tuple, ngram_join.groups(make(rows)).collect()), key=repr)
    assert got == brute_groups(rows)
    assert groups > 16 and files[0] <= -(-groups // 4)


def test_kept_rows_move_once(make, spark):
    """Texts are dealt by id for the join, and not again for the choice among rows that repeat one."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        out = ngram_join.kept(make(repeated_rows() * 2))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Window" in plan and "Exchange" not in plan.split("SortMergeJoin")[0]
        assert sorted((r.doc_id, r.text or "") for r in out.collect()) == sorted((r.doc_id, r.text or "") for r in ngram_join.kept(make(repeated_rows())).collect())
    finally:
        spark.conf.set(key, before)


def test_visitors_are_searched_against_the_others():
    """Smaller and larger ones, and not among themselves."""
    r = np.random.default_rng(4)
    base = r.integers(0, 2**63, 80, dtype=np.uint64)
    sets = [np.unique(np.concatenate([r.permutation(base)[: r.integers(60, 80)], r.integers(0, 2**63, r.integers(0, 9), dtype=np.uint64)])) for _ in range(80)]
    ids, sizes, visitor = np.arange(80), np.array([len(s) for s in sets]), np.arange(80) % 4 == 0
    links = {(a, b) for a in range(80) for b in range(80) if visitor[a] and not visitor[b] and 7 * len(np.intersect1d(sets[a], sets[b])) >= 3 * (sizes[a] + sizes[b])}
    got = ngram_join.linked(ids, sizes, sets, None, visitor)
    root = list(range(80))
    for a, b in got:
        assert (a, b) in links
        root = [min(root[a], root[b]) if z in (root[a], root[b]) else z for z in root]
    assert links and all(root[a] == root[b] for a, b in links)
    assert ngram_join.linked(ids, sizes, sets, None, np.zeros(80, bool)) == []


def test_one_of_each_group_is_kept(make):
    rows = corpus()
    expected = {i for i, _, c in brute_groups(rows) if c == i and i is not None}
    got = [r.doc_id for r in ngram_join.kept(make(rows)).collect()]
    assert sorted(x for x in got if x is not None) == sorted(expected) and got.count(None) == 1


def test_divide_skip_counts_like_a_heap():
    import heapq

    r = random.Random(2)
    for _ in range(60):
        lists = [sorted(r.sample(range(300), r.randint(1, 200))) for _ in range(r.randint(1, 12))]
        least = r.randint(1, len(lists))
        merged = collections.Counter(heapq.merge(*lists))
        expected = {d: c for d, c in merged.items() if c >= least}
        found, count = ngram_join.divide_skip([np.array(x) for x in lists], least)
        assert dict(zip(found.tolist(), count.tolist())) == expected
        assert dict(zip(*(x.tolist() for x in ngram_join.heap_merge([np.array(x) for x in lists], least)))) == expected
    assert ngram_join.divide_skip([np.array([1])], 2)[0].tolist() == [] == ngram_join.heap_merge([np.array([1]), np.array([2])], 2)[0].tolist()


def test_groups_of_nothing(none):
    assert ngram_join.groups(none).collect() == []
    assert ngram_join.kept(none).collect() == []


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 9), (3, 1), (10, 20), (20, 30), (30, 40), (40, 50)], "u long, v long")
    got = {r.node: r.label for r in textcore.components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 10: 10, 20: 10, 30: 10, 40: 10, 50: 10}


# --- language model ----------------------------------------------------------------------------------------
def test_base_score_and_counts(make):
    rows = corpus(n=30)
    got = lm.score(make(rows)).collect()
    assert len(got) == len(rows)
    count, tokens = collections.Counter(), []
    for i, t in rows:
        w = [*WORDS.findall((t or "").encode().lower()), None]
        held = i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        tokens.append((i, held, w))
        if not held:
            count.update(w)
    n, v = sum(count.values()), len(count)
    expected = sorted((repr(i), held, len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 4)) for i, held, w in tokens)
    assert sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == expected
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_probabilities_of_the_network_sum_to_one():
    net = lm.Network(np.arange(70, 0, -1), np.ones(lm.BINS))
    net.p["c"] += np.random.default_rng(0).normal(0, 1, net.p["c"].shape).astype(np.float32)
    h = np.random.default_rng(1).normal(0, 1, (1, net.hidden)).astype(np.float32)
    every = np.arange(70 + lm.BINS)
    p = np.exp(net.output(np.repeat(h, len(every), 0), every).astype(np.float64))
    assert abs(p.sum() - 1) < 1e-4


def test_state_is_carried_across_windows(monkeypatch):
    net = lm.Network(np.arange(64, 0, -1), np.ones(lm.BINS))
    docs = [np.random.default_rng(k).integers(0, 64, n) for k, n in enumerate((5, 200, 33, 1))]
    whole = net.score(docs)
    monkeypatch.setattr(lm, "STEPS", 7)
    assert np.allclose(whole, net.score(docs), atol=1e-3)
    assert np.allclose(whole, [net.score([d])[0] for d in docs], atol=1e-3)


def test_training_gradient_is_right():
    net = lm.Network(np.arange(40, 0, -1), np.ones(lm.BINS), hidden=4)
    net.p = {k: v.astype(np.float64) + np.random.default_rng(3).normal(0, 0.1, v.shape) for k, v in net.p.items()}
    r = np.random.default_rng(4)
    t = r.integers(0, 60, (6, 3))
    start = np.zeros((6, 3), bool)
    start[0] = start[3, 1] = True
    x = np.where(start, net.inputs - 1, np.concatenate([t[:1], t[:-1]]))
    zero = np.zeros((3, 4))

    def loss():
        h, total = zero, 0.0
        for i in range(6):
            h = net.step(h * ~start[i][:, None], x[i])
            total -= net.output(h, t[i]).sum()
        return total / t.size

    _, grad = net._window(zero, x, t, start)
    for k, g in grad.items():
        at = tuple(q[0] for q in np.nonzero(np.abs(g) == np.abs(g).max()))
        old = net.p[k][at]
        net.p[k][at] = old + 1e-5
        high = loss()
        net.p[k][at] = old - 1e-5
        low = loss()
        net.p[k][at] = old
        assert abs((high - low) / 2e-5 - g[at]) < 1e-4 * max(1, abs(g[at])), k


def test_model_beats_the_base_on_regular_text(make):
    r = random.Random(1)
    pairs = [("alpha", "beta"), ("gamma", "delta"), ("red", "green"), ("up", "down")]
    rows = [(i, " ".join(w for _ in range(40) for w in r.choice(pairs))) for i in range(60)]
    got = [x for x in lm.score(make(rows)).collect() if x.held_out]
    assert sum(x.score for x in got) > 0.8 * sum(x.base_score for x in got)


def test_every_training_document_shapes_the_weights(spark):
    net = lm.Network(np.arange(64, 0, -1), np.ones(lm.BINS))
    r = np.random.default_rng(5)
    docs = [r.integers(0, 64, 6).astype(np.uint16) for _ in range(1900)]
    schema = "g int, doc_id long, tokens binary, held_out boolean"

    def fitted(docs):
        rows = spark.createDataFrame([(k * 2 // len(docs), k, bytearray(d.tobytes()), False) for k, d in enumerate(docs)], schema).coalesce(1)
        out = net
        for turn in range(lm.ROUNDS):
            out = lm.fitted(rows, out, turn)
        return out.weights()

    whole = fitted(docs)
    assert np.array_equal(whole, fitted(docs)) and not np.array_equal(whole, net.weights())
    for k in (0, 949, 1501, 1898, 1899):  # far over 1,500, the former bound
        assert not np.array_equal(whole, fitted([*docs[:k], (docs[k] + 1) % 64, *docs[k + 1 :]])), k


@pytest.mark.parametrize("n", [5, 33, 1000, 2 * lm.UPDATES * lm.WINDOW + 41])
def test_every_token_is_a_target_once_at_every_size(n, monkeypatch):
    net = lm.Network(np.arange(64, 0, -1), np.ones(lm.BINS), hidden=4)
    seen, window = collections.Counter(), net._window

    def count(h, x, t, start):
        seen.update(t[t >= 0].tolist())
        return window(h, x, t, start)

    monkeypatch.setattr(net, "_window", count)
    tokens = np.random.default_rng(n).integers(0, 64, n)
    net.train([tokens[: n // 3], tokens[n // 3 :]])
    assert seen == collections.Counter(tokens.tolist())


def test_several_groups_share_a_task_of_the_model(make, monkeypatch):
    """What is checkpointed has a file for several groups, and the counts stay right."""
    rows = [(i, t) for i, t in corpus() if i is not None and i >= 100]
    monkeypatch.setattr(textcore, "GROUP_BYTES", 3000)
    groups, files = textcore.partitions(make(rows)), []

    def checkpointed(df):
        files.append(df.rdd.getNumPartitions())
        return textcore.checkpointed(df)

    monkeypatch.setattr(lm, "checkpointed", checkpointed)
    got = {r.doc_id: r for r in lm.score(make(rows)).collect()}
    assert groups > 16 and len(files) == 2 and max(files) <= -(-groups // 4)
    own = {i: [*WORDS.findall(t.encode()), b""] for i, t in rows}
    count = collections.Counter(w for i, ws in own.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    total = sum(count.values())
    for i, ws in own.items():
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(ws), sum(count[w] > 0 for w in ws), total)
        assert math.isclose(got[i].base_score, sum(math.log10((count[w] + 1) / (total + len(count) + 1)) for w in ws), rel_tol=1e-9)


def test_scores_of_nothing(none):
    assert lm.score(none).collect() == []


# --- toxicity ----------------------------------------------------------------------------------------------
def toxic_rows(n=600, seed=3):
    r, v = random.Random(seed), vocabulary(150)
    rows, labels = [], []
    for i in range(n):
        words = [r.choice(v) for _ in range(60)]
        bad = r.random() < 0.15
        if bad:
            words[r.randrange(60)] = r.choice(["grumblefoo", "grumblebar", "nastyword"])
        rows.append((i, " ".join(words)))
        if r.random() < 0.6:
            labels.append((i, 1, int(bad)))
    return rows, labels


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark, make):
    rows, labels = toxic_rows()
    got = {r.doc_id: r for r in toxicity.score(make(rows), labels_of(spark, labels)).collect()}
    held = [(got[i].predicted, y) for i, _, y in labels if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _ in rows)
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.95


def test_held_out_labels_are_not_read(spark, make):
    rows, labels = toxic_rows(200)
    flipped = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, q, y in labels]
    a, b = (sorted(map(tuple, toxicity.score(make(rows), labels_of(spark, x)).collect())) for x in (labels, flipped))
    assert a == b


def plain_fit(positive, unlabelled, prior, rounds=600, rate=0.03, lasso=1e-3):
    """The same descent row by row in plain Python: score of a set of features, and rounds with a negative risk."""
    count = [collections.Counter(f for x in own for f in x) for own in (positive, unlabelled)]
    kept = []
    for f, n in sorted(count[0].items()):
        expected = max(count[1][f], 1) / len(unlabelled) * len(positive)
        if n >= 3 and n > expected and n * math.log(n / expected) - (n - expected) >= toxicity.EVIDENCE:
            kept.append(f)
    w, m, v = [0.0] * len(kept) + [math.log(prior / (1 - prior))], [0.0] * (len(kept) + 1), [0.0] * (len(kept) + 1)
    place = {f: k for k, f in enumerate(kept)}
    rows = [[[place[f] for f in x if f in place] for x in own] for own in (positive, unlabelled)]
    sigmoid = lambda x: 1 / (1 + math.exp(-sum(w[k] for k in x) - w[-1]))
    negative = 0
    for t in range(1, rounds + 1):
        s = [[sigmoid(x) for x in own] for own in rows]
        toxic, other = [0.0] * len(w), [0.0] * len(w)
        for x, a in zip(rows[0], s[0]):
            for k in [*x, len(kept)]:
                toxic[k] += prior * (a - 1) / len(rows[0])
                other[k] -= prior * a / len(rows[0])
        for x, a in zip(rows[1], s[1]):
            for k in [*x, len(kept)]:
                other[k] += a / len(rows[1])
        risk = sum(-math.log1p(-a) for a in s[1]) / len(s[1]) + prior * sum(math.log1p(-a) for a in s[0]) / len(s[0])
        negative += risk < 0
        for k in range(len(w)):
            g = toxic[k] + other[k] if risk >= 0 else -other[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            root = math.sqrt(v[k] / (1 - 0.999**t)) + 1e-6
            w[k] -= rate * m[k] / (1 - 0.9**t) / root
            if k < len(kept):
                w[k] = math.copysign(max(abs(w[k]) - lasso * rate / root, 0.0), w[k])
    return lambda x: sigmoid([place[f] for f in x if f in place]), negative


@pytest.mark.parametrize("prior", [0.02, 0.9])
def test_fit_equals_plain_python(prior):
    """Both with steps of negative risk and with others."""
    r = random.Random(6)
    word = lambda bad: r.sample(range(10, 60), 12) + ([r.choice([1, 2, 3])] if bad else [])
    positive = [word(True) for _ in range(60)]
    unlabelled = [word(r.random() < 0.1) for _ in range(120)]
    array = lambda own: [np.array(sorted(x), np.int32) for x in own]
    index, weights, bias = toxicity.fit(array(positive), array(unlabelled), prior)
    score, negative = plain_fit(positive, unlabelled, prior)
    assert 0 < negative < 600 and len(index)
    weight = dict(zip(index.tolist(), weights.tolist()))
    for x in [*positive[:9], *unlabelled[:9], [1, 2, 3], []]:
        assert abs(1 / (1 + math.exp(-bias - sum(weight.get(f, 0.0) for f in x))) - score(x)) < 1e-6


def test_repeated_rows_do_not_push_others_out(spark, make):
    """Many rows under one sampled id count once; the other rows of the sample all stay."""
    rows, labels = toxic_rows(200)
    bad = next(i for i, _, y in labels if y and zlib.crc32(str(i).encode()) % 4 != 2)
    more = rows + [(bad, f"other text {k}") for k in range(400)]
    one = toxicity.train(make(rows), labels_of(spark, labels), 60, 60)
    two = toxicity.train(make(more + [(bad, dict(rows)[bad])]), labels_of(spark, labels), 60, 60)
    assert set(one[0].tolist()) & set(two[0].tolist()) and abs(one[2] - two[2]) < 0.5
    same = toxicity.train(make(rows * 3), labels_of(spark, labels * 2), 60, 60)
    assert np.array_equal(one[0], same[0]) and np.allclose(one[1], same[1]) and one[2] == pytest.approx(same[2])


def test_toxicity_edges(spark, edges, none):
    empty = labels_of(spark, [])
    got = toxicity.score(edges, empty).collect()
    assert len(got) == len(EDGES) and all(0 <= r.score <= 1 for r in got)
    nulls = spark.createDataFrame([(1, None, None), (None, 1, 1), (4, 1, 1), (4, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score(edges, nulls).count() == len(EDGES)
    assert toxicity.score(none, nulls).collect() == []
    assert toxicity.accepted(edges, empty).columns == edges.columns


# --- decontamination ---------------------------------------------------------------------------------------
def edits_to_any_part(item: str, text: str) -> int:
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_leaks_match_an_alignment_of_everything(spark, make):
    r, v = random.Random(9), vocabulary(300)
    items = [(i, " ".join(r.choice(v) for _ in range(r.randint(8, 30)))) for i in range(12)]
    items += [(50, None), (51, ""), (52, "short"), (53, items[0][1]), (0, items[0][1])]
    rows = list(EDGES[:6])
    for k in range(30):
        words = " ".join(r.choice(v) for _ in range(40))
        leak = list(items[k % 12][1].upper() if k % 2 else items[k % 12][1])
        for _ in range(k // 2):
            p = r.randrange(len(leak))
            leak[p : p + r.randint(0, 1)] = r.choice("abcxyz")
        rows.append((100 + k, words[:100] + " " + "".join(leak) + "\n" + words[100:] if k % 5 else words))
    got = {r.doc_id: r for r in decontamination.find(make(rows), bench(spark, items)).collect()}
    index = decontamination.Index([(i, t.encode()) for i, t in items if t is not None])
    most = {i: int(k) for i, k in zip(index.item, index.edits)}
    hits = 0
    for i, t in rows:
        if i is None or i == 4:
            continue
        low = (t or "").lower().replace("\n", " ").replace("\t", " ")
        expected = sorted({j for j, x in items if x and j in most and edits_to_any_part(x.lower(), low) <= most[j]})
        assert got[i].item_ids == ",".join(map(str, expected)), i
        assert (got[i].n_items, got[i].contaminated) == (len(expected), bool(expected))
        hits += bool(expected)
    assert hits > 10
    kept = decontamination.clean(make(rows), bench(spark, items))
    assert kept.columns == make(rows).columns and kept.where("doc_id >= 100").count() == 30 - sum(got[100 + k].contaminated for k in range(30))


def test_blocks_of_a_large_benchmark(spark, make, monkeypatch):
    items = [(i, f"item number {i} " + " ".join(vocabulary(12, seed=i))) for i in range(40)]
    rows = [(i, f"xx {t} yy") for i, t in items] + [(None, None)]
    one = sorted(map(tuple, decontamination.find(make(rows), bench(spark, items)).collect()), key=repr)
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 1500)
    n, each = decontamination.blocks(bench(spark, items))
    held = list(each)
    assert n > 2 and len(held) == n and sum(map(len, held)) == 40 and max(map(len, held)) < 40
    assert sorted(map(tuple, decontamination.find(make(rows), bench(spark, items)).collect()), key=repr) == one
    assert decontamination.clean(make(rows), bench(spark, items)).count() == 1


def test_any_window_of_a_long_item_is_found():
    r = random.Random(9)
    item = bytes(r.choice(b"abcdefghijklmnopqrstuvwxyz ") for _ in range(394))
    index = decontamination.Index([(1, item)])
    around = bytes(r.choice(b"ABCDEFGHIJ ") for _ in range(300))
    edited = bytearray(item[60:350])
    edited[20::13] = b"#" * len(edited[20::13])
    for quote, edits in ((item[60:350], 0), *((item[s : s + 256], 0) for s in (1, 7, 61, 72, 100, 137)), (bytes(edited), 19)):
        got = index.leaks([around + quote + around])[0]
        assert [i for i, _ in got] == [1] and got[0][1] <= edits, (len(quote), edits, got)
    assert index.leaks([around + item[60:280] + around]) == [[]]


def test_long_items_in_long_texts_match_an_alignment(spark, make):
    """Every window of a long item against whole long texts, the 30,000 words and the 50,000 letters of the edge rows included."""
    r, v = random.Random(12), vocabulary(300)
    items = [(i, " ".join(r.choice(v) for _ in range(60 + 20 * i))) for i in range(3)]
    assert min(len(t) for _, t in items) > decontamination.PIECE
    rows = [EDGES[-2], EDGES[-1]]
    for k in range(6):
        item = items[k % 3][1]
        at = r.randrange(len(item) - 290)
        quote = list(item[at : at + 290])
        for _ in range(9 * k):
            p = r.randrange(len(quote))
            quote[p] = r.choice("qrstuvw")
        words = [r.choice(v) for _ in range(400)]
        rows.append((100 + k, " ".join(words[:200]) + " " + "".join(quote) + " " + " ".join(words[200:])))
    got = {x.doc_id: x for x in decontamination.find(make(rows), bench(spark, items)).collect()}

    def leaks(item, text):  # all windows at once: one alignment table for each of them
        low = np.frombuffer(text.lower().encode(), np.uint8)
        for s in range(len(item) - decontamination.PIECE + 1):
            if decontamination.alignment(np.frombuffer(item[s : s + decontamination.PIECE].encode(), np.uint8), low, decontamination.PIECE // 10) <= decontamination.PIECE // 10:
                return True
        return False

    for i, t in rows[2:]:
        assert got[i].item_ids == ",".join(str(j) for j, x in items if leaks(x, t)), i
    assert got[7].n_items == got[8].n_items == 0 and 2 <= sum(got[100 + k].contaminated for k in range(6)) < 6


def test_decontamination_of_nothing(spark, edges, none):
    assert decontamination.find(none, bench(spark, [(1, "some item text of the benchmark")])).collect() == []
    assert decontamination.find(edges, bench(spark, [])).where("contaminated").count() == 0


# --- pipeline ----------------------------------------------------------------------------------------------
def test_stages_keep_odd_columns(spark, tmp_path):
    """Names that the stages use themselves, nulls and repeated rows."""
    labels_of(spark, []).write.parquet(str(tmp_path / "labels.parquet"))
    bench(spark, []).write.parquet(str(tmp_path / "benchmark.parquet"))
    names = ["row", "kept", "between", "found", "n_found", "kinds", "component_id", "label", "score", "u", "v"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame([(i, t, None, None, None, *[None if i == 4 else n for n in names]) for i, t in EDGES], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == len(EDGES) - (2 if name == "ngram_join" else 0), name
        assert {tuple(r[5:]) for r in out.collect()} <= {tuple(names), (None,) * len(names)}


def test_pipeline(spark, tmp_path):
    rows, labels = toxic_rows(600)
    r = random.Random(2)
    item = " ".join(vocabulary(30, seed=77))
    rows += [(1000 + k, rows[k][1]) for k in range(5)] + [(2000, item + " and more"), (2001, "card 4425414259157784 " + " ".join(r.choice(vocabulary(80, 9)) for _ in range(30))), (2002, None)]
    frame(spark, rows).drop("g", "h", "held_out", "ids", "_found").write.parquet(str(tmp_path / "documents.parquet"))
    labels_of(spark, labels).write.parquet(str(tmp_path / "labels.parquet"))
    bench(spark, [(7, item)]).write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = textcore.read_table(spark, str(tmp_path), "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, textcore.checkpointed(stage(spark, docs, str(tmp_path)))
        seen[name] = {x.doc_id for x in docs.collect()}
        if name != "bpe":
            assert docs.columns == before.columns
    bad = {i for i, t in rows if t and ("grumble" in t or "nasty" in t)}
    gone = {i for i, _ in rows} - seen["toxicity"]
    assert len(gone & bad) > 0.9 * len(bad) and len(gone - bad) < 0.05 * len(rows)
    assert seen["toxicity"] - seen["ngram_join"] == {1000 + k for k in range(5)} & seen["toxicity"]
    assert seen["ngram_join"] - seen["decontamination"] == {2000}
    assert seen["decontamination"] == seen["pii"] == seen["bpe"] and 2002 in seen["bpe"]
    assert {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == seen["bpe"]


def test_pipeline_of_nothing(spark, none, tmp_path):
    none.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    labels_of(spark, []).write.parquet(str(tmp_path / "labels.parquet"))
    bench(spark, [(1, "some item of the benchmark")]).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
