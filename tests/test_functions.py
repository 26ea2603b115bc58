"""Column functions, scalers and small operators against hand-computed values; each trap of the survey by name."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tesselon import config, errors, telemetry
from tesselon.functions import scale as S
from tesselon.functions import text as T
from tesselon.operators import bm25, candidates, expand, graph, metrics, pack, rank, report, vectors
from tesselon.providers import Registry, post_json
from tesselon.sources import repository as R
from tesselon.sources.script import analyze, lex
from tesselon.sources.store import Store


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("word,parts", [
    ("parseHTMLResponse", "parse HTML Response"), ("user_repo-v2", "user repo v2"), ("V2", "V 2"), ("v2", "v2"), ("SHA1hash", "SHA 1hash"), ("A1b", "A 1b"), ("_foo", "foo"), ("$", ""), ("__", ""),
])
def test_split_identifier(spark, word, parts):
    assert " ".join(one(spark, word, T.split_identifier)) == parts


@pytest.mark.parametrize("text,terms", [
    ("parseHTMLResponse", ["parsehtmlresponse", "parse", "html", "response"]), ("_foo foo", ["_foo", "foo"]), ("the 123 async für x", []), ("a" * 30 + "B" + "c" * 30, ["a" * 30, "b" + "c" * 30]),
    ("getUser get2", ["getuser", "user", "get2"]), ("", []), (None, []), ("V2 v2", ["v2", "v2"]),
])
def test_t9_t10_tokenize(spark, text, terms):
    assert one(spark, text, T.tokenize) == terms


def test_term_rows_are_tokens(spark):
    """Rows of plain words, stopwords and compounds are those of tokenize; an ASCII word of any form is decided alike."""
    text = " ".join(a + b + c for a in ("a", "A", "_", "$", "fo", "FO") for b in ("", "b", "B", "7", "_", "é") for c in ("", "x", "X9", "9")) + " the The THE getUser V2 x"
    d = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    rows = [tuple(r) for r in T.term_rows(d, "text", "id").collect()]
    assert sorted(rows) == sorted((1, t) for t in one(spark, text, T.tokenize)) and len(rows) > 100


def test_document_frequency_without_postings(spark):
    """Only sums by term are shuffled; an id of several texts counts once."""
    rows = [(1, "foo Foo bar getUser user"), (2, "foo"), (None, "foo"), (None, "foo baz"), (2, "foo bar")]
    for n in (2, 5):
        d = spark.createDataFrame(rows[:n], "id int, text string")
        want = {r.term: r.df for r in bm25.document_frequency(bm25.postings(d)).collect()}
        assert {r.term: r.df for r in bm25.corpus_frequency(d).collect()} == want
    assert want["foo"] == 3 and want["bar"] == 2
    plan = bm25.corpus_frequency(spark.createDataFrame(rows[:2], "id int, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1


def test_identifiers(spark):
    assert one(spark, "find .TokenStore. tokenstore in a.b.c, 9x ab my_fn()", T.identifiers) == ["find", "TokenStore", "a.b.c", "my_fn"]


def test_estimates_and_cuts(spark):
    assert [one(spark, x, T.token_estimate) for x in ("", None, "abc", "a" * 36, "a" * 37)] == [0, 0, 1, 10, 11]
    assert one(spark, "x" * 10, lambda c: T.truncate_lines(c, 10)) == "x" * 10
    assert one(spark, "aaaaaa\nbbbbbb", lambda c: T.truncate_lines(c, 10)) == "aaaaaa" + T.TRUNCATION_MARK
    assert one(spark, "aa\nbbbbbbbbbb", lambda c: T.truncate_lines(c, 10)) == "aa\nbbbbbbb" + T.TRUNCATION_MARK
    assert one(spark, "  a \n\t b ﻿", T.collapse_whitespace).strip() == "a b"
    assert one(spark, "abcdef", lambda c: T.snippet(c, 3)) == "abc…"


def test_hash(spark):
    def fnv(s):
        h = 2166136261
        for c in s.encode():
            h = (h ^ c) * 16777619 % 2**32
        return h

    for s in ("", "auth", "token", "a" * 50):
        assert one(spark, s, T.fnv1a32) == fnv(s)


def test_paths(spark):
    assert [one(spark, x, T.extension) for x in ("a/b.TS", ".env", "a/.x.d.ts", "none")] == [".ts", "", ".ts", ""]
    assert one(spark, "a/b/c.ts", T.ancestors) == ["a", "a/b"] and one(spark, "c.ts", T.ancestors) == []
    assert [one(spark, x, T.dirname) for x in ("a/b/c.ts", "c.ts")] == ["a/b", "."]
    score = {x: round(one(spark, x, T.path_score), 6) for x in ("src/index.ts", "src/a/b/c.ts", "tests/x.ts", "a/x.test.ts", "x.ts")}
    assert score == {"src/index.ts": 0.9, "src/a/b/c.ts": 0.5, "tests/x.ts": 0.0, "a/x.test.ts": 0.0, "x.ts": 0.5}
    assert [one(spark, x, T.role_for) for x in ("src", "docs", "e2e", "whatever")] == ["source", "documentation", "tests", "source"]
    assert [one(spark, x, lambda c: T.format_loc(c.cast("int"))) for x in ("999", "1500")] == ["999", "1.5k"]
    assert one(spark, 'a<b>&"', T.escape_xml) == "a&lt;b&gt;&amp;&quot;" and one(spark, "a]]>b", T.cdata) == "<![CDATA[a]]]]><![CDATA[>b]]>"


def test_half_life(spark):
    d = spark.createDataFrame([(-1.0,), (0.0,), (30.0,), (60.0,)], "a double")
    assert [r.x for r in d.select(S.half_life_decay(F.col("a"), 30).alias("x")).collect()] == [1.0, 1.0, 0.5, 0.25]
    assert [r.x for r in d.select(S.half_life_decay(F.col("a"), 0).alias("x")).collect()] == [1.0, 1.0, 0.0, 0.0]


def test_t2_two_rules_for_no_spread(spark):
    d = spark.createDataFrame([(1, 3.0), (1, 3.0), (1, None)], "query_id int, lexical double")
    assert {r.y for r in metrics.scaled(d.where("lexical IS NOT NULL"), "lexical", "y").collect()} == {0.5}
    assert [r.y for r in d.select(S.scaled_within(F.col("lexical"), "query_id").alias("y")).collect()] == [1.0, 1.0, 0.0]


def test_bm25_by_hand(spark):
    c = spark.createDataFrame([(1, "red red green"), (2, "green blue"), (3, "")], "id long, text string")
    q = spark.createDataFrame([(1, "red red"), (2, "green zebra")], "query_id int, query string")
    got = {(r.query_id, r.id): r.score for r in bm25.search(c, q).collect()}
    avg = 5 / 3

    def gain(tf, df, length):
        return math.log(1 + (3 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg))

    assert set(got) == {(1, 1), (2, 1), (2, 2)}
    assert abs(got[1, 1] - gain(2, 1, 3)) < 1e-9 and abs(got[2, 1] - gain(1, 2, 3)) < 1e-9 and abs(got[2, 2] - gain(1, 2, 2)) < 1e-9
    again = {(r.query_id, r.id): r.score for r in bm25.search_index(bm25.postings(c), bm25.lengths(c), q).collect()}
    assert again.keys() == got.keys() and all(abs(again[k] - got[k]) < 1e-9 for k in got)


def test_lengths_from_postings(spark):
    c = spark.createDataFrame([(1, "alpha beta beta"), (2, ""), (3, None)], "id long, text string")
    of = bm25.stored_lengths(bm25.postings(c), c)
    assert sorted(map(tuple, of.collect())) == sorted(map(tuple, bm25.lengths(c).collect())) == [(1, 3), (2, 0), (3, 0)]


def test_vectors(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [-3.0, 0.0]), ("z", [0.0, 0.0]), ("n", None), ("w", [1.0])], "id string, v array<float>")
    got = [(r.id, round(r.score, 6)) for r in vectors.nearest(v, [(7, [2.0, 0.0])], 3).orderBy("rank").collect()]
    assert got == [("a", 1.0), ("b", 0.0), ("z", 0.0)]
    e = {r.id: r.v for r in vectors.hashed_embedding(spark.createDataFrame([(1, "auth token auth"), (2, "")], "id long, text string")).collect()}
    assert abs(sum(x * x for x in e[1]) - 1) < 1e-5 and set(e[2]) == {0.0} and len(e[2]) == 256


def test_norm_is_no_part_of_the_lambda_over_cells(spark):
    """Inside it, it would be computed again for each cell of a vector."""
    c = spark.createDataFrame([(1, "auth token auth")], "id long, text string")
    plan = vectors.hashed_embedding(c)._jdf.queryExecution().optimizedPlan().toString()
    dense = [line for line in plan.splitlines() if "element_at" in line]
    assert dense and not any(x in line for line in dense for x in ("SQRT", "map_from_entries", "aggregate("))


def frame(spark, rows, kind="calls"):
    return spark.createDataFrame([(a, k, b, 1.0) for a, k, b in rows], "src string, kind string, dst string, weight double")


def test_merge(spark):
    n = spark.createDataFrame([("a", "file"), ("b", "file")], "id string, kind string")
    raw = spark.createDataFrame([("a", "calls", "b", 2.0, "x", 0), ("a", "calls", "b", 3.0, "y", 1), ("a", "calls", "a", 1.0, "x", 2), ("a", "calls", "gone", 1.0, "x", 3)], "src string, kind string, dst string, weight double, variant string, seq long")
    assert [tuple(r) for r in graph.merged_edges(raw, n).collect()] == [("a", "calls", "b", 5.0, 2, "x")]
    m = spark.createDataFrame([("a", "first", 0), ("a", "second", 1)], "id string, name string, seq int")
    assert [r.name for r in graph.merged_nodes(m).collect()] == ["first"]


def test_pagerank(spark):
    """Against a dense power iteration."""
    e = [("a", "b", 1.0), ("a", "c", 3.0), ("b", "c", 1.0), ("c", "a", 1.0), ("c", "d", 1.0)]
    ids = ["a", "b", "c", "d", "e"]
    n = spark.createDataFrame([(i,) for i in ids], "id string")
    got = {r.id: r.rank for r in metrics.pagerank(n, spark.createDataFrame(e, "src string, dst string, weight double")).collect()}
    r = dict.fromkeys(ids, 0.2)
    total = {i: sum(w for a, _, w in e if a == i) for i in ids}
    for _ in range(25):
        loose = sum(r[i] for i in ids if not total[i])
        r = {i: 0.15 / 5 + 0.85 * (sum(r[a] * w / total[a] for a, b, w in e if b == i) + loose / 5) for i in ids}
    assert abs(sum(got.values()) - 1) < 1e-9 and all(abs(got[i] - r[i]) < 1e-9 for i in ids)


def test_pagerank_in_blocks(spark):
    """Three blocks and nine cells, with edges that are not merged and ends that are no nodes; no edge is shuffled after packing."""
    e = [(f"n{a}", k, f"n{(a * a + s) % 50}", 1.0 + s) for a in range(40) for s, k in enumerate(["calls", "imports", "calls"])] + [("n1", "calls", "gone", 2.0), ("gone", "calls", "n2", 5.0)]
    n = spark.createDataFrame([(f"n{i}",) for i in range(50)], "id string")
    got = {r.id: r.rank for r in metrics.pagerank(n, spark.createDataFrame(e, "src string, kind string, dst string, weight double"), 3).collect()}
    ids = [f"n{i}" for i in range(50)]
    r = dict.fromkeys(ids, 1 / 50)
    total = {i: sum(w for a, _, _, w in e if a == i) for i in ids}
    for _ in range(25):
        loose = sum(r[i] for i in ids if not total[i])
        r = {i: 0.15 / 50 + 0.85 * (sum(r[a] * w / total[a] for a, _, b, w in e if b == i and a in r) + loose / 50) for i in ids}
    assert got.keys() == r.keys() and all(abs(got[i] - r[i]) < 1e-12 for i in ids)
    assert metrics.pagerank(n.limit(0), spark.createDataFrame(e, "src string, kind string, dst string, weight double")).count() == 0
    assert {round(x.rank, 9) for x in metrics.pagerank(n, spark.createDataFrame([], "src string, dst string, weight double")).collect()} == {0.02}


def test_trim_keeps_lines_up_to_the_first_overflow(spark):
    rows = [("a", i, t) for i, t in enumerate([3, 0, 4, 0, 5, 0, 1])] + [("b", i, 1) for i in range(9)] + [("c", 1, 20), ("c", 2, 0), ("d", 1, 0)]
    d = spark.createDataFrame(rows, "k string, i int, tokens int")
    got = sorted((r.k, r.i, r.used) for r in pack.trim(d, 8, "k").collect())
    assert got == [("a", 0, 3), ("a", 1, 3), ("a", 2, 7), ("a", 3, 7), *(("b", i, i + 1) for i in range(8)), ("d", 1, 0)]


def test_nearest_keeps_the_best_over_all_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        rows = [(i, [float(i % 7), 1.0]) for i in range(40)]
        got = vectors.nearest(spark.createDataFrame(rows, "id long, v array<float>").coalesce(1), [(1, [1.0, 0.0])], 9)
        want = sorted(rows, key=lambda r: (-round(r[1][0] / (r[1][0] ** 2 + 1) ** 0.5, 9), r[0]))[:9]
        assert [r.id for r in got.orderBy("rank").collect()] == [i for i, _ in want]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_nearest_scores_queries_in_steps(spark, monkeypatch):
    """Scores of a batch are held for STEP queries at a time, also where queries do not fill the last step."""
    monkeypatch.setattr(vectors, "STEP", 2)
    v = spark.createDataFrame([(i, [float(i == j) for j in range(5)]) for i in range(5)], "id long, v array<float>")
    got = vectors.nearest(v, [(j, [float(k == j) for k in range(5)]) for j in range(5)], 1).collect()
    assert sorted((r.query_id, r.id, r.score) for r in got) == [(j, j, 1.0) for j in range(5)]


def test_linked_paths(tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.ts").write_text("export const a = 1;")
    (tmp_path / "link").symlink_to(tmp_path / "src")
    (tmp_path / "src/b.ts").symlink_to(tmp_path / "src/a.ts")
    assert R.linked_paths(tmp_path) == ["link", "src/b.ts"]


def expanded(spark, rows, seeds, **limits):
    e = frame(spark, rows)
    n = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    s = spark.createDataFrame([(1, i, x) for i, x in seeds], "query_id int, id string, score double")
    return {r.id: (round(r.score, 6), r.depth) for r in expand.expand(n, e, s, expand.Limits(**limits)).collect()}


def test_t1_best_first_closes_at_the_stronger_path(spark):
    got = expanded(spark, [("a", "contains", "x"), ("a", "calls", "b"), ("b", "calls", "x"), ("x", "calls", "y")], [("a", 1.0)])
    assert got == {"a": (1.0, 0), "b": (0.6, 1), "x": (0.36, 2)}


def test_t1_seeds_close_each_other(spark):
    assert expanded(spark, [("s1", "calls", "s2"), ("s2", "calls", "z")], [("s1", 1.0), ("s2", 0.2)], depth=1) == {"s1": (1.0, 0), "s2": (0.6, 1)}


def test_t5_and_hubs_and_budget(spark):
    hub = [("seed", "calls", "hub")] + [("hub", "calls", f"l{i}") for i in range(10)]
    assert len(expanded(spark, hub, [("seed", 1.0)], hub=5)) == 2 and len(expanded(spark, hub, [("seed", 1.0)], hub=100)) == 12
    assert len(expanded(spark, hub, [("hub", 1.0)], hub=5)) == 12  # seeds always expand
    assert len(expanded(spark, hub, [("seed", 1.0)], hub=100, budget=4)) == 4 and len(expanded(spark, hub, [("seed", 1.0)], hub=100, nodes=3)) == 3
    assert expanded(spark, hub, [("nowhere", 1.0)]) == {}


def test_a_hub_sends_no_more_neighbours_than_the_budget(spark):
    e = frame(spark, [("hub", "contains" if i % 2 else "calls", f"x{i:02}") for i in range(40)] + [("x39", "calls", "hub")])
    seeds = spark.createDataFrame([(1, "hub", 1.0)], "query_id int, id string, score double")
    near = expand.neighbourhood(e, seeds, expand.Limits(depth=1, budget=5)).collect()
    # edges to x39 are of both kinds, and the stronger one counts
    assert {r.other for r in near} == {"x00", "x02", "x04", "x06", "x08"} and len(near) == 5
    near = expand.neighbourhood(e, seeds, expand.Limits(depth=1, budget=21)).collect()
    assert len(near) == 22 and sorted(r.kind for r in near if r.other == "x39") == ["calls", "contains"]


def test_expansion_equals_a_search_of_the_whole_graph(spark):
    r = random.Random(4)
    kinds = list(expand.KIND_WEIGHTS)
    rows = sorted({(f"n{r.randrange(60)}", r.choice(kinds), f"n{r.randrange(60)}") for _ in range(200)})
    rows = [x for x in rows if x[0] != x[2]]
    limits = expand.Limits(depth=2, budget=25, hub=9)
    e = frame(spark, rows)
    n = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    seeds = [(q, f"n{(q * 7 + k * 13) % 60}", 1.0 - k / 10) for q in range(6) for k in range(4)]
    got = {}
    for x in expand.expand(n, e, spark.createDataFrame(seeds, "query_id int, id string, score double"), limits).collect():
        got.setdefault(x.query_id, set()).add((x.id, round(x.score, 9), x.depth))
    around, degree = {}, {}
    for a, k, b in sorted(rows, key=lambda x: "|".join((x[0], x[1], x[2]))):
        around.setdefault(a, []).append((b, k))
        around.setdefault(b, []).append((a, k))
    degree = {i: len(x) for i, x in around.items()}
    for q in range(6):
        full = expand.best_first([(i, s) for p, i, s in seeds if p == q], around, degree, limits)
        assert got[q] == {(i, round(s, 9), d) for i, s, d, _ in full}


def test_t4_candidates(spark):
    hits = lambda rows: spark.createDataFrame(rows, "query_id int, id string, score double")
    g = spark.createDataFrame([(1, "b", 0.4, 2), (1, "c", 0.3, 1)], "query_id int, id string, score double, depth int")
    m = {r.id: r for r in candidates.merge(hits([(1, "a", 4.0), (1, "b", 2.0)]), hits([(1, "b", 1.2), (1, "n", 0.5)]), hits([(1, "n", 1.0)]), g).collect()}
    assert m["n"].sources == ["semantic", "lexical"] and abs(m["n"].lexical - 4.2) < 1e-9
    assert m["b"].sources == ["lexical", "semantic", "graph"] and (m["b"].semantic, m["b"].depth) == (1.0, 0) and m["c"].depth == 1
    only = candidates.merge(hits([]), hits([]), hits([(1, "n", 1.0)]), g.limit(0)).first()
    assert only.lexical == 1.0
    s = {r.id: r.score for r in candidates.seeds(hits([(1, "a", 4.0), (1, "b", 2.0)]), hits([(1, "z", -0.5)]), hits([(1, "n", 1.0)])).collect()}
    assert s == {"a": 0.9, "b": 0.0, "z": 0.0, "n": 1.0}


def test_ranking_by_hand(spark):
    c = spark.createDataFrame([(1, "a", 4.0, None, 0.2), (1, "b", 2.0, 0.5, None), (1, "c", None, 0.5, 2.0)], "query_id int, id string, lexical double, graph double, recency double")
    got = {r.id: r.score for r in rank.weighted(c, ["lexical", "graph", "recency"], {"lexical": 2.0, "graph": 1.0, "recency": 1.0}).collect()}
    assert got == {"a": 0.5 + 0.05, "b": 0.25, "c": 0.25 + 0.25}
    got = {r.id: round(r.score, 9) for r in rank.reciprocal(c, ["lexical", "graph"], {"lexical": 1.0, "graph": 1.0}).collect()}
    assert got == {"a": round(0.5 * 61 / 61 + 0.5 * 61 / 63, 9), "b": round(0.5 * 61 / 62 + 0.5 * 61 / 61, 9), "c": round(0.5 * 61 / 63 + 0.5 * 61 / 62, 9)}
    none = {r.id: r.score for r in rank.weighted(c, ["lexical", "graph"], {}).collect()}
    assert none == {"a": 0.5, "b": 0.5, "c": 0.5}
    assert rank.best(rank.weighted(c, ["lexical"]), 0).count() == 0


def test_t3_packing_skips_but_trimming_stops(spark):
    items = [{"rank": k, "id": str(k), "file": str(k), "is_file": False, "parent": None, "full": None, "card": c, "mention": None} for k, c in enumerate((100, 9000, 50), 1)]
    assert [(r, f) for r, f, _ in pack.ladder(items, pack.Budget(2000))] == [(1, "card"), (3, "card")]
    lines = spark.createDataFrame([(1, 5), (2, 9), (3, 1)], "i int, tokens long")
    assert [r.i for r in pack.trim(lines.withColumn("k", F.lit(1)), 10, "k").collect()] == [1]


def test_ladder_of_files_and_symbols():
    f = lambda r, i, **k: {"rank": r, "id": i, "file": "f", "is_file": True, "parent": None, "full": 500, "card": 60, "mention": 5} | k
    s = lambda r, i, **k: {"rank": r, "id": i, "file": "f", "is_file": False, "parent": None, "full": 100, "card": 20, "mention": None} | k
    b = pack.Budget(4000)
    assert [x[1] for x in pack.ladder([f(1, "file:f"), s(2, "s")], b)] == ["full"]  # the file holds the symbol
    assert [x[1] for x in pack.ladder([s(1, "s"), f(2, "file:f"), s(3, "s.m", parent="s")], b)] == ["code", "compressed"]
    assert [x[1] for x in pack.ladder([f(1, "file:f", full=5000, card=4000)], b)] == ["mention"]


def test_t6_fit():
    sections = {"summary": ["aaaa"] * 3, "recommendations": ["bbbb"] * 3, "architecture": ["cccc"]}
    got = pack.fit(sections, 10, len)
    assert sum(len(x) for v in got.values() for x in v) <= 10 and got["recommendations"] == []


def test_t8_average_over_all_events(spark):
    e = spark.createDataFrame([("a", 10.0), ("a", None), ("b", None)], "name string, duration_ms double")
    got = {r.name: tuple(r)[1:] for r in report.telemetry(e).collect()}
    assert got == {"a": (2, 10.0, 10.0, 5.0), "b": (1, 0.0, 0.0, 0.0)}
    ticks = iter([1.0, 1.5, 1.5, 2.0])
    t = telemetry.Recorder(clock=lambda: next(ticks))
    with t.span("x"):
        pass
    t.record("x")
    assert t.summary()["x"] == {"count": 2, "total_ms": 500.0, "max_ms": 500.0, "avg_ms": 250.0}


def test_t12_stale_counts_paths_only(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "1")], "path string, hash string")
    b = spark.createDataFrame([("x", "2"), ("z", "1")], "path string, hash string")
    assert report.stale(a, b).first().stale == 2
    assert {r.path: r.change for r in report.snapshot_diff(a, b).collect()} == {"x": "changed", "y": "removed", "z": "added"}


def test_git_lines(spark):
    lines = ["\x012\tAnn", "src/a.ts", "", "\x011\tBob", "src/a.ts", "src/b.ts"]
    got = {r.path: (r.commit_count, r.last_commit_at, dict(r.authors)) for r in R.history_of_lines(spark.createDataFrame(list(enumerate(lines)), "n long, line string")).collect()}
    assert got == {"src/a.ts": (2, 2000, {"Ann": 1, "Bob": 1}), "src/b.ts": (1, 1000, {"Bob": 1})}


def test_git_lines_over_ranges(spark, monkeypatch):
    """Headers are carried over ranges without lines of their own, and no window holds all lines."""
    monkeypatch.setattr(R, "RANGE", 2)
    lines = ["lost.ts", "\x012\tAnn", "src/a.ts", "src/b.ts", "src/c.ts", "src/d.ts", "src/e.ts", "\x011\tBob", "src/a.ts"]
    d = R.history_of_lines(spark.createDataFrame(list(enumerate(lines)), "n long, line string"))
    got = {r.path: (r.commit_count, r.last_commit_at, dict(r.authors)) for r in d.collect()}
    ann = {f"src/{x}.ts": (1, 2000, {"Ann": 1}) for x in "bcde"}
    assert got == {"src/a.ts": (2, 2000, {"Ann": 1, "Bob": 1}), **ann}
    windows = [x for x in d._jdf.queryExecution().optimizedPlan().toString().splitlines() if "+- Window" in x]
    assert len(windows) == 2 and sum("[n#" in x for x in windows) == 1 and all("[range#" in x for x in windows)


def test_files_are_dealt_before_analysis(spark):
    from tesselon.sources import analysis

    files = spark.createDataFrame([(f"src/a{i}.ts", "export const x = 1;") for i in range(200)], "path string, content string").coalesce(1)
    sizes = analysis.analyses(files).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 4 and sum(r["count"] for r in sizes) == 200


@pytest.mark.parametrize("rule,yes,no", [
    ("dist/", ["dist/a.ts", "x/dist/a.ts"], ["dist.ts", "xdist/a.ts"]), ("*.min.js", ["a.min.js", "x/a.min.js"], ["a.js"]), ("/top", ["top", "top/a.ts"], ["x/top"]),
    ("a/**/z.ts", ["a/z.ts", "a/b/c/z.ts"], ["b/z.ts"]), ("src/*.ts", ["src/a.ts"], ["src/b/a.ts", "x/src/a.ts"]), ("# note", [], ["note"]), ("?.ts", ["a.ts"], ["ab.ts"]),
])
def test_ignore_rules(spark, rule, yes, no):
    d = spark.createDataFrame([(p,) for p in yes + no], "path string")
    assert [r.i for r in d.select(R.ignored(F.col("path"), [rule]).alias("i")).collect()] == [True] * len(yes) + [False] * len(no)


def test_entrypoints():
    p = {"main": "./a.js", "bin": {"x": "./b.js", "y": "b.js"}, "exports": {".": {"import": "./c.mjs", "deep": {"d": {"e": {"f": {"g": "./too-deep.js"}}}}}, "./p": "./a.js"}}
    assert R.entrypoints(p) == [("main", "a.js"), ("bin", "b.js"), ("exports", "c.mjs"), ("exports", "a.js")]
    assert R.entrypoints({}) == []


def test_scanner_survives_anything():
    r = random.Random(0)
    for _ in range(300):
        text = "".join(r.choice(["class A ", "{", "}", "(", ")", "export ", "import ", "function f", "`a${", "/re/", "'", '"', "=>", "<", ">", "const x = ", "\n", "@", "interface ", "enum E", "extends ", ";", "/**", "*/"]) for _ in range(r.randint(0, 40)))
        lex(text)
        analyze("a.ts", text)


def test_scanner_overloads_and_arrows():
    a = analyze("a.js", "export function f(a: string): void;\nexport function f(a) { g(); }\nconst h = async x => g(x);\nexport { h as default };\n")
    s = {x["name"]: x for x in a["symbols"]}
    assert a["language"] == "javascript" and (s["f"]["start_line"], s["f"]["end_line"]) == (1, 2) and [c["name"] for c in s["f"]["calls"]] == ["g"]
    assert s["h"]["kind"] == "function" and s["h"]["exported"] and {"exported": "default", "symbol_path": "h"} in a["exports"]


def test_config(tmp_path):
    assert config.load(str(tmp_path)).context.max_tokens == 12_000
    (tmp_path / "tesselon.config.json").write_text('{"graph_depth": 3, "exclude": ["a"], "weights": {"graph": 1}}')
    (tmp_path / "sub").mkdir()
    c = config.load(str(tmp_path / "sub"), {"exclude": ["b"], "context": {"max_tokens": 500}})
    assert (c.graph_depth, c.exclude, c.context.max_tokens, c.weights["graph"], c.weights["lexical"]) == (3, ("a", "b"), 500, 1, 0.18)
    for wrong in ({"graph_depth": 9}, {"strategy": "x"}, {"unknown": 1}, {"context": {"max_tokens": 1}}, {"expansion": {"edge_weights": {"x": 1}}}, {"expansion": {"decay": 0}}, {"extensions": ["ts"]}, {"weights": {"graph": -1}}):
        with pytest.raises(errors.ConfigError):
            config.load(str(tmp_path), wrong)
    (tmp_path / "tesselon.config.py").write_text("def config():\n    return {'graph_depth': 1}\n")
    assert config.load(str(tmp_path)).graph_depth == 1


def test_providers():
    import io
    import urllib.error

    r = Registry(env={"OPENAI_API_KEY": "k", "GOOGLE_API_KEY": "  "})
    assert r.available()["openai"] and not r.available()["google"] and r.embedder().name == "local"
    with pytest.raises(errors.ProviderNotConfiguredError):
        r.generator()
    waits, answers = [], [503, 429, 200]

    def opener(request, timeout):
        code = answers.pop(0)
        if code != 200:
            raise urllib.error.HTTPError("u", code, "x", {}, None)
        return io.BytesIO(b'{"ok": 1}')

    assert post_json("http://x", {}, wait=waits.append, opener=opener) == {"ok": 1} and waits == [0.3, 0.6]
    answers[:] = [400]
    with pytest.raises(errors.ProviderError):
        post_json("http://x", {}, wait=waits.append, opener=opener)


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "st"))
    assert s.meta() is None and s.sizes() == {}
    with pytest.raises(errors.NotIndexedError):
        s.read("t")
    s.write({"t": spark.range(3)}, {"a": 1})
    s.write({"t": spark.range(5)}, {"a": 2})
    assert s.read("t").count() == 5 and s.meta()["a"] == 2 and s.sizes()["t"] > 0
    assert len([x for x in (tmp_path / "st").iterdir() if x.is_dir()]) == 1
    (tmp_path / "st/current.json").write_text("{broken")
    assert s.meta() is None
    t = telemetry.Recorder()
    t.record("x", n=1)
    assert t.flush(s) == 1 and t.flush(s) == 0 and spark.read.json(str(tmp_path / "st/telemetry")).count() == 1


def test_streamed_reindex(spark, tmp_path):
    from tesselon.streaming import reindex

    src, schema = tmp_path / "in", "id long, at timestamp, text string"
    for k, rows in enumerate(([(1, "2024-01-01 00:00:00", "alpha beta"), (2, "2024-01-01 00:00:00", "beta")], [(1, "2024-01-01 00:10:00", "gamma"), (1, "2024-01-01 00:10:00", "gamma")])):
        spark.createDataFrame(rows, "id long, at string, text string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(schema).parquet(str(src))
        reindex.start(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r.id, r.term, r.tf) for r in reindex.current(spark, str(tmp_path / "out")).collect()}
    assert got == {(1, "gamma", 1), (2, "beta", 1)}


def test_edges_are_dealt_before_they_are_summed(spark):
    """No hash table for a whole split of the input, and no sort for a join beside one."""
    raw = spark.createDataFrame([("a", "x", "b", 1.0), ("a", "x", "b", 2.0), ("a", "x", "a", 1.0), ("a", "x", "gone", 1.0), ("gone", "x", "a", 1.0)], "src string, kind string, dst string, weight double")
    d = graph.merged_edges(raw, spark.createDataFrame([("a",), ("b",)], "id string"))
    assert [tuple(r) for r in d.collect()] == [("a", "x", "b", 3.0, 2)]
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftSemi") < plan.index("Aggregate [") < plan.index("RepartitionByExpression")
