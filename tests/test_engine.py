"""The engine over a small repository in which every kind of edge occurs."""

import json
import subprocess

import pytest

from tesselon import cli, render
from tesselon.engine import Engine
from tesselon.errors import AmbiguousError, NotFoundError, NotIndexedError, PluginError, ProviderNotConfiguredError, TesselonError
from tesselon.plugins import Plugin, Signal
from tesselon.providers import Registry

from . import fixture_repo


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    folder = tmp_path_factory.mktemp("repo")
    fixture_repo.write(folder)
    return folder


@pytest.fixture(scope="module")
def engine(spark, root):
    e = Engine(spark, str(root), registry=Registry(env={}))
    e.first = e.index()
    return e


@pytest.fixture(scope="module")
def edges(engine):
    return {(r.src, r.kind, r.dst): r for r in engine.graph()[1].collect()}


def sym(file, name):
    return f"sym:src/{file}.ts#{name}"


def test_counts(engine):
    assert engine.first["files"] == 9 and engine.first["added"] == 9 and engine.first["warnings"] == []
    assert engine.first["chunks"] == engine.first["embeddings"] > 9


def test_ignored_files(engine):
    paths = {r.path for r in engine.graph()[0].where("kind = 'file'").collect()}
    assert "keep.log.ts" in paths and not paths & {"secret/key.ts", "debug.log.ts", "node_modules/x/index.ts", "notes.md"}


def test_nodes(engine):
    n = {r.id: r for r in engine.graph()[0].collect()}
    assert {"repo:.", "dir:src", "dir:src/store", "mod:express", "file:src/util.ts"} <= set(n)
    token = n[sym("store/token", "TokenStore")]
    assert (token.kind, token.exported, token.doc, token.external) == ("class", True, "Stores auth tokens.", False) and n["mod:express"].external
    assert n[sym("store/token", "TokenStore.keep")].kind == "method" and n[sym("util", "twice")].exported is False
    assert 0 <= n["file:src/index.ts"].importance <= 1 and n["file:src/index.ts"].recency > 0.9


@pytest.mark.parametrize("src,kind,dst", [
    ("repo:.", "contains", "dir:src"), ("dir:src", "contains", "dir:src/store"), ("dir:src/store", "contains", "file:src/store/token.ts"),
    ("file:src/util.ts", "contains", sym("util", "helper")), (sym("store/token", "TokenStore"), "contains", sym("store/token", "TokenStore.keep")),
    ("file:src/store/token.ts", "imports", "file:src/store/base.ts"), ("file:src/services/order.ts", "imports", "mod:express"),
    ("file:src/util.ts", "exports", sym("util", "helper")), (sym("store/token", "TokenStore"), "inheritance", sym("store/base", "BaseStore")),
    (sym("store/token", "TokenStore"), "inheritance", sym("store/base", "Keeper")), (sym("services/order", "OrderService"), "composition", sym("store/token", "TokenStore")),
    (sym("services/order", "OrderService.place"), "references", sym("store/base", "Keeper")), ("file:src/cli.ts", "imports", "file:src/index.ts"),
])
def test_edges(edges, src, kind, dst):
    assert (src, kind, dst) in edges


def test_edge_details(edges):
    assert edges["file:src/store/token.ts", "imports", "file:src/store/base.ts"].weight == 2
    assert edges["file:src/services/order.ts", "imports", "file:src/store/base.ts"].variant == "type-only"
    assert edges["file:src/index.ts", "exports", sym("store/token", "TokenStore")].variant == "reexport"
    assert edges["file:src/index.ts", "exports", "file:src/services/order.ts"].variant == "reexport"
    assert edges[sym("store/token", "TokenStore"), "inheritance", sym("store/base", "Keeper")].variant == "implements"


def test_calls(edges):
    place = sym("services/order", "OrderService.place")
    how = {k[2]: (r.resolution, r.variant) for k, r in edges.items() if k[:2] == (place, "calls")}
    assert how[sym("store/token", "TokenStore")] == ("import", "instantiates")
    assert how[sym("util", "helper")][0] == "namespace" and how[sym("far", "uniqueThing")][0] == "global-unique"
    assert edges[sym("store/token", "TokenStore.keep"), "calls", sym("store/token", "TokenStore.check")].resolution == "same-class"
    assert edges[sym("util", "helper"), "calls", sym("util", "twice")].resolution == "same-file"
    assert ("file:src/cli.ts", "calls", sym("services/order", "OrderService")) in edges  # through a re-export chain


def test_no_change_is_noticed_and_edits_are(spark, tmp_path):
    fixture_repo.write(tmp_path)
    e = Engine(spark, str(tmp_path), registry=Registry(env={}))
    e.index()
    r = e.index()
    assert (r["unchanged"], r["added"], r["changed"], r["removed"]) == (9, 0, 0, 0)
    (tmp_path / "src/far.ts").write_text("export function otherThing(): void {}\n")
    (tmp_path / "src/new.ts").write_text("export const fresh = 1;\n")
    (tmp_path / "tests/order.test.ts").unlink()
    checks = {c["check"]: c for c in e.doctor()}
    assert checks["paths"]["detail"].startswith("2 ") and checks["embeddings"]["ok"]  # edits do not count
    r = e.index()
    assert (r["unchanged"], r["added"], r["changed"], r["removed"]) == (7, 1, 1, 1)
    assert r["embeddings"] == r["chunks"]


def test_retrieval(engine):
    r = engine.retrieve("auth token store")
    assert r["items"][0]["file"] == "src/store/token.ts" and r["items"] == sorted(r["items"], key=lambda x: (x["rank"]))
    assert {x["id"] for x in engine.search("uniqueThing")["items"]} & {sym("far", "uniqueThing")}
    assert all(x["signals"]["graph"] is None for x in engine.search("token")["items"])
    semantic = engine.retrieve("TokenStore", strategy="semantic")["items"]
    assert any("lexical" in x["sources"] for x in semantic)  # exact names count under every strategy
    assert len(engine.retrieve("store", ranking="rrf", limit=3)["items"]) == 3


@pytest.mark.parametrize("budget", [256, 700, 12_000])
def test_context_keeps_its_budget(engine, budget):
    p = engine.context("place an order with the token store " * (30 if budget == 256 else 1), max_tokens=budget)
    assert p["tokens"]["used"] <= p["tokens"]["budget"] == budget
    assert budget == 256 or p["files"]


def test_renderers(engine):
    p = engine.context("token store", max_tokens=900)
    p["files"][0]["text"] = "a ]]> b ``` c"
    assert json.loads(render.text_of(p, "json"))["query"] == "token store"
    assert "]]]]><![CDATA[>" in render.text_of(p, "xml") and "````" in render.text_of(p, "markdown")


def test_explanations(engine):
    r = engine.explain("TokenStore")
    assert r["node"]["id"] == sym("store/token", "TokenStore") and all(x["kind"] != "contains" for x in r["relations"])
    assert engine.resolve("src/util.ts") == "file:src/util.ts" and engine.resolve("services/order.ts") == "file:src/services/order.ts"
    with pytest.raises(NotFoundError):
        engine.explain("nothing-like-this")
    with pytest.raises(ProviderNotConfiguredError):
        engine.explain("TokenStore", ai=True)


def test_names_that_stand_twice(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "same.ts").write_text("export function twin(): void {}\n")
    e = Engine(spark, str(tmp_path), registry=Registry(env={}))
    e.index()
    for target in ("twin", "same.ts"):
        with pytest.raises(AmbiguousError):
            e.resolve(target)


def test_report(engine):
    r = engine.repository_analysis()
    assert r["frameworks"] == ["Express", "Vitest", "TypeScript"] and ("bin", "src/cli.ts") in r["entrypoints"]
    assert {x["dir"] for x in r["layout"]} == {"src", "tests", "."} and "ESM package" in r["patterns"]
    assert r["external_dependencies"] == [{"id": "mod:express", "uses": 1}]


def test_plugins(spark, root, tmp_path):
    from pyspark.sql import functions as F

    seen = []
    plugin = Plugin("hot", signals=(Signal("hot", lambda q: F.when(F.col("file").startswith("src/far"), 1.0), 50.0),), hooks={"before_retrieve": lambda o: seen.append(o["query"])}, summarize=lambda p, t: "HOT " + t)
    e = Engine(spark, str(root), {"store": str(tmp_path / "store")}, registry=Registry(env={})).use(plugin)
    with pytest.raises(PluginError):
        e.use(Plugin("hot"))
    with pytest.raises(NotIndexedError):
        e.retrieve("x")
    with pytest.raises(TesselonError):
        e.use(Plugin("late"))
    e.index()
    assert e.retrieve("store unique thing far")["items"][0]["file"] == "src/far.ts" and "store unique thing far" in seen
    assert any((f["text"] or "").startswith("HOT ") for f in e.context("token")["files"])


def test_git_history(spark, tmp_path):
    fixture_repo.write(tmp_path)
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=Ann", "-c", "user.email=a@b.c", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "-A")
    run("commit", "-qm", "one")
    (tmp_path / "src/util.ts").write_text("export const helper = 1;\n")
    run("commit", "-qam", "two")
    e = Engine(spark, str(tmp_path), registry=Registry(env={}))
    e.index()
    n = {r.path: r for r in e.graph()[0].where("kind = 'file'").collect()}
    assert n["src/util.ts"].commit_count == 2 and n["src/util.ts"].activity == 1.0 and n["src/far.ts"].commit_count == 1
    own = {x["dir"]: x for x in e.repository_analysis()["ownership"]}
    assert own["src"]["owner"] == "Ann" and own["src"]["share"] == 1.0


def test_command_line(spark, root, capsys):
    assert cli.main(["--cwd", str(root), "--json", "search", "token"], spark) == 0
    assert json.loads(capsys.readouterr().out)["items"]
    assert cli.main(["--cwd", str(root), "explain", "nope"], spark) == 4
    assert "NODE_NOT_FOUND" in capsys.readouterr().err
    assert cli.main(["version"]) == 0 and cli.main(["--cwd", str(root), "graph"], spark) == 0
