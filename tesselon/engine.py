"""The facade: index a repository, retrieve, pack context, explain, report."""

from __future__ import annotations

import math
import os
import sys
import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import render
from .config import Config, as_dict, load
from .errors import AmbiguousError, NotFoundError, NotIndexedError, ProviderError, TesselonError
from .functions import text as T
from .operators import bm25, candidates, expand, graph, link, metrics, pack, rank, report, vectors
from .plugins import Plugins
from .providers import Registry
from .sources import analysis as A
from .sources import repository as R
from .sources.store import Store
from .telemetry import Recorder

ANALYZER_VERSION = 1
SIGNALS = ["semantic", "lexical", "graph", "centrality", "importance", "usage", "activity", "recency", "dependency"]
CORPUS_SIGNALS = SIGNALS[3:]
# Frameworks told by a dependency, in the order they are shown.
FRAMEWORKS = (
    ("react", "React"), ("next", "Next.js"), ("vue", "Vue"), ("svelte", "Svelte"), ("@angular/core", "Angular"), ("solid-js", "SolidJS"), ("astro", "Astro"),
    ("express", "Express"), ("fastify", "Fastify"), ("koa", "Koa"), ("hono", "Hono"), ("@nestjs/core", "NestJS"), ("electron", "Electron"),
    ("commander", "Commander (CLI)"), ("yargs", "Yargs (CLI)"), ("prisma", "Prisma"), ("drizzle-orm", "Drizzle"), ("typeorm", "TypeORM"), ("mongoose", "Mongoose"),
    ("vitest", "Vitest"), ("jest", "Jest"), ("mocha", "Mocha"), ("vite", "Vite"), ("webpack", "Webpack"), ("esbuild", "esbuild"), ("typescript", "TypeScript"),
)
# Folder names that tell the layers and parts of a repository.
ENTRY_DIRS = ("controllers", "routes", "handlers", "http", "api")
SERVICE_DIRS = ("services", "usecases", "domain", "core")
DATA_DIRS = ("repositories", "models", "db", "dao", "entities", "data")
UI_DIRS = ("components", "pages", "hooks")


def tokens(text: str | None) -> int:
    return math.ceil(len(text or "") / T.CHARS_PER_TOKEN)


class Engine:
    def __init__(self, spark: SparkSession, root: str = ".", config: dict | None = None, config_file: str | None = None, registry: Registry | None = None):
        self.spark = spark
        self.config: Config = load(root, config, config_file)
        self.plugins, self.registry = Plugins(), registry or Registry()
        self.telemetry = Recorder(self.config.telemetry.enabled)
        self.store = Store(spark, self.config.store_path if "://" in self.config.store_path else os.path.abspath(self.config.store_path))
        self._tables: dict[str, DataFrame] = {}
        self._started = False
        for p in self.config.plugins:
            self.plugins.load(p, root)
            self._register(self.plugins.all[-1])

    # --- set-up
    def use(self, plugin) -> "Engine":
        if self._started:
            raise TesselonError("plugins have to be added before the first operation")
        self.plugins.load(plugin, self.config.root)
        self._register(self.plugins.all[-1])
        return self

    def _register(self, plugin) -> None:
        for p in plugin.providers:
            self.registry.add(p)

    def resolved_config(self) -> dict:
        return as_dict(self.config)

    def dispose(self) -> None:
        if self.config.telemetry.file:
            self.telemetry.flush(self.store)
        self._forget()

    def _forget(self) -> None:
        for df in self._tables.values():
            df.unpersist()
        self._tables = {}

    def _table(self, name: str) -> DataFrame:
        """A stored table; graph tables get the plugins' extensions, which are never stored."""
        if self.store.meta() is None:
            raise NotIndexedError(f"no index at {self.store.path}")
        if name not in self._tables:
            if name in ("nodes", "edges"):
                n, e = self.plugins.extended(self.store.read("nodes"), self.store.read("edges"))
                self._tables["nodes"], self._tables["edges"] = n.persist(), e.persist()
            else:
                self._tables[name] = self.store.read(name).persist()
        return self._tables[name]

    # --- index
    def index(self, force: bool = False) -> dict:
        self._started = True
        began = time.time()
        c, spark = self.config, self.spark
        with self.telemetry.span("index"):
            package = R.package_json(c.root)
            print_ = A.fingerprint({"extensions": c.extensions, "exclude": c.exclude, "size": c.max_file_size_bytes, "analyzer": ANALYZER_VERSION, "plugins": [p.name for p in self.plugins.all if p.analyzers]})
            old = None if force else self.store.meta()
            old = old if old and old.get("fingerprint") == print_ else None
            files = R.scan(spark, c).withColumn("hash", F.sha1("content")).persist()
            if old:
                known = self.store.read("files").select("path", "hash")
                diff = report.snapshot_diff(known, files)
                counts = {r["change"]: r["n"] for r in diff.groupBy("change").agg(F.count("*").alias("n")).collect()}
                same = files.join(known, ["path", "hash"], "left_semi").select("path")
                fresh = files.join(same, "path", "left_anti")
                made = A.analyses(fresh, (*self.plugins.analyzers, A.BUILT_IN)).unionByName(self.store.read("analyses").join(same, "path", "left_semi"))
            else:
                counts = {"added": files.count()}
                made = A.analyses(files, (*self.plugins.analyzers, A.BUILT_IN))
            analysis = link.checkpointed(made)
            nodes, edges = link.build(analysis)
            history = R.history(spark, c)
            nodes = self._with_metrics(nodes, edges, files, history, package)
            chunks = link.checkpointed(A.chunks(analysis, files))
            embeddings, warnings, embedder = self._embedded(chunks, old)
            corpus = chunks.select("id", F.concat_ws("\n", "text", "file", "name").alias("text"))
            tables = {
                "files": files, "analyses": analysis, "nodes": nodes, "edges": edges, "chunks": chunks, "embeddings": embeddings,
                "postings": bm25.postings(corpus).repartition("term").sortWithinPartitions("term"), "lengths": bm25.lengths(corpus),
                "history": history if history is not None else spark.createDataFrame([], R.HISTORY),
            }
            meta = {
                "fingerprint": print_, "indexed_at": datetime.now(timezone.utc).isoformat(), "root": os.path.abspath(c.root), "provider": embedder.name, "model": getattr(embedder, "model", ""),
                "git": history is not None, "package": {k: package.get(k) for k in ("name", "version", "description")}, "warnings": warnings,
            }
            self.store.write(tables, meta)
            files.unpersist()
            self._forget()
        stats = {
            "files": self._table("files").count(), "nodes": self._table("nodes").count(), "edges": self._table("edges").count(), "chunks": self._table("chunks").count(),
            "embeddings": self._table("embeddings").count(), "added": counts.get("added", 0), "changed": counts.get("changed", 0), "removed": counts.get("removed", 0),
            "unchanged": counts.get("unchanged", 0), "duration_ms": (time.time() - began) * 1000, "warnings": warnings,
        }
        if stats["files"] == 0:
            stats["warnings"] = [*warnings, "no source files found"]
        return self.plugins.run("after_index", stats)

    def _with_metrics(self, nodes, edges, files, history, package) -> DataFrame:
        ranks = metrics.pagerank(nodes, edges)
        deg = graph.degrees(edges).select("id", "fan_in", "fan_out")
        f = nodes.where("kind = 'file'").select("id", "path").join(deg, "id", "left").join(files.select("path", "mtime_ms"), "path", "left")
        ex = edges.where("kind = 'exports'").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("exports"))
        entry = [p for _, p in R.entrypoints(package)]
        f = f.join(ex, "id", "left").fillna(0, ["fan_in", "fan_out", "exports"]).withColumn("entrypoint", F.col("path").isin(entry).cast("int") if entry else F.lit(0))
        h = history.select("path", "commit_count", "last_commit_at") if history is not None else self.spark.createDataFrame([], "path string, commit_count long, last_commit_at long")
        f = link.checkpointed(f.join(h, "path", "left").withColumn("last_modified_at", F.coalesce("last_commit_at", "mtime_ms")))
        own = metrics.importance(f).join(metrics.recency(f, int(time.time() * 1000)), "id", "left")
        if history is not None and history.limit(1).count():
            own = own.join(metrics.activity(f, h), "id", "left")
        else:
            own = own.withColumn("activity", F.lit(None).cast("double"))
        own = own.join(f.select("id", "path", "commit_count", "last_modified_at"), "id").select(F.col("path").alias("file"), "importance", "dependency", "activity", "recency", "commit_count", "last_modified_at")
        symbols = nodes.where("id LIKE 'sym:%'")
        out = nodes.join(metrics.centrality(ranks), "id", "left").join(metrics.usage(symbols, edges), "id", "left").join(deg, "id", "left").join(own, "file", "left")
        return link.checkpointed(out.fillna(0, ["fan_in", "fan_out"]))

    def _embedded(self, chunks, old):
        embedder = self.registry.embedder(self.config.embedding_provider)
        empty = self.spark.createDataFrame([], "id string, hash string, v array<float>")
        kept, todo = empty, chunks
        if old and old.get("provider") == embedder.name and old.get("model") == getattr(embedder, "model", ""):
            stored = self.store.read("embeddings")
            todo = vectors.cache_misses(chunks, stored)
            kept = stored.join(chunks.select("id", "hash"), ["id", "hash"], "left_semi")
        text = todo.select("id", F.concat(F.lit("// "), "file", F.lit(" "), "name", F.lit("\n"), "text").alias("text"))
        try:
            fresh = link.checkpointed(embedder.embed_frame(text))
        except Exception as e:  # a failing provider leaves a partial index with a warning
            return kept, [f"embeddings: {e}"], embedder
        return kept.unionByName(fresh.join(chunks.select("id", "hash"), "id").select("id", "hash", "v")), [], embedder

    # --- retrieval
    def retrieve(self, query: str | dict, **options) -> dict:
        """items (best first) and diagnostics of a query."""
        self._started = True
        o = {"query": query} if isinstance(query, str) else dict(query)
        o.update(options)
        c = self.config
        nodes, edges = self._table("nodes"), self._table("edges")
        o = self.plugins.run("before_retrieve", {"strategy": c.strategy, "ranking": c.ranking, "limit": c.retrieval.limit, "depth": c.graph_depth, **o})
        strategy, most = o["strategy"], c.retrieval.candidate_limit
        began = time.time()
        q = self.spark.createDataFrame([(1, o["query"])], "query_id int, query string")
        none = self.spark.createDataFrame([], "query_id int, id string, score double")
        warnings: list[str] = []
        lexical = semantic = none
        if strategy in ("hybrid", "lexical", "graph"):
            lexical = bm25.search_index(self._table("postings"), self._table("lengths"), q, most).select("query_id", "id", "score")
        if strategy in ("hybrid", "semantic"):
            semantic = self._semantic(o["query"], most, warnings) or none
        named = graph.by_name(nodes.where("file IS NOT NULL"), candidates.name_terms(q)).select("query_id", "id")
        lexical, semantic, named = (link.checkpointed(x) for x in (lexical, semantic, named))
        found = self.spark.createDataFrame([], "query_id int, id string, score double, depth int")
        if strategy in ("hybrid", "graph"):
            e = c.expansion
            limits = expand.Limits(o["depth"], e.traversal_budget, e.min_score, e.decay, e.hub_degree_limit, max(c.max_nodes * 3, 60), e.edge_weights)
            found = expand.expand(nodes, edges, candidates.seeds(lexical, semantic, named), limits).select("query_id", "id", "score", "depth")
        merged = candidates.merge(lexical, semantic, named, found)
        merged = merged.join(nodes.where("file IS NOT NULL").select("id", "kind", "name", "file", "path", "signature", "doc", "start_line", "end_line", "exported", *CORPUS_SIGNALS), "id")
        weights, signals = dict(c.weights), list(SIGNALS)
        for s in self.plugins.signals:
            merged = merged.withColumn(s.name, s.compute(o["query"]))
            weights[s.name] = s.weight
            signals.append(s.name)
        fuse = rank.reciprocal if o["ranking"] == "rrf" else rank.weighted
        scored = self.plugins.reranked(rank.best(fuse(merged, signals, weights), o["limit"]))
        text = self._table("chunks").select("id", T.snippet(F.col("text"), c.retrieval.snippet_length).alias("snippet"))
        rows = scored.join(text, "id", "left").orderBy("rank", "id").collect()
        items = []
        for r in rows:
            d = r.asDict()
            d["signals"] = {s: d.pop(s) for s in signals}
            d["score"] = math.floor(d["score"] * 1e4 + 0.5) / 1e4
            items.append(d)
        took = (time.time() - began) * 1000
        self.telemetry.record("retrieve", duration_ms=took, results=len(items))
        result = {"query": o["query"], "items": items, "diagnostics": {"strategy": strategy, "ranking": o["ranking"], "duration_ms": took, "warnings": warnings}}
        return self.plugins.run("after_retrieve", result)

    def search(self, query: str, **options) -> dict:
        return self.retrieve(query, **{**options, "strategy": "lexical"})

    def _semantic(self, query: str, most: int, warnings: list[str]) -> DataFrame | None:
        meta = self.store.meta()
        try:
            embedder = self.registry.embedder(self.config.embedding_provider)
            if embedder.name != meta["provider"]:
                warnings.append(f"semantic search skipped: the index has vectors of {meta['provider']}")
                return None
            row = embedder.embed_frame(self.spark.createDataFrame([("q", query)], "id string, text string")).first()
        except (TesselonError, ProviderError) as e:
            warnings.append(f"semantic search skipped: {e}")
            return None
        return vectors.nearest(self._table("embeddings").select("id", "v"), [(1, list(row["v"]))], most).select(F.col("query_id").cast("int").alias("query_id"), "id", "score")

    # --- context
    def context(self, query: str, max_tokens: int | None = None, **options) -> dict:
        c = self.config.context
        budget = pack.Budget(max_tokens or c.max_tokens, c.max_file_tokens, c.max_symbol_tokens)
        found = self.retrieve(query, **{"limit": self.config.max_nodes, **options})
        items = found["items"]
        ids = [x["id"] for x in items]
        files = sorted({x["file"] for x in items})
        content = {r["path"]: r["content"] for r in self._table("files").where(F.col("path").isin(files)).select("path", "content").collect()}
        analysis = {r["path"]: r.asDict(True) for r in self._table("analyses").where(F.col("path").isin(files)).collect()}
        code = {r["id"]: r["text"] for r in self._table("chunks").where(F.col("id").isin(ids)).select("id", "text").collect()}
        edges = self._table("edges").where(F.col("src").isin(ids) | F.col("dst").isin(ids)).withColumn("edge", graph.edge_id()).orderBy("edge").collect()
        name = {r["id"]: r["name"] for r in self._table("nodes").where(F.col("id").isin(list({e[k] for e in edges for k in ("src", "dst")}))).select("id", "name").collect()} if edges else {}
        rows, about = [], {}
        for x in items:
            is_file = x["kind"] == "file"
            if is_file:
                whole = self.plugins.summary(x["file"], content.get(x["file"], ""))
                card = self.plugins.summary(x["file"], file_summary(analysis.get(x["file"])))
                about[x["rank"]] = {"full": whole, "compressed": card, "mention": ""}
                costs = (tokens(whole), tokens(card), tokens(x["file"]) + 4)
            else:
                notes = relation_notes(x["id"], edges, name)
                fixed = tokens(x["signature"]) + tokens(x["file"]) + 8 + tokens(x["doc"]) + sum(map(tokens, notes))
                own = code.get(x["id"]) or ""
                about[x["rank"]] = {"code": own, "card": None, "notes": notes}
                costs = (fixed + tokens(own) if own else None, fixed, None)
            parent = x["id"].rsplit(".", 1)[0] if "#" in x["id"] and "." in x["id"].split("#")[1] else None
            rows.append({"rank": x["rank"], "id": x["id"], "file": x["file"], "is_file": is_file, "parent": parent, "full": costs[0], "card": costs[1], "mention": costs[2]})
        taken = {r: (form, cost) for r, form, cost in pack.ladder(rows, budget)}
        packed_files, packed_symbols = [], []
        for x in items:
            if x["rank"] not in taken:
                continue
            form, cost = taken[x["rank"]]
            a = about[x["rank"]]
            if x["kind"] == "file":
                packed_files.append({"path": x["file"], "form": form, "text": a[form], "language": (analysis.get(x["file"]) or {}).get("language"), "tokens": cost, "score": x["score"]})
            else:
                packed_symbols.append({"id": x["id"], "name": x["name"], "kind": x["kind"], "file": x["file"], "start_line": x["start_line"], "signature": x["signature"], "doc": x["doc"], "relations": a["notes"], "code": a.get(form) if form == "code" else None, "tokens": cost, "reason": reason(x)})
        included = [x["id"] for x in items if x["rank"] in taken]
        lines = {"architecture": self.architecture() if c.include_architecture else [], "dependencies": self.dependency_lines(included) if c.include_dependencies else [], "recommendations": self._recommendations(included, packed_files) if c.include_recommendations else []}
        for part, share in (("architecture", pack.ARCHITECTURE_SHARE), ("dependencies", pack.DEPENDENCY_SHARE)):
            lines[part] = prefix(lines[part], int(budget.tokens * share))
        lines["summary"] = [f"{len(packed_files)} files and {len(packed_symbols)} symbols for: {query}"]
        content_used = sum(f["tokens"] for f in packed_files) + sum(s["tokens"] for s in packed_symbols)
        lines = pack.fit(lines, budget.tokens - content_used, tokens)
        report_ = {k: sum(map(tokens, v)) for k, v in lines.items()} | {"content": content_used}
        p = {"query": query, **{k: lines[k] for k in ("summary", "architecture", "dependencies", "recommendations")}, "files": packed_files, "symbols": packed_symbols, "tokens": {"budget": budget.tokens, "used": sum(report_.values()), "parts": report_}}
        return self.plugins.run("before_context", p)

    def context_text(self, query: str, format: str | None = None, **options) -> str:
        return render.text_of(self.context(query, **options), format or self.config.context.format)

    def dependency_lines(self, ids: list[str]) -> list[str]:
        files = [("file:" + i.split("#")[0].removeprefix("sym:") if i.startswith("sym:") else i,) for i in ids]
        if not files:
            return []
        chosen = self.spark.createDataFrame(files, "id string").distinct()
        edges = self._table("edges")
        inner = [f"{r['src'][5:]} -> {r['dst'][5:]} ({int(r['weight'])} bindings)" for r in report.dependencies(edges, chosen).collect()]
        outer = edges.where("kind = 'imports' AND dst LIKE 'mod:%'").join(chosen.withColumnRenamed("id", "src"), "src", "left_semi")
        used = outer.groupBy("dst").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dst").limit(8).collect()
        return inner + [f"{r['dst'][4:]} in {r['n']} files" for r in used]

    def _recommendations(self, ids: list[str], files: list[dict]) -> list[str]:
        out = [f"Start with {files[0]['path']}."] if files else []
        if ids:
            chosen = self.spark.createDataFrame([(i,) for i in ids], "id string")
            edges = self._table("edges")
            out += [f"{r['id'].split('#')[-1]} is also called by {r['caller'].split(':', 1)[1]}." for r in report.outside_callers(edges, chosen).collect()]
            tests = edges.where("kind = 'imports'").join(chosen.withColumnRenamed("id", "dst"), "dst", "left_semi").where(F.col("src").rlike(T.TEST_DIR) | F.col("src").rlike(T.TEST_FILE))
            out += [f"Covered by {r['src'][5:]}." for r in tests.select("src").distinct().orderBy("src").limit(3).collect()]
        return list(dict.fromkeys(out))[:6]

    # --- reports
    def graph(self) -> tuple[DataFrame, DataFrame]:
        return self._table("nodes"), self._table("edges")

    def architecture(self) -> list[str]:
        r = self.repository_analysis()
        out = [f"{x['language']}: {x['files']} files, {x['loc']} lines" for x in r["languages"] if x["language"]]
        out += [f"{x['dir']}/ ({x['role']}): {x['files']} files" for x in r["layout"]]
        if r["frameworks"]:
            out.append("Built with " + ", ".join(r["frameworks"]))
        out += r["patterns"]
        return out + [f"Central: {x['path']}" for x in r["top_central"][:3]]

    def repository_analysis(self) -> dict:
        analyses, nodes, edges, history = (self._table(t) for t in ("analyses", "nodes", "edges", "history"))
        files = nodes.where("kind = 'file'")
        package = R.package_json(self.store.meta()["root"])
        deps = {**(package.get("dependencies") or {}), **(package.get("devDependencies") or {}), **(package.get("peerDependencies") or {})}
        commits = history.join(files.select("path"), "path", "left_semi").select(report.top_directory().alias("dir"), F.explode("authors").alias("author", "n"))

        def rows(df):
            return [r.asDict() for r in df.collect()]

        central = files.select("path", "centrality").where("centrality IS NOT NULL")
        return {
            "package": {k: package.get(k) for k in ("name", "version", "description")}, "entrypoints": R.entrypoints(package),
            "languages": rows(report.languages(analyses)), "layout": rows(report.layout(files)), "frameworks": [label for d, label in FRAMEWORKS if d in deps],
            "patterns": self.patterns(analyses, package), "top_imported": rows(report.top_imported(files.select("id", "path", "fan_in"))),
            "top_central": rows(central.orderBy(F.desc("centrality"), "path").limit(report.TOP)), "external_dependencies": rows(report.externals(edges, nodes.where("kind = 'module'"))),
            "hotspots": rows(report.hotspots(history.join(files.select("path"), "path", "left_semi"), central)), "ownership": rows(report.ownership(commits)),
        }

    def patterns(self, analyses: DataFrame, package: dict) -> list[str]:
        """What the shape of the paths tells: one aggregation over the files."""
        root = self.store.meta()["root"]
        p = F.col("path")
        barrel = p.rlike(r"(^|/)index\.[cm]?[jt]sx?$") & (F.size("reexports") > 0)
        folders = F.explode_outer(F.slice(F.split(p, "/"), 1, F.size(F.split(p, "/")) - 1))
        one = analyses.agg(
            F.countDistinct(T.dirname(p)).alias("dirs"), F.sum(barrel.cast("int")).alias("barrels"),
            F.max(p.rlike(r"\.(test|spec)\.[cm]?[jt]sx?$").cast("int")).alias("beside"), F.max(p.rlike(r"(^|/)(tests?|__tests__)/").cast("int")).alias("apart"),
        ).first()
        names = {r["d"] for r in analyses.select(folders.alias("d")).where(F.col("d").isin(*ENTRY_DIRS, *SERVICE_DIRS, *DATA_DIRS, *UI_DIRS)).distinct().collect()}
        out = []
        if "workspaces" in package or any(os.path.exists(os.path.join(root, f)) for f in ("pnpm-workspace.yaml", "lerna.json")):
            out.append("monorepo with workspaces")
        if package.get("type") == "module":
            out.append("ESM package")
        if "bin" in package:
            out.append("ships a command line tool")
        if one["dirs"] and (one["barrels"] or 0) / one["dirs"] >= 0.3:
            out.append("barrel exports")
        if all(names & set(own) for own in (ENTRY_DIRS, SERVICE_DIRS, DATA_DIRS)):
            out.append("layered architecture")
        if len(names & set(UI_DIRS)) >= 2:
            out.append("component-based user interface")
        if one["apart"]:
            out.append("tests in their own directories")
        elif one["beside"]:
            out.append("tests beside the sources")
        return out

    # --- explanations
    def resolve(self, target: str) -> str:
        """Node id of a target: an id, a name, a path or the end of a path; each has to be unique."""
        nodes = self._table("nodes")
        low = target.lower()
        order = F.when(F.col("id") == target, 0).when(F.lower("name") == low, 1).when(F.col("path") == target, 2).when(F.col("path").endswith("/" + target), 3)
        found = nodes.where("file IS NOT NULL OR kind IN ('module', 'directory', 'repository')").select("id", "kind", order.alias("o")).where("o IS NOT NULL")
        found = found.where("o < 2 OR kind = 'file'").orderBy("o", "id").limit(50).collect()
        for o in range(4):
            own = [r["id"] for r in found if r["o"] == o]
            if len(own) == 1:
                return own[0]
            if own:
                raise AmbiguousError(f"{target!r} may be {', '.join(own[:5])}")
        raise NotFoundError(f"nothing is called {target!r}")

    def explain(self, target: str, ai: bool = False) -> dict:
        node = self.resolve(target)
        row = self._table("nodes").where(F.col("id") == node).first().asDict()
        relations = [r.asDict() for r in report.relations(self._table("edges"), node).collect()]
        relations.sort(key=lambda r: (r["kind"], r["direction"], r["node"].lower(), r["node"]))
        out = {"node": row, "relations": relations}
        if ai:
            chunk = self._table("chunks").where(F.col("id") == node).first()
            prompt = "\n".join([f"Explain {row['kind']} {row['name']}.", chunk["text"] if chunk else "", *[f"{r['direction']} {r['kind']} {r['node']}" for r in relations[:12]]])
            out["text"] = self.registry.generator(self.config.provider).generate(prompt)
        return out

    def stats(self) -> dict:
        nodes, edges = self.graph()
        counts = [r.asDict() for r in graph.statistics(nodes, edges).collect()]
        return {"index": self.store.meta(), "graph": counts, "store": self.store.sizes(), "telemetry": self.telemetry.summary(), "providers": self.registry.available()}

    def doctor(self) -> list[dict]:
        checks = [{"check": "python", "ok": sys.version_info >= (3, 9), "detail": sys.version.split()[0]}, {"check": "spark", "ok": True, "detail": self.spark.version}]
        meta = self.store.meta()
        checks.append({"check": "index", "ok": meta is not None, "detail": meta["indexed_at"] if meta else "none"})
        if meta:
            stale = report.stale(self.store.read("files"), R.scan(self.spark, self.config)).first()["stale"]
            checks.append({"check": "paths", "ok": stale == 0, "detail": f"{stale} added or removed"})
            chunks, vecs = self._table("chunks").count(), self._table("embeddings").count()
            checks.append({"check": "embeddings", "ok": chunks == vecs, "detail": f"{vecs} of {chunks} chunks"})
        checks.append({"check": "git", "ok": R.git_log(self.config.root, 1, 1) is not None, "detail": "history of the root"})
        checks.append({"check": "providers", "ok": True, "detail": ", ".join(n for n, there in self.registry.available().items() if there)})
        checks.append({"check": "plugins", "ok": True, "detail": ", ".join(p.name for p in self.plugins.all) or "none"})
        return checks


def prefix(lines: list[str], budget: int) -> list[str]:
    """Lines up to the first that overflows."""
    out, used = [], 0
    for x in lines:
        used += tokens(x)
        if used > budget:
            break
        out.append(x)
    return out


def reason(item: dict) -> str:
    if item["depth"] == 0:
        return "matches the query" if item["sources"] else "matched"
    return f"{item['depth']} hop{'s' if item['depth'] != 1 else ''} from a match"


def relation_notes(node: str, edges, name: dict[str, str]) -> list[str]:
    """At most two callers by weight, two callees, a base and a derived type; four in all."""
    callers = sorted((e for e in edges if e["dst"] == node and e["kind"] == "calls"), key=lambda e: (-e["weight"], e["edge"]))[:2]
    callees = [e for e in edges if e["src"] == node and e["kind"] == "calls"][:2]
    bases = [e for e in edges if e["src"] == node and e["kind"] == "inheritance"][:1]
    derived = [e for e in edges if e["dst"] == node and e["kind"] == "inheritance"][:1]
    notes = [f"called by {name.get(e['src'], e['src'])}" for e in callers] + [f"calls {name.get(e['dst'], e['dst'])}" for e in callees]
    notes += [f"extends {name.get(e['dst'], e['dst'])}" for e in bases] + [f"base of {name.get(e['src'], e['src'])}" for e in derived]
    return notes[:4]


def file_summary(a: dict | None) -> str:
    """Imports, re-exports, declarations with their members, and exports of a file."""
    if not a:
        return ""
    out = [f"// {a['path']} ({a['language']}, {a['loc']} lines)"]
    for i in a["imports"] or []:
        names = ", ".join(b["local"] if b["imported"] in (b["local"], "default", "*") else f"{b['imported']} as {b['local']}" for b in i["bindings"])
        out.append(f"import {'type ' if i['type_only'] else ''}{names} from {i['specifier']}" if names else f"import {i['specifier']}")
    for r in a["reexports"] or []:
        out.append(f"export {'*' if r['star'] else ', '.join(n['exported'] for n in r['names'])} from {r['specifier']}")
    for s in a["symbols"] or []:
        pad = "  " if s["parent"] else ""
        if s["doc"]:
            out.append(f"{pad}// {s['doc']}")
        out.append(pad + (s["signature"] or s["name"]))
    names = [e["exported"] for e in a["exports"] or []]
    return "\n".join(out + ([f"exports {', '.join(names)}"] if names else []))


def symbol_summary(item: dict) -> str:
    return "\n".join(x for x in (item["signature"], item["doc"], f"{item['file']}:{item['start_line']}") if x)
