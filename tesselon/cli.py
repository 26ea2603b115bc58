"""Command line: data on stdout, commentary on stderr, exit status from the error."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from . import render
from .engine import Engine
from .errors import TesselonError

VERSION = "0.1.0"
TEMPLATE = '{\n  "graph_depth": 2,\n  "strategy": "hybrid"\n}\n'


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tesselon")
    p.add_argument("--cwd", default=".")
    p.add_argument("--config")
    p.add_argument("--json", action="store_true")
    p.add_argument("--quiet", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("init")
    sub.add_parser("index").add_argument("--force", action="store_true")
    sub.add_parser("graph")
    for name in ("search", "retrieve", "context"):
        s = sub.add_parser(name)
        s.add_argument("query")
        s.add_argument("--limit", type=int)
        if name == "retrieve":
            s.add_argument("--strategy", choices=("hybrid", "lexical", "semantic", "graph"))
            s.add_argument("--ranking", choices=("hybrid", "weighted", "rrf"))
        if name == "context":
            s.add_argument("--max-tokens", type=int)
            s.add_argument("--format", choices=("markdown", "json", "xml"))
            s.add_argument("--output")
    e = sub.add_parser("explain")
    e.add_argument("target")
    e.add_argument("--ai", action="store_true")
    for name in ("doctor", "stats", "version"):
        sub.add_parser(name)
    return p


def init(root: str) -> str:
    """Write a configuration and keep the store out of version control."""
    config, ignore = Path(root) / "tesselon.config.json", Path(root) / ".gitignore"
    if not config.exists():
        config.write_text(TEMPLATE)
    lines = ignore.read_text().splitlines() if ignore.exists() else []
    if ".tesselon/" not in lines:
        ignore.write_text("\n".join([*lines, ".tesselon/"]) + "\n")
    return str(config)


def main(argv: list[str] | None = None, spark=None, out=None) -> int:
    a = parser().parse_args(argv)
    say = (lambda x: None) if a.quiet else (lambda x: print(x, file=sys.stderr))
    emit = lambda x: print(x, file=out or sys.stdout)
    dump = lambda x: emit(json.dumps(x, indent=2, default=str, ensure_ascii=False))
    try:
        if a.command == "version":
            emit(VERSION)
            return 0
        if a.command == "init":
            emit(init(a.cwd))
            return 0
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.appName("tesselon").config("spark.ui.enabled", "false").getOrCreate()
        engine = Engine(spark, a.cwd, config_file=a.config)
        limit = {"limit": a.limit} if getattr(a, "limit", None) else {}
        if a.command == "index":
            r = engine.index(a.force)
            say(f"{r['files']} files, {r['nodes']} nodes, {r['edges']} edges in {r['duration_ms']:.0f} ms")
            dump(r) if a.json else emit(f"added {r['added']}, changed {r['changed']}, removed {r['removed']}, unchanged {r['unchanged']}")
        elif a.command in ("search", "retrieve"):
            if a.command == "search":
                r = engine.search(a.query, **limit)
            else:
                r = engine.retrieve(a.query, **limit, **{k: v for k in ("strategy", "ranking") if (v := getattr(a, k))})
            for w in r["diagnostics"]["warnings"]:
                say(w)
            dump(r) if a.json else emit(render.table(r["items"]))
        elif a.command == "context":
            text = engine.context_text(a.query, "json" if a.json else a.format, **({"max_tokens": a.max_tokens} if a.max_tokens else {}), **limit)
            Path(a.output).write_text(text) if a.output else emit(text)
        elif a.command == "explain":
            r = engine.explain(a.target, a.ai)
            if a.json:
                dump(r)
            else:
                emit(f"{r['node']['kind']} {r['node']['name']} ({r['node']['id']})")
                for x in r["relations"]:
                    emit(f"  {x['direction']:3} {x['kind']:12} {x['node']}")
                if r.get("text"):
                    emit(r["text"])
        elif a.command == "graph":
            dump(engine.stats()["graph"])
        elif a.command == "stats":
            dump(engine.stats())
        elif a.command == "doctor":
            checks = engine.doctor()
            dump(checks) if a.json else [emit(f"{'ok  ' if c['ok'] else 'FAIL'} {c['check']}: {c['detail']}") for c in checks]
            return int(not all(c["ok"] for c in checks))
        engine.dispose()
        return 0
    except TesselonError as e:
        print(f"{e.code}: {e}", file=sys.stderr)
        return e.exit_status


if __name__ == "__main__":
    sys.exit(main())
