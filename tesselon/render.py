"""Context packages as Markdown, XML or JSON, and results as tables."""

from __future__ import annotations

import json
from xml.sax.saxutils import escape, quoteattr

LANGUAGES = {"typescript": "ts", "javascript": "js"}


def fence(text: str) -> str:
    n = 3
    while "`" * n in text:
        n += 1
    return "`" * n


def markdown(p: dict) -> str:
    out = [f"# Context: {p['query']}", "", *p["summary"], ""]
    if p["architecture"]:
        out += ["## Architecture", "", *[f"- {x}" for x in p["architecture"]], ""]
    if p["dependencies"]:
        out += ["## Dependencies", "", *[f"- {x}" for x in p["dependencies"]], ""]
    if p["files"]:
        out += ["## Files", ""]
        for f in p["files"]:
            out += [f"### {f['path']} ({f['form']})", ""]
            if f["text"]:
                mark = fence(f["text"])
                out += [mark + LANGUAGES.get(f.get("language") or "", ""), f["text"], mark, ""]
    if p["symbols"]:
        out += ["## Symbols", ""]
        for s in p["symbols"]:
            out += [f"### {s['name']} ({s['kind']}, {s['file']}:{s['start_line']})", "", f"`{s['signature']}`", *([s["doc"]] if s.get("doc") else []), *[f"- {x}" for x in s["relations"]], ""]
            if s.get("code"):
                mark = fence(s["code"])
                out += [mark, s["code"], mark, ""]
    if p["recommendations"]:
        out += ["## Recommendations", "", *[f"- {x}" for x in p["recommendations"]], ""]
    out.append(f"_{p['tokens']['used']} of {p['tokens']['budget']} tokens_")
    return "\n".join(out)


def cdata(text: str) -> str:
    return "<![CDATA[" + text.replace("]]>", "]]]]><![CDATA[>") + "]]>"


def xml(p: dict) -> str:
    out = [f"<context query={quoteattr(p['query'])}>"]
    for name in ("summary", "architecture", "dependencies"):
        if p[name]:
            out += [f"  <{name}>", *[f"    <line>{escape(x)}</line>" for x in p[name]], f"  </{name}>"]
    out.append("  <files>")
    for f in p["files"]:
        out.append(f"    <file path={quoteattr(f['path'])} form={quoteattr(f['form'])}>{cdata(f['text']) if f['text'] else ''}</file>")
    out += ["  </files>", "  <symbols>"]
    for s in p["symbols"]:
        out.append(f"    <symbol name={quoteattr(s['name'])} kind={quoteattr(s['kind'])} file={quoteattr(s['file'])} line=\"{s['start_line']}\">")
        out.append(f"      <signature>{escape(s['signature'] or '')}</signature>")
        out += [f"      <relation>{escape(x)}</relation>" for x in s["relations"]]
        if s.get("code"):
            out.append(f"      <code>{cdata(s['code'])}</code>")
        out.append("    </symbol>")
    out.append("  </symbols>")
    if p["recommendations"]:
        out += ["  <recommendations>", *[f"    <line>{escape(x)}</line>" for x in p["recommendations"]], "  </recommendations>"]
    out += [f"  <tokens used=\"{p['tokens']['used']}\" budget=\"{p['tokens']['budget']}\"/>", "</context>"]
    return "\n".join(out)


def text_of(p: dict, form: str) -> str:
    return {"markdown": markdown, "xml": xml, "json": lambda x: json.dumps(x, indent=2, ensure_ascii=False)}[form](p)


def table(items: list[dict]) -> str:
    """Results with their strongest signals (at most three, of at least 0.005)."""
    rows = []
    for n, x in enumerate(items, 1):
        strong = sorted(((v, k) for k, v in x["signals"].items() if v is not None and v >= 0.005), key=lambda t: (-t[0], t[1]))[:3]
        rows.append((str(n), f"{x['score']:.4f}", x["kind"], x["name"], x["file"] or "", ", ".join(f"{k} {v:.2f}" for v, k in strong)))
    head = ("#", "score", "kind", "name", "file", "signals")
    width = [max(len(r[k]) for r in [head, *rows]) for k in range(len(head))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, width)).rstrip() for r in [head, *rows])
