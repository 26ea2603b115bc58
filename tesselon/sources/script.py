"""Declaration scanner for TypeScript and JavaScript: imports, exports, symbols, calls and type references of a file.

A lexer makes tokens with their lines; the scanner reads declarations from them and looks into bodies only for
calls and type names. It never needs valid syntax: what it does not know is skipped to the end of the statement.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Lengths that are kept.
SIGNATURE, DOC, TYPE_REFS, SYMBOLS = 400, 280, 120, 2000
TYPED = (".ts", ".tsx", ".mts", ".cts")

_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<line>//[^\n]*)|(?P<block>/\*.*?(?:\*/|\Z))|(?P<id>[A-Za-z_$¡-￿][\w$¡-￿]*|\#[A-Za-z_$][\w$]*)
    |(?P<num>\d[\w.]*)|(?P<str>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)|(?P<op>=>|\.\.\.|\?\.|[-+*/%&|^<>=!?:;,.(){}\[\]@~`\\])""",
    re.X | re.S,
)
_BEFORE_REGEX = set("( , = : [ ! & | ? { } ; + - * % < > ~ ^ => return typeof case in of delete void throw new do else".split())
_NOT_CALLS = set("if for while switch catch function return typeof await void delete in of instanceof new super import constructor do else yield case throw with class extends async get set static".split())
_MODIFIERS = set("public private protected static readonly abstract override declare accessor".split())
_CONTINUES = set(". ?. ( [ , = + - * / % & | ^ < > ? : => && || ! instanceof in of as satisfies extends implements".split())
#: Operators that begin no longer one.
_ALONE = frozenset("(){}[],;:")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    at: int
    end: int
    line: int
    doc: str | None = None


@dataclass
class Symbol:
    symbol_path: str
    name: str
    kind: str
    exported: bool
    start_line: int
    end_line: int
    signature: str
    parent: str | None = None
    default_export: bool = False
    doc: str | None = None
    extends_names: list = field(default_factory=list)
    implements_names: list = field(default_factory=list)
    composition_names: list = field(default_factory=list)
    calls: list = field(default_factory=list)
    type_refs: list = field(default_factory=list)


def _template_end(s: str, i: int) -> int:
    """The end of a template that starts at s[i], with the expressions inside it."""
    i += 1
    while i < len(s):
        if s[i] == "\\":
            i += 2
        elif s[i] == "`":
            return i + 1
        elif s.startswith("${", i):
            depth, i = 1, i + 2
            while i < len(s) and depth:
                if s[i] == "`":
                    i = _template_end(s, i)
                    continue
                depth += {"{": 1, "}": -1}.get(s[i], 0)
                i += 1
        else:
            i += 1
    return len(s)


def _regex_end(s: str, i: int) -> int | None:
    k, inside = i + 1, False
    while k < len(s) and s[k] != "\n":
        if s[k] == "\\":
            k += 2
            continue
        if s[k] == "[":
            inside = True
        elif s[k] == "]":
            inside = False
        elif s[k] == "/" and not inside:
            k += 1
            while k < len(s) and s[k].isalpha():
                k += 1
            return k
        k += 1
    return None


def lex(s: str) -> list[Token]:
    """Tokens with their lines. Single spaces, line ends and brackets are told by their letter, the rest by one match; only
    what may span lines is searched for line ends."""
    out: list[Token] = []
    add, match, size = out.append, _TOKEN.match, len(s)
    i, line, doc = 0, 1, None
    while i < size:
        c = s[i]
        if c == " " or c == "\n":
            line += c == "\n"
            i += 1
            continue
        if c in _ALONE:
            add(Token("op", c, i, i + 1, line, doc))
            doc = None
            i += 1
            continue
        m = match(s, i)
        kind, end = (m.lastgroup, m.end()) if m else ("other", i + 1)
        if kind == "space":
            line += s.count("\n", i, end)
        elif kind == "id" or kind == "num":
            add(Token(kind, s[i:end], i, end, line, doc))
            doc = None
        elif kind == "block":
            if s.startswith("/**", i):
                doc = s[i:end]
            line += s.count("\n", i, end)
        elif kind != "line":
            if kind == "op" and c == "`":
                kind, end = "tpl", _template_end(s, i)
            elif kind == "op" and c == "/" and (not out or out[-1].text in _BEFORE_REGEX):
                stop = _regex_end(s, i)
                kind, end = ("re", stop) if stop else (kind, end)
            add(Token(kind, s[i:end], i, end, line, doc))
            doc = None
            if kind != "op":
                line += s.count("\n", i, end)
        i = end
    return out


def doc_text(raw: str | None) -> str | None:
    """First paragraph of a documentation comment, up to the first tag or blank line."""
    if not raw:
        return None
    lines = []
    for x in raw.removeprefix("/**").removesuffix("*/").split("\n"):
        x = re.sub(r"^\s*\*? ?", "", x).strip()
        if x.startswith("@") or (not x and lines):
            break
        if x:
            lines.append(x)
    text = re.sub(r"\s+", " ", " ".join(lines)).strip()
    return text[:DOC] or None


class Scanner:
    def __init__(self, path: str, content: str):
        self.path, self.s, self.t = path, content, lex(content)
        self.n = len(self.t)
        self.imports: list[dict] = []
        self.reexports: list[dict] = []
        self.exports: list[dict] = []
        self.symbols: list[Symbol] = []
        self.file_calls: list[dict] = []
        self.file_type_refs: list[str] = []
        self.named: list[tuple[str, str]] = []
        self.match = self._pairs()

    def _pairs(self) -> dict[int, int]:
        stack, out = [], {}
        for i, t in enumerate(self.t):
            if t.kind == "op" and t.text in _OPEN:
                stack.append(i)
            elif t.kind == "op" and t.text in _CLOSE:
                while stack:
                    j = stack.pop()
                    if _OPEN[self.t[j].text] == t.text:
                        out[j] = i
                        break
        for j in stack:
            out[j] = len(self.t) - 1
        return out

    # --- helpers
    def is_(self, i: int, *texts: str) -> bool:
        return i < self.n and (t := self.t[i]).text in texts and t.kind != "str"

    def name_at(self, i: int) -> str | None:
        return self.t[i].text if i < len(self.t) and self.t[i].kind == "id" else None

    def after(self, i: int) -> int:
        """The token after the bracket at i."""
        return self.match.get(i, i) + 1

    def past_generics(self, i: int) -> int:
        if not self.is_(i, "<"):
            return i
        depth = 0
        while i < len(self.t):
            text = self.t[i].text
            if text in _OPEN:
                i = self.after(i)
                continue
            depth += {"<": 1, ">": -1}.get(text, 0)
            i += 1
            if depth == 0 or text in (";",):
                return i
        return i

    def statement_end(self, i: int, limit: int) -> int:
        """One past the last token of a statement that starts at i."""
        start = i
        while i < limit:
            t = self.t[i]
            if t.text == ";" and t.kind == "op":
                return i + 1
            if i > start and t.line > self.t[i - 1].line and t.text not in _CONTINUES and self.t[i - 1].text not in _CONTINUES and self.t[i - 1].text != "{":
                return i
            i = self.after(i) if t.kind == "op" and t.text in _OPEN else i + 1
        return limit

    def signature(self, a: int, b: int) -> str:
        """Source of tokens a .. b - 1 on one line."""
        if b <= a:
            return ""
        text = re.sub(r"\s+", " ", self.s[self.t[a].at : self.t[b - 1].end]).strip()
        return re.sub(r"\s*(=>|\{)$", "", text)[:SIGNATURE]

    def look(self, a: int, b: int, calls: list, types: list) -> None:
        """Calls and type names between two tokens."""
        for i in range(a, min(b, len(self.t))):
            t = self.t[i]
            if t.kind != "id":
                continue
            before = self.t[i - 1].text if i else ""
            if before == "new":
                j = i
                while self.is_(j + 1, ".") and self.name_at(j + 2):
                    j += 2
                calls.append({"name": self.t[j].text, "receiver": self.t[j - 2].text if j > i else None, "is_new": True})
                continue
            nxt = i + 1
            if self.is_(nxt, "<") and before not in (":", "extends"):
                skip = self.past_generics(nxt)
                nxt = skip if self.is_(skip, "(") and skip - nxt < 40 else nxt
            if self.is_(nxt, "(") and t.text not in _NOT_CALLS and before not in ("function", "class"):
                receiver = None
                if before in (".", "?."):
                    r = self.t[i - 2] if i > 1 else None
                    if r is not None and r.kind == "id" and not (i > 2 and self.t[i - 3].text in (".", "?.")):
                        receiver = r.text
                if self.is_(self.after(nxt), "{") and before not in (".", "?.", "=", "(", ",", "return", "await"):
                    continue  # a method's own head
                calls.append({"name": t.text, "receiver": receiver, "is_new": False})
            elif before in (":", "<", "|", "&", "as", "extends", "implements", "satisfies", "is", "keyof", "=>") and t.text[0].isupper():
                types.append(t.text)
            elif before == "," and t.text[0].isupper() and nxt < len(self.t) and self.t[nxt].text in (">", ","):
                types.append(t.text)

    def add(self, s: Symbol) -> None:
        s.type_refs = list(dict.fromkeys(s.type_refs))[:TYPE_REFS]
        for old in self.symbols:
            if old.symbol_path == s.symbol_path:  # overloads and merged declarations
                old.end_line = max(old.end_line, s.end_line)
                old.exported |= s.exported
                old.doc = old.doc or s.doc
                for name in ("extends_names", "implements_names", "composition_names", "calls", "type_refs"):
                    getattr(old, name).extend(x for x in getattr(s, name) if x not in getattr(old, name))
                return
        self.symbols.append(s)

    # --- statements
    def scan(self, i: int = 0, limit: int | None = None, prefix: str = "", gate: bool = True, inside: bool = False) -> None:
        limit = len(self.t) if limit is None else limit
        while i < limit:
            begin, doc = i, self.t[i].doc
            while self.is_(i, "@"):  # decorators
                i += 2
                while self.is_(i, "."):
                    i += 2
                if self.is_(i, "("):
                    i = self.after(i)
            exported = default = False
            if self.is_(i, "export") and not inside or self.is_(i, "export"):
                done = self.export_list(i, limit)
                if done:
                    i = done
                    continue
                exported, i = True, i + 1
                if self.is_(i, "default"):
                    default, i = True, i + 1
            while self.is_(i, "declare", "abstract", "async") and i + 1 < limit and self.t[i + 1].kind == "id":
                i += 1
            if i < limit:
                doc = doc or self.t[i].doc
            i = max(self.declaration(begin, i, limit, prefix, exported and gate, default, doc), begin + 1)

    def export_list(self, i: int, limit: int) -> int | None:
        j = i + 1
        if self.is_(j, "type") and self.is_(j + 1, "{", "*"):
            j += 1
        if self.is_(j, "*"):
            j += 1
            alias = None
            if self.is_(j, "as"):
                alias, j = self.name_at(j + 1), j + 2
            if self.is_(j, "from"):
                names = [{"imported": "*", "exported": alias}] if alias else []
                self.reexports.append({"specifier": self.t[j + 1].text[1:-1], "star": alias is None, "names": names})
            return self.statement_end(j, limit)
        if self.is_(j, "{"):
            close = self.match[j]
            names = self.name_list(j + 1, close)
            if self.is_(close + 1, "from"):
                self.reexports.append({"specifier": self.t[close + 2].text[1:-1], "star": False, "names": [{"imported": a, "exported": b} for a, b in names]})
                return self.statement_end(close + 1, limit)
            self.named += names
            return close + 1 + self.is_(close + 1, ";")
        return None

    def name_list(self, i: int, end: int) -> list[tuple[str, str]]:
        out = []
        while i < end:
            if self.is_(i, "type") and self.name_at(i + 1) and not self.is_(i + 1, "as"):
                i += 1
            name = self.t[i].text.strip("\"'")
            other = name
            if self.is_(i + 1, "as") and i + 2 < end:
                other, i = self.t[i + 2].text.strip("\"'"), i + 2
            out.append((name, other))
            i += 1
            while i < end and not self.is_(i, ","):
                i += 1
            i += 1
        return out

    def declaration(self, begin: int, i: int, limit: int, prefix: str, exported: bool, default: bool, doc: str | None) -> int:
        word = self.t[i].text if i < limit and self.t[i].kind == "id" else ""
        if word == "import" and not self.is_(i + 1, "(", "."):
            return self.import_(i, limit)
        if word == "class":
            return self.class_(begin, i, limit, prefix, exported, default, doc)
        if word == "interface" and self.name_at(i + 1):
            return self.interface_(begin, i, limit, prefix, exported, default, doc)
        if word == "function":
            return self.function_(begin, i, limit, prefix, exported, default, doc)
        if word == "const" and self.is_(i + 1, "enum"):
            i, word = i + 1, "enum"
        if word == "enum" and self.name_at(i + 1):
            name, body = self.name_at(i + 1), i + 2
            end = self.match.get(body, body)
            members, k = 0, body + 1
            while k < end:
                members += 1
                while k < end and not self.is_(k, ","):
                    k = self.after(k) if self.t[k].text in _OPEN else k + 1
                k += 1
            self.add(Symbol(prefix + name, name, "enum", exported, self.t[begin].line, self.t[end].line, f"enum {name} ({members} members)", default_export=default, doc=doc_text(doc)))
            return end + 1
        if word == "type" and self.name_at(i + 1) and self.is_(self.past_generics(i + 2), "="):
            end = self.statement_end(i, limit)
            name = self.name_at(i + 1)
            s = Symbol(prefix + name, name, "type", exported, self.t[begin].line, self.t[end - 1].line, self.signature(i, end), default_export=default, doc=doc_text(doc))
            self.look(i + 2, end, [], s.type_refs)
            s.type_refs += [self.t[k].text for k in range(i + 3, end) if self.t[k].kind == "id" and self.t[k].text[0].isupper() and self.t[k - 1].text in ("=", "|", "&")]
            self.add(s)
            return end
        if word in ("namespace", "module") and (self.name_at(i + 1) or i + 1 < limit and self.t[i + 1].kind == "str"):
            j, parts = i + 1, []
            while j < limit and not self.is_(j, "{"):
                if self.t[j].kind == "id":
                    parts.append(self.t[j].text)
                j += 1
            if self.is_(j, "{"):
                self.scan(j + 1, self.match[j], prefix + "".join(p + "." for p in parts), exported, True)
                return self.match[j] + 1
            return j
        if word in ("const", "let", "var"):
            return self.variable_(begin, i, limit, prefix, exported, doc)
        if default:
            end = self.statement_end(i, limit)
            if self.name_at(i) and end - i <= 2:
                self.named.append((self.t[i].text, "default"))
            else:
                self.exports.append({"exported": "default", "symbol_path": None})
            self.look(i, end, self.file_calls, self.file_type_refs)
            return end
        if self.is_(i, "{"):
            self.look(i, self.after(i), self.file_calls, self.file_type_refs)
            return self.after(i)
        end = self.statement_end(i, limit)
        self.look(i, end, self.file_calls, self.file_type_refs)
        return end

    def import_(self, i: int, limit: int) -> int:
        end = self.statement_end(i, limit)
        j, only = i + 1, False
        if self.is_(j, "type") and not self.is_(j + 1, "from", ",") and (self.name_at(j + 1) or self.is_(j + 1, "{", "*")):
            only, j = True, j + 1
        bindings = []
        while j < end and not self.is_(j, "from") and self.t[j].kind != "str":
            if self.is_(j, "{"):
                bindings += [{"local": b, "imported": a} for a, b in self.name_list(j + 1, self.match[j])]
                j = self.after(j)
            elif self.is_(j, "*"):
                bindings.append({"local": self.t[j + 2].text, "imported": "*"})
                j += 3
            elif self.is_(j + 1, "=") and self.is_(j + 2, "require"):
                bindings.append({"local": self.t[j].text, "imported": "*"})
                j += 4
            elif self.t[j].kind == "id":
                bindings.append({"local": self.t[j].text, "imported": "default"})
                j += 1
            else:
                j += 1
        source = next((self.t[k].text[1:-1] for k in range(j, end) if self.t[k].kind == "str"), None)
        if source is not None:
            self.imports.append({"specifier": source, "bindings": bindings, "type_only": only})
        return end

    def heritage(self, i: int, end: int) -> tuple[list[str], list[str]]:
        """Names after extends and implements; of a.b.C the last part."""
        out: dict[str, list[str]] = {"extends": [], "implements": []}
        now = None
        while i < end:
            if self.is_(i, "extends", "implements"):
                now = self.t[i].text
                i += 1
            elif now and self.t[i].kind == "id":
                name = self.t[i].text
                while self.is_(i + 1, ".") and self.name_at(i + 2):
                    i += 2
                    name = self.t[i].text
                out[now].append(name)
                i = self.past_generics(i + 1)
                if self.is_(i, "("):
                    i = self.after(i)
            else:
                i += 1
        return out["extends"], out["implements"]

    def body_of(self, i: int, limit: int) -> int:
        """The opening brace that follows i outside of other brackets."""
        while i < limit and not self.is_(i, "{"):
            if self.is_(i, "<"):
                i = self.past_generics(i)
            else:
                i = self.after(i) if self.is_(i, "(", "[") else i + 1
        return i

    def class_(self, begin, i, limit, prefix, exported, default, doc) -> int:
        name = self.name_at(i + 1) if not self.is_(i + 1, "extends", "implements") else None
        body = self.body_of(i + 1, limit)
        end = self.match.get(body, min(body, limit - 1))
        name = name or "default"
        path = prefix + name
        ext, imp = self.heritage(self.past_generics(i + 2), body)
        s = Symbol(path, name, "class", exported, self.t[begin].line, self.t[end].line, self.signature(i, body), None, default, doc_text(doc), ext, imp)
        k = body + 1
        methods: list[Symbol] = []
        while k < end:
            k = self.member(k, end, s, methods)
        s.composition_names = list(dict.fromkeys(x for x in s.composition_names if x != name))
        self.add(s)
        for m in methods:
            self.add(m)
        return end + 1

    def member(self, i: int, end: int, owner: Symbol, methods: list[Symbol]) -> int:
        begin = i
        doc = self.t[i].doc
        while self.is_(i, "@"):
            i += 2
            if self.is_(i, "("):
                i = self.after(i)
        while i + 1 < end and self.t[i].text in _MODIFIERS | {"async", "get", "set"} and not self.is_(i + 1, "(", "=", ":", ";", "?", "<", "!"):
            i += 1
        if self.is_(i, "*"):
            i += 1
        doc = doc or (self.t[i].doc if i < end else None)
        if i >= end or self.t[i].kind not in ("id", "str", "num") and not self.is_(i, "["):
            if self.is_(i, "{"):  # static block
                self.look(i, self.after(i), owner.calls, owner.type_refs)
                return self.after(i)
            return i + 1
        name = self.t[i].text.strip("\"'").lstrip("#")
        j = self.after(i) if self.is_(i, "[") else i + 1
        if self.is_(j, "?", "!"):
            j += 1
        head = self.past_generics(j)
        if self.is_(head, "("):
            close = self.after(head)
            stop = close
            while stop < end and not self.is_(stop, "{", ";") and (self.t[stop].line == self.t[stop - 1].line or self.t[stop].text in _CONTINUES or self.t[stop - 1].text in _CONTINUES):
                stop = self.after(stop) if self.is_(stop, "(", "[") or self.is_(stop, "{") and self.is_(stop - 1, ":") else stop + 1
            last = self.match[stop] if self.is_(stop, "{") else stop - (not self.is_(stop, ";"))
            m = Symbol(f"{owner.symbol_path}.{name}", name, "method", owner.exported, self.t[begin].line, self.t[min(last, end - 1)].line, self.signature(i, stop), owner.symbol_path, False, doc_text(doc))
            self.look(head, last + 1, m.calls, m.type_refs)
            if name == "constructor":
                k = head + 1
                while k < close - 1:
                    if self.t[k].text in ("public", "private", "protected", "readonly"):
                        while k < close - 1 and not self.is_(k, ","):
                            if self.t[k].kind == "id" and self.t[k].text[0].isupper() and self.t[k - 1].text in (":", "|", "&", "<"):
                                owner.composition_names.append(self.t[k].text)
                            k = self.after(k) if self.t[k].text in _OPEN else k + 1
                    k += 1
            methods.append(m)
            return last + 1
        stop = self.statement_end(begin, end)
        equals = next((k for k in range(j, stop) if self.is_(k, "=")), None)
        value = equals + 1 if equals is not None else stop
        if self.is_(value, "async"):
            value += 1
        past = self.after(self.past_generics(value)) if self.is_(self.past_generics(value), "(") else value + 1
        arrow = next((k for k in range(past, min(stop, past + 40)) if self.is_(k, "=>")), None) if equals is not None and (self.is_(self.past_generics(value), "(") or self.is_(value + 1, "=>")) else None
        if arrow is not None or equals is not None and self.is_(value, "function"):
            m = Symbol(f"{owner.symbol_path}.{name}", name, "method", owner.exported, self.t[begin].line, self.t[stop - 1].line, self.signature(i, (arrow or value) + 1), owner.symbol_path, False, doc_text(doc))
            self.look(value, stop, m.calls, m.type_refs)
            methods.append(m)
            return stop
        types: list[str] = []
        calls: list[dict] = []
        self.look(j, stop, calls, types)
        owner.composition_names += types + [c["name"] for c in calls if c["is_new"]]
        owner.calls += calls
        owner.type_refs += types
        return stop

    def interface_(self, begin, i, limit, prefix, exported, default, doc) -> int:
        name = self.name_at(i + 1)
        body = self.body_of(i + 2, limit)
        end = self.match.get(body, min(body, limit - 1))
        ext, _ = self.heritage(self.past_generics(i + 2), body)
        s = Symbol(prefix + name, name, "interface", exported, self.t[begin].line, self.t[end].line, self.signature(i, body), None, default, doc_text(doc), ext)
        self.look(body, end, [], s.type_refs)
        self.add(s)
        return end + 1

    def function_(self, begin, i, limit, prefix, exported, default, doc) -> int:
        j = i + 1 + self.is_(i + 1, "*")
        name = self.name_at(j) or "default"
        head = self.past_generics(j + 1 if self.name_at(j) else j)
        close = self.after(head)
        body = close
        while body < limit and not self.is_(body, "{", ";") and (self.t[body].line == self.t[body - 1].line or self.t[body].text in _CONTINUES or self.t[body - 1].text in _CONTINUES):
            body = self.after(body) if self.is_(body, "(", "[") or self.is_(body + 1, "{") and self.is_(body, "{") else body + 1
            if self.is_(body, "{") and self.is_(body - 1, ":", "|", "&", "=>"):
                body = self.after(body)  # an object type as the result
        last = self.match[body] if self.is_(body, "{") else min(body, limit - 1)
        s = Symbol(prefix + name, name, "function", exported, self.t[begin].line, self.t[last].line, self.signature(i, body), None, default, doc_text(doc))
        self.look(head, last + 1, s.calls, s.type_refs)
        self.add(s)
        return last + 1

    def variable_(self, begin, i, limit, prefix, exported, doc) -> int:
        end = self.statement_end(i, limit)
        k = i + 1
        while k < end:
            stop = k
            while stop < end and not self.is_(stop, ",", ";"):
                stop = self.after(stop) if self.t[stop].text in _OPEN and self.t[stop].kind == "op" else (self.past_generics(stop) if self.is_(stop, "<") and stop == k + 1 else stop + 1)
            stop = min(stop, end)
            name = self.name_at(k)
            equals = next((x for x in range(k, stop) if self.is_(x, "=")), None)
            if equals is not None and self.is_(equals + 1, "require") and self.is_(equals + 2, "(") and self.t[equals + 3].kind == "str":
                names = self.name_list(k + 1, self.match[k]) if self.is_(k, "{") else [("*", name)]
                self.imports.append({"specifier": self.t[equals + 3].text[1:-1], "bindings": [{"local": name or b, "imported": "*"} for _, b in names], "type_only": False})
            elif name:
                value = equals + 1 if equals is not None else stop
                value += self.is_(value, "async")
                params = self.past_generics(value)
                arrow = next((x for x in range(self.after(params) if self.is_(params, "(") else params, stop) if self.is_(x, "=>")), None) if self.is_(params, "(") or self.is_(params + 1, "=>") else None
                function = arrow is not None or self.is_(value, "function")
                if function or exported:
                    cut = arrow + 1 if arrow is not None else (self.body_of(value, stop) if function else min(stop, k + 12))
                    s = Symbol(prefix + name, name, "function" if function else "variable", exported, self.t[begin].line, self.t[stop - 1].line, self.signature(i, cut), doc=doc_text(doc))
                    self.look(k + 1, stop, s.calls, s.type_refs)
                    self.add(s)
                else:
                    self.look(k, stop, self.file_calls, self.file_type_refs)
            else:
                self.look(k, stop, self.file_calls, self.file_type_refs)
            k = stop + 1
        return end

    def analysis(self) -> dict:
        self.scan()
        top = {s.symbol_path: s for s in self.symbols if s.parent is None}
        for local, name in self.named:
            if local in top:
                top[local].exported = True
                top[local].default_export |= name == "default"
                for m in self.symbols:
                    if m.parent == local:
                        m.exported = True
            self.exports.append({"exported": name, "symbol_path": local if local in top else None})
        for s in self.symbols:
            if s.exported and s.parent is None and not any(e["symbol_path"] == s.symbol_path for e in self.exports):
                self.exports.append({"exported": "default" if s.default_export else s.name, "symbol_path": s.symbol_path})
        ordered = sorted(self.symbols, key=lambda s: (s.start_line, s.symbol_path))[:SYMBOLS]
        return {
            "path": self.path, "language": "typescript" if self.path.endswith(TYPED) else "javascript", "loc": self.s.count("\n") + 1,
            "imports": self.imports, "reexports": self.reexports, "exports": self.exports, "symbols": [vars(s) for s in ordered],
            "file_calls": self.file_calls, "file_type_refs": list(dict.fromkeys(self.file_type_refs))[:TYPE_REFS],
        }


def analyze(path: str, content: str) -> dict | None:
    """The analysis of a file, or null if scanning fails."""
    try:
        return Scanner(path, content).analysis()
    except (IndexError, KeyError, RecursionError, ValueError):
        return None
