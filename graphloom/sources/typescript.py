"""From TypeScript texts to rows: symbols, imports, calls and framework edges of a file.

A shallow reader: tokens, matched brackets and the declarations at a module's top
level. Whatever needs other files (import targets, call targets, placeholders) is
left to joins over the rows of all files.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

_TOKEN = re.compile(
    r"(?P<doc>/\*\*[\s\S]*?\*/)|(?P<note>/\*[\s\S]*?\*/|//[^\n]*)|(?P<str>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')|(?P<tpl>`(?:[^`\\]|\\[\s\S])*`)"
    r"|(?P<num>\d[\w.]*)|(?P<word>[^\W\d][\w$]*|\$[\w$]*)|(?P<op>=>|\?\.|&&|\|\||\?\?|\.\.\.|===|!==|==|!=|<=|>=|\S)"
)
_BRANCHES = frozenset(["if", "for", "while", "case", "catch", "do", "?", "&&", "||"])
_NOT_CALLED = frozenset("if for while switch catch function return typeof new await async super import constructor".split())
_MODIFIERS = frozenset("public private protected static readonly abstract override async get set declare".split())
_METHODS = frozenset(["GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS"])
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, frozenset(")]}")


@dataclass
class Token:
    kind: str
    text: str
    line: int
    pos: int
    mate: int = -1


def read_tokens(text: str) -> list[Token]:
    """Tokens with lines and matched brackets; comments are kept only as documentation."""
    out, line, last = [], 1, 0
    for m in _TOKEN.finditer(text):
        line += text.count("\n", last, m.start())
        last = m.start()
        if m.lastgroup != "note":
            out.append(Token(m.lastgroup, m.group(), line, m.start()))
    stack: list[int] = []
    for n, t in enumerate(out):
        if t.kind == "op" and t.text in _OPEN:
            stack.append(n)
        elif t.kind == "op" and t.text in _CLOSE and stack and _OPEN[out[stack[-1]].text] == t.text:
            out[stack[-1]].mate = n
            t.mate = stack.pop()
    return out


def complexity(tokens: list[Token], start: int, end: int) -> str:
    """simple, moderate (from 6 branches) or complex (from 16)."""
    n = sum(t.text in _BRANCHES for t in tokens[start : end + 1] if t.kind in ("word", "op"))
    return "complex" if n >= 16 else "moderate" if n >= 6 else "simple"


def documentation(doc: str | None, form: str) -> str:
    """The JSON documentation of a declaration."""
    out = {"version": 1, "hasJsDoc": doc is not None, "description": None, "params": [], "returns": None, "tags": [], "declarationForm": form}
    if doc is None:
        return json.dumps(out)
    lines = [re.sub(r"^\s*\*? ?", "", x).strip() for x in doc[3:-2].replace("\r\n", "\n").split("\n")]
    parts = re.split(r"(?:^|\n)@", "\n".join(lines).strip())
    out["description"] = parts[0].strip() or None
    for part in parts[1:]:
        tag, _, rest = part.partition(" ")
        rest = re.sub(r"^\{[^}]*\}\s*", "", rest.strip())
        if tag in ("param", "arg", "argument"):
            name, _, text = rest.partition(" ")
            out["params"].append({"name": name.strip("[]"), "description": text.lstrip("- ").strip()})
        elif tag in ("returns", "return"):
            out["returns"] = rest
        else:
            out["tags"].append({"name": tag, "text": rest, "subject": None})
    return json.dumps(out, ensure_ascii=False)


class FileReader:
    """Collects the rows of one file."""

    def __init__(self, path: str, text: str) -> None:
        self.path, self.text = path, text
        self.t = read_tokens(text)
        self.rows: list[dict] = []
        self.owners: list[tuple[int, int, str, str]] = []  # first and last token, id, name
        self.seen: dict[tuple[str, str], int] = {}

    def node(self, kind: str, name: str, first: int, last: int, tags: list[str], doc: str | None, form: str, parent: str | None = None) -> str:
        t = self.t
        line = t[first].line
        family = (kind, name)
        self.seen[family] = self.seen.get(family, 0) + 1
        unique = name if self.seen[family] == 1 else f"{name}@{line}"
        own = f"{kind}:{self.path}:{unique}"
        self.rows.append({"rel": "node", "id": own, "type": kind, "name": unique, "line_start": line, "line_end": t[last].line, "complexity": complexity(t, first, last), "tags": json.dumps(tags) if tags else None, "documentation": documentation(doc, form)})
        self.edge("contains", parent or f"file:{self.path}", own)
        if kind == "function":
            self.owners.append((first, last, own, unique))
        return own

    def edge(self, kind: str, source: str, target: str, **metadata) -> None:
        self.rows.append({"rel": "edge", "source": source, "target": target, "type": kind, "metadata": json.dumps(metadata, ensure_ascii=False) if metadata else None})

    def _end(self, n: int) -> int:
        """The last token of the statement that starts at n."""
        t = self.t
        while n < len(t):
            if t[n].mate > n:
                closing = t[n].mate
                after = t[closing + 1] if closing + 1 < len(t) else None
                if t[n].text == "{" and (after is None or after.line > t[closing].line and after.text not in (".", "?.", ",", "=", "(") or after.text == ";"):
                    return closing + 1 if after is not None and after.text == ";" else closing
                n = closing + 1
                continue
            if t[n].text == ";":
                return n
            n += 1
        return len(t) - 1

    def _parameters(self, at: int, owner: str) -> None:
        """param nodes of a parameter list; destructured ones give their names."""
        t, depth, expect = self.t, 0, True
        for n in range(at + 1, t[at].mate):
            x = t[n]
            if x.text in "([{<":
                depth += 1
            elif x.text in ")]}>":
                depth -= 1
            elif x.text == "," and depth <= 1:
                expect = True
            elif x.kind == "word" and expect and x.text not in _MODIFIERS and (depth == 0 or t[n + 1].text in (",", "}", "]", "=", ":")):
                own = f"param:{self.path}:{owner.rsplit(':', 1)[-1]}:{x.text}"
                self.rows.append({"rel": "node", "id": own, "type": "param", "name": x.text, "line_start": x.line, "line_end": x.line, "complexity": "simple", "tags": None, "documentation": None})
                self.edge("param_flow", own, owner)
                expect = depth > 0 and t[n + 1].text == ","

    def _class(self, at: int, name: str, tags: list[str], doc: str | None) -> int:
        t = self.t
        body = next((n for n in range(at, len(t)) if t[n].text == "{" and t[n].mate > 0), -1)
        if body < 0:
            return len(t)
        own = self.node("class", name, at, t[body].mate, tags, doc, "class")
        head = t[at:body]
        for n, x in enumerate(head):
            if x.text == "extends" and n + 1 < len(head):
                self.edge("extends", own, f"class:*:{head[n + 1].text}")
            elif x.text == "implements":
                depth = 0
                for m, y in enumerate(head[n + 1 :]):
                    depth += (y.text == "<") - (y.text == ">")
                    if y.kind == "word" and depth == 0 and (m == 0 or head[n + m].text == ","):
                        self.edge("implements", own, f"interface:*:{y.text}")
        n, member_doc, mods = body + 1, None, []
        while n < t[body].mate:
            x = t[n]
            if x.kind == "doc":
                member_doc = x.text
            elif x.text in _MODIFIERS and t[n + 1].kind == "word":
                mods.append(x.text)
            elif x.kind == "word" and t[n + 1].text == "(" and t[n + 1].mate > 0:
                block = t[n + 1].mate + 1
                while block < t[body].mate and t[block].text not in ("{", ";"):
                    block = t[block].mate + 1 if t[block].mate > block else block + 1
                if block < t[body].mate and t[block].text == "{" and t[block].mate > 0:
                    kinds = ["internal" if {"private", "protected"} & set(mods) else "public"] + (["constructor"] if x.text == "constructor" else []) + [g for g in tags if g == "exported"]
                    self.node("function", f"{name}.{x.text}", n, t[block].mate, kinds, member_doc, "method", own)
                    n = t[block].mate
                else:
                    n = block
                member_doc, mods = None, []
            elif x.text == ";" or x.mate > n:
                n = x.mate if x.mate > n else n
                if x.text == ";":
                    member_doc, mods = None, []
            n += 1
        return t[body].mate + 1

    def _parents(self, at: int, last: int, own: str) -> None:
        """An extends edge to each parent of an interface."""
        t, depth, listed = self.t, 0, False
        for n in range(at, last):
            x = t[n]
            if x.text == "{" and depth == 0:
                return
            depth += (x.text == "<") - (x.text == ">")
            if depth == 0 and x.text == "extends":
                listed = True
            elif listed and depth == 0 and x.kind == "word" and t[n - 1].text in ("extends", ","):
                self.edge("extends", own, f"interface:*:{x.text}")

    def _import(self, at: int, declaration: int) -> int:
        t = self.t
        end = at + 1
        while end < len(t) and t[end].kind != "str" and t[end].text not in (";", "import"):
            end += 1
        if end >= len(t) or t[end].kind != "str":
            return at + 1
        specifier = t[end].text[1:-1]
        self.rows.append({"rel": "import", "specifier": specifier, "declaration": declaration})
        n, place = at + 1, 0
        if t[n].text == "type":
            n += 1
        if t[n].kind == "word" and t[n].text != "from" and t[n + 1].text in ("from", ","):
            self.rows.append({"rel": "binding", "specifier": specifier, "declaration": declaration, "binding": 0, "kind": "default", "local": t[n].text, "imported": "default"})
        for m in range(n, end):
            if t[m].text == "*" and t[m + 1].text == "as" and t[m + 2].kind == "word":
                self.rows.append({"rel": "binding", "specifier": specifier, "declaration": declaration, "binding": 0, "kind": "namespace", "local": t[m + 2].text, "imported": "*"})
            elif t[m].text == "{" and t[m].mate > 0:
                names = [x.text for x in t[m + 1 : t[m].mate] if x.text != "type"]
                for group in " ".join(names).split(","):
                    words = group.split()
                    if words:
                        self.rows.append({"rel": "binding", "specifier": specifier, "declaration": declaration, "binding": place, "kind": "named", "local": words[-1], "imported": words[0]})
                        place += 1
        return end + 1

    def read(self) -> list[dict]:
        t = self.t
        lines = self.text.count("\n") + 1
        self.rows.append({"rel": "node", "id": f"file:{self.path}", "type": "file", "name": self.path.rsplit("/", 1)[-1], "line_start": 1, "line_end": lines, "complexity": "simple", "tags": None, "documentation": None})
        n, doc, tags, declaration = 0, None, [], 0
        while n < len(t):
            x = t[n]
            nxt = t[n + 1] if n + 1 < len(t) else None
            if x.kind == "doc":
                doc, n = x.text, n + 1
                continue
            if x.text in ("export", "declare", "abstract", "async", "default") and nxt is not None:
                tags = tags + ["exported"] if x.text == "export" else tags + ["default"] if x.text == "default" else tags
                n += 1
                continue
            shown = [g for g in tags if g == "exported"]
            if x.text == "import" and nxt is not None and nxt.text not in ("(", "."):
                n = self._import(n, declaration)
                declaration += 1
            elif x.text == "function" and nxt is not None:
                at = n + 2 if nxt.text == "*" else n + 1
                name = t[at].text if t[at].kind == "word" else "default" if "default" in tags else "anonymous"
                paren = next((m for m in range(at, len(t)) if t[m].text == "(" and t[m].mate > 0), -1)
                last = self._end(t[paren].mate + 1) if paren >= 0 else len(t) - 1
                own = self.node("function", name, n, last, shown, doc, "function")
                if paren >= 0:
                    self._parameters(paren, own)
                n = last + 1
            elif x.text == "class" and nxt is not None:
                n = self._class(n, nxt.text if nxt.kind == "word" and nxt.text != "extends" else "default", shown, doc)
            elif x.text in ("interface", "type") and nxt is not None and nxt.kind == "word" and (x.text == "interface" or t[min(n + 2, len(t) - 1)].text in ("=", "<")):
                last = self._end(n)
                own = self.node("interface" if x.text == "interface" else "type_alias", nxt.text, n, last, shown, doc, x.text)
                if x.text == "interface":
                    self._parents(n + 2, last, own)
                n = last + 1
            elif x.text in ("const", "let", "var") and nxt is not None:
                last = self._end(n)
                self._variable(n, last, shown, doc)
                n = last + 1
            else:
                n = max(n + 1, self._end(n) + 1)
            doc, tags = None, []
        self._uses()
        self._routes()
        for row in self.rows:
            row["path"] = self.path
        return self.rows

    def _arrow_after(self, n: int, last: int) -> bool:
        """Whether an arrow follows a parameter list, behind a return type of any length."""
        t = self.t
        if n > last or t[n].text != ":":
            return n <= last and t[n].text == "=>"
        while n <= last and t[n].text != ";":
            if t[n].text == "=>":
                return True
            n = t[n].mate + 1 if t[n].mate > n else n + 1
        return False

    def _variable(self, first: int, last: int, tags: list[str], doc: str | None) -> None:
        t = self.t
        if t[first + 1].kind != "word":
            return
        name = t[first + 1].text
        eq = next((m for m in range(first + 2, last) if t[m].text == "="), -1)
        if eq < 0:
            return
        at = eq + 2 if t[eq + 1].text == "async" and eq + 2 <= last else eq + 1
        arrow = t[at].text == "(" and t[at].mate > 0 and self._arrow_after(t[at].mate + 1, last)
        if arrow or t[at].text == "function" or t[at].kind == "word" and t[min(at + 1, last)].text == "=>":
            own = self.node("function", name, first, last, tags, doc, "arrow" if t[at].text != "function" else "function-expression")
            if arrow:
                self._parameters(at, own)
            return
        called = "".join(x.text for x in t[at : at + 3])
        if called.startswith(("defineTable", "z.object")):
            brace = next((m for m in range(at, last + 1) if t[m].text == "{" and t[m].mate > 0), -1)
        else:
            brace = at if t[at].text == "{" and "exported" in tags and t[at].mate > 0 else -1
        if brace < 0:
            return
        own = f"schema:{self.path}:{name}"
        self.rows.append({"rel": "node", "id": own, "type": "schema", "name": name, "line_start": t[first].line, "line_end": t[last].line, "complexity": "simple", "tags": None, "documentation": None})
        self.edge("contains", f"file:{self.path}", own)
        n = brace + 1
        while n < t[brace].mate:
            if t[n].kind in ("word", "str") and t[n + 1].text == ":":
                label = t[n].text.strip("'\"")
                field = f"field:{self.path}:{name}.{label}"
                self.rows.append({"rel": "node", "id": field, "type": "field", "name": f"{name}.{label}", "line_start": t[n].line, "line_end": t[n].line, "complexity": "simple", "tags": None, "documentation": None})
                self.edge("has_field", own, field)
                n += 2
                while n < t[brace].mate and t[n].text != ",":
                    if t[n].text == "id" and t[n - 1].text == "." and t[n + 2].kind == "str":
                        self.edge("references", field, f"schema:*:{t[n + 2].text[1:-1]}")
                    n = t[n].mate + 1 if t[n].mate > n and t[n].text != "(" else n + 1
            n += 1

    def _owned(self) -> list[tuple[str, str] | None]:
        """The innermost function around each token, by one sweep over sorted intervals."""
        out: list[tuple[str, str] | None] = [None] * len(self.t)
        waiting = sorted(self.owners, key=lambda o: (-o[0], o[1]))
        stack: list[tuple[int, int, str, str]] = []
        for n in range(len(self.t)):
            while waiting and waiting[-1][0] <= n:
                stack.append(waiting.pop())
            while stack and stack[-1][1] < n:
                stack.pop()
            out[n] = stack[-1][2:] if stack else None
        return out

    def _arguments(self, at: int) -> list[list[str]]:
        """The tokens of each argument of a call whose bracket opens at at."""
        t, out, n = self.t, [[]], at + 1
        while n < t[at].mate:
            if t[n].text == ",":
                out.append([])
                n += 1
                continue
            stop = t[n].mate if t[n].mate > n else n
            out[-1] += [x.text for x in t[n : stop + 1]]
            n = stop + 1
        return out

    def _uses(self) -> None:
        """Calls, hooks, queries, rendered components and literals inside functions."""
        t = self.t
        heads, owner = {o[0] for o in self.owners}, self._owned()
        for n in range(1, len(t)):
            x = t[n]
            if x.text == "<" and n + 1 < len(t) and t[n + 1].kind == "word" and t[n + 1].text[:1].isupper() and (t[n - 1].text in ("(", "return", ">", "}", "=>", "?", ":", "&&", "||", "{", "[", ",") or t[n - 1].kind == "word" and t[n - 1].line < x.line):
                own = owner[n]
                if own:
                    self.edge("renders", own[0], f"function:*:{t[n + 1].text}")
                continue
            if x.text != "(" or t[n - 1].kind != "word" or t[n - 1].text in _NOT_CALLED:
                if x.kind == "tpl" and t[n - 1].text == "sql" and owner[n]:
                    self.edge("calls", owner[n][0], "function:*:sql", query_template=x.text[1:-1])
                continue
            if n >= 2 and t[n - 2].text in ("function", "new") or x.mate > 0 and x.mate + 1 < len(t) and t[x.mate + 1].text == "{" and not (n >= 2 and t[n - 2].text == "."):
                continue
            own = owner[n]
            if not own or n - 1 in heads:
                continue
            parts, m = [t[n - 1].text], n - 2
            while m > 0 and t[m].text in (".", "?.") and t[m - 1].kind == "word":
                parts.insert(0, t[m - 1].text)
                m -= 2
            called = parts[-1]
            if called in ("useQuery", "useSuspenseQuery", "useMutation") and len(parts) == 1:
                names = [w for w in "".join(self._arguments(n)[0]).split("(")[0].split(".") if w][1:]
                if names:
                    self.edge("mutates" if called == "useMutation" else "queries", own[0], f"function:*:{'.'.join(names)}")
                    continue
            if len(parts) == 1 and re.match(r"use[A-Z]", called):
                self.edge("uses_hook", own[0], f"function:*:{called}")
                continue
            first = t[n + 1] if n + 1 < len(t) else x
            if (called == "fetch" and len(parts) == 1 or parts[-2:] == ["router", "push"]) and first.kind == "str":
                self.edge("calls", own[0], f"function:*:{'.'.join(parts)}", string_literal=first.text[1:-1])
                continue
            if called == "eq":
                sides = self._arguments(n)
                if len(sides) > 1 and sides[0] and sides[1]:
                    self.edge("calls", own[0], "function:*:eq", column_ref="".join(sides[0]), value_ref="".join(sides[1]))
                    continue
            self.rows.append({"rel": "call", "owner": own[0], "owner_name": own[1], "expression": ".".join(parts), "call_start": t[m + 1].pos, "line_start": x.line})

    def _routes(self) -> None:
        """Routes of file-based routers and of registrations by method."""
        m = re.search(r"(?:^|/)app(/.*)?/(route|page)\.[jt]sx?$", self.path)
        if m:
            parts = [p for p in (m[1] or "").split("/") if p and not re.fullmatch(r"\(.*\)", p)]
            place = "/" + "/".join(re.sub(r"^\[(?:\.\.\.)?(.+?)\]$", r":\1", p.replace("[[", "[").replace("]]", "]")) for p in parts)
            tags = [f"param:{p[1:]}" for p in place.split("/") if p.startswith(":")]
            for row in list(self.rows):
                if m[2] == "route" and row["rel"] == "node" and row["type"] == "function" and row["name"] in _METHODS:
                    self._route(f"{row['name']} {place}", row["line_start"], tags, row["id"])
            if m[2] == "page":
                self._route(f"GET {place}", None, tags, None)
        t = self.t
        for n in range(2, len(t) - 2):
            if t[n].text == "(" and t[n - 1].text in ("get", "post", "put", "delete", "patch") and t[n - 2].text == "." and t[n + 1].kind == "str" and t[n + 2].text == "," and t[n + 1].text[1:2] == "/":
                self._route(f"{t[n - 1].text.upper()} {t[n + 1].text[1:-1]}", t[n].line, ["mode:registered"], None)
            elif t[n].text == "(" and t[n - 1].text in ("query", "mutation") and t[n - 2].text == "." and n >= 3 and t[n - 3].text == "router":
                label = t[n + 1].text[1:-1] if t[n + 1].kind == "str" else "anonymous"
                self._route(f"{'QUERY' if t[n - 1].text == 'query' else 'MUTATION'} {label}", t[n].line, ["mode:rpc"], None)

    def _route(self, name: str, line: int | None, tags: list[str], handler: str | None) -> None:
        own = f"route:{self.path}:{name}"
        self.rows.append({"rel": "node", "id": own, "type": "route", "name": name, "line_start": line, "line_end": line, "complexity": "simple", "tags": json.dumps(tags) if tags else None, "documentation": None})
        self.edge("contains", f"file:{self.path}", own)
        if handler:
            self.edge("calls", own, handler)


def read_file(path: str, text: str) -> list[dict]:
    """All rows of one file, in source order; an unreadable text gives its file node only."""
    return FileReader(path, text.removeprefix("﻿")).read()
