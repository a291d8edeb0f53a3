"""Tokens and syntax of Python 3 and JSON files."""

from __future__ import annotations

import re

from graphloom.llm.grammar import END, Grammar, Kinds
from graphloom.llm.scripts import SyntaxFault

#: The words of the language.
RESERVED = "and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
SOFT = ["match", "case", "type"]
LITERALS = ["None", "True", "False"]
_OPS = "... **= //= >>= <<= ** // >> << <= >= == != -> := += -= *= /= %= @= &= |= ^= ( ) [ ] { } , : . ; = + - * / % @ & | ^ ~ < >".split()

_PREFIX = r"(?:[rRbBuUfF]|[bB][rR]|[rR][bB]|[fF][rR]|[rR][fF])?"
_FORMAT = r"(?:[fF][rR]?|[rR][fF])"
_INNER = r"\{(?:[^{}\n]|\{(?:[^{}\n]|\{[^{}\n]*\})*\})*\}"
_STRING = (
    rf"{_PREFIX}(?:\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*''')"
    rf"|{_FORMAT}(?:\"(?:[^\"\\\n{{]|\\[\s\S]|\{{\{{|{_INNER})*\"|'(?:[^'\\\n{{]|\\[\s\S]|\{{\{{|{_INNER})*')"
    rf"|{_PREFIX}(?:\"(?:[^\"\\\n]|\\[\s\S])*\"(?!\"\")|'(?:[^'\\\n]|\\[\s\S])*'(?!''))"
)
_NUMBER = r"(?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)"
_NUM = re.compile(_NUMBER)
_LEADING = re.compile(r"0+[1-9_][\d_]*$")
_TOKENS = re.compile(rf"{_STRING}|#[^\n]*|\\\n|\n[ \t\f]*|[^\W\d]\w*|\d[\d_]*\.(?=\.[^\W\d])|(?:\d|\.\d)(?:[\w.]|(?<=[eE])[+-](?=\d))*|{'|'.join(re.escape(o) for o in sorted(_OPS, key=len, reverse=True))}|\S")
#: Escapes that a literal (of text, of bytes) cannot hold.
_BAD_ESCAPE = [re.compile(r"(?<!\\)(?:\\\\)*\\" + after) for after in (r"(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4})|U(?!00(?:0[0-9a-fA-F]|10)[0-9a-fA-F]{4})|N(?!\{[^{}]+\}))", r"x(?![0-9a-fA-F]{2})")]
_FIELD = re.compile(r"\{\{|\}\}|" + _INNER.replace(r"\n", "") + "|[{}]")
_NAME = re.compile(r"\s*[A-Za-z_][\w.]*\s*(?:![rsa])?(?::[^{}]*)?\Z")
_CONVERSION = re.compile(r"![rsa]\s*(?:[:}]|\Z)")
_CLOSE = {"}": ("{", "B"), ")": ("(", "P"), "]": ("[", "S")}


class Pythons:
    """Parser of Python 3 files: cells for brackets, a stack for indentation."""

    def __init__(self) -> None:
        self.g = g = Grammar("python.peg", sets={"SOFT": SOFT})
        char = g.kinds.char
        self._fixed = {w: char(w) for w in [*RESERVED, *SOFT, *_OPS]} | {w: "l" for w in LITERALS}
        outer = self

        class ByToken(dict):
            def __missing__(self, token: str) -> str:
                k = outer._kind(token)
                if len(self) < 300_000:
                    self[token] = k
                return k

        self._kinds = ByToken(self._fixed)
        c = self._fixed
        self._first = {c[w]: w for w in ["if", "while", "for", "try", "with", "def", "class", "async", "elif", "else", "except", "finally", "match", "case", "@"]}
        self._repeat = re.compile("((?:[^" + c[","] + "]+" + re.escape(c[","]) + r"))\1+")
        self._colon = c[":"]
        self._cells: dict[tuple[str, str], str] = {}
        self._lines: dict[str, tuple[str, bool] | None] = {}

    def _kind(self, t: str) -> str:
        f = t[0]
        if f.isdigit() or f == "." and len(t) > 1:
            ok = _NUM.fullmatch(t) and not (_LEADING.match(t) and "." not in t and "e" not in t.lower() and t[-1] not in "jJ")
            return "9" if ok else "\0"
        if t[-1] in "\"'" and len(t) > 1:
            head = re.match(r"[A-Za-z]*", t).group().lower()
            if "b" in head and not t.isascii() or "\\" in t and "r" not in head and _BAD_ESCAPE[("b" in head)].search(t):
                return "\0"
            return "b" if "b" in head else "s" if "f" not in head or self._fields(t) else "\0"
        return "i" if t.isidentifier() else "\0"

    def _fields(self, token: str) -> bool:
        """Whether the replacement fields of an f-string parse."""
        body = token.lstrip("rRbBfFuU")
        quote = body[:3] if body[:3] in ('"""', "'''") else body[:1]
        for m in _FIELD.finditer(body[len(quote) : -len(quote)]):
            if m.group() in ("{", "}") and "\\N" not in token:
                return False
            inner = m.group()[1:-1]
            if m.group() in ("{{", "}}") or _NAME.match(inner):
                continue
            for end in [*(n for n, ch in enumerate(inner) if ch in ":!="), len(inner)]:
                if inner[end : end + 1] == "!" and not _CONVERSION.match(inner, end):
                    continue
                if self.fault("(" + inner[:end] + ")") is None and inner[:end].strip():
                    break
            else:
                return False
        return True

    def _cell(self, bracket: str, content: str) -> str:
        known = self._cells.get((bracket, content))
        if known is None:
            if len(self._cells) > 150_000:
                self._cells.clear()
            mask = self.g.mask(bracket, self._repeat.sub(r"\1", content) + END)
            known = self._cells[bracket, content] = chr(Kinds.BASES[bracket] + mask) if mask else ""
        return known

    def _line(self, s: str) -> tuple[str, bool] | None:
        """What a logical line is, and whether a block has to follow; None if it does not parse."""
        if s in self._lines:
            return self._lines[s]
        word, rule, text = self._first.get(s[0]), self.g.rule, s + END
        found = None
        if word in ("match", "case") and rule[word](text, 0) >= 0:
            found = (word, s[-1] == self._colon)
        elif word in ("elif", "else", "except", "finally"):
            if rule[word](text, 0) >= 0:
                found = (word, s[-1] == self._colon)
        elif word == "@":
            if rule["decorator"](text, 0) >= 0:
                found = ("@", False)
        elif word and word not in ("match", "case"):
            if rule["header"](text, 0) >= 0:
                kind = "def" if word in ("def", "class") or word == "async" and s[1] == self._fixed["def"] else "loop" if word in ("for", "while") or word == "async" and s[1] == self._fixed["for"] else word
                found = (kind, s[-1] == self._colon)
        if found is None and (word is None or word in ("match", "case")) and rule["line"](text, 0) >= 0:
            found = ("simple", False)
        if len(self._lines) > 150_000:
            self._lines.clear()
        self._lines[s] = found
        return found

    def fault(self, text: str) -> SyntaxFault | None:
        """The first unrecoverable error of a file, or None if it parses."""
        text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
        if "\0" in text:
            return SyntaxFault(text.index("\0"), "null character")
        tokens = _TOKENS.findall(text if text[:1] not in " \t" else "\n" + text)
        kinds = self._kinds
        parts: list[str] = []
        stack: list[tuple[list[str], str, int]] = []
        blocks: list[list] = [[0, None, False, 0]]  # indentation, last clause, whether it holds cases, indentation with tabs of one column
        expect, cases, indent, begin = False, False, "", 0
        n = 0

        def at(k: int) -> int:
            place = 0
            for t in tokens[:k]:
                found = text.find(t, place)
                place = found + len(t) if found >= 0 else place
            return place

        def close(line: str, k: int) -> SyntaxFault | None:
            nonlocal expect, cases
            blanks = indent[indent.rfind("\f") + 1 :]
            width, narrow = len(blanks.expandtabs(8)), len(blanks)
            found = self._line(line)
            if expect:
                if width <= blocks[-1][0]:
                    return SyntaxFault(at(k), "expected an indented block")
                if narrow <= blocks[-1][3]:
                    return SyntaxFault(at(k), "tabs and blanks mixed")
                blocks.append([width, None, cases, narrow])
            elif width > blocks[-1][0]:
                return SyntaxFault(at(k), "unexpected indent")
            while width < blocks[-1][0]:
                if blocks.pop()[1] in ("try", "@"):
                    return SyntaxFault(at(k), "a clause is missing")
            if width != blocks[-1][0]:
                return SyntaxFault(at(k), "unindent matches no level")
            if narrow != blocks[-1][3]:
                return SyntaxFault(at(k), "tabs and blanks mixed")
            if found is None:
                return SyntaxFault(at(k), "no statement derives this line")
            kind, expect = found
            if kind == "case" and not blocks[-1][2]:
                # outside a match, case is a name
                kind, expect = ("simple", False)
                if self.g.rule["line"](line + END, 0) < 0:
                    return SyntaxFault(at(k), "case outside match")
            if blocks[-1][2] and kind != "case":
                return SyntaxFault(at(k), "expected case")
            last = blocks[-1][1]
            follows = {"elif": ("if",), "else": ("if", "loop", "except"), "except": ("try", "except"), "finally": ("try", "except", "tryelse")}
            if kind in follows:
                if last not in follows[kind]:
                    return SyntaxFault(at(k), f"{kind} follows nothing")
                last = {"elif": "if", "except": "except", "finally": None, "else": "tryelse" if last == "except" else None}[kind]
            else:
                if last == "try" or last == "@" and kind not in ("def", "@"):
                    return SyntaxFault(at(k), "a clause is missing")
                last = kind if kind in ("if", "loop", "try", "@") else None
            blocks[-1][1] = last
            cases = kind == "match"
            return None

        for n, t in enumerate(tokens):
            f = t[0]
            if f == "\n":
                if not stack:
                    if parts:
                        bad = close("".join(parts), begin)
                        if bad:
                            return bad
                        parts = []
                    indent, begin = t[1:], n + 1
                continue
            if f == "#" or f == "\\" and len(t) == 2:
                continue
            if t in _BRACKETS:
                pair = _CLOSE.get(t)
                if pair is None:
                    stack.append((parts, t, n))
                    parts = []
                    continue
                if not stack or stack[-1][1] != pair[0]:
                    return SyntaxFault(at(n), f"unexpected {t}")
                content = "".join(parts)
                parts, _, start = stack.pop()
                cell = self._cell(pair[1], content)
                if not cell:
                    return SyntaxFault(at(start), f"nothing derives the content of {pair[0]}")
                parts.append(cell)
            else:
                parts.append(kinds[t])
        if stack:
            return SyntaxFault(at(stack[-1][2]), f"{stack[-1][1]} is never closed")
        if parts:
            bad = close("".join(parts), begin)
            if bad:
                return bad
        if expect or any(b[1] in ("try", "@") for b in blocks):
            return SyntaxFault(len(text), "unexpected end of file")
        return None


_BRACKETS = frozenset("{}()[]")
_JSON = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|true|false|null|[{}\[\],:]|[ \t\n\r]+|[\s\S]', re.ASCII)


class Jsons:
    """Parser of strict JSON files."""

    def __init__(self) -> None:
        self.g = g = Grammar("json.peg", sets={})
        self._fixed = {",": g.kinds.char(","), ":": g.kinds.char(":"), "true": "l", "false": "l", "null": "l"}
        self._repeat = re.compile("((?:[^" + self._fixed[","] + "]+" + re.escape(self._fixed[","]) + r"))\1+")

    def fault(self, text: str) -> SyntaxFault | None:
        """The first unrecoverable error of a file, or None if it parses."""
        parts: list[str] = []
        stack: list[tuple[list[str], str, int]] = []
        place = 0
        for t in _JSON.findall(text):
            f = t[0]
            if f in " \t\n\r":
                pass
            elif t in "{[":
                stack.append((parts, t, place))
                parts = []
            elif t in "}]":
                if not stack or stack[-1][1] != _CLOSE[t][0]:
                    return SyntaxFault(place, f"unexpected {t}")
                content = self._repeat.sub(r"\1", "".join(parts))
                parts, _, start = stack.pop()
                bracket = _CLOSE[t][1]
                mask = self.g.mask(bracket, content + END)
                if not mask:
                    return SyntaxFault(start, f"nothing derives the content of {_CLOSE[t][0]}")
                parts.append(chr(Kinds.BASES[bracket] + mask))
            elif t in self._fixed:
                parts.append(self._fixed[t])
            elif f == '"' and len(t) > 1:
                parts.append("s")
            elif f == "-" and len(t) > 1 or "0" <= f <= "9":
                parts.append("9")
            else:
                return SyntaxFault(place, "unexpected character")
            place += len(t)
        if stack:
            return SyntaxFault(stack[-1][2], f"{stack[-1][1]} is never closed")
        return None if self.g.rule["document"]("".join(parts) + END, 0) >= 0 else SyntaxFault(0 if not parts else len(text), "no document derives this text")
