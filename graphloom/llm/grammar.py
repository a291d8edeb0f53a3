"""Chart parsing over bracket groups, driven by bundled grammars.

A grammar file is a list of rules over token kinds, written as a parsing expression
grammar. Every kind is one character, so a token stream is a string. Rules compile
to prediction tables: for each choice, a table from the next kind to the
alternatives that can start with it. Bracket groups are chart cells, filled from the
inside out: the content of a group is a string in which inner groups are single
characters that say which nonterminals they derive, so a cell is known by its
string, and equal strings are parsed once.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from pathlib import Path

_HERE = Path(__file__).parent / "grammars"
_TOKEN = re.compile(r"'[^']*'|[&!]\(|[()|*+?]|[A-Z]\.[a-z]+|[A-Z]+|[a-z]+")

Parser = Callable[[str, int], int]
END = "\x03"


class Kinds:
    """Characters for token kinds and for bracket groups."""

    #: Where the group characters of each bracket begin; a group has up to 12 bits.
    BASES = {"B": 0xF0000, "P": 0xF1000, "S": 0xF2000, "T": 0xF3000, "J": 0xF4000, "U": 0xF5000}
    #: The kinds that are not written as the token itself.
    FIXED = {"ID": "i", "NUM": "9", "STR": "s", "BYTES": "b", "TPL": "t", "RX": "r", "LITERAL": "l", "PRIVATE": "p", "NL": "\n", "EOS": END}

    def __init__(self) -> None:
        self.of: dict[str, str] = {}

    def char(self, token: str) -> str:
        """The character of a punctuator or keyword."""
        if token not in self.of:
            self.of[token] = chr(0xE000 + len(self.of))
        return self.of[token]


class Node:
    """An expression of a rule: what it can start with, and its parser."""

    def __init__(self, kind: str, parts: list | None = None, chars: frozenset = frozenset(), name: str = "") -> None:
        self.kind, self.parts, self.chars, self.name = kind, parts or [], chars, name


class Grammar:
    """The compiled rules of a grammar file and its overriding files."""

    def __init__(self, *files: str, sets: dict[str, list[str]]) -> None:
        rules: dict[str, str] = {}
        for file in files:
            for line in (_HERE / file).read_text().splitlines():
                if line.strip() and not line.startswith("#"):
                    name, _, body = line.partition("=")
                    rules[name.strip()] = body.strip()
        self.kinds, self._sets = Kinds(), sets
        self.bits: dict[str, dict[str, int]] = {b: {} for b in Kinds.BASES}
        for name in sorted({t for body in rules.values() for t in _TOKEN.findall(body)} | set(rules)):
            if re.fullmatch(r"[A-Z]\.[a-z]+", name):
                self.bits[name[0]][name[2:]] = 1 << len(self.bits[name[0]])
        self._nodes = {n: self._read(b) for n, b in rules.items()}
        self._starts: dict[str, tuple[frozenset, bool]] = {n: (frozenset(), False) for n in rules}
        changed = True
        while changed:
            found = {n: self._first(node) for n, node in self._nodes.items()}
            changed, self._starts = found != self._starts, found
        self._parsers: dict[str, list[Parser]] = {n: [] for n in rules}
        for n, node in self._nodes.items():
            self._parsers[n].append(self._compile(node))
        self.rule = {n: p[0] for n, p in self._parsers.items()}
        self._cells = {b: [(bit, *self._entry(f"{b}.{n}")) for n, bit in bits.items() if f"{b}.{n}" in rules and rules[f"{b}.{n}"] != "NEVER"] for b, bits in self.bits.items()}

    def assignable(self, s: str, i: int) -> bool:
        """Whether what ends before i can be assigned to; a dialect replaces it."""
        return True

    def _entry(self, name: str) -> tuple[frozenset | None, Parser]:
        chars, void = self._starts[name]
        return (None if void else chars), self.rule[name]

    # -- reading ------------------------------------------------------------

    def _read(self, body: str) -> Node:
        tokens = _TOKEN.findall(body)
        node, at = self._choice(tokens, 0)
        if at != len(tokens):
            raise ValueError(f"cannot read {body}")
        return node

    def _choice(self, tokens: list[str], at: int) -> tuple[Node, int]:
        options = []
        while True:
            parts = []
            while at < len(tokens) and tokens[at] not in ("|", ")"):
                part, at = self._item(tokens, at)
                while at < len(tokens) and tokens[at] in ("*", "+", "?"):
                    part, at = Node(tokens[at], [part]), at + 1
                parts.append(part)
            options.append(parts[0] if len(parts) == 1 else Node("seq", parts))
            if at >= len(tokens) or tokens[at] == ")":
                break
            at += 1
        if all(o.kind == "chars" for o in options):
            return Node("chars", chars=frozenset().union(*(o.chars for o in options))), at
        return (options[0] if len(options) == 1 else Node("or", options)), at

    def _item(self, tokens: list[str], at: int) -> tuple[Node, int]:
        t = tokens[at]
        if t in ("(", "&(", "!("):
            node, end = self._choice(tokens, at + 1)
            return (node if t == "(" else Node(t[0], [node])), end + 1
        one = lambda c: Node("chars", chars=frozenset(c))
        if t[0] == "'":
            node = one(self.kinds.char(t[1:-1]))
        elif re.fullmatch(r"[A-Z]\.[a-z]+", t):
            bit, base = self.bits[t[0]][t[2:]], Kinds.BASES[t[0]]
            node = one(chr(base + m) for m in range(1 << len(self.bits[t[0]])) if m & bit)
        elif t == "BRACE":
            node = one(map(chr, range(Kinds.BASES["B"], Kinds.BASES["P"])))
        elif t == "EMPTY":
            node = Node("seq")
        elif t == "NEVER":
            node = one("")
        elif t == "LHS":
            node = Node("lhs")
        elif t in self._sets:
            node = one([self.kinds.char(w) for w in self._sets[t]] + list("l" if t == "RESERVED" else ""))
        elif t in Kinds.FIXED:
            node = one(Kinds.FIXED[t])
        else:
            node = Node("rule", name=t)
        return node, at + 1

    # -- tables ---------------------------------------------------------------

    def _first(self, node: Node) -> tuple[frozenset, bool]:
        """The kinds a node can start with, and whether it can be empty."""
        if node.kind == "chars":
            return node.chars, False
        if node.kind == "rule":
            return self._starts[node.name]
        if node.kind in ("&", "!", "lhs"):
            return frozenset(), True
        if node.kind in ("*", "?"):
            return self._first(node.parts[0])[0], True
        if node.kind == "+":
            return self._first(node.parts[0])
        chars: frozenset = frozenset()
        if node.kind == "or":
            firsts = [self._first(p) for p in node.parts]
            return chars.union(*(c for c, _ in firsts)), any(v for _, v in firsts)
        for p in node.parts:
            more, void = self._first(p)
            chars |= more
            if not void:
                return chars, False
        return chars, True

    def _compile(self, node: Node) -> Parser:
        kind = node.kind
        if kind == "chars":
            chars = node.chars

            def take(s: str, i: int) -> int:
                c = s[i]
                return (i if c == END else i + 1) if c in chars else -1  # the end is seen, not taken

            return take
        if kind == "rule":
            target, (chars, void) = self._parsers[node.name], self._starts[node.name]

            def call(s: str, i: int) -> int:
                return target[0](s, i) if void or s[i] in chars else -1

            return call
        if kind == "lhs":
            return lambda s, i: i if self.assignable(s, i) else -1
        parts = [self._compile(p) for p in node.parts]
        if kind == "seq":
            if len(parts) == 2:
                a, b = parts

                def two(s: str, i: int) -> int:
                    i = a(s, i)
                    return b(s, i) if i >= 0 else -1

                return two

            def several(s: str, i: int) -> int:
                for p in parts:
                    i = p(s, i)
                    if i < 0:
                        return -1
                return i

            return several
        if kind == "or":
            firsts = [self._first(p) for p in node.parts]
            table: dict[str, tuple[Parser, ...]] = {}

            def choose(s: str, i: int) -> int:
                c = s[i]
                options = table.get(c)
                if options is None:
                    options = table[c] = tuple(p for p, (chars, void) in zip(parts, firsts) if void or c in chars)
                for p in options:
                    j = p(s, i)
                    if j >= 0:
                        return j
                return -1

            return choose
        inner = parts[0]
        chars, void = self._first(node.parts[0])
        if kind == "&":
            return lambda s, i: i if inner(s, i) >= 0 else -1
        if kind == "!":
            return lambda s, i: -1 if inner(s, i) >= 0 else i
        if kind == "?":

            def maybe(s: str, i: int) -> int:
                if not void and s[i] not in chars:
                    return i
                j = inner(s, i)
                return j if j >= 0 else i

            return maybe

        def many(s: str, i: int) -> int:
            n = 0
            while void or s[i] in chars:
                j = inner(s, i)
                if j <= i:
                    break
                i, n = j, n + 1
            return i if n or kind == "*" else -1

        return many

    # -- cells ------------------------------------------------------------------

    def mask(self, bracket: str, content) -> int:
        """The nonterminals, as bits, that derive a group's content.

        content is the string with its end mark, or a function from a bit to it.
        """
        found = 0
        for bit, chars, rule in self._cells[bracket]:
            s = content if isinstance(content, str) else content(bit)
            if (chars is None or s[0] in chars) and rule(s, 0) >= 0:
                found |= bit
        return found
