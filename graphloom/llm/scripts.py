"""Tokens and syntax of ECMAScript and TypeScript files."""

from __future__ import annotations

import re

from graphloom.llm.grammar import END, Grammar, Kinds

#: The words of the language.
RESERVED = "break case catch class const continue debugger default delete do else enum export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with".split()
LITERALS = "null true false this super".split()
CONTEXTUAL = "as satisfies async await yield let static get set of from type interface implements declare namespace module global abstract public private protected readonly override accessor keyof infer is asserts unique using require out assert".split()

_SETS = {
    "CONTEXTUAL": CONTEXTUAL,
    "RESERVED": [w for w in RESERVED if w not in LITERALS],
    "PARAMMOD": ["public", "private", "protected", "readonly", "override"],
    "CLASSMOD": ["static", "public", "private", "protected", "readonly", "abstract", "override", "declare", "accessor"],
    "JSMOD": ["static", "accessor"],
}

_PUNCTUATORS = "=== !== **= ... <<= &&= ||= ??= => == != <= ** ++ -- << && || ?? ?. += -= *= /= %= &= |= ^= { } ( ) [ ] ; , < > + - * / % & | ^ ! ~ ? : = . @".split()
_NUMBER = r"(?:0[xX][0-9a-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)n?(?![\w$])"
_STRING = r""""(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'"""
_COMMENT = r"//[^\n\r  ]*|/\*[\s\S]*?\*/"
_WORD = r"\#?(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$‌‍]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*"
_OPS = r"\?\.(?!\d)|" + "|".join(re.escape(p) for p in sorted((p for p in _PUNCTUATORS if p != "?."), key=len, reverse=True))
#: One token that is neither a template, a regular expression nor JSX.
_PLAIN = re.compile(rf"{_WORD}|[\n\r  ]+|{_NUMBER}|{_STRING}|{_OPS}|\d[\w$.]*|\S")
_NUM = re.compile(_NUMBER)
#: A stretch without templates, slashes that are no comments, and (in the last two) the named characters.
_RUN = {stop: re.compile(rf"""(?:[^"'`/{re.escape(stop)}]+|{_STRING})+""") for stop in ("", "<", "{}", "<{}")}
_SKIP = re.compile(rf"{_COMMENT}")
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*")
_ESCAPE = re.compile(r"\\.")
_CLASS = re.compile(r"\[[^\]]*\]")
_GROUP = re.compile(r"\((?:\?(?:[:=!]|<[=!]|<[^>]*>|[a-z-]+:))?")
_NOTHING_REPEATS = re.compile(r"(?:^|[(|])[*+?]|\*\*|\+\+|\?\?\?|[*+]\*|\*\+")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_GENERIC = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|extends\s+[^>])")
_TAG = re.compile(r"\s*([A-Za-z_$][\w$.:-]*)?")
_ATTRIBUTE = re.compile(r"""(?:\s|/\*[\s\S]*?\*/|//[^\n]*\n)*(?:([A-Za-z_$][\w$:-]*)(?:\s*=\s*("[^"]*"|'[^']*'|(?=[{<])))?|(?=\{)|(/?>))""")
_ARGUMENTS = re.compile(r"<[^<>{}]*(?:<[^<>{}]*>[^<>{}]*)*>")
_TEXT = re.compile(r"[^{<}>]*")


def _well_formed(literal: str) -> bool:
    """Whether a regular expression's groups are balanced, its repetitions repeat and its flags exist."""
    body, _, flags = literal[1:].rpartition("/")
    if len(set(flags)) < len(flags) or not set(flags) <= set("dgimsuvy") or {"u", "v"} <= set(flags):
        return False
    plain = _CLASS.sub("c", _ESCAPE.sub("e", body))
    plain = _GROUP.sub("(", plain)
    depth = 0
    for ch in plain:
        depth += (ch == "(") - (ch == ")")
        if depth < 0:
            return False
    return not depth and not _NOTHING_REPEATS.search(plain)


class SyntaxFault(Exception):
    """The first place at which no parse can go on."""

    def __init__(self, offset: int, what: str) -> None:
        super().__init__(what)
        self.offset, self.what = offset, what


class Scripts:
    """Parser of one dialect: ``js``, ``ts`` or ``tsx``."""

    def __init__(self, dialect: str) -> None:
        files = ["typescript.peg"] + (["ecmascript.peg"] if dialect == "js" else [])
        self.g = g = Grammar(*files, sets=_SETS)
        self.jsx = dialect == "tsx"
        char = g.kinds.char
        fixed = {w: char(w) for w in [*_PUNCTUATORS, *CONTEXTUAL, *RESERVED]}
        fixed |= {w: Kinds.FIXED["LITERAL"] for w in LITERALS if w != "this"} | {"this": char("this"), "super": Kinds.FIXED["LITERAL"]}
        self._fixed = fixed
        outer = self

        class ByToken(dict):
            def __missing__(self, token: str) -> str:
                k = outer._kind(token)
                if len(self) < 300_000:
                    self[token] = k
                return k

        self._kinds = ByToken(fixed)
        c = {t: char(t) for t in fixed if t not in ("null", "true", "false", "super")}
        cls = lambda ts: "[" + "".join(re.escape(c[t]) for t in ts) + "]"
        # a line end is void after a token that cannot end a statement, and before one that goes on with it
        goes_on = [p for p in _PUNCTUATORS if p not in (")", "]", "}", ";", "++", "--", "!", "@", "{", "(", "[")] + ["(", "[", "{"]
        opens = goes_on + "case class default delete do else enum extends finally import in instanceof new throw try typeof var export function catch as satisfies implements keyof".split()
        follows = [p for p in _PUNCTUATORS if p not in ("++", "--", "!", "~", "@", "{", "}", ";", "...", "*", "[", "(", "+", "-", "/", "<")] + ["[", "(", "+", "-", "/", "*", "<", "in", "instanceof", "extends", "implements"]
        self._void_type = re.compile(f"(?<={cls(opens)})\n|\n(?={cls([p for p in follows if p not in ('[', '(', '+', '-', '*', '<')])})")
        groups = f"[{chr(0xF1000)}-{chr(0xF3FFF)}t]"
        # after a brace the line end stays: it may close an arrow function, which no group goes on with
        brace = f"[{chr(Kinds.BASES['B'])}-{chr(Kinds.BASES['P'] - 1)}]"
        self._void = re.compile(f"(?<={cls(opens)})\n|\n(?={cls(follows)})|(?<!{brace})\n(?={groups})")
        self._repeat = re.compile(r"((?:[^,\n;" + re.escape(c[","] + c[";"]) + r"]+" + re.escape(c[","]) + r"))\1+")
        self._semi = c[";"]
        self._not_simple = re.compile(cls(["if", "do", "try"]))
        self._module_only = cls(["import", "export"])
        self._statements: dict[str, bool] = {}
        self._special = {"B.block": lambda s: self._list(s, "stmt"), "B.module": lambda s: self._list(s, "item")} if dialect != "js" else {"B.block": lambda s: self._list(s, "stmt")}
        self._after_import = {c["."]}
        bits = g.bits["B"]
        self._flat = {bits[n] for n in ("object", "pattern", "names", "enum", "hole") if n in bits}
        self._typed = bits.get("type", 0)
        self._flat.add(bits["target"])
        self._ids = {"i", *(c[w] for w in CONTEXTUAL)}
        self._names = {"l", "p", *(c[w] for w in RESERVED if w in c), c["this"]}
        self._ends = {"9", "s", "t", "r"} | self._ids | self._names
        self._dot, self._maybe, self._bang = c["."], c["?."], "" if dialect == "js" else c["!"]
        g.assignable = self._assignable
        self._cells: dict[tuple[str, str], str] = {}

    def _kind(self, token: str) -> str:
        f = token[0]
        if f in "\n\r  ":
            return "\n"
        if f in "\"'":
            return "s"
        if f.isdigit() or f == ".":
            return "9" if _NUM.fullmatch(token) else "\0"
        if f == "\ufeff":
            return ""
        if f == "#" and len(token) > 1:
            return "p"
        return "i" if f.isalpha() or f in "_$\\" and len(token) > len(f) - (f in "_$") else "\0"

    def _assignable(self, s: str, i: int) -> bool:
        """Whether the operand that ends before i can be assigned to, by its last kinds.

        A name or an index can, unless an optional chain leads to it; a group can if
        its content can, and a call cannot.
        """
        ch, before = s[i - 1], s[i - 2] if i > 1 else ""
        if ch in self._ids:
            return before != self._maybe
        if ch in self._names:
            return before == self._dot
        if ch == self._bang:
            return self._assignable(s, i - 1)
        bracket = next((b for b in "BPS" if 0 <= ord(ch) - Kinds.BASES[b] < 0x1000), "")
        if not bracket:
            return False
        if bracket == "S" and before:
            if before in self._ends or before == self._bang or ord(before) >= Kinds.BASES["B"]:
                return before != self._maybe
        if bracket == "P" and before and (before in self._ids or before in "9str" or Kinds.BASES["S"] <= ord(before)):
            return False
        if bracket == "B" and before and (before in self._ids or ord(before) >= Kinds.BASES["P"]):
            return False  # a body, of a function or class
        return bool((ord(ch) - Kinds.BASES[bracket]) & self.g.bits[bracket]["target"])

    # -- tokens -----------------------------------------------------------

    def _tokens(self, text: str, out: list[str]) -> None:
        """Appends all tokens of a text to out; templates and JSX as groups."""
        self._text = text
        at = self._scan(text, 0, out, "")
        if at < len(text):
            raise SyntaxFault(at, "unexpected character")

    def _scan(self, text: str, at: int, out: list[str], until: str) -> int:
        """Tokens from at on; with until '}', to the brace that closes what is open."""
        stop = ("<" if self.jsx else "") + ("{}" if until else "")
        run, depth, n = _RUN[stop], 0, len(text)
        while at < n:
            m = run.match(text, at)
            if m:
                out.extend(_PLAIN.findall(m.group()))
                at = m.end()
                if at >= n:
                    break
            ch = text[at]
            if ch == "/":
                m = _SKIP.match(text, at)
                if m:
                    if "\n" in m.group():
                        out.append("\n")
                    at = m.end()
                    continue
                if self._operand_before(out):
                    op = "/=" if text.startswith("/=", at) else "/"
                    out.append(op)
                    at += len(op)
                    continue
                m = _REGEX.match(text, at)
                if not m or not _well_formed(m.group()):
                    raise SyntaxFault(at, "unterminated regular expression")
                out.append("/re/")
                at = m.end()
            elif ch == "`":
                at = self._template(text, at, out)
            elif ch == "<" and self.jsx:
                if self._operand_before(out) or _GENERIC.match(text, at):
                    op = next(o for o in ("<<=", "<<", "<=", "<") if text.startswith(o, at))
                    out.append(op)
                    at += len(op)
                else:
                    at = self._element(text, at, out)
            elif ch in "{}" and until:
                if ch == "}" and depth == 0:
                    return at
                depth += 1 if ch == "{" else -1
                out.append(ch)
                at += 1
            else:
                raise SyntaxFault(at, "unterminated string" if ch in "\"'" else "unexpected character")
        if until:
            raise SyntaxFault(at, "unexpected end of file")
        return at

    def _operand_before(self, out: list[str]) -> bool:
        """Whether an operand ends here, so that a slash divides and < compares."""
        n = len(out) - 1
        while n >= 0 and out[n][0] in "\n\r\u2028\u2029":
            n -= 1
        if n < 0:
            return False
        t = out[n]
        if t in (")", "]", "}", "++", "--", "`)", "J)", "/re/", "``"):
            return True
        if t in self._fixed:
            if n and out[n - 1] in (".", "?.") and t[0].isalpha():
                return True  # a keyword as the name of a property
            return t in ("this", "super", "null", "true", "false") or (t in CONTEXTUAL and t not in ("as", "satisfies", "await", "yield", "of", "keyof", "is"))
        return t[0] not in _OPENING

    def _template(self, text: str, at: int, out: list[str]) -> int:
        begin = at
        m = _TEMPLATE.match(text, at + 1)
        if m.end() < len(text) and text[m.end()] == "`":
            out.append("``")
            return m.end() + 1
        out.append("`(")
        at = m.end()
        while True:
            if at >= len(text):
                raise SyntaxFault(begin, "unterminated template")
            if text[at] == "`":
                out.append("`)")
                return at + 1
            out.append("${")
            at = self._scan(text, at + 2, out, "}")
            out.append("$}")
            at = _TEMPLATE.match(text, at + 1).end()

    def _element(self, text: str, at: int, out: list[str]) -> int:
        """A JSX element with all it holds; nested ones are handled by a stack."""
        begin, stack = at, []
        out.append("J(")
        while True:
            if at >= len(text):
                raise SyntaxFault(begin, "unterminated JSX element")
            ch = text[at]
            if ch == "{":
                out.append("{")
                at = self._scan(text, at + 1, out, "}") + 1
                out.append("}")
            elif ch == "<" and text.startswith("</", at):
                m = _TAG.match(text, at + 2)
                close = m.end() + len(text[m.end() :]) - len(text[m.end() :].lstrip())
                if not stack or stack[-1] != (m[1] or "") or not text.startswith(">", close):
                    raise SyntaxFault(at, "JSX tags do not match")
                stack.pop()
                at = close + 1
            elif ch == "<":
                m = _TAG.match(text, at + 1)
                name, at = m[1] or "", m.end()
                if name and text.startswith("<", at):
                    generic = _ARGUMENTS.match(text, at)
                    at = generic.end() if generic else at
                while True:
                    m = _ATTRIBUTE.match(text, at)
                    if not m:
                        raise SyntaxFault(at, "bad JSX attribute")
                    at = m.end()
                    if m[3]:
                        if m[3] == ">":
                            stack.append(name)
                        break
                    if text.startswith("{", at):
                        out.append("{")
                        at = self._scan(text, at + 1, out, "}") + 1
                        out.append("}")
                    elif text.startswith("<", at) and m[1]:
                        at = self._element(text, at, out)
            else:
                m = _TEXT.match(text, at)
                if m.end() == at:
                    raise SyntaxFault(at, "unexpected character in JSX")
                at = m.end()
            if not stack:
                out.append("J)")
                return at

    # -- groups -------------------------------------------------------------

    def _list(self, s: str, rule: str) -> bool:
        return self._statement_fault(s, rule) < 0

    def _statement_fault(self, s: str, rule: str) -> int:
        """Where the first statement starts that does not parse; -1 if all do."""
        at, n, known, semi = 0, len(s), self._statements, self._semi
        parse, import_, export = self.g.rule["item"], self._fixed["import"], self._fixed["export"]
        s += END
        while at < n:
            if s[at] == "\n":
                at += 1
                continue
            end = s.find(semi, at) + 1
            piece = s[at:end] if end else ""
            if piece and known.get(piece):
                at = end
                continue
            if rule == "stmt" and (s[at] == export or s[at] == import_ and s[at + 1 : at + 2] not in self._after_import and not 0xF1000 <= ord(s[at + 1 : at + 2] or "\0") < 0xF2000):
                return at  # imports and exports stand at the top of a module
            stop = parse(s, at)
            if stop <= at:
                return at
            if stop > n:
                stop = n
            if stop == end and not self._not_simple.search(piece):
                if len(known) > 150_000:
                    known.clear()
                known[piece] = True
            at = stop
        return -1

    def fault(self, text: str) -> SyntaxFault | None:
        """The first unrecoverable error of a file, or None if it parses."""
        try:
            if text.startswith("﻿"):
                text = " " + text[1:]
            if text.startswith("#!"):
                text = "//" + text[2:]
            tokens: list[str] = []
            self._tokens(text, tokens)
            self._reduce(tokens)
        except SyntaxFault as f:
            if f.offset < 0:
                f.offset = self._offset(text, tokens, -1 - f.offset)
            return f
        return None

    def _offset(self, text: str, tokens: list[str], n: int) -> int:
        """The place of token n in the text, by reading the tokens again."""
        at = 0
        for t in tokens[:n]:
            if t[0] in "`$J" and len(t) == 2 or t == "/re/":
                continue
            found = text.find(t, at)
            at = found + len(t) if found >= 0 else at
        return at

    _CLOSE = {"}": ("{", "B"), ")": ("(", "P"), "]": ("[", "S"), "`)": ("`(", "T"), "J)": ("J(", "J"), "$}": ("${", "U")}

    def _reduce(self, tokens: list[str]) -> None:
        """Fills the chart from the inside out; raises at the first dead cell."""
        kinds, stack, parts = self._kinds, [], []
        opened, start = [], 0
        g, special, close = self.g, self._special, self._CLOSE
        for n, t in enumerate(tokens):
            if t in _BRACKETS:
                pair = close.get(t)
                if pair is None:
                    stack.append(parts)
                    opened.append((t, n))
                    parts = []
                    continue
                if not opened or opened[-1][0] != pair[0]:
                    raise SyntaxFault(-1 - n, f"unexpected {t}")
                start = opened.pop()[1]
                content = "".join(parts)
                parts = stack.pop()
                cell = self._cell(pair[1], content)
                if not cell:
                    raise SyntaxFault(-1 - start, f"nothing derives the content of {pair[0]}")
                parts.append(cell)
            elif t == "/re/":
                parts.append("r")
            elif t == "``":
                parts.append("t")
            else:
                parts.append(kinds[t])
        if opened:
            raise SyntaxFault(-1 - opened[-1][1], f"{opened[-1][0]} is never closed")
        s = self._voided("".join(parts))
        bad = self._statement_fault(s, "item")
        if bad >= 0:
            raise SyntaxFault(-1 - self._top_level(tokens, s, bad), "no statement starts here")

    def _top_level(self, tokens: list[str], s: str, bad: int) -> int:
        """The token at which the statement at s[bad] starts."""
        want = sum(1 for ch in s[:bad] if ch != "\n")
        depth = seen = 0
        for n, t in enumerate(tokens):
            if depth == 0 and t[0] not in "\n\r  ":
                if seen == want:
                    return n
                seen += 1
            if t in _BRACKETS:
                depth += -1 if t in self._CLOSE else 1
        return len(tokens)

    def _voided(self, s: str) -> str:
        while "\n\n" in s:
            s = s.replace("\n\n", "\n")
        return self._void.sub("", s)

    def _cell(self, bracket: str, content: str) -> str:
        """The group's character after all that derives its content; "" if nothing does."""
        known = self._cells.get((bracket, content))
        if known is not None:
            return known
        g = self.g
        flat = self._repeat.sub(r"\1", content.replace("\n", "")) + END
        if bracket == "B":
            lined = self._voided(content)
            typed, ended = self._void_type.sub("", content) + END, lined + END
            mask = g.mask("B", lambda bit: flat if bit in self._flat else typed if bit == self._typed else ended)
            for name, test in self._special.items():
                if test(lined):
                    mask |= g.bits["B"][name[2:]]
        else:
            mask = g.mask(bracket, flat)
        cell = chr(Kinds.BASES[bracket] + mask) if mask else ""
        if len(self._cells) > 150_000:
            self._cells.clear()
        self._cells[bracket, content] = cell
        return cell


_BRACKETS = frozenset(["{", "}", "(", ")", "[", "]", "`(", "`)", "J(", "J)", "${", "$}"])
_OPENING = frozenset("({[,;:?=<>+-*/%&|^!~@.")

