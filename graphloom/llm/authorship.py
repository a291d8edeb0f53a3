"""Signs in a file that nobody wrote it by hand, from its tokens."""

from __future__ import annotations

import re
import zlib

#: Strings come before comments, so that neither starts inside the other.
_TOKEN = re.compile(
    r'"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`(?:[^`\\]|\\[\s\S])*`'
    r"|/\*[\s\S]*?\*/|//[^\n]*|\n[ \t]*#[^\n]*|0[xX][0-9a-fA-F]+|\d[\w.]*|[^\W\d][\w$]*|\S"
)
_CONTROL = frozenset("function return if for while class def switch case try interface lambda import from enum type async".split()) | {"=>"}

#: What tools write at the head of their output.
_MADE = re.compile(
    r"^\W*code generated by\b(?![^\n.]*\b(?:is|are|was|were|must|should|can|will)\b)|\bcode generated by\b[^\n]*\bdo not edit\b|^[^\w@\n]*@generated\b|<auto-?generated|\bauto-?generated\b|\bautomatically (?:generated|produced|created)\b"
    r"|\b(?:this|the) (?:file|code|module|source) (?:is|was|has been) (?:generated|produced|created|written|emitted) (?:by|from|with)\b"
    r"|\bgenerated (?:file|code|source)\b|\bmachine[- ](?:made|generated|written)\b(?:\s+(?:file|code|source|module|output|from|by|with)\b|[^\w\s]|\s*$)|\bgenerated (?:by|from) (?:the )?(?:protocol buffer compiler|\S+\.(?:proto|schema|json|ya?ml|graphql|idl|xsd|g4)\b)"
    r"|\bdo not (?:edit|modify|change)(?: (?:it|this file|this|by hand|manually))?\s*(?:[.!*]|-->|$)|\bchanges (?:to this file )?will be (?:lost|overwritten)\b"
    r"|\boverwritten (?:on|by|at|with) (?:each|every|the next)\b|\boutput of (?:the )?\S+ (?:template|generator|compiler)\b"
    r"|\b(?:datei|code|quelltext) wurde\b.*\b(?:erzeugt|generiert|erstellt)\b|\bautomatisch (?:erzeugt|generiert|erstellt)\b|\bnicht von hand (?:ändern|bearbeiten)\b"
    r"|\b(?:fichier|code) (?:produit|généré|créé) (?:par|automatiquement|à partir)\b|\bne pas (?:modifier|éditer)\b|\btoute modification sera\b"
    r"|\b(?:archivo|fichero|código) (?:generado|producido|creado) (?:por|automáticamente|a partir)\b|\bno (?:editar|modificar)\b|\blos cambios se (?:perderán|sobrescribirán)\b"
    r"|\b(?:arquivo|ficheiro|file) (?:gerado|generato|prodotto) (?:por|da|automaticamente)\b|\bnon modificare\b|\bnão (?:editar|edite|modifique)\b|\bniet (?:handmatig )?bewerken\b"
    r"|\b(?:produced|emitted|created|written|built|made) (?:by|with) \S*(?:gen|generator|compiler|protoc|codegen|swagger|thrift|bison|yacc|antlr)\S*"
    r"|自动生成|自動生成|自动產生|自動產生|请勿(?:手动|手工)?(?:修改|编辑|改动)|請勿(?:手動)?(?:修改|編輯)|不要(?:手动)?(?:修改|编辑)|(?:編集|変更|修正)しないで|자동\s*(?:으로\s*)?생성|(?:수정|편집)하지\s*마"
    r"|\b(?:файл|код) (?:создан|сгенерирован|сформирован)\b|\bсгенерировано?\b|\bне (?:редактир|изменяй|правьте)\w*|\bwygenerowan\w+|\bnie edytuj\w*|\botomatik (?:olarak )?(?:oluşturul|üretil)\w*",
    re.IGNORECASE | re.MULTILINE,
)
#: What compilers and bundlers leave in their output.
_RUNTIME = re.compile(r"Object\.defineProperty\(exports,\s*[\"']__esModule[\"'][\s\S]*\bthis\s*&&\s*this\.__\w+|\b__webpack_require__\b|\b_interopRequire(?:Default|Wildcard)\b|^//[#@]\s*sourceMappingURL=", re.MULTILINE)
#: One of these stands in every text that _RUNTIME finds something in.
_TRACES = ("__esModule", "__webpack_require__", "_interopRequire", "sourceMappingURL=")
_LICENCE = re.compile(r"\blicen[cs]ed?\b|\bcopyright\b|\(c\)|©", re.IGNORECASE)
_VERSION = re.compile(r"\bv?\d+\.\d+\.\d+\b")
_MADE_PATH = re.compile(r"/(?:__generated__|generated|gen|autogen|codegen)/|\.(?:generated|gen|g|pb|autogen)\.[A-Za-z]+$|_pb2?(?:_grpc)?\.[A-Za-z]+$", re.IGNORECASE)
_THIRD_PATH = re.compile(r"/(?:node_modules|bower_components|vendor|vendors|vendored|third[_-]?party|external|externals|extern|deps|site-packages)/|-\d+\.\d+\.\d+\.[A-Za-z]+$", re.IGNORECASE)
#: Folders that package managers write, and nobody else.
_ALWAYS_THIRD = re.compile(r"/(?:node_modules|bower_components|site-packages)/", re.IGNORECASE)

_HASHES: dict[str, int] = {}


def tokens(text: str) -> tuple[list[str], str]:
    """The tokens without comments, and the comments before the first of them."""
    found = _TOKEN.findall("\n" + text.removeprefix("﻿"))
    code, head = [], []
    for t in found:
        if t.startswith(("//", "/*")) or t[0] == "\n":
            if not code:
                head.append(t)
        elif not code and (t.startswith(('"""', "'''"))):
            head.append(t)
        else:
            code.append(t)
    return code, "\n".join(head)


def token_hashes(code: list[str]) -> list[int]:
    """A stable number for each token; quotes and trailing punctuation are normalized."""
    out = []
    for t in code:
        h = _HASHES.get(t)
        if h is None:
            h = zlib.crc32((t[1:-1] if t[0] in "\"'`" and len(t) > 1 else t).encode("utf-8", "surrogatepass"))
            if len(_HASHES) < 400_000:
                _HASHES[t] = h
        if t not in (";", ","):
            out.append(h)
    return out


def _regular(text: str) -> float:
    """The share of lines whose shape occurs at least three times."""
    shapes: dict[str, int] = {}
    for line in text.split("\n"):
        line = line.strip()
        if line and not line.startswith(("//", "*", "/*", "#")):
            shape = re.sub(r"\d+", "9", re.sub(r"[^\W\d][\w$]*", "i", re.sub(r"\"[^\"]*\"|'[^']*'", "s", line)))
            shapes[shape] = shapes.get(shape, 0) + 1
    return sum(n for n in shapes.values() if n > 2) / max(1, sum(shapes.values()))


def least_share(hits: int, n: int, z: float = 2.0) -> float:
    """The share that hits of n make likely at least (Wilson's lower bound); little evidence gives little."""
    if not n:
        return 0.0
    p = hits / n
    return (p + z * z / (2 * n) - z * ((p * (1 - p) + z * z / (4 * n)) / n) ** 0.5) / (1 + z * z / n)


#: A mark after or around which hand-written code has a blank or a line end.
_MARK = re.compile(r"[,;{}=:?]|&&|\|\|")


def _minified(text: str, code: list[str]) -> bool:
    """Marks without blanks around, short names and full lines: squeezed by a tool.

    Whether the lines are very long, or cut at some width, does not matter: the lines
    of code hold many tokens, hardly any of its marks has a blank beside it, and most
    of its own names have one or two characters.
    """
    words = [t for t in code if (t[0].isalpha() or t[0] in "_$") and t not in _CONTROL]
    short, names = sum(len(w) <= 2 for w in words), sum(map(len, words)) / max(1, len(words))
    brief = least_share(short, len(words)) >= 0.35
    if not words or names >= 5.5 and not brief:
        return False
    strings = sum(len(t) for t in code if t[0] in "\"'`")
    size = sum(map(len, code))
    if strings > 0.6 * size:
        return False
    bare = _TOKEN.sub(lambda m: "s" if m.group()[0] in "\"'`" else "" if m.group().startswith(("//", "/*", "\n")) and m.group().strip().startswith(("//", "/*", "#")) else m.group(), "\n" + text)
    lines = [x for x in bare.split("\n") if x.strip()]
    blanks = sum(x.count(" ") + x.count("\t") for x in lines) / max(1, sum(map(len, lines)))
    if size / max(1, len(lines)) >= 120 and max(map(len, lines)) >= 250 and blanks < 0.12 and names < 5.5 and len(code) >= 60:
        return True
    marks = [m.span() for m in _MARK.finditer(bare)]
    tight = sum(bare[a - 1 : a] not in ("", " ", "\t", "\n") and bare[b : b + 1] not in (" ", "\t") for a, b in marks)
    return brief and blanks < 0.12 and size / max(1, len(lines)) >= 40 and least_share(tight, len(marks)) >= 0.75


_LITERAL, _CONSTANTS = frozenset("0123456789\"'`"), frozenset(["true", "false", "null", "None", "True", "False"])


def _data(code: list[str], least: int = 600) -> bool:
    """Almost nothing but literals: a file that holds data, not a program.

    By definition that takes at least ``least`` characters of code: a shorter list is a
    constant somebody wrote. A few tokens of control flow (an accessor) are outweighed
    by enough values.
    """
    control = sum([t in _CONTROL for t in code])
    if control and sum([t[0] in _LITERAL for t in code]) + sum([t in _CONSTANTS for t in code]) < 50 * control:
        return False
    size = values = n_values = 0
    for n, t in enumerate(code):
        size += len(t)
        f = t[0]
        if t in _CONTROL:
            pass
        elif f.isdigit() or t in _CONSTANTS:
            values += len(t)
            n_values += 1
        elif f in "\"'`":
            if len(t) < 42 or not re.search(r"\s", t):
                values += len(t)
                n_values += 1
        elif t in ("[", "]", "{", "}", "(", ")", ",", ":", "-", "+", "."):
            values += 1
        elif n + 1 < len(code) and code[n + 1] == ":" and (n == 0 or code[n - 1] in ("{", ",")):
            values += len(t)  # a key
    if control:
        return n_values >= 50 * control and least_share(values, size) >= 0.93
    return size >= least and values >= 0.85 * size


def signs(path: str, text: str, code: list[str], head: str) -> tuple[str | None, bool]:
    """Why a file is not hand-written, if its own text shows it; and whether it hints at a third party."""
    made = _MADE.search(head)
    if made:
        return "generated", False
    third = bool(_LICENCE.search(head) and _VERSION.search(head))
    if _minified(text, code):
        return "minified", third
    if _data(code):
        return "data", third
    if any(w in text for w in _TRACES) and _RUNTIME.search(text):
        return "generated", third
    if _MADE_PATH.search(path) and _regular(text) >= 0.5:
        return "generated", third
    if _ALWAYS_THIRD.search(path):
        return "vendored", True
    return None, third or bool(_THIRD_PATH.search(path))
