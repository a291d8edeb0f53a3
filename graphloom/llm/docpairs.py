"""Functions paired with their documentation."""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.workspace import Scratch

#: Pieces without recursion. A class inside a regular expression holds no further [, and
#: what starts like a string but does not end in its line is a character like others.
_STRINGS = r"""(?:"(?:[^"\\\n]++|\\(?s:.))*+"|'(?:[^'\\\n]++|\\(?s:.))*+'|`(?:[^`\\$]++|\\(?s:.)|\$(?!\{))*+`)"""
_NOTES = r"//[^\n]*+|/\*(?>(?s:.*?)\*/)"
_SLASHES = r"(?<=[(,=:\[!&|?{};+*%~^-][ \t]*+)/(?![*/])(?:[^\\/\[\n]++|\\.|\[(?:[^\[\]\\\n]++|\\.)*+\])++/|/(?![*/])"
#: Every group is entered once at a place: what fails inside fails as a whole.
_PATTERN = rf"""
(?(DEFINE)
  (?<template>`(?:[^`\\$]++|\\(?s:.)|\$(?!\{{)|\$(?&block))*+`)
  (?<block>\{{(?:[^{{}}"'`/]++|{_STRINGS}|{_NOTES}|{_SLASHES}|["']|(?&template)|(?&block))*+\}})
  (?<round>\((?:[^()"'`/]++|{_STRINGS}|{_NOTES}|{_SLASHES}|["']|(?&template)|(?&round))*+\))
)
\A
(?:
  (?P<pycomment>(?:[ \t]*+\#[^\n]*+\n)*+)
  (?P<pysignature>(?:[ \t]*+@[^\n]*+\n)*+(?P<indent>[ \t]*+)(?:async[ ]+)?(?:def|class)\b[^\n(:]*+(?:(?&round)|(?!\())[^\n:]*+:)
  (?P<pybody>[^\n]*+(?:\n(?:[ \t]*+(?=\n|\Z)|(?P=indent)[ \t]++(?:\"\"\"(?>(?s:.*?)\"\"\")|'''(?>(?s:.*?)''')|[^\n])*+))*+)
|
  (?P<comment>(?:[ \t\r\n]*+/\*\*(?>(?s:.*?)\*/))?+)
  (?P<signature>(?:[^{{}}"'`/(]++|{_STRINGS}|{_NOTES}|{_SLASHES}|(?&round)|(?&template)|(?&block)(?=\s*+\{{))*+)
  (?P<body>(?&block))
)
"""
_CAPTURE = regex.compile(_PATTERN, regex.VERBOSE)
_HEAD = regex.compile(r"(?:[ \t]*+(?:\#|@)[^\n]*+\n)*+[ \t]*+(?:async[ ]+)?(?:def|class)\b[^\n(:]*+")
_NEXT = regex.compile(rf"{_STRINGS}|/\*(?>(?s:.*?)\*/)|//[^\n]*+|{_SLASHES}|[(){{}}`]|/\*")
_INSIDE = regex.compile(r"[^\n]")
_IN_TEMPLATE = regex.compile(r"\\(?s:.)|\$\{|`")
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_CAPITAL = regex.compile(r"([A-Z])")
_BLANK = " \t\n\x0b\x0c\r"


def words_of(text: str) -> set[str]:
    """Maximal runs of letters and digits, lower-cased."""
    return set(_WORD.findall(text.lower()))


def words_of_name(name: str) -> set[str]:
    """The words of an identifier, whole and split before each capital A-Z."""
    return words_of(name) | words_of(_CAPITAL.sub(r" \1", name))


def skeleton(code: str) -> str:
    """The text with the inside of its outermost brackets overwritten by [, in one pass.

    Brackets, strings and comments are those of the pattern, so it captures the same
    parts of the skeleton as of the text, without recursion. Where a bracket or
    comment never ends, which no body can hold, the skeleton stops with a backtick.
    Of Python code only the parameters of the head are overwritten.
    """
    head = _HEAD.match(code)
    at, opened, modes, out, done = head.end() if head else 0, 0, [], [], 0
    if head and not code.startswith("(", at):
        return code
    while True:
        m = (_IN_TEMPLATE if modes and modes[-1] == "`" else _NEXT).search(code, at)
        if m is None:
            return "".join([*out, code[done : opened + 1], "`"] if modes else [*out, code[done:]])
        t, at = m.group(), m.end()
        mode = modes[-1] if modes else ""
        if t == "/*":
            return "".join([*out, code[done : opened + 1 if modes else m.start()], "`"])
        if t == "${":
            modes.append("{")
        elif mode == "`":
            if t == "`":
                modes.pop()
        elif t == "`" or t == mode or not mode and t in "({":
            modes.append(t)
        elif mode and t == {"{": "}", "(": ")"}[mode]:
            modes.pop()
        elif not mode and t == "}":
            return "".join([*out, code[done:]])
        if not mode and modes:
            opened = m.start()
        elif mode and not modes:
            out += [code[done : opened + 1], _INSIDE.sub("[", code[opened + 1 : at - 1]), code[at - 1]]
            done = at
            if head:
                return "".join([*out, code[done:]])


def capture(code: str, whole: int = 4000) -> tuple[str, str, str, bool]:
    """Comment, signature and body of a function's text, and whether the body is balanced.

    A text in which the pattern finds no signature with a balanced body is a
    fragment: all of it is body, and it is not balanced. Of a text longer than
    ``whole`` the pattern sees the skeleton, which gives the same parts.
    """
    m = _CAPTURE.match(code if len(code) <= whole else skeleton(code))
    if m is None:
        return "", "", code, False
    names = ("pycomment", "pysignature", "pybody") if m["pysignature"] is not None else ("comment", "signature", "body")
    return *(code[slice(*m.span(n))] for n in names), True


def _lead(text: str, begin: int) -> str:
    """The documentation comment that ends before begin with only blanks between."""
    end = begin
    while end and text[end - 1] in _BLANK:
        end -= 1
    if text[max(0, end - 2) : end] != "*/":
        return ""
    start = text.rfind("/**", 0, end)
    if start < 0 or text.find("*/", start + 3, end) < 0:
        return ""
    return text[start:begin]


class _Text:
    """A file's text, with where its lines begin."""

    def __init__(self, text: str) -> None:
        self.text, self.starts = text, [0]
        at = text.find("\n")
        while at >= 0:
            self.starts.append(at + 1)
            at = text.find("\n", at + 1)

    def cut(self, first: int, last: int) -> tuple[str, str] | None:
        """The comment before some lines (from 1), and the lines; None beyond the text."""
        if last > len(self.starts):
            return None
        begin = self.starts[first - 1]
        end = self.starts[last] - 1 if last < len(self.starts) else len(self.text)
        return _lead(self.text, begin), self.text[begin:end]


def documented_functions(nodes: DataFrame, sources: DataFrame, least_words: int = 3, crowd: int = 2000) -> DataFrame:
    """Functions with a telling description and their code, one row per distinct node.

    Columns: node_id, name, description, comment, signature, body, balanced boolean,
    code. A node of type function counts if its documentation is JSON of version 1
    with a description of which at least least_words distinct words are not words of
    the name, and if its lines, both given and in order, lie within the text of its
    file (split at line feeds, counted from 1). Lines in which no function with a
    balanced body is found are kept whole as body, with balanced false. Nulls in any
    of these columns give no row, nor do files without a text; repeated nodes and
    sources change nothing; empty tables give an empty result; further columns are
    ignored.

    Texts and functions meet by path in one shuffle: in each task a text comes once,
    before its functions, and the functions pass by it, so nothing is gathered per
    file. One recursive pattern captures comment, signature and balanced body
    together, with strings, templates, regular expressions and comments protected;
    captures whose description is trivial are filtered there. A file of more than
    ``crowd`` functions is spread over several tasks, each with its text.
    """
    scratch = Scratch(nodes.sparkSession, "docpairs")
    functions = nodes.filter("type = 'function' and id is not null and file_path is not null and line_start >= 1 and line_start <= line_end")
    crowded = functions.groupBy(F.col("file_path").alias("busy")).agg(F.count("*").alias("n")).filter(F.col("n") > crowd)
    crowded = scratch.save(crowded.select("busy", F.ceil(F.col("n") / crowd).cast("int").alias("parts")), "crowded")
    doc = F.from_json("documentation", "version string, description string")
    wanted = functions.select("id", F.coalesce("name", F.lit("")).alias("name"), "file_path", "line_start", "line_end", doc.alias("doc"), F.get_json_object("documentation", "$.version").alias("v"))
    wanted = wanted.filter("v = '1' and doc.version = '1' and doc.description is not null").join(crowded, F.col("file_path") == F.col("busy"), "left")
    part = F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(0)).cast("int")
    asks = wanted.select(F.col("file_path").alias("path"), part.alias("part"), F.lit(1).alias("kind"), F.col("id").alias("node_id"), "name", F.col("doc.description").alias("description"), "line_start", "line_end")
    texts = sources.select("path", "text").filter("path is not null and text is not null").join(crowded, F.col("path") == F.col("busy"), "left")
    texts = texts.select("path", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), F.lit(0).alias("kind"), "text")
    rows = texts.unionByName(asks, allowMissingColumns=True).repartition("path", "part").sortWithinPartitions("path", "part", "kind")
    names = ["node_id", "name", "description", "comment", "signature", "body", "balanced", "code"]
    schema = pa.schema([(c, pa.bool_() if c == "balanced" else pa.string()) for c in names])

    def run(batches):
        at, known = None, {}
        for batch in batches:
            out: list[list] = [[] for _ in names]
            cols = [batch.column(c).to_pylist() for c in ("path", "kind", "text", "node_id", "name", "description", "line_start", "line_end")]
            for path, kind, text, node, name, description, first, last in zip(*cols):
                if path != at:
                    at, known = path, {}
                if kind == 0:
                    if text not in known:
                        known[text] = None
                    continue
                for body in known:
                    if known[body] is None:
                        known[body] = _Text(body)
                    cut = known[body].cut(first, last)
                    if cut is None:
                        continue
                    comment, signature, inner, balanced = capture(cut[0] + cut[1])
                    if len(words_of(description) - words_of_name(name)) < least_words:
                        continue  # a trivial capture
                    for values, value in zip(out, (node, name, description, comment, signature, inner, balanced, cut[1])):
                        values.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema)], schema=schema)

    pairs = rows.mapInArrow(run, ", ".join(f"{c} {'boolean' if c == 'balanced' else 'string'}" for c in names))
    return pairs.dropDuplicates()
