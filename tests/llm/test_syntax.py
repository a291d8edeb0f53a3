import ast
import glob
import sysconfig
import warnings

import pytest

from graphloom.llm.syntax import error_rates, first_error, parser, syntax_errors, unreliable_notes

from .snippets import python_snippets, script_snippets

JS = """const a = 1;\nlet b = a ? (x) : y => z\nfoo()\n[1,2].map(x => x*2)
====
for (const x of y) { x += 1 }
====
export default class extends A { #p = 1; static async *gen() { yield* x } get a() { return 1 } set a(v) {} static { init() } }
====
a = b / c / d; e = /re[/]g/g.test(x)
====
const {a, b: {c = 1} = {}, ...r} = q, [d,,e=2,...f] = z
====
`a ${b + `c ${d}` } e`
====
import a, {b as c, default as d} from 'x'; import * as q from "y"; import 'z'\nexport {a as b, c}; export * as ns from 'r'
====
async () => { await x; for await (const a of b); }
====
({a: 1, 'b': 2, [c]: 5, d() {}, get e() { return 1 }, async *f() {}, ...g, h}); ({a = 1} = b)
====
if (a)\n  b()\nelse\n  c()
====
!function(){var a=1;return a}(); var q=(()=>{"use strict";return!0})()
====
const s = 'it\\'s' // }\n/* ( */
====
#!/usr/bin/env node\nfoo()
====
const t = `\n<<<<<<< ours\n`
""".split("====\n")
TS = """interface A<T extends B = C> extends D, E<F> { a: string; b?: number, readonly c: T[]\n d(): void; [k: string]: any; new (x: number): A }
====
type A = { [K in keyof T]?: T[K] } & B | C; type D<T> = T extends Array<infer U> ? U : never
====
abstract class A<T> extends B<T> implements C, D { private readonly x: number = 1; constructor(private a: string) { super() } abstract foo(): void; foo(a): void\n foo(a, b) {} }
====
let a = b as unknown as string; let c = <string>d; let e = f!.g![0]!
====
function f<T>(this: Window, a: T): a is string { return true }\nfunction over(a: string): void;\nfunction over(a: any) {}
====
namespace A.B { export const x = 1 }\ndeclare module 'x' { export default y }\nenum E { A = 1, B }
====
foo<string>(x); new Map<string, Array<number>>(); a < b; c > d; let f: new (...a: any[]) => T
====
@Dec() class A { @Input() x: string; m(@P() p: string) {} }
""".split("====\n")
TSX = """const a = <div className="x" onClick={() => f('y')}>Don't {b} <B.C x={1}/> <></> {/* c */}</div>;
====
const f = <T,>(x: T) => x; while (x.switch < 4) { y() }
""".split("====\n")
BAD = {
    "js": ["const a = ;", "foo(", "foo)", "{", "}", "const x: number = 1", "interface A { }", "function f(a: any) {}", "<div/>", "<<<<<<< HEAD\na\n=======\nb\n>>>>>>> x", "# Title\n\nSome text here", "def f(x):\n  return x", "'open", "`open ${", "/* open", "var 1a = 2", '{"a": 1, "b": 2}', "<!DOCTYPE html>\n<html></html>", "const a = 1 const b = 2", "function () {}"],
    "ts": ["const a: = 1", "const C = () => <div>hi</div>", "class A { x: }", "interface { }", "import sys\n\ndef f():\n    pass"],
    "tsx": ["const a = <div>", "const a = <div></span>", "const x = <string>y;", "const a = (<div>hello"],
    "py": ["def f(:\n pass", "x = = 1", "print 'a'", "def f():\nreturn 1", "  x = 1", "try:\n  x\ny", "x = (1", "'''abc", "1abc = 2", "<<<<<<< HEAD\nx", "const x = 1;", "@d\nx = 1", "if a:\n", "f'{a'"],
    "json": ["", "{", '{"a": 1,}', "[1, 2,]", "{'a': 1}", '{"a": NaN}', '{"a": 01}', "// c\n{}", '{"a": "\n"}', "[1] x", '"\\x"'],
}
GOOD = {"js": JS, "ts": TS, "tsx": TSX, "py": ["", "# c\n\n\t\n", "match x:\n    case [a, *b] if a: pass\nmatch = 1\n", "x = [a for a in b if a]\nf(*a, **b)\n", "a = f\"{d['x']}\" f'{x!r:>{w}}'\n"], "json": ["{}", "[]", "1", '"a"', ' {"a": [1, -2.5e3, {"b": null}], "a": "\\u00e9"} ', "true"]}


@pytest.mark.parametrize("dialect", sorted(GOOD))
def test_valid_and_broken_texts(dialect):
    for text in GOOD[dialect]:
        assert parser(dialect).fault(text) is None, text
    for text in BAD[dialect]:
        assert parser(dialect).fault(text) is not None, text


def test_python_agrees_with_the_interpreter():
    warnings.simplefilter("ignore")
    for file in sorted(glob.glob(sysconfig.get_paths()["stdlib"] + "/*.py"))[:60]:
        text = open(file, errors="replace").read()
        ast.parse(text)
        assert parser("py").fault(text) is None, file
        cut = text[: len(text) // 2 + 7]
        try:
            ast.parse(cut)
            valid = True
        except SyntaxError:
            valid = False
        assert (parser("py").fault(cut) is None) == valid, file


def test_places_and_deep_nesting():
    assert first_error("a.JS", "a();\nb();\nlet x = ;\n")[0] == 3
    deep = "function a() {\n" * 3000 + "}\n" * 3000
    assert first_error("a.ts", deep) is None and first_error("a.ts", deep[:-2]) is not None
    assert first_error("a.json", "[" * 5000 + "]" * 5000) is None


def test_flags_rates_and_notes(spark):
    r = "/srv/checkouts/one/packages/p/"
    rows = [(r + "a.ts", "let x = 1", "v"), (r + "b.TS", "let x =", "v"), (r + "b.TS", "let x =", "v"), (r + "c.md", "# x", "v"), (r + "d.py", None, "v"), (None, "x", "v"), (r + "e.mjs", "", "v")]
    found = syntax_errors(spark.createDataFrame(rows, "path string, text string, valid string"))
    assert {(x["path"], x["valid"]) for x in found.collect()} == {(r + "a.ts", True), (r + "b.TS", False), (r + "e.mjs", True)}
    assert {tuple(x)[:4] for x in error_rates(found).collect()} == {("one", "ts", 2, 1), ("one", "mjs", 1, 0)}
    files = spark.createDataFrame([(r + "a.ts", "boom", 2), (r + "a.ts", None, 1), (r + "b.TS", None, 1)], "path string, errors string, indexed_at bigint")
    assert {tuple(x) for x in unreliable_notes(found, files).collect()} == {(r + "a.ts", True, True), (r + "b.TS", False, False)}
    assert syntax_errors(spark.createDataFrame([], "path string, text string")).count() == 0


def test_python_snippets_agree_with_the_interpreter():
    warnings.simplefilter("ignore")
    texts = python_snippets()
    assert len(texts) > 1000
    for text in texts:
        try:
            ast.parse(text)
            valid = True
        except (SyntaxError, ValueError):
            valid = False
        assert (parser("py").fault(text) is None) == valid, text


@pytest.mark.parametrize("dialect", ["js", "ts"])
def test_script_snippets(dialect):
    texts = script_snippets()[dialect]
    assert len(texts) > 300
    for text, valid in texts:
        assert (parser(dialect).fault(text) is None) == valid, text


def test_deep_nesting_is_no_fault():
    assert first_error("a.js", "x = " + "- " * 30_000 + "1;") is None and first_error("a.js", "x = " + "- " * 30_000 + ";") is not None
    assert first_error("a.json", "[" * 20_000 + "]" * 20_000) is None
    assert first_error("a.js", "x = " + "a ? " * 8_000 + "b" + " : c" * 8_000 + ";") is None
