"""Short texts for the syntax tests; those of Python are judged by the interpreter itself."""

import itertools

_TARGETS = ["a", "a.b", "a[0]", "a[1:2]", "a.b[0].c", "f().x", "f()[0]", "(a)", "((a))", "(a.b)", "a, b", "a,", "(a, b)", "(a,)", "()", "[]", "[a, b]", "[a, *b]", "*a, b", "a, *b", "(a, [b, c])", "f()", "f(1)", "a.f()", "1", "'a'", "b'a'", "None", "True", "...", "a + b", "-a", "not a", "a if b else c", "lambda: 1", "(yield)", "{a: b}", "{a}", "{}", "[1]", "(1,)", "(f(), a)", "a < b", "await a", "f''", "(a := 1)", "[a for a in b]", "a and b", "(*a)", "(*a,)", "(a)(b)", "(a).b", "'x'.y", "f(a)(b).c"]
_FORMS = ["{} = 1", "{} += 1", "{}: int", "{}: int = 1", "del {}", "for {} in x: pass", "with a as {}: pass", "[1 for {} in x]", "x = {} = 1", "async def f():\n async for {} in x: pass", "({} := 1)"]
_ARGUMENTS = ["", "a", "a,", "a, b", "a=1", "a=1, b", "a=1, *b", "*a", "*a, b", "**a", "**a, b", "**a, *b", "**a, b=1", "*a, b=1, **c", "a for a in b", "a for a in b, c", "c, a for a in b", "(a for a in b), c", "a := 1", "a=b=1", "a.b=1", "1=2", "None=1", "a, *b, c=1, *d, **e", "*a, *b", ",", "a,,b", "*", "**", "a b", "lambda: 1", "lambda x: x, y", "a if b else c", "*a for a in b", "yield", "(yield)", "a=yield", "f(a=1, b)", "x=(a for a in b)"]
_PARAMETERS = ["", "a", "a,", "a, b", "a=1", "a=1, b", "a=1, b=2", "a, b=1, c", "*a", "*a, b", "*a, b=1, c", "*", "*,", "*, a", "*, a=1, b", "**k", "**k,", "**k, a", "**k, *a", "*a, **k", "*a, *b", "a, /", "a, /, b", "a=1, /, b", "a=1, /, b=2", "/", "/, a", "a, /, b, /", "a, *, b, /", "*a, /", "a, b=1, /, c=2, *, d, e=3, **f", "a.b", "1", "None", "(a, b)", "a,, b", "*, **k", "*a=1", "**k=1", "a, /, *, b"]
_VALUES = ["a ** -b", "not a", "a not in b", "a is not b", "a = b", "a == b == c", "a <> b", "a ! b", "a ? b : c", "a ? b", "a && b", "a || b", "!a", "~a", "a @ b", "a // b", "a if b", "a else b", "lambda", "lambda x=1: x", "lambda x=1, y: x", "lambda *, x: x", "lambda *: x", "lambda *a, **k: 1", "lambda (a): 1", "lambda a, /: a", "x.1", "1.x", "1..x", "1.e5", "1e", "0x", "0xg", "0b12", "0o8", "0777", "00", "1_000", "1__0", "1_", "0_7", "1j", "1L", "'a' 'b'", "'a' b'b'", "b'a' b'b'", "b'é'", "'\\x1'", "'\\x12'", "'\\u123'", "r'\\x1'", "'\\N{DIGIT ONE}'", "'\\Nx'", "f'{a}'", "f'{a!r}'", "f'{a!z}'", "f'{a:>{b}}'", "f'{'", "f'}'", "f'{}'", "f'{a b}'", "f'{a=}'", "f'{{}}'", "rb'a'", "bu'a'", "ur'a'", "[a, b", "a, b]", "[a for b in c if d]", "[a for b in c if d else e]", "{a: b for a in c}", "{**a}", "{**a for a in b}", "{a: b, c}", "{a, b: c}", "{a: *b}", "{*a, b}", "(a b)", "a[b:c, d]", "a[]", "a[:]", "a[b:c:d:e]", "a[*b]", "a[b=c]", "a.b.c", "a..b", "a.(b)", ".a", "await a", "yield a", "x := 1", "(x := 1)", "(x.y := 1)", "*a", "(*a)", "*a, b", "a, b,", ",", "a,, b", "...", "a.....b", "print a", "print(a)", "exec 'a'", "`a`", "$a", "a$", "a\\\nb", "(a\nb)", "(a,\nb)", "None", "none", "async", "nonlocal", "class", "é", "a²", "ａ"]
_LINES = [
    "if a: b\nelse: c", "if a: b\nelif c: d\nelse: e", "else: a", "elif a: b", "if a:\nb", "if a:\n b\n  c", "if a:\n  b\n c", "if a: if b: c", "if a: b; c", "if a: pass;", ";", "a;;b", "a;", "while a: b\nelse: c", "for a in b: c\nelse: d", "try: a\nexcept: b", "try: a\nfinally: b", "try: a", "try: a\nexcept B as c: d\nelse: e\nfinally: f", "try: a\nelse: b", "try: a\nexcept B, c: d",
    "try: a\nexcept (B, C): d", "try: a\nexcept* B: c", "try: a\nexcept B as c.d: e", "except: a", "finally: a", "with a: b", "with a, b as c: d", "with (a as b, c as d): e", "with (a as b, c as d,): e", "with a as b as c: d", "with: a", "def f(): pass", "def f: pass", "def f()", "def f(): \n", "def f() -> int: pass", "def f() - > int: pass", "def 1f(): pass", "def f(a) b: pass", "async def f(): await a", "async f(): pass",
    "class A: pass", "class A(): pass", "class A(B, metaclass=C): pass", "class A(B, metaclass=C, D): pass", "class A(B for B in C): pass", "class A B: pass", "class 1: pass", "@a\ndef f(): pass", "@a\nclass B: pass", "@a\nb", "@a.b(c)[d]\ndef f(): pass", "@\ndef f(): pass", "import a", "import a.b as c, d", "import a.b.", "import .a", "import a as b.c", "from a import b", "from a import b as c, d", "from a import (b, c)", "from a import (b, c,)", "from a import b,", "from a import *",
    "from a import (*)", "from . import a", "from .a import b", "from ...a import b", "from .... import b", "from a import", "from import a", "from a.b import c.d", "global a, b", "global a.b", "global", "nonlocal a", "return", "return a, *b", "return *a", "raise", "raise A from b", "raise A, b", "raise from b", "assert a", "assert a, b", "assert a, b, c", "assert", "pass", "pass a", "break", "continue", "break a", "del a, b", "del a,", "del", "del (a, b), c", "del *a", "yield", "yield from a", "yield from", "x = yield", "x = yield from a", "x += yield",
    "match a:\n case b: c", "match a:\n case 1 | 2: c", "match a:\n case [b, *c] if d: e", "match a:\n case {'b': c, **d}: e", "match a:\n case B(c, d=e): f", "match a:\n case b.c: d", "match a:\n b", "match a: b", "match = 1", "match(a)", "case = 1", "match a:\n case _: pass\n case b: pass", "match a, b:\n case (c, d): e", "type A = int", "type A[T] = list[T]", "type = 1", "type(a)", "def f[T](a: T): pass", "class A[T, *U, **V]: pass", "class A[]: pass",
    "\tif a:\n\t\tb", "if a:\n\tb\n        c", "if a:\n        b\n\tc", "if a:\n    b\n\tc", "if a:\n\tif b:\n\t    c\n\t    d", "if a:\n \tb\n\tc", "if a:\n    if b:\n\tc", "# a", "\n\n", "  # a\nb", "  b", "a\n  b", "a = (\n1\n)", "a = (\n1\n", "a = [1, 2\nb = 3", "'''a", "'''a\n'''", "'a\nb'", "'a\\\nb'", "a = 'b", 'a = "b\'', "if (a:\n  b", "if a): b", "if a}: b", "a = {1, 2)", "x = 5 +", "x = + 5", "x = * 5", "x == 1", "x = = 1", "=", "= 1", "x =", "a b", "a b c", "1 2", "'a' c", "for a: b", "for a in: b", "for in b: c", "while: a", "if: a", "if a = b: c", "if a := b: c", "if (a := b): c", "while a := b: c",
    "for a in *b, c: d", "for a in b, c: d", "for a, in b: c", "x: int", "x: int = 1", "x: int = 1, 2", "x: int: str", "a, b: int", "def f(a: int = 1, *b: str, **c: dict) -> None: pass", "def f(a: int b): pass", "const x = 1", "let x = 1", "var x", "function f() {}", "x++", "++x", "x--", "a && b", "// a", "/* a */", "<<<<<<< HEAD", "=======", ">>>>>>> a", "import React from 'react'", "export default a", "if a then b", "end", "print 'a'", "print", "a = b c", "def f(self, x) {", "}", "return x }", "x = [i for i in]", "x = [for i in y]", "x = {a: }", "x = {: a}", "a.b = c.d()", "a.b() = c", "a[b]() = c", "a().b = c", "a()[b] = c", "a, b() = c", "[a, b()] = c", "(a, 1) = c", "a = 1 = b", "a = b() = c", "f() += 1", "a, b += 1", "[a] += 1", "(a) += 1", "a.b += 1", "a[0]: int = 1", "(a): int = 1", "[a]: int = 1", "f(): int",
]


def python_snippets() -> list[str]:
    out = [f.format(t) for f, t in itertools.product(_FORMS, _TARGETS)]
    out += [f"f({a})" for a in _ARGUMENTS] + [f"class A({a}): pass" for a in _ARGUMENTS[:12]]
    out += [f"def f({p}): pass" for p in _PARAMETERS] + [f"lambda {p}: 0" for p in _PARAMETERS]
    out += [form.format(v) for v in _VALUES if "{" not in v and "}" not in v for form in ("x = {}", "f({})", "[{}]")]
    return out + ["x = " + v for v in _VALUES if "{" in v or "}" in v] + _LINES


#: What can be assigned to in a script, what cannot, and the places of an assignment.
_PLACES = ["a", "a.b", "a[0]", "f().a", "f()[0]", "a.b.c", "(a)", "(a.b)", "this.a", "new A().b", "a.if", "`x`.y", "a.b(c).d", "(f()).a"]
_VALUES_ONLY = ["f()", "a.f()", "1", "'a'", "null", "this", "(a + b)", "a?.b", "a?.[0]", "new A()", "(f())", "`a`", "/a/", "(x => y)", "a[0]()", "function () {}"]
_ASSIGNED = ["x = {} = 1", "x = {} += 1", "x = {}++", "x = --{}", "for ({} of x) ;", "[{}] = x", "({{a: {}}} = x)", "[...{}] = x"]
BAD_JS = [
    "const x;", "f() = 1", "0++", "(...a, b) => 1", "function f(...a, b){}", "({get a(x){}})", "({set a(){}})", "/(/", "a ?? b || c", "a && b ?? c", "-1 ** 2", "++f()", "f()++",
    "[...a, b] = c", "let {a, ...b, c} = d", "let [a];", "const {a};", "a + b = c", "a?.b = 1", "(a, b) = 1", "(f()) = 1", "for (f() of x) ;", "this = 1", "true = 1", "'a' = 1",
    "`a` = 1", "/a/gg", "/a/x", "/+/", "new f() = 1", "a.b() = 1", "[f()] = x", "({a: f()} = x)", "typeof a ** 2", "!a ** 2", "function f(a, ...b,){}", "[...a,] = b", "super = 1",
    "x => {} = 1", "a++ = 1", "++a++", "a ? b : c = d = 1 = 2",
]
GOOD_JS = [
    "a => {}\n(b)", "(a) = 1", "(a.b) = 1", "[a, b] = [b, a]", "[a.b, c[0], ...d] = e", "({a, b: c.d, ...e} = f)", "({a = 1} = b)", "f(x)[0] = 1", "f().a = 1", "a.b.c++", "a[0]--",
    "++a[0]", "(-1) ** 2", "2 ** -1", "a ** b ** c", "(a ?? b) || c", "a ?? (b || c)", "a ?? b ?? c", "a || b && c", "a.if = 1", "a.this = 1", "if (a) [b] = c", "if (a) (b) = c",
    "for ([a, b] of c) ;", "for (a.b of c) ;", "for (const [a, b] of c) ;", "for (const a in b) ;", "for (let i = 0, n = 1; i < n; i++) ;", "const {a, ...b} = c", "let a, b = 1",
    "var {a} = b, [c] = d", "({get a(){}, set a(b){}, get: 1, set: 2, get(){}, async a(){}})", "class A { get a(){} set a(b){} static get c(){} get(){} set(a){} static async *d(){} }",
    "/[(]/", "/\\(/", "/(?:a)(?=b)(?<!c)(?<n>d)/giu", "/a+?b*?c??/", "/a{1,2}/", "x = y = z", "x += y -= 1", "a ??= b", "[a = 1, [b]] = c", "({[a]: b} = c)", "delete a.b", "await a",
    "async () => { await a ** 2 }", "(a, b) => a", "({...a, b} )", "f(...a, b)", "[...a, b]", "let async; async = 1", "(async)[0] = 1", "a\n++b", "{ a }\n[b] = c",
    "x = function(){}\n(b)", "for (a of b) c\n", "while(a) (b)++", "new A().b = 1", "new A()[0] = 1", "`${a}`.b = 1", "this.a = 1", "super_.a = 1", "a = b ? c : d",
    "a = b ? (c) : d => e", "let [] = a, {} = b", "[, a] = b", "[a, , b] = c", "({} = a)", "[] = a", "export const a = 1", "for (var a = 0; ; ) ;", "label: for (;;) break label",
]
GOOD_TS = [
    "a! = 1", "a!.b = 1", "(a as any) = 1", "(a as any).b = 1", "(<any>a).b = 1", "declare const x: number", "const x: number = 1", "function f(this: A, a?: B, ...c: D[]): E {}",
    "let x!: number", "a! += 1", "a![0]++", "class A { constructor(private readonly a: B, public c = 1) {} get x(): number { return 1 } set x(v: number) {} }",
    "const f = <T,>(a: T, ...b: T[]): T => a", "for (const a of b as C[]) {}", "x = a as B ?? c", "x = y satisfies Z", "abstract class A { abstract get a(): B; abstract set a(b: B) }",
    "type F = (a: number, ...b: string[]) => void", "interface A { (a: B, ...c: D[]): E; new (...a: B[]): C }", "export abstract class A<T> { protected a?: T }",
    "let {a, b}: {a: A, b: B} = c", "function f({a, b}: C = {}) {}", "enum A { B = 1 << 0, C }", "x = <T>y", "let a = b! as C",
]
BAD_TS = [
    "f() = 1", "a ?? b || c", "-1 ** 2", "function f(...a: A[], b: B){}", "let x: = 1", "0++", "a?.b = 1", "class A { x: }", "(a, ...b, c) => 1", "const [...a, b] = c",
]


def script_snippets() -> dict[str, list[tuple[str, bool]]]:
    """Texts of each dialect, with whether they are valid."""
    shared = [(f.format(p), ok) for f in _ASSIGNED for some, ok in ((_PLACES, True), (_VALUES_ONLY, False)) for p in some]
    js = shared + [(t, True) for t in GOOD_JS] + [(t, False) for t in BAD_JS]
    typed = [(f.format(p), True) for f in _ASSIGNED for p in ("a!", "a!.b", "a![0]", "(a as B)", "(<B>a)", "(a as B).c")]
    return {"js": js, "ts": shared + typed + [(t, True) for t in GOOD_JS + GOOD_TS] + [(t, False) for t in BAD_TS]}
