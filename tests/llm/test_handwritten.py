import random

import pytest

from graphloom.llm.authorship import signs, tokens
from graphloom.llm.handwritten import not_handwritten


def written(seed, n=25):
    rng = random.Random(seed)
    name = lambda: "".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(3))
    return "\n".join(f"export function {name()}({name()}Arg: any) {{\n  if ({name()}Arg.{name()} > {rng.randint(1, 99)}) {{\n    return {name()}({name()}Arg);\n  }}\n}}" for _ in range(n)) + "\n"


ROWS = {
    "r1/packages/p/src/hand.ts": (written(1), None),
    "r1/packages/p/src/ids.ts": ("// ids below are generated by pick at run time, do not edit them while it runs\n" + written(2), None),
    "r1/packages/p/src/steps.ts": ("const steps = [" + ", ".join(map(str, range(40))) + "];\n" + written(3, 3), None),
    "r1/packages/p/src/few.ts": ("const steps = [" + ", ".join(map(str, range(40))) + "];\n", None),
    "r1/packages/p/src/help.ts": ('export const help = "' + "some words of prose " * 60 + '";\n' + written(4, 2), None),
    "r1/packages/p/src/vendors/own.ts": (written(5), None),
    "r1/packages/p/src/api.ts": ("// Code generated by tool. DO NOT EDIT.\n" + written(6), "generated"),
    "r1/packages/p/src/de.ts": ("/* Diese Datei wurde von tool erzeugt. Nicht von Hand ändern. */\n" + written(7), "generated"),
    "r1/packages/p/src/fr.py": ("# Fichier produit par outil 1.2.3 ; toute modification sera perdue.\nx = 1\n", "generated"),
    "r1/packages/p/src/__generated__/n.ts": ("".join(f"export const a_{n:03}: number = {n};\n" for n in range(20)), "generated"),
    "r1/packages/p/src/t.js": ('"use strict";\nObject.defineProperty(exports, "__esModule", { value: true });\nvar __assign = (this && this.__assign) || function (t) { return t; };\n', "generated"),
    "r1/packages/p/src/m.js": ("(function(){" + "".join(f"var a{n}=b.c({n});if(a{n}){{d(a{n})}}" for n in range(60)) + "})();\n", "minified"),
    "r1/packages/p/src/d.ts": ("export const rows = [\n" + "".join(f'  [{n}, "name{n}", {n}.5],\n' for n in range(80)) + "];\n", "data"),
    "r1/packages/p/src/b.py": ('BLOB = "' + "QUJDREVGRw//+a" * 100 + '"\n', "data"),
    "r1/packages/p/src/broken.ts": ("// Code generated by tool. DO NOT EDIT.\nlet x = ;\n", None),
    "r1/packages/p/node_modules/x/dist/x.ts": (written(8), "vendored"),
    "r1/packages/p/src/empty.ts": ("", None),
    "r1/packages/p/readme.md": ("# generated", None),
}


def test_reasons(spark):
    lib = written(50, 40)
    rows = [("/srv/checkouts/" + p, t) for p, (t, _) in ROWS.items()]
    rows += [(f"/srv/checkouts/r{n}/packages/q/src/lib{n}.ts", f"// copy {n}\n" + lib.replace("export function", "export  function", n) + (f"export const own{n} = {n};\n" if n == 3 else "")) for n in (1, 2, 3)]
    rows += [("/srv/checkouts/r9/packages/q/src/lib.ts", lib + "let broken = ;")]
    rows += [(f"/srv/checkouts/r{n}/packages/q/src/pair.ts", written(60)) for n in (1, 2)]
    rows += [("/srv/checkouts/r1/packages/q/src/a.ts", written(61)), ("/srv/checkouts/r1/packages/q/src/b.ts", written(61))]
    rows += rows[:6] + [(None, "x"), ("/srv/checkouts/r1/x.ts", None)]
    got = not_handwritten(spark.createDataFrame([(p, t, "x") for p, t in rows], "path string, text string, reason string")).collect()
    assert len({r["path"] for r in got}) == len(got)
    expected = {"/srv/checkouts/" + p: why for p, (_, why) in ROWS.items() if why} | {f"/srv/checkouts/r{n}/packages/q/src/lib{n}.ts": "vendored" for n in (1, 2, 3)}
    assert {r["path"]: r["reason"] for r in got} == expected


def test_empty(spark):
    assert not_handwritten(spark.createDataFrame([], "path string, text string")).count() == 0
    assert pytest is not None


HAND = "import { a } from './b';\n\nexport function loadThing(name: string) {\n  const found = a(name);\n  if (!found) {\n    throw new Error(`no ${name}`);\n  }\n  return found.map((x) => x + 1);\n}\n" * 3


def judged(text, path="/srv/checkouts/r/a.ts"):
    code, head = tokens(text)
    return signs(path, text, code, head)


def test_heads_of_tools_and_what_only_sounds_like_them():
    for head in ("// 本文件由工具自动生成，请勿修改", "// 自動生成されたファイルです。編集しないでください", "// Produced with protoc-gen-ts", "// Code generated by mockery v2. DO NOT EDIT.", "/* @generated */", "// Этот файл сгенерирован, не редактируйте"):
        assert judged(head + "\n" + HAND)[0] == "generated", head
    for head in ("// Code generated by templates is checked in CI", "/* Handles machine-generated keys of users. */", "// Sends mail to the @generated list"):
        assert judged(head + "\n" + HAND) == (None, False), head
    assert judged("/*! Our graphs v1.2.3, licensed under MIT */\n" + HAND) == (None, True)


def test_minified_code_with_and_without_line_breaks():
    rng = random.Random(1)
    one = "".join(f"function {rng.choice('abcdefgh')}{rng.choice('xyz')}({rng.choice('tnre')},{rng.choice('ijk')}){{var o={rng.choice('tnre')}.{rng.choice(['length', 'map', 'x'])};return o?{rng.choice('tnre')}+{i}:void 0}}" for i in range(40))
    assert judged(one)[0] == judged("\n".join(one[i : i + 180] for i in range(0, len(one), 180)))[0] == judged(one[:400])[0] == "minified"
    assert judged(HAND)[0] is None


def test_tables_with_an_accessor_are_data():
    table = "export const TABLE = [\n" + "".join(f"  [{i}, {i * 7 % 13}, 'k{i}'],\n" for i in range(200)) + "];\n"
    assert judged(table)[0] == judged(table + "export function at(i) { return TABLE[i]; }\n")[0] == "data"
    assert judged("export const SIZES = [1, 2, 3, 5, 8];\n")[0] is None


def test_the_layout_of_repositories_is_a_parameter(spark):
    text = "".join(f"export function helper{i}(value) {{ return value.part{i}.map((x) => x * {i} + shift{i}); }}\n" for i in range(40))
    rows = [(f"/work/{r}/lib/util.js", text) for r in ("a", "b", "c", "d")] + [("/work/a/own.ts", HAND)]
    df = spark.createDataFrame(rows, "path string, text string")
    assert {r["path"] for r in not_handwritten(df, layout=r"^/work/([^/]+)/").collect()} == {p for p, _ in rows[:4]}
    assert not_handwritten(df).count() == 0
