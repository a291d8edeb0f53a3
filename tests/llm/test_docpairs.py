import json
import random
import time

from graphloom.llm.docpairs import capture, documented_functions

NODES = "id string, type string, name string, file_path string, line_start int, line_end int, documentation string, code string"


def doc(text, version=1):
    return json.dumps({"version": version, "description": text})


def test_capture_protects_strings_and_comments():
    code = '/** Says hi. */\nexport function hi(a: { b: string } = {}): string {\n  // } not this\n  const s = "}" + `${{}}` + \'{\';\n  return s;\n}\ntrailing'
    comment, signature, body, balanced = capture(code)
    assert comment == "/** Says hi. */" and "function hi" in signature and body.startswith("{\n  // }") and body.endswith("return s;\n}")
    comment, signature, body, balanced = capture('def f(a, b=")"):\n    """doc"""\n\n    return {\n    }\nx = 1')
    assert signature == 'def f(a, b=")"):' and body.rstrip().endswith("}") and "x = 1" not in body
    assert balanced and capture("no function") == ("", "", "no function", False) and capture("") == ("", "", "", False)
    assert capture("(" * 20000)[2] == "(" * 20000


def test_which_functions_count(spark):
    text = "/** Opens the old gate. */\nfunction openGate() {\n  return 1;\n}\n"
    good = ("function", "openGate", "/a.ts", 2, 4, doc("Opens the old wooden gate"))
    rows = [
        ("ok", *good), ("ok", *good), ("last", *good[:3], 5, 5, good[5]), ("class", "class", *good[1:]), ("two", *good[:5], doc("Opens the gate")), ("v2", *good[:5], doc("Opens the old wooden gate", 2)), ("text", *good[:5], "not json"), ("null", *good[:5], doc(None)),
        ("none", *good[:5], None), ("order", *good[:3], 4, 2, good[5]), ("zero", *good[:3], 0, 2, good[5]), ("far", *good[:3], 2, 6, good[5]), ("open", *good[:3], None, 2, good[5]), ("nofile", "function", "f", "/none.ts", 1, 1, good[5]), ("words", *good[:5], doc("über ÜBER straße 42, gate")),
    ]
    nodes = spark.createDataFrame([(*r, "x") for r in rows], NODES)
    sources = spark.createDataFrame([("/a.ts", text, "c"), ("/a.ts", text, "c"), ("/b.ts", None, "c")], "path string, text string, code string")
    found = {r["node_id"]: r for r in documented_functions(nodes, sources).collect()}
    assert set(found) == {"ok", "last", "words"}
    assert found["ok"]["comment"].strip() == "/** Opens the old gate. */" and found["ok"]["body"] == "{\n  return 1;\n}" and found["last"]["code"] == ""
    assert documented_functions(nodes.limit(0), sources).count() == 0 and documented_functions(nodes, sources.limit(0)).count() == 0


def test_comments_of_files_with_crlf_are_kept(spark):
    text = "/** Opens the old gate. */\r\nfunction openGate() {\r\n  return 1;\r\n}\r\n"
    nodes = spark.createDataFrame([("n", "function", "openGate", "/a.ts", 2, 4, doc("Opens the old wooden gate"), "x")], NODES)
    row = documented_functions(nodes, spark.createDataFrame([("/a.ts", text)], "path string, text string")).first()
    assert row["comment"] == "/** Opens the old gate. */" and row["body"] == "{\r\n  return 1;\r\n}"
    assert capture("\r\n" + text)[0].strip() == "/** Opens the old gate. */"


def test_capture_takes_time_in_proportion_to_the_text():
    began = time.perf_counter()
    for piece in ("(", "{", "{`${", "/*", '"', "'", "`", "${", "{(`", "/[", "/a", "{'", "\\", "a => (", '"""', "def f(", "/** ", "=/"):
        capture(piece * (200_000 // len(piece)))
        capture("function f(a) {" + piece * (60_000 // len(piece)) + "\n}")
    assert time.perf_counter() - began < 20


def test_the_skeleton_gives_the_same_parts():
    rng = random.Random(7)
    pieces = ["(", ")", "{", "}", '"', "'", "`", "${", "/", "*", "/*", "*/", "//", "\n", "a", " ", "=", "[", "]", "\\", "def f(", "/** d */", "function f(a) {", ":", "    ", "@d\n"]
    known = 0
    for n in range(30_000):
        code = rng.choice(["", "function f(a) {", "def f(a):", "/** d */ f(", "@d\ndef f("]) + "".join(rng.choices(pieces, k=rng.randint(0, 25))) + rng.choice(["", "}", "}\n"])
        short, long = capture(code), capture(code, whole=0)
        assert short == long, code
        known += short[3]
    assert known > 3000


def test_the_pattern_finds_regular_expressions_and_nested_templates():
    code = "function f(a = /[)`]/) {\n  return a.match(/[{'`\"]/) || `${`${a}}`}`;\n}\nrest"
    comment, signature, body, balanced = capture(code)
    assert balanced and signature == "function f(a = /[)`]/) " and body.startswith("{\n  return") and body.endswith(";\n}")
    assert capture("function f() {\n  return 1;\n")[3] is False


def test_a_crowded_file_is_spread_and_a_trivial_description_filtered(spark):
    text = "/** Opens the old gate. */\nfunction openGate() {\n  return 1;\n}\n" * 3
    rows = [(f"n{i}", "function", "openGate", "/a.ts", 2, 4, doc("Opens the old wooden gate" if i % 2 else "open the Gate"), "x") for i in range(40)]
    nodes, sources = spark.createDataFrame(rows, NODES), spark.createDataFrame([("/a.ts", text, "c")], "path string, text string, code string")
    for crowd in (3, 1000):
        found = documented_functions(nodes, sources, crowd=crowd).collect()
        assert sorted(r["node_id"] for r in found) == sorted(f"n{i}" for i in range(1, 40, 2))
        assert {(r["comment"], r["balanced"]) for r in found} == {("/** Opens the old gate. */", True)}
