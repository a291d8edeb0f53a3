import datetime
import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from graphloom.functions.paths import file_group, filter_glob, glob_regex, relative_path
from graphloom.operators import affected, audit, freshness, ingest, legacy, resolve, scan, search, stats, traverse, update
from graphloom.operators.graph import clean_edges, clean_nodes
from graphloom.operators.search_index import SearchIndex, indexed_search
from graphloom.plans import shell
from graphloom.sources import project
from graphloom.sources.hooks import install_hooks
from graphloom.sources.store import SnapshotStore
from graphloom.sources.typescript import read_file
from graphloom.streaming import observations

NODES = "id string, type string, name string, file_path string, line_start int, line_end int, summary string, documentation string, tags string, complexity string, package_id string"
EDGES = "id bigint, source string, target string, type string, direction string, weight double, metadata string"


def graph(spark, links, kinds=None):
    names = sorted({x for a, b, *_ in links for x in (a, b)})
    kinds = kinds or {}
    nodes = spark.createDataFrame([(n, kinds.get(n, "function"), n, f"/p/{n}.ts", 1, 2, None, None, None, None, "pk") for n in names], NODES)
    edges = spark.createDataFrame([(i, a, b, t[0] if t else "calls", "forward", 1.0, None) for i, (a, b, *t) in enumerate(links)], EDGES)
    return clean_nodes(nodes), clean_edges(edges)


def hops(df):
    return sorted((r["hops"], r["node_id"]) for r in df.collect())


def test_upstream_guard_lags_by_one(spark):
    n, e = graph(spark, [("S1", "R"), ("S2", "S1"), ("S2", "S2"), ("S3", "S2")])
    assert hops(traverse.dependencies(n, e, "R", depth=4)) == [(1, "S1"), (2, "S2"), (3, "S2"), (3, "S3"), (4, "S3")]


def test_downstream_paths_are_simple_and_parallel_edges_count(spark):
    n, e = graph(spark, [("a", "b"), ("a", "b"), ("b", "a"), ("b", "c")])
    assert hops(traverse.dependencies(n, e, "a", True, 3)) == [(1, "b"), (1, "b"), (2, "c"), (2, "c")]
    assert hops(traverse.dependencies(n, e, "nobody", True, 3)) == []


def test_callers_filter_the_first_level_only(spark):
    n, e = graph(spark, [("k", "r"), ("f", "r"), ("k2", "f"), ("x", "r", "renders")], {"k": "class", "k2": "class"})
    assert hops(traverse.callers(n, e, "r", 2)) == [(1, "f"), (2, "k2")]


def test_shortest_path(spark):
    n, e = graph(spark, [("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("d", "e"), ("s", "s")])
    assert traverse.shortest_path(e, "a", "e").first()["path"] == ["a", "b", "d", "e"]
    assert traverse.shortest_path(e, "e", "a").count() == 0 and traverse.shortest_path(e, "a", "a").count() == 0
    assert traverse.shortest_path(e, "s", "s").first()["hops"] == 1


def test_impact_walk_caps_and_is_deterministic(spark):
    links = [(f"n{i:02}", "r") for i in range(60)] + [("r", "z"), ("r", "r")]
    n, e = graph(spark, links)
    a, b = (traverse.impact_walk(n, e, "r").collect() for _ in range(2))
    assert a == b and len(a) == 50 and all(r["truncated"] for r in a)
    small = traverse.impact_walk(n, e, "z", depth=1).collect()
    assert [(r["source"], r["target"], r["direction"], r["truncated"]) for r in small] == [("r", "z", "upstream", False)]


def test_affected_reaches_files_and_echoes_unknown_ones(spark):
    n, e = graph(spark, [("file:/p/t.test.ts", "file:/p/a.ts", "imports"), ("file:/p/b.ts", "file:/p/t.test.ts", "imports")], {k: "file" for k in ("file:/p/a.ts", "file:/p/b.ts", "file:/p/t.test.ts")})
    n = n.withColumn("file_path", F.regexp_replace("id", "^file:", ""))
    changed = spark.createDataFrame([("/p/a.ts",), ("/p/gone.ts",), (None,)], "path string")
    rows = affected.report(n, e, changed.filter("path is not null")).collect()
    assert [(r["file_path"], r["file_group"], len(r["paths"])) for r in rows] == [("/p/t.test.ts", "tests", 1), ("/p/b.ts", "other", 1), ("/p/gone.ts", "other", 0)]
    near = traverse.reached(e, spark.createDataFrame([("file:/p/a.ts",)], "node string"))
    assert {(r["node"], r["hops"]) for r in near.collect()} == {("file:/p/a.ts", 0), ("file:/p/t.test.ts", 1), ("file:/p/b.ts", 2)}


def test_resolution_ladder(spark):
    n, _ = graph(spark, [("alpha", "ALPHA"), ("alphabet", "beta")])
    found = lambda w: sorted((r["id"], r["tier"], r["verdict"]) for r in resolve.resolve_node(n, w).collect())
    assert found("alpha") == [("alpha", 0, "single")]
    assert found("Alpha") == [("ALPHA", 1, "ambiguous"), ("alpha", 1, "ambiguous")]
    assert found("phab") == [("alphabet", 2, "single")] and found("zz") == []
    assert resolve.resolve_root(n, "/p/unknown.ts").first()["id"] == "file:/p/unknown.ts"
    assert resolve.resolve_root(n, "function:beta").first()["tier"] == 1


def test_search(spark):
    rows = [("1", "function", "validateToken", "/a/x.ts", 1, 1, "Über ledger book", None, '["exported"]', None, None), ("2", "class", "Token", "/a/token.ts", 1, 1, None, None, None, None, None)]
    n = clean_nodes(spark.createDataFrame(rows, NODES))
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(search.phrase_search(n, "Token")) == ["2"] and ids(search.phrase_search(n, "ledger bo")) == ["1"] and ids(search.phrase_search(n, "--")) == []
    assert ids(search.like_search(n, "token")) == ["2", "1"] and ids(search.search(n, "ateTok")) == ["1"] and ids(search.like_search(n, "e%r", "function")) == ["1"]


def test_statistics_and_audits(spark):
    n, e = graph(spark, [("a", "b", "imports"), ("c", "b", "imports"), ("a", "gone"), ("a", "class:*:X"), ("x", "y")])
    n = n.filter("id not in ('gone', 'y', 'x', 'class:*:X')")
    assert stats.top_imported(n, e).first()["n"] == 2
    assert {(r["edge_id"], r["missing"]) for r in audit.orphan_edges(n, e).collect()} == {(2, "target"), (4, "both")}
    assert ingest.placeholders(n, e).collect()[0][:3] == ("class:*:X", "class", "X")
    assert audit.documentation_issues(n, include_internal=True).groupBy("issue").count().collect()[0][:] == ("missing_jsdoc", 3)
    assert update.update_counters(n, e, spark.createDataFrame([("/p/a.ts",), ("/p/b.ts",)], "path string")).first()[:] == (2, 5)
    assert stats.packages(n).first()[:] == ("pk", 3)


def test_freshness(spark):
    cols = "path string, digest string, size bigint, modified_at bigint"
    old = spark.createDataFrame([("a", "1", 1, 1), ("b", "1", 1, 1), ("c", "1", 1, 1), ("d", "1", 1, 1)], cols)
    now = spark.createDataFrame([("a", "1", 1, 1), ("b", "2", 1, 1), ("d", None, 1, 1)], cols)
    assert {tuple(r) for r in freshness.stale_files(old, now).collect()} == {("b", "modified"), ("c", "deleted"), ("d", "unknown")}
    assert freshness.file_status(old, now, "zz").first()["status"] == "missing" and freshness.file_status(old, now, "a").first()["status"] == "current"
    assert {p: freshness.file_status(old, now, p).first()["status"] for p in "bcd"} == {"b": "stale", "c": "missing", "d": "missing"}


def test_documentation_issues_against_declared_parameters(spark):
    doc = {"version": 1, "hasJsDoc": True, "description": "", "params": [{"name": "a", "description": ""}, {"name": "x", "description": "y"}], "tags": [{"name": "see", "text": "b"}, {"name": "see", "text": "b"}, {"name": "odd", "text": "b"}]}
    rows = [("f", "function", "f", "/p.ts", 1, 1, None, json.dumps(doc), '["exported"]', None, None), ("g", "function", "g", "/q.ts", 1, 1, None, json.dumps(doc | {"hasJsDoc": False}), '["public"]', None, None), ("h", "function", "h", "/gone.ts", 1, 1, None, json.dumps(doc | {"description": "d", "tags": []}), '["public"]', None, None), ("i", "function", "i", "/p.ts", 1, 1, None, None, "[]", None, None), ("j", "function", "j", "", 1, 1, None, None, '["public"]', None, None)]
    n = clean_nodes(spark.createDataFrame(rows, NODES))
    declared = spark.createDataFrame([("f", ["a", "b"]), ("g", []), ("h", None)], "id string, params array<string>")
    found = lambda *x: sorted((r["id"], r["issue"], r["subject"]) for r in audit.documentation_issues(n, *x).collect())
    plain = [("f", "duplicate_tag", "see"), ("f", "extra_tag", "odd"), ("f", "missing_description", None), ("g", "missing_jsdoc", None)]
    assert found() == plain
    more = [("f", "extra_tag", "x"), ("f", "mismatched_param", "a"), ("f", "missing_param", "b"), ("h", "unsupported_form", None)]
    assert found(declared) == sorted(plain + more, key=lambda r: (r[0], r[1], r[2] or ""))


def test_impact_walk_equals_a_walk_by_hand(spark):
    rng = random.Random(11)
    names = [f"n{i:02}" for i in range(14)]
    for root in ("n00", "file:/p/a.ts"):
        pairs = sorted({(rng.choice(names), rng.choice(names)) for _ in range(30)}) + [("file:/p/a.ts", n) for n in names[:3]]
        links = [(a, b, "contains" if a.startswith("file:") else rng.choice(["calls", "imports"])) for a, b in pairs]
        n, e = graph(spark, links, {"file:/p/a.ts": "file"})
        stored = [tuple(r) for r in e.select("edge_id", "edge_type", "source", "target").collect()]
        for cap in (4, 50):
            front, seen, taken, out, cut = [root] + (names[:3] if root.startswith("file:") else []), set(), set(), [], False
            seen.update(front)
            for level in (1, 2, 3):
                grown = []
                for node in front:
                    for i, kind, a, b in sorted((r for r in stored if node in r[2:] and r[2] != r[3]), key=lambda r: (r[1], r[2], r[3], r[0])):
                        way = "downstream" if a == node else "upstream"
                        if (i, way) in taken:
                            continue
                        if len(out) >= cap:
                            cut = True
                            break
                        taken.add((i, way))
                        out.append((level, way, i))
                        other = b if a == node else a
                        if other not in seen:
                            seen.add(other)
                            grown.append(other)
                    if cut:
                        break
                front = [] if cut else grown
            got = traverse.impact_walk(n, e, root, 3, cap=cap).collect()
            assert [(r["depth"], r["direction"], r["edge_id"]) for r in got] == out and all(r["truncated"] == cut for r in got)


def test_the_affected_filter_escapes_all_but_stars():
    assert re.search(filter_glob("src/(group)/a.ts"), "src/(group)/a.ts") and not re.search(filter_glob("*/a.ts"), "src/axts")
    assert re.search(filter_glob("*.ts"), "src/x/a.ts") and not re.search(filter_glob("a.ts"), "b/a.ts")


def test_call_resolution_order(spark):
    make = spark.createDataFrame
    calls = make([(1, "f", "x", "own"), (2, "A.m", "x", "this.n"), (3, "f", "x", "far"), (4, "f", "x", "lost"), (5, "f", "x", "def")], "call_id int, owner_name string, file_path string, expression string")
    lookups = make([("x", "own", "t2"), ("x", "own", "t1"), ("x", "A.n", "t3"), ("y", "orig", "t4"), ("z", "def", "t5")], "file_path string, lookup_name string, target_id string")
    bindings = make([("x", 0, 0, "y", "named", "far", "orig"), ("x", 1, 0, "z", "default", "def", "default")], "file_path string, declaration int, binding int, target_file string, kind string, local_name string, imported_name string")
    got = {r["call_id"]: (r["target_id"], r["resolution"]) for r in ingest.resolve_calls(calls, lookups, bindings).collect()}
    assert got == {1: ("t1", "resolved"), 2: ("t3", "resolved"), 3: ("t4", "import"), 4: ("unresolved-call:x:4", "unresolved"), 5: ("t5", "import")}


def test_batches_owners_and_imports(spark):
    files = spark.createDataFrame([(f"/r/a/f{i:03}.ts",) for i in range(70)] + [("/r/a/b/g.ts",), ("/q.ts",)], "path string")
    owner = ingest.package_owner(files, spark.createDataFrame([("/r/a",), ("/r/a/b",)], "dir string"))
    assert {r["package_id"]: r["count"] for r in owner.groupBy("package_id").count().collect()} == {"a": 70, "b": 1, "root": 1}
    plan = ingest.plan_batches(owner.filter("config_dir = '/r/a'"))
    assert {r["batch"]: r["count"] for r in plan.groupBy("batch").count().collect()} == {0: 32, 1: 32, 2: 6}
    imports = spark.createDataFrame([("/r/a/b/g.ts", "../f001"), ("/r/a/b/g.ts", "./none"), ("/r/a/b/g.ts", "pkg")], "importer string, specifier string")
    assert {(r["specifier"], r["target_path"]) for r in ingest.resolve_imports(imports, files).collect()} == {("../f001", "/r/a/f001.ts"), ("./none", None)}


def test_legacy_normalization(spark):
    ids = [("file:file:a.ts", "file", "a.ts", "a"), ("func:a.ts:f", "function", "a.ts", "f"), ("proj:file:a.ts", "file", "a.ts", "a"), ("f", "function", "a.ts", "f"), ("f", "function", None, "f"), ("src/x.ts", "file", None, None)]
    df = spark.createDataFrame(ids, "i string, t string, p string, n string")
    got = [r[0] for r in df.select(legacy.normalized_id(F.col("i"), F.col("t"), F.col("p"), F.col("n"))).collect()]
    assert got == ["file:a.ts", "function:a.ts:f", "file:a.ts", "function:a.ts:f", "function:__nofilepath__:f", "file:src/x.ts"]
    values = spark.createDataFrame([("Low",), ("5",), ("7.2",), ("odd",), (None,)], "v string")
    assert [r[0] for r in values.select(legacy.normalized_complexity(F.col("v"))).collect()] == ["simple", "moderate", "complex", "moderate", "moderate"]
    tests = spark.createDataFrame([("a/__tests__/x.test.ts",), ("pkg/x_test.go",), ("tests/test_y.py",)], "p string").select(legacy.production_candidates(F.col("p"))).collect()
    assert "a/x.ts" in tests[0][0] and tests[1][0][0] == "pkg/x.go" and "src/y.py" in tests[2][0]


def test_paths(spark):
    df = spark.createDataFrame([("/r/app/x/page.tsx",), ("/r/components/A.tsx",), ("/r/db/q.ts",), ("/r/a.spec.mjs",), ("/r/x.md",)], "p string")
    assert [r[0] for r in df.select(file_group(F.col("p"))).collect()] == ["routes", "components", "dataAccess", "tests", "other"]
    assert df.select(relative_path(F.col("p"), "/r")).first()[0] == "./app/x/page.tsx"
    import re

    assert re.match(glob_regex("src/**/*.ts"), "src/a/b/c.ts") and re.match(glob_regex("src/**/*.ts"), "src/c.ts") and not re.match(glob_regex("src/*.ts"), "src/a/c.ts")
    assert project.changed_paths("a.ts\n\n../out.ts\n./b/c.ts\n", "/r") == (["/r/a.ts", "/r/b/c.ts"], False)


def test_typescript_names_and_calls():
    rows = read_file("/p/a.ts", "function parse(a: string): void;\nfunction parse(a: any) { helper(a); }\nexport class Foo extends Bar { go() { this.stop() } }\nconst run = () => parse(1);\n")
    names = [r["name"] for r in rows if r["rel"] == "node" and r["type"] in ("function", "class")]
    assert names == ["parse", "parse@2", "Foo", "Foo.go", "run"]
    assert [(r["owner_name"], r["expression"]) for r in rows if r["rel"] == "call"] == [("parse@2", "helper"), ("Foo.go", "this.stop"), ("run", "parse")]
    assert read_file("/p/e.ts", "")[0]["id"] == "file:/p/e.ts" and read_file("/p/b.ts", "function ( {{{")[0]["type"] == "file"


def test_scan_links_files(spark):
    texts = spark.createDataFrame([("/p/src/a.ts", 'import { f } from "./b";\nexport function g() { f(); lost(); }\n'), ("/p/src/b.ts", "export function f() {}\n"), ("/p/x.md", "# no"), ("/p/n.ts", None)], "path string, text string")
    nodes, edges = scan.scan(texts, spark.createDataFrame([("/p/src",)], "dir string"))
    got = {(r["source"], r["target"], r["edge_type"]) for r in edges.collect()}
    assert ("file:/p/src/a.ts", "file:/p/src/b.ts", "imports") in got and ("function:/p/src/a.ts:g", "function:/p/src/b.ts:f", "calls") in got
    by_id = {r["id"]: r for r in nodes.collect()}
    assert by_id["function:/p/src/b.ts:f"]["package_id"] == "src" and sum(r["tags"] == '["unresolved"]' for r in by_id.values()) == 1
    stale = scan.stale_symbols(spark.createDataFrame([("function:/p/src/b.ts:old", "function", "old", "/p/src/b.ts"), ("function:/p/src/b.ts:f", "function", "f", "/p/src/b.ts")], "id string, type string, name string, file_path string"), texts)
    assert [tuple(r) for r in stale.collect()] == [("function:/p/src/b.ts:old", "stale")]


def test_project_store_and_shell(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "tsconfig.json").write_text('{ // c\n "include": ["src"], }')
    (tmp_path / "src/a.ts").write_text("export function useIt() {}\n")
    (tmp_path / "other.ts").write_text("export const x = 1\n")
    (tmp_path / "node_modules/b.ts").write_text("x")
    texts = project.load_project(spark, str(tmp_path))
    assert [r["path"].rsplit("/", 1)[1] for r in texts.collect()] == ["a.ts"]
    nodes, edges = scan.scan(texts)
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    assert store.read("nodes").count() == 0
    numbered = edges.select(F.xxhash64("source", "target").alias("id"), "source", "target", F.col("edge_type").alias("type"), F.lit("forward").alias("direction"), F.lit(1.0).alias("weight"), "metadata")
    first = store.write(nodes=nodes, edges=numbered)
    second = store.write(nodes=nodes, edges=numbered)
    assert store.current() == second != first and store.read("nodes").count() == 2
    assert shell.main(["query", f"file://{tmp_path}/store", "select type, count(*) as n from nodes group by type order by type"]) == 0
    assert "function | 1" in capsys.readouterr().out
    assert shell.main(["inspect", f"file://{tmp_path}/store", "useit", "--json"]) == 0 and '"way": "in"' in capsys.readouterr().out
    assert shell.main(["deps", f"file://{tmp_path}/store", "nobody"]) == 2 and shell.main(["nonsense", "x"]) == 3
    for sql in ("drop table nodes", "select 1; drop table nodes", "insert into nodes values (1)"):
        with pytest.raises(ValueError):
            shell.run_query(spark, sql)
    records = project.file_records(spark, str(tmp_path), nodes, 7).collect()
    assert {r["node_count"] for r in records} == {0, 2} and all(r["content_hash"].startswith("sha256:") for r in records)
    assert any("digraph" in r["value"] for r in shell.to_dot(nodes, edges).collect())
    assert project.load_custom_edges('{"customEdges": [{"type": "t", "sourceType": "a", "targetType": "b"}, {"type": 1}]}')[1] == ["custom edge 1 is invalid and was skipped"]


def test_stream_of_observations(spark, tmp_path):
    schema = "obs_id bigint, run_id int, path string, content_hash string, indexed_at bigint"
    at = int(datetime.datetime(2026, 1, 1).timestamp() * 1000)
    spark.createDataFrame([(1, 1, "p", "A" * 64, at), (2, 1, "p", "b" * 64, at + 1), (3, 1, None, None, None)], schema).write.parquet(f"{tmp_path}/in")
    stream = observations.latest_states(observations.read_observations(spark, f"{tmp_path}/in", schema))
    observations.write_batches(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("path", "digest").collect()] == [("p", "b" * 64)]


@pytest.mark.parametrize("call", [lambda n, e: traverse.dependencies(n, e, "a", depth=2), lambda n, e: traverse.neighbourhood(n, e, "a"), lambda n, e: audit.orphan_edges(n, e), lambda n, e: stats.totals(n, e), lambda n, e: search.like_search(n, "x"), lambda n, e: traverse.impact_walk(n, e, "a"), lambda n, e: ingest.deduplicate_edges(e), lambda n, e: stats.file_counts(n), lambda n, e: legacy.link_tests(n, e)])
def test_empty_graphs(spark, call):
    n, e = clean_nodes(spark.createDataFrame([], NODES)), clean_edges(spark.createDataFrame([], EDGES))
    assert call(n, e).count() <= 1


def test_commands_scan_update_and_audit_a_project(spark, tmp_path, capsys):
    root, store = tmp_path / "p", f"file://{tmp_path}/s"
    (root / "src").mkdir(parents=True)
    (root / "tsconfig.json").write_text("{}")
    (root / "src" / "a.ts").write_text("/** Adds. @param x one */\nexport function add(x: number, y: number): number { return x + y; }\n")
    (root / "src" / "b.ts").write_text("import { add } from './a';\nexport const twice = (n: number) => add(n, n);\n")
    run = lambda *w: (shell.main([*w]), capsys.readouterr().out)
    assert run("init", store)[1].strip() == "created" and run("init", store)[1].strip() == "exists"
    code, out = run("scan", store, str(root), "--json")
    counts = json.loads(out)
    assert code == 0 and counts["files"] == 2 and counts["nodes"] >= 4
    assert json.loads(run("update", store, str(root), "--json")[1]) == {"changed": 0}
    (root / "src" / "b.ts").write_text("import { add } from './a';\nexport const thrice = (n: number) => add(n, add(n, n));\n")
    assert json.loads(run("update", store, str(root), "--json")[1])["changed"] == 1
    names = {r["name"] for r in SnapshotStore(spark, store).read("nodes").filter("type = 'function'").collect()}
    assert "thrice" in names and "twice" not in names
    (root / "src" / "b.ts").unlink()
    code, out = run("audit", store, "--docs", "--json")
    found = {(r["check"], r["detail"]) for r in json.loads(out)}
    assert code == 1 and {c for c, _ in found} >= {"missing_files", "stale_symbols", "documentation_issues"} and ("documentation_issues", "missing_param y") in found
    code, out = run("explore", store, "add", "--json")
    told = json.loads(out)
    assert code == 0 and {r["section"] for r in told} == {"match", "relationship", "snippet"} and any("return x + y" in (r["value"] or "") for r in told if r["section"] == "snippet")
    assert len({r["id"] for r in told if r["section"] == "snippet"}) == sum(r["section"] == "snippet" for r in told)
    code, out = run("stats", store)
    assert code == 0 and "nodes by type" in out and "most imported" in out
    code, out = run("impact", store, "add", "--json")
    assert code == 0 and any(r["section"] == "upstream" for r in json.loads(out))
    assert run("version")[0] == 0 and "usage" in run("help")[1] and run("scan", store)[0] == 3


def test_fingerprints_see_declarations_only(spark):
    texts = ["export function a(x) { return 1 }\nconst b = () => 2\n", "// c\nconst b = () => { return 3 }\n\nexport function a(x) { return 4 }\n", "export function a2(x) { return 1 }\nconst b = () => 2\n"]
    found = {r["path"]: r["fingerprint"] for r in project.fingerprint(spark.createDataFrame([("/x.ts", t, n) for n, t in enumerate(texts[:1])] + [("/y.ts", texts[1], 1), ("/z.ts", texts[2], 2)], "path string, text string, n int").withColumn("path", F.col("path"))).collect()}
    assert len(found) == 3 and len(set(found.values())) == 3  # a file's name is part of what it declares
    same = [project.fingerprint(spark.createDataFrame([("/x.ts", t)], "path string, text string")).first()["fingerprint"] for t in texts]
    assert same[0] == same[1] != same[2]


def test_the_search_index_equals_the_scan(spark):
    rng = random.Random(5)
    words = ["load", "Ledger", "book", "straße", "x1", "loader", "-", "ledger_book"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(rng.randint(0, n))) or None
    rows = [(f"function:/a/{i}.ts:f{i}", "function", text(2) or "f", f"/a/{i}.ts", 1, 1, text(8), text(9), text(3), None, None) for i in range(60)]
    n = clean_nodes(spark.createDataFrame(rows, NODES))
    index = SearchIndex.build(n)
    moved = n.filter("id < 'function:/a/3'").withColumn("summary", F.lit("ledger book book"))
    after = n.filter("id >= 'function:/a/3'").unionByName(moved)
    renewed = index.replaced(n.filter("id < 'function:/a/3'"), moved)
    for some, nodes in ((index, n), (renewed, after)):
        for keyword in ("load", "ledger book", "book led", "straße x", "lo", "none", "--", "book book"):
            assert [tuple(r) for r in indexed_search(some, nodes, keyword).collect()] == [tuple(r) for r in search.phrase_search(nodes, keyword).collect()], keyword


def test_imports_resolve_through_configurations(spark, tmp_path):
    (tmp_path / "pkg/src/deep").mkdir(parents=True)
    (tmp_path / "pkg/lib").mkdir()
    (tmp_path / "tsconfig.base.json").write_text('{"compilerOptions": {"paths": {"@x/*": ["pkg/none/*", "pkg/lib/*"], "@x/deep/*": ["pkg/src/deep/*"], "exact": ["pkg/lib/one"]}}, "exclude": ["pkg/lib/skip"]}')
    (tmp_path / "tsconfig.mid.json").write_text('{"extends": "./tsconfig.base", }')
    (tmp_path / "pkg/tsconfig.json").write_text('{"extends": "../tsconfig.mid.json", "compilerOptions": {"baseUrl": "src"}} // c')
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/tsconfig.json").write_text("{nonsense")
    texts = {"pkg/src/a.ts": "import { one } from '@x/one'; import d from '@x/deep/d'; import e from 'exact'; import b from 'b'; import r from 'react';\nexport function go() { return one(); }\n", "pkg/src/b.ts": "export default 1\n", "pkg/src/deep/d.ts": "export default 2\n", "pkg/lib/one.ts": "export function one() {}\n"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    configs = project.discover_configs(spark, str(tmp_path))
    assert [r["dir"] for r in configs.collect()] == [str(tmp_path / "pkg")]
    sources = project.load_project(spark, str(tmp_path))
    assert {r["path"] for r in sources.collect()} == {str(tmp_path / n) for n in texts}
    nodes, edges = scan.scan(sources, configs)
    got = {r["target"].split("pkg/")[1] for r in edges.filter("edge_type = 'imports'").collect()}
    assert got == {"lib/one.ts", "src/deep/d.ts", "src/b.ts"}
    assert edges.filter("edge_type = 'calls' and target like 'function:%one.ts:one'").count() == 1


def test_hooks_are_installed_once_and_keep_others(tmp_path):
    git = tmp_path / ".git"
    (git / "hooks").mkdir(parents=True)
    (git / "hooks" / "pre-commit").write_text("#!/bin/sh\necho own\n")
    assert install_hooks(str(git), "/p", "/s") == {"pre-commit": "wrapped", "post-checkout": "created"}
    assert install_hooks(str(git), "/p", "/s") == {"pre-commit": "updated", "post-checkout": "updated"}
    assert "echo own" in (git / "hooks" / "pre-commit.backup").read_text() and "pre-commit.backup" in (git / "hooks" / "pre-commit").read_text()
    assert os.access(git / "hooks" / "post-checkout", os.X_OK)
    with pytest.raises(ValueError):
        install_hooks(str(tmp_path) + "/../.git", "/p", "/s")


def test_batches_merge_with_a_report(spark, tmp_path):
    one = {"nodes": [{"id": "file:file:src/a.ts", "type": "file", "name": "a.ts", "filePath": "src/a.ts", "complexity": "low"}, {"id": "func:src/a.ts:f", "type": "function", "name": "f", "filePath": "src/a.ts", "complexity": "simple"}, {"id": "odd:1", "type": "odd", "name": "o", "filePath": "o", "complexity": "simple"}], "edges": [{"source": "file:file:src/a.ts", "target": "func:src/a.ts:f", "type": "contains", "weight": 0.4}, {"source": "file:src/a.ts", "target": "gone", "type": "calls"}]}
    two = {"nodes": [{"id": "file:src/a.test.ts", "type": "file", "name": "a.test.ts", "filePath": "src/a.test.ts", "complexity": "complex"}], "edges": [{"source": "file:src/a.ts", "target": "function:src/a.ts:f", "type": "contains", "weight": 0.9}]}
    (tmp_path / "batch-2.json").write_text(json.dumps(two))
    (tmp_path / "batch-10.json").write_text(json.dumps(one))
    (tmp_path / "batch-3.json").write_text("{bad")
    nodes, edges, report = legacy.merge_batches(*project.read_batches(spark, str(tmp_path)))
    assert {r["id"] for r in nodes.collect()} >= {"file:src/a.ts", "function:src/a.ts:f", "file:src/a.test.ts"}
    assert {(r["source"], r["target"], r["edge_type"], r["weight"]) for r in edges.collect()} == {("file:src/a.ts", "function:src/a.ts:f", "contains", 0.9), ("file:src/a.ts", "file:src/a.test.ts", "tested_by", 0.5)}
    told = {(r["section"], r["item"]): r["n"] for r in report.collect()}
    assert told["input", "nodes"] == 4 and told["output", "edges"] == 2 and told["fixed", "id: double_prefix"] == 1 and told["fixed", "edges rewritten"] == 1
    assert told["linked", "tested_by by path"] == 1 and told["unfixed", "edges without target"] == 1 and told["unfixed", "node type: odd"] == 1


def test_duplicate_nodes_by_scope_and_name(spark):
    rows = [("function:/a.ts:f", "function", "f", "/a.ts"), ("function:/a.ts:f@9", "function", "f@9", "/a.ts"), ("function:/b.ts:f", "function", "f", "/b.ts"), ("param:/a.ts:f:x", "param", "x", "/a.ts"), ("param:/a.ts:g:x", "param", "x", "/a.ts"), ("class:*:f", "class", "f", ""), ("class:*:g", "class", "f", "")]
    n = clean_nodes(spark.createDataFrame([(*r, 1, 1, None, None, None, None, None) for r in rows], NODES))
    assert [tuple(r) for r in audit.duplicate_nodes(n).collect()] == [("function", "/a.ts", "f", 2, "function:/a.ts:f", "function:/a.ts:f@9")]
