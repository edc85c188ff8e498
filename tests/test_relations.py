"""Resolution, issues, graph, store, sources and sinks on literal rows."""
import random

from pyspark.sql import functions as F

from tessella.functions import lang, paths
from tessella.operators import graph, issues, resolve, service
from tessella.sinks import reports
from tessella.sources import diff, parsers, specs, tree
from tessella.streaming import watch


def col(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"c {kind}")


def test_paths(spark):
    cleaned = [r.x for r in col(spark, ["a/./b/../c", "../x", "a//b", "", None]).select(paths.clean(F.col("c")).alias("x")).collect()]
    assert cleaned == ["a/c", "../x", "a/b", ".", None]
    parts = col(spark, ["a/b.test.TS", "x", ".env"]).select(paths.dirname(F.col("c")).alias("d"), paths.extension(F.col("c")).alias("e"), paths.stem(F.col("c")).alias("s")).collect()
    assert [tuple(r) for r in parts] == [("a", ".ts", "b.test"), (".", "", "x"), (".", ".env", "")]
    assert [bool(__import__("re").match(paths.glob_regex(g), p)) for g, p in (("*.go", "a.go"), ("*.go", "a/b.go"), ("a/?.go", "a/b.go"), ("[!a]*.py", "b.py"))] == [True, False, True, True]


def test_languages_and_tests(spark):
    df = col(spark, ["a/x.go", "a/x_test.go", "b/test_x.py", "tests/y.py", "q.unknown", "C.java"]).withColumn("l", lang.language(F.col("c")))
    got = df.select("l", lang.is_test(F.col("c")).alias("t")).collect()
    assert [tuple(r) for r in got] == [("go", False), ("go", True), ("python", True), ("python", True), (None, False), ("java", False)]


def lines_of(spark, rows):
    return spark.createDataFrame([(1, f, 0, i, t, c, i) for i, (f, t, c) in enumerate(rows)], "file_id long, file string, hunk_no int, pos int, type string, content string, new_num int")


def test_parsers(spark):
    rows = [
        ("a.ts", "added", "import { x, y as z } from './m'"), ("a.ts", "added", "export async function go(a) {"), ("a.py", "added", "from p.q import f, g"), ("a.go", "added", '\t"fmt"'), ("a.go", "added", "func (r *T) Do(x int) {"), ("a.rs", "added", "use crate::m::T;"),
        ("a.py", "removed", "import gone"), ("a.java", "added", "import a.b.C;"), ("a.txt", "added", "import x"), ("a.go", "added", None), ("a.c", "added", "#include <stdio.h>"), ("m.hs", "added", "import qualified Data.Map as M"), ("s.sol", "added", 'import "./T.sol";'),
    ]
    got = {(r.lang, r.path, tuple(r.names)) for r in parsers.imports(lines_of(spark, rows)).collect()}
    assert got == {("typescript", "./m", ("x", "y")), ("python", "p.q", ("f", "g")), ("go", "fmt", ()), ("rust", "crate::m::T", ()), ("java", "a.b.C", ()), ("c", "stdio.h", ()), ("haskell", "Data.Map", ()), ("solidity", "./T.sol", ())}
    syms = {(r.lang, r.name, r.exported) for r in parsers.symbols(lines_of(spark, rows)).collect()}
    assert syms == {("typescript", "go", True), ("go", "Do", True)}


def test_resolution_takes_the_first_candidate(spark):
    imp = spark.createDataFrame([("src/a.ts", "./m"), ("src/a.ts", "../lib"), ("src/a.ts", "./none")], "file string, path string")
    files = spark.createDataFrame([("src/m.js",), ("src/m.ts",), ("lib/index.ts",)], "file string")
    got = resolve.resolve(imp, files, resolve.script_base(F.col("file"), F.col("path")), resolve.SCRIPT_TAILS, ["path"]).collect()
    assert {r.path: r.target for r in got} == {"./m": "src/m.ts", "../lib": "lib/index.ts", "./none": None}
    base = spark.createDataFrame([("p/q/a.py", ".u"), ("p/q/a.py", "..v.w")], "file string, path string").select(resolve.python_base(F.col("file"), F.col("path")).alias("b")).collect()
    assert [r.b for r in base] == ["p/q/u", "p/v/w"]


def test_phantoms_and_unused(spark):
    imp = col(spark, ["a.b", "os", "zz.q"]).withColumnRenamed("c", "path")
    known = col(spark, ["a", "os"]).withColumnRenamed("c", "key")
    assert [r.path for r in resolve.phantom(imp, known, F.col("path"), "top", ".").collect()] == ["zz.q"]
    assert resolve.phantom(imp, known.limit(0), F.col("path")).count() == 0
    go = col(spark, ["h.io/x/y", "h.io/xy"]).withColumnRenamed("c", "path")
    deps = col(spark, ["h.io/x", "h.io/z"]).withColumnRenamed("c", "key")
    assert [r.path for r in resolve.phantom(go, deps, F.col("path"), "prefix").collect()] == ["h.io/xy"]
    assert [r.key for r in resolve.unused(deps, go).collect()] == ["h.io/z"]


def test_substring_pairs_equal_brute_force(spark):
    rnd = random.Random(4)
    a, b = (["".join(rnd.choice("ab") for _ in range(rnd.randint(0, 7))) for _ in range(30)] for _ in range(2))
    got = {tuple(r) for r in resolve.substring_pairs(col(spark, a).withColumnRenamed("c", "x"), col(spark, b).withColumnRenamed("c", "y"), "x", "y").select("x", "y").collect()}
    assert got == {(x, y) for x in a for y in b if x and y and (x in y or y in x)}


def test_suppression_and_baseline(spark):
    found = spark.createDataFrame([("f", 2, "test", "m one"), ("f", 5, "tests", "m"), ("f", 0, "tests", "m"), ("g", 2, "tests", "longer m one here")], "file string, line int, category string, message string")
    marks = issues.directives(spark.createDataFrame([("f", 1, "// q:off tests, more */ tail"), ("f", 5, "x // q:off")], "file string, line int, content string"), "q:off")
    assert {(r.file, r.line) for r in issues.unsuppressed(found, marks).collect()} == {("f", 0), ("g", 2)}
    base = spark.createDataFrame([("Tests", "g", "m one")], "category string, file string, message string")
    left = issues.not_in_baseline(found, base)
    assert {(r.file, r.line) for r in left.collect()} == {("f", 2), ("f", 5), ("f", 0)}
    assert issues.not_in_baseline(found, found).count() == 0  # a baseline of itself leaves nothing


def test_cycles_and_rotation(spark):
    edges = spark.createDataFrame([("b", "c"), ("c", "a"), ("a", "b"), ("a", "d"), ("d", "d"), ("x", "y"), (None, "a"), ("b", "a")], "src string, dst string")
    assert sorted(r.key for r in graph.cycles(edges).collect()) == ["a->b", "a->b->c", "d"]
    turned = col(spark, [["b", "c", "a"], ["c", "a", "b"]], "array<string>").select(graph.canonical(F.col("c")).alias("x")).distinct().collect()
    assert [r.x for r in turned] == [["a", "b", "c"]]
    assert graph.cycles(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_store(spark):
    t = spark.createDataFrame([("a", "m", 1), ("b", "m", 2)], "u string, m string, n int")
    assert {tuple(r) for r in service.upsert_add(t, spark.createDataFrame([("a", "m", 5), ("c", "m", None)], "u string, m string, n int"), ["u", "m"], ["n"]).collect()} == {("a", "m", 6), ("b", "m", 2), ("c", "m", 0)}
    v = service.upsert_version(spark.createDataFrame([("a", "x", 3)], "k string, y string, v int"), spark.createDataFrame([("a", "z"), ("b", "w")], "k string, y string"), "k", "y", "v")
    assert {tuple(r) for r in v.collect()} == {("a", "z", 4), ("b", "w", 1)}
    rows = spark.range(300).withColumn("o", F.col("id"))
    assert service.page(rows, [F.desc("o")]).count() == 20 and service.page(rows, [F.desc("o")], 1000).count() == 100 and service.page(rows, [F.desc("o")], 5, 298).count() == 2
    same = spark.createDataFrame([("p", 1, 2)], "path string, size int, changed int")
    assert service.cache_valid(same, same).collect()[0].valid and not service.cache_valid(same, same.limit(0)).collect()[0].valid
    left = service.delete_cascade({"t": (t, "u")}, col(spark, ["a"]).withColumnRenamed("c", "id"))["t"]
    assert [r.u for r in left.collect()] == ["b"]


DIFF = """diff --git a/old name.py b/new.py
similarity index 90%
rename from old name.py
rename to new.py
@@ -1,2 +1,3 @@ def f():
 a
-b
+c
+
diff --git a/n.go b/n.go
new file mode 100644
@@ -0,0 +1 @@
+--- not a header
diff --git a/i.png b/i.png
deleted file mode 100644
Binary files a/i.png and /dev/null differ
"""


def test_diff_source(spark):
    rows = diff.file_diffs(spark.createDataFrame([(1, DIFF), (2, None), (3, "")], "id long, text string"), "id").collect()
    assert [(r.path, r.old_path, r.status, r.is_binary, len(r.hunks)) for r in rows] == [("new.py", "old name.py", "renamed", False, 1), ("n.go", "", "added", False, 1), ("i.png", "", "deleted", True, 0)]
    assert [(x.type, x.content, x.old_num, x.new_num) for x in rows[0].hunks[0].lines] == [("context", "a", 1, 1), ("removed", "b", 2, 0), ("added", "c", 0, 2), ("added", "", 0, 3)]
    assert rows[1].hunks[0].lines[0].content == "--- not a header" and rows[1].hunks[0].new_count == 1


def test_specs_manifests_config():
    text = "# T\n## One\nfirst\nline\n\nsecond\n### Sub\n```\n## no\n```\n## Two\n"
    assert specs.parse_markdown(text) == [("SEC-1", "One", "first line"), ("SEC-1-1", "Sub", ""), ("SEC-2", "Two", "")]
    assert specs.parse_manifest("go.mod", "module x\nrequire (\n\tgithub.com/a/b v1.2.3 // indirect\n)\n") == ["github.com/a/b"]
    assert specs.parse_manifest("p/package.json", '{"dependencies":{"a":"1"},"devDependencies":{"@s/b":"2"}}') == ["a", "@s/b"]
    assert specs.parse_manifest("Cargo.toml", '[package]\nname = "x"\n[dependencies]\nserde = "1"\n') == ["serde"]
    assert specs.merge_config({"a": 1, "analyzers": {"x": True}, "compliance": "own"}, {"a": 0, "analyzers": {}, "compliance": "t", "b": 2}) == {"a": 1, "analyzers": {}, "compliance": "own", "b": 2}


def test_model_answers(spark):
    got = [r.x for r in col(spark, ['```json\n{"a": 1}\n```', 'text {"b": 2} more', "none", None]).select(specs.lenient_json(F.col("c")).alias("x")).collect()]
    assert got == ['{"a": 1}', '{"b": 2}', None, None]


def test_tree_source(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("x\r\ny")
    (tmp_path / "gen").mkdir()
    (tmp_path / "gen/b.py").write_text("z")
    (tmp_path / "n.bin").write_bytes(b"\x00")
    files = tree.repo_files(spark, str(tmp_path), ["gen"])
    assert [(r.file, r.lang) for r in files.collect()] == [("src/a.py", "python")]
    assert [(r.line, r.content) for r in tree.tree_lines(files).collect()] == [(1, "x"), (2, "y")]
    assert tree.as_added(files).selectExpr("hunks[0].new_count").collect()[0][0] == 2


def test_edits_and_reports(spark):
    lines = spark.createDataFrame([("f", 1, "  old"), ("f", 2, "gone"), ("f", 3, "other")], "file string, line int, content string")
    edits = spark.createDataFrame([("f", 1, "old", "new"), ("f", 2, "gone", ""), ("f", 3, "stale", "x")], "file string, line int, old_text string, new_text string")
    done = reports.apply_edits(lines, edits)
    assert [(r.content, r.state) for r in done.orderBy("line").collect()] == [("  new", "changed"), (None, "deleted"), ("other", "mismatch")]
    assert reports.rejoin(done).collect()[0].text == "  new\nother"
    found = spark.createDataFrame([("r", "security-xss", "error", "c", "f", 1, "m", "s")], "run string, id string, severity string, category string, file string, line int, message string, suggestion string")
    cwe = spark.createDataFrame([("security-xss", "CWE-79")], "id string, cwe string")
    import json

    log = json.loads(reports.sarif(found, cwe).collect()[0].sarif)
    assert log["version"] == "2.1.0" and log["runs"][0]["results"][0]["ruleId"] == "security-xss" and log["runs"][0]["taxonomies"][0]["taxa"][0]["id"] == "CWE-79"
    assert json.loads(reports.json_report(found, "run").collect()[0].report)["total"] == 1
    assert reports.terminal_lines(found).collect()[0].text.startswith("f:1: error [security-xss] m")


def test_baseline_file(spark, tmp_path):
    found = spark.createDataFrame([("i", "c", "f", "m")], "id string, category string, file string, message string")
    specs.write_baseline(found, str(tmp_path / "b"))
    assert specs.baseline(spark, str(tmp_path / "b")).collect() == found.collect()


def test_watch_changes_and_bursts(spark):
    from datetime import datetime, timedelta

    a = spark.createDataFrame([("p", 1), ("q", 1), ("r", 1)], "path string, changed int")
    b = spark.createDataFrame([("p", 1), ("q", 2), ("s", 1)], "path string, changed int")
    assert {tuple(x) for x in watch.changes(a, b).select("path", "change").collect()} == {("q", "changed"), ("r", "deleted"), ("s", "new")}
    assert watch.trigger(watch.changes(a, b)).collect()[0].path == "r"
    t = datetime(2025, 1, 1)
    ev = spark.createDataFrame([("k", t), ("k", t + timedelta(milliseconds=150)), ("k", t + timedelta(milliseconds=400))], "k string, t timestamp")
    assert sorted(r.events for r in watch.bursts(ev, "k", "t").collect()) == [1, 2]
