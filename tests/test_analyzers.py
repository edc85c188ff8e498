"""Guarded rules and relational analyzers on literal diffs: positive, negative and boundary cases."""
import pytest
from pyspark.sql import functions as F

from tessella.operators import guards
from tessella.operators import lines as L
from tessella.plans import guard_packs, pipeline
from tests.test_lines import files


def fired(spark, rules, path, texts):
    return sorted({r.id.split("/")[1] for r in guards.guarded_issues(L.diff_lines(files(spark, (path, texts))), rules).collect()})


@pytest.mark.parametrize(("path", "texts", "want"), [
    ("a.go", ["+f, err := os.Open(p)", "+if err != nil {", "+defer f.Close()"], []), ("a.go", ["+f, err := os.Open(p)", "+x()"], ["go-unclosed-file"]), ("a.go", ["+f := os.Open(p)", *["+."] * 5, "+defer f.Close()"], ["go-unclosed-file"]),
    ("a.go", ["+f := os.Open(p)", "-defer f.Close()"], ["go-unclosed-file"]), ("a.go", ["+f := os.Open(p)", "+// defer"], ["go-unclosed-file"]), ("a.go", [" f := os.Open(p)"], []),
    ("a.py", ["+with open(p) as f:"], []), ("a.py", ["+f = open(p)"], ["python-no-context-manager"]), ("a.py", ["+f = open(p)", "+f.close()"], []), ("a.ts", ["+x.addEventListener('a')", " y", "+x.removeEventListener('a')"], []),
    ("a.ts", ["+useEffect(() => {", "+fetch(u)"], ["ts-missing-abort-controller"]), ("a.ts", ["+fetch(u)"], []), ("a.rs", ["+Box::leak(b)"], ["rust-leaked-box"]), ("a.c", ["+p = malloc(4);", "+free(p);"], []), ("a.c", ["+p = malloc(4);"], ["c-malloc-no-free"]),
    ("a.rb", ["+File.open(p) do |f|"], []), ("a.kt", ["+val s = Socket(h)"], ["kotlin-unclosed-resource"]), ("a.php", ["+$f = fopen($p);", *[" ."] * 20, "+fclose($f);"], []),
])
def test_resources(spark, path, texts, want):
    assert fired(spark, guard_packs.RESOURCE, path, texts) == want


@pytest.mark.parametrize(("path", "texts", "want"), [
    ("a.go", ["+go func() {", "+select { case <-ctx.Done(): }"], []), ("a.go", ["+go work()"], ["goroutine-leak"]), ("a.go", ["+c := make(chan int)", "+d := make(chan int, 3)"], ["channel-size-zero"]), ("a.go", ["+go func() { ctx }", "+m[k] = 1"], ["missing-lock"]),
    ("a.go", ["+go func() { ctx }", "+mu.Lock()", "+m[k] = 1"], []), ("a.java", ["+if (x == null)", "+synchronized (this) {"], ["double-check-locking"]), ("a.java", ["+if (x == null)", "+synchronized (this) {", " volatile X x;"], []),
    ("a.cs", ["+async void F()"], ["async-void"]), ("a.ex", ["+spawn(f)", "+spawn_link(f)"], ["unlinked-spawn"]), ("a.py", ["+  t = Thread(target=f)", "+  t.start()"], ["missing-join"]), ("a.py", ["+t = Thread(x)", "+t.start()", "+t.join()"], []),
])
def test_concurrency(spark, path, texts, want):
    assert fired(spark, guard_packs.CONCURRENCY, path, texts) == want


def test_errors(spark):
    assert fired(spark, guard_packs.ERRORS, "a.go", ["+_ = f.Close()"]) == ["go-discarded-error"]
    assert fired(spark, guard_packs.ERRORS, "a.ts", ["+try {", *["+."] * 19, "+await f()"]) == []
    assert fired(spark, guard_packs.ERRORS, "a.ts", ["+try {", *["+."] * 20, "+await f()"]) == ["ts-unhandled-await"]
    assert fired(spark, guard_packs.ERRORS, "a.c", ["+p = malloc(1);", "+.", "+.", "+if (!p)"]) == []


RULES = ("import-name", "import-deleted", "import-broken", "export-removed", "sig-change", "sig-change-partial", "type-change", "iface-gap", "ref-deleted", "ref-renamed", "ref-symbol-deleted", "ref-symbol-usage", "deadcode", "spec-orphan", "spec-unanchored", "spec-modified", "spec-target", "docdrift-stale-doc", "docdrift-param-mismatch", "docdrift-return-type", "docdrift-stale-example")


def rule(ident):
    """The rule of an issue's id, without where it stands."""
    return max((r for r in RULES if ident.startswith(r + "-")), key=len, default=ident)


def found(spark, ctx, name):
    return sorted((r.file, r.line, rule(r.id)) for r in pipeline.found_by(ctx, [name]).collect())


def test_imports_and_references(spark):
    diff = files(spark, ("src/a.ts", ["+import { x, y } from './b'", "+import { z } from './gone'", "+import { q } from './never'"]), ("src/b.ts", ["+export const x = 1"]), ("src/gone.ts", ["-export const z = 1"], "deleted"))
    ctx = pipeline.Context(diff)
    assert found(spark, ctx, "imports") == [("src/a.ts", 1, "import-name"), ("src/a.ts", 2, "import-deleted"), ("src/a.ts", 3, "import-broken")]
    assert {r.id for r in pipeline.found_by(ctx, ["imports"]).collect()} == {"import-name-src/a.ts-1-y", "import-deleted-src/a.ts-2", "import-broken-src/a.ts-3"}
    assert found(spark, ctx, "references") == [("src/a.ts", 2, "ref-deleted"), ("src/a.ts", 2, "ref-symbol-deleted")]


def test_consistency_docdrift_and_deadcode(spark):
    diff = files(spark, ("m.py", [" # doc of f", "-def f(a):", "+def f(a, b):", "+def unused():"]), ("u.py", [" from m import f"]))
    ctx = pipeline.Context(diff)
    assert found(spark, ctx, "consistency") == [("u.py", 1, "sig-change-partial")]
    assert found(spark, ctx, "deadcode") == [("m.py", 4, "deadcode")]
    assert found(spark, ctx, "docdrift") == [("m.py", 1, "docdrift-stale-doc")]


def test_tests_depgraph_spec_and_phantoms(spark):
    diff = files(spark, ("a/x.go", ["+package a"], "added"), ("a/y.go", ["+package a"], "added"), ("a/y_test.go", ["+package a"], "added"), ("p.ts", ["+import './q'"]), ("q.ts", ["+import './p'", "+// spec:REQ-9"]), ("s.py", ["+import numpy", "+import os", "+import ghost"]))
    manifests = spark.createDataFrame([("requirements.txt", "numpy==1\nspare\n")], "file string, content string")
    wanted = spark.createDataFrame([("REQ-1",)], "req_id string")
    ctx = pipeline.Context(diff, extra={"manifests": manifests, "requirements": wanted})
    assert ("a/x.go", 0, "tests/new-file-no-test") in found(spark, ctx, "tests") and ("a/y.go", 0, "tests/new-file-no-test") not in found(spark, ctx, "tests")
    assert ("p.ts", 0, "depgraph/circular-dependency") in found(spark, ctx, "depgraph") and ("requirements.txt", 0, "depgraph/unused-dependency") in found(spark, ctx, "depgraph")
    assert [x[2] for x in found(spark, ctx, "spec")] == ["spec-unanchored", "spec-modified", "spec-orphan"]
    assert found(spark, ctx, "hallucination") == [("s.py", 3, "hallucination/phantom-import")]  # ./p and ./q exist
    assert found(spark, pipeline.Context(diff), "hallucination") == []


def test_empty_diff_and_shapes(spark):
    empty = pipeline.Context(files(spark, ("a.py", ["+x"])).where(F.lit(False)))
    for name in pipeline.ANALYZERS:
        assert pipeline.found_by(empty, [name]).columns == pipeline.COLUMNS, name
    assert pipeline.analyse(empty, ["security", "resource", "custom"]).count() == 0
    assert pipeline.analyse(pipeline.Context(empty.files, enabled=frozenset())).count() == 0


def test_errors_of_many_languages(spark):
    cases = [
        ("a.ts", ["+f().then(g)"], ["ts-unhandled-promise"]), ("a.ts", ["+f()", "+  .then(g)", "+  .catch(h)"], []), ("a.ts", ["+f().then(g)", "+next()", "+x.catch(h)"], ["ts-unhandled-promise"]), ("a.py", ["+except Exception as e:", "+    pass"], ["python-except-pass"]),
        ("a.py", ["+except Exception:", "     pass"], []), ("a.zig", ["+x catch unreachable;", "+@panic(m);", "+// @panic(m)"], ["catch-unreachable", "panic"]), ("a.nim", ["+except:"], ["bare-except"]), ("a.cr", ["+rescue", "+rescue Exception"], ["broad-rescue", "empty-rescue"]),
        ("a.v", ["+f() or { panic(err) }", "+g() or {}"], ["empty-or-block", "or-panic"]), ("a.d", ["+catch (Exception e) {}", "+/+ catch (E e) {}"], ["empty-catch"]), ("a.hs", ["+x = fromJust y", "+error \"no\"", "+undefined", "+-- undefined"], ["haskell-error", "haskell-fromjust", "haskell-undefined"]),
        ("a.clj", ["+(catch Exception e", "+; (catch Exception e"], ["clojure-catch-all"]), ("a.erl", ["+catch _ -> ok"], ["erlang-catch-all"]), ("a.fs", ["+failwith m"], ["fsharp-failwith"]), ("a.ml", ["+try f () with _ -> 1"], ["ocaml-catch-all"]), ("a.pl", ["+die;", "+die 'x';"], ["perl-die-no-message"]),
        ("a.ps1", ["+gci -ErrorAction SilentlyContinue"], ["powershell-silently-continue"]), ("a.groovy", ["+catch (Exception e) {"], ["groovy-catch-all"]), ("a.jl", ["+catch e", "+# catch e"], ["julia-catch-all"]), ("a.sol", ["+require(x);", "+require(x, 'm');"], ["solidity-require-no-message"]),
        ("a.vb", ["+Catch", "+Catch e As IOException", "+' Catch"], ["vb-empty-catch"]), ("a.adb", ["+when others =>"], ["ada-when-others"]), ("a.pas", ["+except", "+{ except"], ["pascal-bare-except"]), ("a.scala", ["+} catch {", "+case _ => x", "+}", "+case _ => y"], ["catch-all"]),
    ]
    diff = [(f"{k}/{p}", t) for k, (p, t, _) in enumerate(cases)]
    got = {}
    for r in guards.guarded_issues(L.diff_lines(files(spark, *diff)), guard_packs.ERRORS).collect():
        got.setdefault(r.file, set()).add(r.id.split("/")[1])
    assert {f: sorted(x) for f, x in got.items()} == {f"{k}/{p}": w for k, (p, _, w) in enumerate(cases) if w}


def test_async_work_that_blocks_or_races(spark):
    assert fired(spark, guard_packs.CONCURRENCY, "a.py", ["+async def f():", "+  time.sleep(1)", "+  requests.get(u)", "+def g():", "+  time.sleep(1)"]) == ["async-blocking"]
    assert fired(spark, guard_packs.CONCURRENCY, "a.ts", [" async load() {", "+setState(a)", "+setState(b)"]) == ["race-condition"]
    assert fired(spark, guard_packs.CONCURRENCY, "a.ts", ["+setState(a)", "+setState(b)"]) == []
    assert fired(spark, guard_packs.RESOURCE, "a.cpp", ["+auto x = new Foo;"]) == ["cpp-new-no-delete"] and fired(spark, guard_packs.RESOURCE, "a.cpp", ["+auto x = new Foo;", "+delete x;"]) == []


def test_hunks_and_files_as_a_whole(spark):
    from tessella.plans import hunk_checks as H

    diff = files(
        spark, ("a.go", ["+func F() error {", "+\treturn nil", "+}", "+func G() {", "+\tx()", "+\ty()", "+}"]), ("a.py", ["+def f():", "+    pass", "+def g():", "+    # TODO later", "+def h():", "+    return 3"]), ("b.py", ["+# x = f.g(1)", "+# y", "+# z", "+ok", "+# prose", "+# only", "+# here"]),
        ("c.go", ["+\treturn x", "+\ty := 1", "+}", "+\treturn z", "+}", "+\tcase 1:"]), ("d.sh", ["+#!/bin/sh", "+rm x"]), ("e.sh", ["+set -euo pipefail"]), ("f.d", ["+scope(exit) g();"]), ("db/migrations/1.up.sql", ["+-- BEGIN", "+DROP TABLE x;"]), ("db/migrations/2.up.sql", ["+BEGIN;"]), ("db/migrations/2.down.sql", ["+BEGIN;"]),
        ("notes.md", ["+# a.b(", "+# b", "+# c"]),
    )
    lines = L.diff_lines(diff)
    at = lambda f: sorted((r.file, r.line) for r in f(lines).collect())
    assert at(H.stubs) == [("a.go", 1), ("a.py", 1), ("a.py", 3)]
    assert at(H.commented_code) == [("b.py", 1)] and at(H.unreachable_code) == [("c.go", 2)] and at(H.shell_without_set_e) == [("d.sh", 1)] and at(H.scope_without_failure) == [("f.d", 0)]
    assert sorted(r.id for r in H.migration_files(lines).collect()) == ["migration-no-down-db/migrations/1.up.sql", "migration-no-transaction-db/migrations/1.up.sql"]


def test_doc_drift_in_detail(spark):
    diff = files(spark, ("m.go", [" // Sum adds a and b, see Sum(1, 2).", "-func Sum(a int, b int) int {", "+func Sum(a int) string {"]))
    got = sorted((rule(r.id), r.message) for r in pipeline.found_by(pipeline.Context(diff), ["docdrift"]).collect())
    assert [x[0] for x in got] == ["docdrift-param-mismatch", "docdrift-return-type", "docdrift-stale-doc", "docdrift-stale-example"]
    assert got[0][1] == 'Documentation for Sum references parameters "b" that no longer exist in the function signature' and "from int to string" in got[1][1]


def test_consistency_of_types_and_interfaces(spark):
    diff = files(spark, ("p/i.go", [" type Store interface {", "+\tGet(k string) string", " }"]), ("t.ts", ["+export class Box {"]))
    tree = files(spark, ("p/impl.go", [" func (m *Mem) Get(k string) string {"]), ("u.ts", [" import { Box } from './t'"]))
    got = [(r.file, r.id) for r in pipeline.found_by(pipeline.Context(diff, extra={"tree": L.diff_lines(tree)}), ["consistency"]).collect()]
    assert sorted(got) == [("p/impl.go", "iface-gap-Store-p/impl.go-Get"), ("u.ts", "type-change-t.ts-u.ts-Box")]


def test_compliance_packs_and_weaknesses():
    from tessella.plans import packs

    assert {k: len(set(v)) for k, v in packs.COMPLIANCE_PACKS.items()} == {"owasp-top-10-2021": 15, "cwe-top-25-2023": 25}
    assert {"CWE-862", "CWE-863"} <= set(packs.COMPLIANCE_PACKS["owasp-top-10-2021"]) and {"CWE-611", "CWE-732"} <= set(packs.COMPLIANCE_PACKS["cwe-top-25-2023"])
    assert not {"CWE-287", "CWE-352"} & set(packs.COMPLIANCE_PACKS["cwe-top-25-2023"]) and len(packs.ISSUE_CWE) == 27 and "security-hardcoded-secret" not in packs.ISSUE_CWE
