"""Drawn diffs, and by hand the issues that each analyzer finds in them.

A file is (path, lines[, status[, old path]]); a line begins with +, - or a blank. What is expected is (file, line, id,
severity). The rule analyzers read these files together with the table; the others, whose issues no SQL gives, read them
by themselves.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import guards
from tessella.operators import lines as L
from tessella.operators import rules as R
from tessella.plans import line_queries as Q
from tessella.plans import pipeline
from tessella.sources.tables import table

KINDS = {"+": "added", "-": "removed", " ": "context"}
SHAPE = "file_id long, run_id string, path string, old_path string, status string, is_binary boolean, hunks array<struct<old_start:int,old_count:int,new_start:int,new_count:int,lines:array<struct<type:string,content:string,old_num:int,new_num:int>>>>"

SECURITY = (
    [("s/a.py", ["+cursor.execute('select ' + x)", "+hashlib.md5(b)", "+# hashlib.md5(b)", " hashlib.md5(b)"]), ("s/a.go", ['+db.Query("select " + x)', '+http.ListenAndServe(":80", nil)']), ("s/a.ts", ["+el.innerHTML = x", "+eval(x)", "+const t = Math.random()"]), ("s/A.java", ["+new ObjectInputStream(in)"]),
     ("s/a.sol", ["+require(tx.origin == owner);", "+// tx.origin"]), ("s/a.tf", ['+  password = "hunter22"', "+  encrypted = false"]), ("s/a.jl", ["+eval(x)"]), ("s/a.erl", ["+os:cmd(X)", "+% os:cmd(X)"]), ("s/a.clj", ["+(eval x)"]), ("s/a.ml", ["+Obj.magic x"]), ("s/a.fs", ["+Assembly.Load n"]), ("s/a.vb", ["+Shell(x)", "+' Shell(x)"]),
     ("s/a.cbl", ["+CALL 'SYSTEM' USING X", "+STRING A ON OVERFLOW"]), ("s/a.adb", ["+pragma Suppress (All_Checks);"]), ("s/a.pas", ["+ShellExecute(0)"]), ("s/a.pl", ["+system('ls')"]), ("s/a.ps1", ["+Invoke-Expression $x"]), ("s/a.groovy", ["+'ls'.execute()"]), ("s/a.v", ["+#flag -lm"]), ("s/a.proto", ["+google.protobuf.Any x = 1;"]), ("s/a.f90", ["+CALL SYSTEM('ls')", "+! CALL SYSTEM('ls')"])],
    [("s/a.py", 1, "security/sql-injection", "error"), ("s/a.py", 2, "security/insecure-crypto", "warning"), ("s/a.go", 1, "security/sql-injection", "error"), ("s/a.go", 2, "security/go-no-tls", "warning"), ("s/a.ts", 1, "security/xss", "error"), ("s/a.ts", 2, "security/code-execution", "error"), ("s/a.ts", 3, "security/insecure-crypto", "warning"), ("s/A.java", 1, "security/deserialization", "error"),
     ("s/a.sol", 1, "security/solidity-tx-origin", "error"), ("s/a.tf", 1, "security/terraform-hardcoded-secret", "error"), ("s/a.tf", 2, "security/terraform-unencrypted", "warning"), ("s/a.jl", 1, "security/julia-code-injection", "error"), ("s/a.erl", 1, "security/erlang-command-injection", "error"), ("s/a.clj", 1, "security/clojure-code-injection", "error"), ("s/a.ml", 1, "security/ocaml-unsafe-cast", "error"),
     ("s/a.fs", 1, "security/fsharp-reflection", "warning"), ("s/a.vb", 1, "security/vb-shell-injection", "error"), ("s/a.cbl", 1, "security/cobol-system-call", "error"), ("s/a.adb", 1, "security/ada-suppress-checks", "error"), ("s/a.pas", 1, "security/pascal-shell-execute", "error"), ("s/a.pl", 1, "security/perl-command-injection", "error"), ("s/a.ps1", 1, "security/powershell-code-injection", "error"),
     ("s/a.groovy", 1, "security/groovy-command-injection", "error"), ("s/a.v", 1, "security/vlang-ffi", "info"), ("s/a.proto", 1, "security/protobuf-any-type", "warning"), ("s/a.f90", 1, "security/fortran-command-injection", "error")],
)
PATTERNS = (
    [("t/a.py", ["+# TODO later", "+    pass", "+x = 1"]), ("t/a.ts", ["+let a: any = 1", "+// @ts-ignore", "+console.log(1)"]), ("t/a.rs", ["+x.unwrap()", "+y()"]), ("t/a.swift", ["+#if DEBUG", "+fatalError(1)"]), ("t/a.d", ["+goto end;", "+GC.disable();"]), ("t/a.c", ["+goto out;"]), ("t/a.sol", ["+function pay() public {", "+function see() public view {"]), ("t/a.cbl", ["+GO TO X"]), ("t/a.md", ["+# TODO not code"])],
    [("t/a.py", 1, "patterns/todo-placeholder", "warning"), ("t/a.py", 2, "patterns/todo-placeholder", "warning"), ("t/a.ts", 1, "patterns/ts-any-type", "warning"), ("t/a.ts", 2, "patterns/ts-ignore", "warning"), ("t/a.rs", 1, "patterns/rust-unwrap", "warning"), ("t/a.swift", 2, "patterns/swift-fatal-error", "warning"),
     ("t/a.d", 1, "patterns/dlang-goto", "warning"), ("t/a.d", 2, "patterns/dlang-gc-disable", "warning"), ("t/a.c", 1, "patterns/c-goto", "warning"), ("t/a.sol", 1, "patterns/solidity-missing-event", "info"), ("t/a.cbl", 1, "patterns/cobol-goto", "warning")],
)
ERRORS = (
    [("e/a.go", ["+_ = f.Close()"]), ("e/a.ts", ["+f().then(g)", "+x()", "+await h()"]), ("e/b.ts", ["+try {", "+await h()", "+f()", "+  .then(g)", "+  .catch(k)"]), ("e/a.py", ["+except:", "+except Exception as e:", "+    pass"]), ("e/a.zig", ["+x catch unreachable;"]), ("e/a.nim", ["+except:"]), ("e/a.cr", ["+rescue Exception"]), ("e/a.v", ["+f() or {}"]), ("e/a.d", ["+catch (Exception e) {}"]),
     ("e/a.hs", ["+fromJust y", "+-- undefined"]), ("e/a.clj", ["+(catch Exception e"]), ("e/a.erl", ["+catch _ -> ok"]), ("e/a.fs", ["+failwith m"]), ("e/a.ml", ["+with _ -> 1"]), ("e/a.pl", ["+die;"]), ("e/a.ps1", ["+x -ErrorAction SilentlyContinue"]), ("e/a.groovy", ["+catch (Exception e) {"]), ("e/a.jl", ["+catch e"]), ("e/a.sol", ["+require(x);"]), ("e/a.vb", ["+Catch", "+Catch e As X"]),
     ("e/a.adb", ["+when others =>"]), ("e/a.pas", ["+except"]), ("e/a.scala", ["+} catch {", "+case _ => x"]), ("e/a.ex", ["+rescue"]), ("e/a.dart", ["+on Exception catch (e)"]), ("e/A.java", ["+catch (Exception e) { }"]), ("e/a.rs", ["+x.unwrap()"])],
    [("e/a.go", 1, "errorhandling/go-discarded-error", "warning"), ("e/a.ts", 1, "errorhandling/ts-unhandled-promise", "warning"), ("e/a.ts", 3, "errorhandling/ts-unhandled-await", "warning"), ("e/a.py", 1, "errorhandling/python-bare-except", "warning"), ("e/a.py", 2, "errorhandling/python-except-pass", "warning"), ("e/a.zig", 1, "errorhandling/catch-unreachable", "warning"), ("e/a.nim", 1, "errorhandling/bare-except", "warning"),
     ("e/a.cr", 1, "errorhandling/broad-rescue", "warning"), ("e/a.v", 1, "errorhandling/empty-or-block", "warning"), ("e/a.d", 1, "errorhandling/empty-catch", "warning"), ("e/a.hs", 1, "errorhandling/haskell-fromjust", "warning"), ("e/a.clj", 1, "errorhandling/clojure-catch-all", "warning"), ("e/a.erl", 1, "errorhandling/erlang-catch-all", "warning"), ("e/a.fs", 1, "errorhandling/fsharp-failwith", "warning"),
     ("e/a.ml", 1, "errorhandling/ocaml-catch-all", "warning"), ("e/a.pl", 1, "errorhandling/perl-die-no-message", "warning"), ("e/a.ps1", 1, "errorhandling/powershell-silently-continue", "warning"), ("e/a.groovy", 1, "errorhandling/groovy-catch-all", "warning"), ("e/a.jl", 1, "errorhandling/julia-catch-all", "warning"), ("e/a.sol", 1, "errorhandling/solidity-require-no-message", "info"), ("e/a.vb", 1, "errorhandling/vb-empty-catch", "warning"),
     ("e/a.adb", 1, "errorhandling/ada-when-others", "info"), ("e/a.pas", 1, "errorhandling/pascal-bare-except", "warning"), ("e/a.scala", 2, "errorhandling/catch-all", "warning"), ("e/a.ex", 1, "errorhandling/bare-rescue", "warning"), ("e/a.dart", 1, "errorhandling/broad-catch", "warning"), ("e/A.java", 1, "errorhandling/java-empty-catch", "warning"), ("e/A.java", 1, "errorhandling/java-broad-catch", "info"), ("e/a.rs", 1, "errorhandling/rust-unwrap", "warning")],
)
CONCURRENCY = (
    [("c/a.go", ["+go work()", "+x", "+y", "+z", "+c := make(chan int)"]), ("c/b.go", ["+go work(ctx)"]), ("c/a.ts", [" async load() {", "+setState(a)", "+setState(b)"]), ("c/a.py", ["+async def f():", "+  time.sleep(1)", "+def g():", "+  time.sleep(1)"]), ("c/a.rs", ["+unsafe impl Send for X {}"]), ("c/A.java", ["+if (x == null)", "+synchronized (this) {"]), ("c/a.kt", ["+GlobalScope.launch {"]), ("c/a.ex", ["+spawn(f)"]), ("c/a.cs", ["+async void F()"])],
    [("c/a.go", 1, "concurrency/goroutine-leak", "warning"), ("c/a.go", 5, "concurrency/channel-size-zero", "info"), ("c/a.ts", 2, "concurrency/race-condition", "warning"), ("c/a.py", 2, "concurrency/async-blocking", "warning"), ("c/a.rs", 1, "concurrency/unsafe-send", "error"), ("c/A.java", 2, "concurrency/double-check-locking", "error"), ("c/a.kt", 1, "concurrency/global-scope", "warning"),
     ("c/a.ex", 1, "concurrency/unlinked-spawn", "info"), ("c/a.cs", 1, "concurrency/async-void", "warning")],
)
RESOURCE = (
    [("r/a.go", ["+f, err := os.Open(p)", "+x()"]), ("r/b.go", ["+f, err := os.Open(p)", "+defer f.Close()"]), ("r/a.py", ["+f = open(p)", "+with open(q) as g:"]), ("r/a.cpp", ["+auto x = new Foo;"]), ("r/a.ts", ["+w = new WebSocket(u)"]), ("r/a.c", ["+p = malloc(4);"]), ("r/a.rs", ["+Box::leak(b)"])],
    [("r/a.go", 1, "resource/go-unclosed-file", "warning"), ("r/a.py", 1, "resource/python-no-context-manager", "warning"), ("r/a.cpp", 1, "resource/cpp-new-no-delete", "warning"), ("r/a.ts", 1, "resource/ts-unclosed-connection", "warning"), ("r/a.c", 1, "resource/c-malloc-no-free", "warning"), ("r/a.rs", 1, "resource/rust-leaked-box", "warning")],
)
MIGRATION = (
    [("db/migrations/1.up.sql", ["+DROP TABLE x;", "+-- alter table x drop column y", "+ALTER TABLE x DROP COLUMN y;"]), ("db/migrate/2_x.rb", ["+remove_column :a, :b"]), ("alembic/versions/3.py", ["+op.drop_column('a')", "+op.alter_column('a', type_=X)"]), ("knex/migrations/4.js", ["+t.dropTable('x')"]), ("other/x.sql", ["+DROP TABLE x;"])],
    [("db/migrations/1.up.sql", 1, "migration-drop-table-db/migrations/1.up.sql-1", "error"), ("db/migrations/1.up.sql", 2, "migration-drop-column-db/migrations/1.up.sql-2", "error"), ("db/migrations/1.up.sql", 3, "migration-drop-column-db/migrations/1.up.sql-3", "error"), ("db/migrate/2_x.rb", 1, "migration-remove-column-db/migrate/2_x.rb-1", "error"),
     ("alembic/versions/3.py", 1, "migration-drop-column-alembic/versions/3.py-1", "error"), ("alembic/versions/3.py", 2, "migration-alter-column-type-alembic/versions/3.py-2", "warning"), ("knex/migrations/4.js", 1, "migration-drop-table-knex/migrations/4.js-1", "error")],
)

#: Analyzers whose issues are drawn alone.
ALONE = {
    "complexity": (
        [("a.go", ["+func Run(a int) {", *["+if a > 1 && b {"] * 5, "+}"]), ("r.rb", ["+def f", *["+return 1 if x"] * 10]), ("p.py", ["+def f(a, b, c=(1, 2), d: dict[str, int] = {}, e=0, g=1):", "+" + " " * 20 + "x", "+" + " " * 28 + "y"]), ("l.go", ["+func Long() {", *["+\tx()"] * 90, "+}"]), ("a_test.go", ["+func Run(a int) {", *["+if a > 1 && b {"] * 5])],
        [("a.go", 1, "complexity-cyclomatic-a.go-1", "warning"), ("a.go", 5, "complexity-nesting-a.go-5", "warning"), ("a.go", 6, "complexity-nesting-a.go-6", "warning"), ("a.go", 7, "complexity-nesting-a.go-7", "warning"), ("r.rb", 1, "complexity-cyclomatic-r.rb-1", "warning"), ("r.rb", 1, "complexity-returns-r.rb-1", "warning"), ("p.py", 1, "complexity-params-p.py-1", "warning"),
         ("p.py", 2, "complexity-nesting-p.py-2", "warning"), ("p.py", 3, "complexity-nesting-p.py-3", "error"), ("l.go", 1, "complexity-func-length-l.go-1", "warning")],
    ),
    "imports": (
        [("src/a.ts", ["+import { x, y } from './b'", "+import { z } from './gone'", "+import { q } from './never'"]), ("src/b.ts", ["+export const x = 1"]), ("src/gone.ts", ["-export const z = 1"], "deleted"), ("p/a.py", ["+from .b import y", "+from .only import was"]), ("p/b.py", ["+def x():"]), ("p/only.py", ["-def was():", "+pass"])],
        [("src/a.ts", 1, "import-name-src/a.ts-1-y", "error"), ("src/a.ts", 2, "import-deleted-src/a.ts-2", "error"), ("src/a.ts", 3, "import-broken-src/a.ts-3", "error"), ("p/a.py", 1, "import-name-p/a.py-1-y", "warning"), ("p/a.py", 2, "export-removed-p/only.py-p/a.py-was", "warning")],
    ),
    "references": (
        [("src/a.ts", ["+import { z } from './gone'", "+import { k } from './old'"]), ("src/gone.ts", ["-export const z = 1"], "deleted"), ("src/new.ts", [" export const k = 1"], "renamed", "src/old.ts"), ("g/a.go", ["-func Lost() {"]), ("g/b.go", ["+x := Lost()"])],
        [("src/a.ts", 1, "ref-deleted-src/a.ts-1-src/gone.ts", "error"), ("src/a.ts", 1, "ref-symbol-deleted-src/gone.ts-src/a.ts-z", "warning"), ("src/a.ts", 2, "ref-renamed-src/a.ts-2-src/old.ts", "warning"), ("g/b.go", 1, "ref-symbol-usage-g/a.go-g/b.go-Lost", "warning")],
    ),
    "consistency": (
        [("m.py", ["-def f(a):", "+def f(a, b):"]), ("u.py", [" from m import f"]), ("q/a.go", ["-func Do(a int) {", "+func Do(a, b int) {"]), ("q/b.go", [" x := Do(1)"])],
        [("u.py", 1, "sig-change-partial-m.py-u.py-f", "info"), ("q/b.go", 0, "sig-change-partial-q/a.go-q/b.go-Do", "info")],
    ),
    "docdrift": (
        [("m.go", [" // Sum adds a and b, see Sum(1, 2).", "-func Sum(a int, b int) int {", "+func Sum(a int) string {"]), ("n.go", [" x", "-func No(a int) {", "+func No() {"])],
        [("m.go", 1, "docdrift-param-mismatch-m.go-Sum-2", "warning"), ("m.go", 1, "docdrift-return-type-m.go-Sum-2", "info"), ("m.go", 1, "docdrift-stale-example-m.go-Sum-2", "info"), ("m.go", 1, "docdrift-stale-doc-m.go-Sum-2", "warning")],
    ),
    "deadcode": (
        [("m.py", ["+def unused():", "+def used():", "+def _own():"]), ("u.py", ["+from m import used"]), ("x.ts", ["+export const Y = 1"])],
        [("m.py", 1, "deadcode-m.py-unused-1", "warning"), ("x.ts", 1, "deadcode-x.ts-Y-1", "warning")],
    ),
    "depgraph": (
        [("p.ts", ["+import './q'"]), ("q.ts", ["+import './p'"]), *((f"ring/{i}.ts", [f"+import './{(i + 1) % 6}'"]) for i in range(6)), ("one/x.go", ['+import "m.test/r/two"']), ("two/y.go", ['+import "m.test/r/one"'])],
        [("p.ts", 0, "depgraph/circular-dependency", "warning"), ("ring/0.ts", 0, "depgraph/circular-dependency", "warning"), ("one/x.go", 0, "depgraph/circular-dependency", "warning")],
    ),
    "hallucination": (
        [("a.go", ["+func F() error {", "+\treturn nil", "+}", "+func G() {", "+\tx()", "+\ty()", "+}"]), ("a.py", ["+def f():", "+    pass", "+def h():", "+    return 3"]), ("b.rs", ["+fn k() {", "+    todo!()", "+}"]), ("s.ts", ["+import './nowhere'", "+import './t'"]), ("t.ts", ["+x"])],
        [("a.go", 1, "hallucination/stub-implementation", "warning"), ("a.py", 1, "hallucination/stub-implementation", "warning"), ("b.rs", 1, "hallucination/stub-implementation", "warning"), ("s.ts", 1, "hallucination/missing-import-target", "error")],
    ),
    "tests": (
        [("a/x.go", ["+package a"], "added"), ("a/y.go", ["+package a"], "added"), ("a/y_test.go", ["+package a"], "added"), ("b/z.py", ["+x"], "modified"), ("c/w_test.go", ["+package c"], "modified")],
        [("a/x.go", 0, "tests/new-file-no-test", "warning"), ("b/z.py", 0, "tests/changed-no-test", "warning"), ("c/w_test.go", 0, "tests/test-only-change", "info")],
    ),
    "spec": (
        [("q.ts", ["+x", "+// spec:REQ-9", "+// spec:REQ-1"])],
        [("", 0, "spec-unanchored-REQ-2", "warning"), ("q.ts", 2, "spec-orphan-REQ-9-q.ts-2", "error"), ("q.ts", 2, "spec-modified-REQ-9-q.ts-2", "info"), ("q.ts", 3, "spec-modified-REQ-1-q.ts-3", "info")],
    ),
}


def drawn(spark: SparkSession, files: list) -> DataFrame:
    """The drawn files in the shape of file_diffs, with ids below zero."""
    rows = []
    for k, (path, texts, *more) in enumerate(files):
        old, new, lines = 0, 0, []
        for x in texts:
            old, new = old + (x[0] in "- "), new + (x[0] in "+ ")
            lines.append((KINDS[x[0]], x[1:], old, new))
        rows.append((-1 - k, f"drawn {k}", path, more[1] if len(more) > 1 else None, more[0] if more else "modified", False, [(1, old, 1, new, lines)]))
    return spark.createDataFrame(rows, SHAPE)


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _values(rows: list[tuple]) -> str:
    lit = lambda v: R.quoted(v) if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


def _with_table(name: str, case: tuple, groups: tuple, guarded: tuple, doc: str) -> None:
    files, expected = case
    place = {path: (-1 - k, lines) for k, (path, lines, *_) in enumerate(files)}

    def run(spark, sf_dir):
        lines = Q.lines_of(spark, sf_dir).unionByName(L.diff_lines(drawn(spark, files)))
        found = R.scan(lines, groups) if groups else guards.guarded_issues(lines, guarded)
        return found.select("file_id", "hunk_no", "pos", "id", "severity")

    def position(path: str, line: int) -> int:
        return [k for k, x in enumerate(place[path][1]) if x[0] in "+ "][line - 1]

    QUERIES[name] = run
    run.__doc__ = doc
    rows = [(place[f][0], 0, position(f, n), i, s) for f, n, i, s in expected]
    table_sql = "\nUNION ALL\n".join(R.group_sql(g) for g in groups) if groups else guards.guarded_sql(guarded)
    ORACLE[name] = f"WITH {Q.LINES_SQL} SELECT file_id, hunk_no, pos, id, severity FROM ({table_sql}) UNION ALL SELECT * FROM (VALUES {_values(rows)})"


for _name, _case, _groups, _guarded in (
    ("security", SECURITY, pipeline.GROUPS["security"], ()), ("patterns", PATTERNS, tuple(g for g in pipeline.GROUPS["patterns"] if g.name != "console"), ()), ("migration", MIGRATION, pipeline.GROUPS["migration"], ()),
    ("errorhandling", ERRORS, (), pipeline.GUARDS["errorhandling"]), ("concurrency", CONCURRENCY, (), pipeline.GUARDS["concurrency"]), ("resource", RESOURCE, (), pipeline.GUARDS["resource"]),
):
    _with_table(f"analyzer_{_name}", _case, _groups, _guarded, f"Issues of the rules of {_name} in the table and in drawn files, whose issues are expected by hand.")


def _alone(name: str, case: tuple) -> None:
    files, expected = case

    def run(spark, sf_dir):
        extra = {"requirements": spark.createDataFrame([("REQ-1",), ("REQ-2",)], "req_id string")} if name == "spec" else {}
        return pipeline.found_by(pipeline.Context(drawn(spark, files), extra=extra), [name]).select("file", F.col("line").cast("int").alias("line"), "id", "severity")

    run.__doc__ = f"Issues of the analyzer {name} in drawn files, as expected by hand."
    QUERIES[f"analyzer_{name}"] = run
    ORACLE[f"analyzer_{name}"] = f"SELECT file, CAST(line AS INT) AS line, id, severity FROM (VALUES {_values(expected)}) t(file, line, id, severity)"


for _name, _case in ALONE.items():
    _alone(_name, _case)


def analyzers_overview(spark, sf_dir):
    """Issues per analyzer and severity of one analysis over all files, with every analyzer at work.

    Manifests are those among the files, as far as hunks show them; requirements are those that spec_results name. The
    tables hold no other files, so the tree is the diff itself. go.sum makes modules known but doesn't name the module
    of the repository, so Go imports are asked only beside a go.mod.
    """
    from tessella.plans import histories
    from tessella.sources import specs

    files = table(spark, sf_dir, "file_diffs")
    told = histories._nested(spark, sf_dir, "spec_results").select(F.explode("items").alias("x")).select(F.get_json_object("x.json", "$.id").alias("req_id"))
    extra = {"manifests": specs.diff_manifests(files), "requirements": told.where("req_id is not null").distinct()}
    ctx = pipeline.Context(files, custom=Q.CUSTOM, extra=extra)
    return pipeline.analyse(ctx).groupBy("category", "severity").agg(F.count("*").alias("issues"))


QUERIES["analyzers_overview"] = analyzers_overview
