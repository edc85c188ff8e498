"""Anti-patterns: a firing and a clean line per language."""
from tessella.operators import lines as L
from tessella.operators import rules as R
from tessella.plans import pattern_packs as P
from tests.test_lines import files

CASES = [
    ("a.py", "raise NotImplementedError()", "todo-placeholder", "raise ValueError()"), ("a.go", 'password = "hunter2x"', "hardcoded-credential", 'password = "${PW}"'), ("a.ts", "let x: any = 1", "ts-any-type", "let x: unknown = 1"), ("b.ts", "// @ts-ignore", "ts-ignore", "// note"), ("A.java", 'if (s == "x")', "string-equals", 's.equals("x")'),
    ("a.rs", "x.clone()", "rust-unnecessary-clone", "x.copy()"), ("a.cs", "#pragma warning disable 1", "pragma-disable", "#region"), ("a.php", "$x = @$y;", "php-error-suppression", "$x = $y;"), ("a.swift", 'fatalError("x")', "swift-fatal-error", "throw x"), ("a.c", "goto end;", "c-goto", "return;"), ("a.zig", "f() catch unreachable", "zig-catch-unreachable", "try f()"),
    ("a.nim", "discard f()", "nim-discard", "f()"), ("a.cr", "x.not_nil!", "crystal-not-nil-bang", "x"), ("a.v", "f() or { panic(err) }", "vlang-or-panic", "f()?"), ("a.hs", "x = head xs", "haskell-partial-function", "x = xs"), ("a.clj", "  (def x 1)", "clojure-nested-def", "(def x 1)"), ("a.erl", "A ++ [B]", "erlang-list-append", "[B|A]"), ("a.fs", "let mutable x = 1", "fsharp-mutable", "let x = 1"),
    ("a.ml", "Obj.magic x", "ocaml-obj-magic", "x"), ("a.pl", 'open(F, "<x")', "perl-two-arg-open", "close(F)"), ("a.ps1", "$global:x = 1", "powershell-global-var", "$x = 1"), ("a.groovy", "x.getClass().name", "groovy-reflection", "x.name"), ("a.jl", "global x", "julia-global-var", "x = 1"), ("a.f90", "GOTO 10", "fortran-goto", "CALL x"), ("a.sol", "x.call{value: 1}", "solidity-unchecked-call", "(bool ok, ) = x.call{value: 1}"),
    ("a.tf", 'ami = "ami-0ab1"', "terraform-hardcoded-ami", "ami = var.ami"), ("a.proto", "repeated int32 x = 16;", "protobuf-high-field-number", "repeated int32 x = 15;"), ("a.vb", "On Error Resume Next", "vb-on-error-resume-next", "Dim x"), ("a.cob", "GO TO x", "cobol-goto", "PERFORM x"), ("a.adb", "goto x;", "ada-goto", "exit;"), ("a.pas", "goto x;", "pascal-goto", "exit;"),
]


def test_rules(spark):
    diff = files(spark, *[(p, ["+" + bad, "+" + good]) for p, bad, _, good in CASES])
    rows = R.scan(L.diff_lines(diff), P.ALL).collect()
    assert {(r.file, r.line, r.id) for r in rows} == {(p, 1, "patterns/" + i) for p, _, i, _ in CASES}
    assert next(r.message for r in rows if r.file == "a.ts").endswith("let x: any = 1")
