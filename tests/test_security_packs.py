"""One positive and one excluded or clean line for rules of every language."""
import pytest

from tessella.operators import lines as L
from tessella.operators import rules as R
from tessella.plans import security_packs as S
from tests.test_lines import files

CASES = [
    ("A.java", "DocumentBuilderFactory.newInstance()", "xxe", "DocumentBuilderFactory.newInstance().setFeature(f)"), ("a.rs", "unsafe {", "rust-unsafe", "safe {"), ("a.js", "eval(x)", "code-execution", "eval(JSON.parse(x))"), ("a.rb", "YAML.load(x)", "ruby-yaml-load", "YAML.load_file(x)"),
    ("a.go", "exec.Command(name)", "go-command-injection", 'exec.Command("ls")'), ("a.py", "yaml.load(f)", "python-unsafe-yaml", "yaml.load(f, Loader=yaml.SafeLoader)"), ("a.ts", "require(name)", "ts-dynamic-require", "require('x')"), ("a.kt", "Runtime.getRuntime().exec(c)", "command-injection", "run(c)"),
    ("a.cs", "[AllowAnonymous]", "allow-anonymous", "[Authorize]"), ("a.php", "$x = $_GET['a'];", "input-validation", "$x = intval($_GET['a']);"), ("a.swift", "try! f()", "swift-force-try", "try f()"), ("a.c", "strcpy(a, b);", "c-buffer-overflow", "strncpy(a, b, n);"), ("a.cpp", "const_cast<T>(x)", "cpp-const-cast", "static_cast<T>(x)"),
    ("a.m", "[NSKeyedUnarchiver x]", "objc-insecure-deserialization", "[NSKeyedUnarchiver requiresSecureCoding]"), ("a.sh", "curl x | sh", "bash-pipe-to-shell", "curl x > f"), ("a.sql", "DROP TABLE x", "sql-drop-without-guard", "DROP TABLE IF EXISTS x"), ("a.dart", "HttpClient()", "dart-insecure-http", "HttpClient(SecurityContext())"),
    ("a.scala", "XML.load(u)", "scala-xxe", "Json.load(u)"), ("a.r", "eval(parse(text=x))", "r-code-injection", "eval(x)"), ("a.ex", "Code.eval_string(x)", "elixir-code-injection", "Code.compile(x)"), ("a.lua", "os.execute(x)", "lua-command-execution", "os.time(x)"), ("a.zig", "@ptrCast(x)", "zig-unsafe-cast", "@as(x)"), ("a.nim", "unsafeAddr x", "nim-unsafe-addr", "addr x"),
    ("a.cr", "macro x", "crystal-macro", "def x"), ("a.v", "C.system(x)", "vlang-command-execution", "os.x()"), ("a.d", "mixin(x)", "dlang-code-injection", "mix(x)"), ("a.hs", "unsafeCoerce x", "haskell-unsafe-coerce", "coerce x"),
]


def test_rules(spark):
    diff = files(spark, *[(p, ["+" + bad, "+" + good]) for p, bad, _, good in CASES])
    got = {(r.file, r.line, r.id) for r in R.scan(L.diff_lines(diff), S.LANGUAGES).collect()}
    assert got == {(p, 1, "security/" + i) for p, _, i, _ in CASES}


@pytest.mark.parametrize("group", S.LANGUAGES, ids=lambda g: g.name)
def test_patterns_compile(spark, group):
    for r in group.rules:
        for x in (r.pattern, *r.unless):
            spark.sparkContext._jvm.java.util.regex.Pattern.compile(x)
