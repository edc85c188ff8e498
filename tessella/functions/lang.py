"""Languages of files, test files and their conventional places."""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions import paths

# fixed values: extensions of the known languages
LANGUAGES = {
    "go": ".go", "typescript": ".ts .tsx .js .jsx .mjs .cjs", "python": ".py", "java": ".java", "rust": ".rs", "ruby": ".rb .rake", "kotlin": ".kt .kts", "csharp": ".cs", "php": ".php", "swift": ".swift",
    "c": ".c .h", "cpp": ".cpp .cc .cxx .hpp .hxx", "objc": ".m .mm", "bash": ".sh .bash", "sql": ".sql", "dart": ".dart", "scala": ".scala .sc", "r": ".r", "elixir": ".ex .exs", "lua": ".lua",
    "julia": ".jl", "fortran": ".f90 .f95 .f03 .f08 .f .for", "solidity": ".sol", "terraform": ".tf", "protobuf": ".proto", "perl": ".pl .pm", "powershell": ".ps1 .psm1", "groovy": ".groovy .gvy",
    "zig": ".zig", "nim": ".nim", "crystal": ".cr", "vlang": ".v", "dlang": ".d", "haskell": ".hs .lhs", "clojure": ".clj .cljs .cljc .edn", "erlang": ".erl .hrl", "fsharp": ".fs .fsx .fsi", "ocaml": ".ml .mli",
    "visualbasic": ".vb .vbs", "cobol": ".cob .cbl .cpy", "ada": ".adb .ads", "pascal": ".pas .pp .dpr .lpr",
}
EXTENSIONS = {e: lang for lang, exts in LANGUAGES.items() for e in exts.split()}
# fixed values: folders that hold no source of one's own
SKIPPED_DIRS = ["vendor", "node_modules", "testdata", "__tests__"]
# fixed values: folders of tests, and by extension what a test file's name ends or begins with and further folders
TEST_FOLDERS = ("__tests__", "tests", "test")
TEST_AFFIXES = (
    # extensions, endings, beginnings, further folders; without folders at all for Go
    (".go", "_test", "", None),
    (".ts .tsx .js .jsx .mjs .cjs", ".test .spec", "", ()),
    (".py", "_test", "test_", ()),
    (".rb .rake", "_test _spec", "", ("spec",)),
    (".kt .kts", "Test Tests Spec", "", ()),
    (".cs", "Test Tests", "", ("Tests", "[^/]*\\.Tests", "[^/]*\\.Test")),
    (".php", "Test _test", "", ()),
    (".swift", "Tests Test", "", ()),
    (".c .h", "_test", "test_", ()),
    (".cpp .cc .cxx .hpp .hxx", "_test", "test_", ()),
    (".m .mm", "Tests Test", "", ()),
    (".sh .bash", "_test", "test_", ()),
    (".dart", "_test", "", ()),
    (".scala", "Spec Test Suite", "", ()),
    (".r", "", "test_ test-", ()),
    (".ex .exs", "_test", "", ()),
    (".lua", "_test _spec", "test_", ()),
    (".zig", "_test", "", ()),
    (".nim", "", "test_ t_", ()),
    (".cr", "_spec", "", ("spec",)),
    (".v", "_test", "", ()),
    (".d", "_test", "test_", ()),
    (".hs .lhs", "Spec Test", "", ()),
    (".clj .cljs .cljc", "_test", "", ()),
    (".erl", "_SUITE _tests", "", ()),
    (".fs .fsx", "Tests Test", "", ()),
    (".ml .mli", "_test", "test_", ()),
    (".pl .pm", ".t", "test_", ()),
    (".ps1", ".Tests .Test", "", ()),
    (".groovy .gvy", "Test Spec", "", ()),
    (".jl", "_test", "test_", ()),
    (".f90 .f95 .f03 .f08", "_test", "test_", ()),
    (".sol", ".t", "Test", ()),
    (".vb .vbs", "Test Tests", "", ()),
    (".adb .ads", "_test", "test_", ()),
    (".pas .pp", "_test", "test_", ()),
)


def _test_pattern() -> str:
    """One pattern of a test file's path, from the table of affixes."""
    out = []
    for exts, tails, heads, folders in TEST_AFFIXES:
        names = [f"[^/]*{re.escape(t)}" for t in tails.split()] + [f"{re.escape(h)}[^/]*" for h in heads.split()]
        end = f"(?:{'|'.join(re.escape(e) for e in exts.split())})$"
        out += [f"(?:^|/)(?:{'|'.join(names)}){end}"] if names else []
        out += [f"(?:^|/)(?:{'|'.join((*TEST_FOLDERS, *folders))})/.*{end}"] if folders is not None else []
    return "|".join(out)


TEST_FILE = _test_pattern()


def language(path: Column) -> Column:
    """The language of a path by its extension, null for an unknown one."""
    table = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    return F.try_element_at(table, paths.extension(path))


def is_test(path: Column) -> Column:
    """Whether a path follows its language's convention for tests."""
    return F.coalesce(path.rlike(TEST_FILE), F.lit(False))


def test_places(path: Column, lang: Column) -> Column:
    """Conventional paths of the tests of a source file, best first."""
    d, n, e = paths.dirname(path), paths.stem(path), paths.extension(path)
    at = lambda *x: F.concat(*x)
    here = F.concat(d, F.lit("/"))
    return (
        F.when(lang == "go", F.array(at(here, n, F.lit("_test.go"))))
        .when(lang == "typescript", F.array(at(here, n, F.lit(".test"), e), at(here, n, F.lit(".spec"), e), at(here, F.lit("__tests__/"), n, F.lit(".test"), e)))
        .when(lang == "python", F.array(at(here, F.lit("test_"), n, e), at(here, F.lit("tests/test_"), n, e)))
        .when(lang.isin("kotlin", "swift", "java"), F.array(at(here, n, F.lit("Test"), e), at(here, n, F.lit("Tests"), e)))
        .when(lang == "csharp", F.array(at(here, n, F.lit("Test"), e), at(here, n, F.lit("Tests"), e), at(here, F.lit("Tests/"), n, F.lit("Tests"), e)))
        .when(lang == "php", F.array(at(here, n, F.lit("Test"), e), at(here, F.lit("tests/"), n, F.lit("Test"), e)))
        .when(lang.isin("c", "cpp"), F.array(at(here, n, F.lit("_test"), e), at(here, F.lit("test_"), n, e)))
    )
