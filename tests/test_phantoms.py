"""Phantom imports: one known and one unknown import per language."""
from tessella.plans import phantoms as P

KNOWN = [
    ("go", "fmt"), ("go", "h.io/mod/sub"), ("typescript", "node:fs"), ("typescript", "@s/pkg/deep"), ("typescript", "./x"), ("python", "os.path"), ("python", "some_dep.x"), ("rust", "std::io"), ("rust", "my_dep::x"), ("php", "App\\X"), ("swift", "UIKit"), ("ruby", "net/http"), ("c", "stdio.h"), ("cpp", "vector"), ("cpp", "stdio.h"),
    ("dart", "dart:io"), ("dart", "package:dep/x.dart"), ("dart", "x.dart"), ("scala", "scala.io.X"), ("r", "stats"), ("elixir", "Enum"), ("lua", "string"), ("zig", "std"), ("nim", "strutils"), ("crystal", "http/client"), ("vlang", "net.http"), ("dlang", "std.stdio"), ("haskell", "Data.Map"), ("clojure", "clojure.string"),
    ("fsharp", "System.IO"), ("ocaml", "List"), ("perl", "File::Spec"), ("powershell", "PSReadLine"), ("powershell", "./m.psm1"), ("julia", "Dates"), ("solidity", "@openzeppelin/x.sol"), ("protobuf", "google/protobuf/any.proto"), ("groovy", "groovy.json.X"), ("java", "anything.at.all"), ("csharp", "System.Net"), ("terraform", "x"), ("objc", "Foundation/Foundation.h"),
]
UNKNOWN = [
    ("go", "h.io/modx"), ("typescript", "ghost"), ("python", "ghost.x"), ("rust", "ghost::x"), ("php", "Ghost\\X"), ("swift", "GhostKit"), ("ruby", "ghost"), ("c", "ghost.h"), ("dart", "dart:ghost"), ("scala", "ghost.X"), ("r", "ghost"), ("elixir", "Ghost.X"), ("haskell", "Ghost.X"), ("perl", "Ghost::X"), ("powershell", "Ghost"),
    ("solidity", "@ghost/x.sol"), ("java", "java.utils.List"), ("kotlin", "org.spring.X"), ("csharp", "System.Collections.Generics.List"), ("julia", "Ghost"),
]


def test_every_language(spark):
    imports = spark.createDataFrame(KNOWN + UNKNOWN + [("python", None), (None, "x")], "lang string, path string")
    packages = spark.createDataFrame([("h.io/mod",), ("@s/pkg",), ("some-dep",), ("my-dep",), ("dep",)], "key string")
    got = {(r.lang, r.path) for r in P.phantom_imports(imports, packages).collect()}
    assert got == set(UNKNOWN)


def test_without_manifests_only_what_needs_none(spark):
    imports = spark.createDataFrame(UNKNOWN, "lang string, path string")
    got = {(r.lang, r.path): r.severity for r in P.phantom_imports(imports, None).collect()}
    assert got == {("powershell", "Ghost"): "warning", ("solidity", "@ghost/x.sol"): "warning", ("java", "java.utils.List"): "error", ("kotlin", "org.spring.X"): "error", ("csharp", "System.Collections.Generics.List"): "error"}


def test_own_modules_and_empty(spark):
    imports = spark.createDataFrame([("python", "mine.x")], "lang string, path string")
    dep = spark.createDataFrame([("d",)], "key string")
    assert P.phantom_imports(imports, dep, spark.createDataFrame([("mine",)], "key string")).count() == 0
    assert P.phantom_imports(imports.limit(0), dep).count() == 0
