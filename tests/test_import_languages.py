"""Imports, references and cycles of Python and Go, beside those of scripts."""
from tessella.plans import pipeline
from tests.test_analyzers import found
from tests.test_lines import files


def test_python_imports_and_references(spark):
    diff = files(
        spark, ("p/a.py", ["+from .b import x, y", "+from .gone import z", "+from . import b, c", "+from .away import k", "+from .only import was", "+from outside import f"]), ("p/b.py", ["+def x():"]),
        ("p/__init__.py", ["+def c():"]), ("p/gone.py", ["-def z():"], "deleted"), ("p/only.py", ["-def was():", "+pass"]), ("r/a.rb", ["+require_relative './gone'", "+require_relative './never'"]), ("r/gone.rb", ["-x"], "deleted"),
    )
    moved = spark.createDataFrame([(99, "p/new.py", "p/away.py", "renamed", False, [], "")], diff.schema)
    ctx = pipeline.Context(diff.unionByName(moved))
    assert found(spark, ctx, "imports") == [("p/a.py", 1, "import-name"), ("p/a.py", 2, "import-deleted"), ("p/a.py", 5, "export-removed"), ("r/a.rb", 1, "import-deleted")]
    assert found(spark, ctx, "references") == [
        ("p/a.py", 2, "ref-deleted"), ("p/a.py", 2, "ref-symbol-deleted"), ("p/a.py", 4, "ref-renamed"), ("p/a.py", 5, "ref-symbol-deleted"), ("r/a.rb", 1, "ref-deleted"),
    ]


def test_python_and_go_cycles(spark):
    diff = files(
        spark, ("p/a.py", ["+from .b import x"]), ("p/b.py", ["+from . import c"]), ("p/__init__.py", ["+from .a import y"]),
        ("svc/one/x.go", ['+import "m.test/r/svc/two"', '+import "fmt"']), ("svc/one/a.go", ["+package one"]), ("svc/two/y.go", ['+import "m.test/r/svc/one"']), ("svc/two/y_test.go", ['+import "m.test/r/fmt"']), ("fmt/f.go", ['+import "m.test/r/svc/two"']),
    )
    got = sorted((r.file, r.message.split(": ")[1]) for r in pipeline.relational.depgraph(pipeline.Context(diff)).collect())
    assert got == [("p/__init__.py", "p/__init__.py->p/a.py->p/b.py"), ("svc/one/x.go", "svc/one->svc/two")]
