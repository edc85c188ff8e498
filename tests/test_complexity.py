"""Complexity as an analyzer of the pipeline, and the manifests and requirements that the overview feeds."""
import pytest
from pyspark.sql import functions as F

from tessella.plans import complexity, pipeline
from tessella.sources import specs
from tests.test_lines import files


def test_complexity_is_an_analyzer(spark):
    branchy = ["+func Run(a int) {", *["+if a > 1 && b {"] * 5, "+}"]
    diff = files(
        spark, ("a.go", branchy), ("a_test.go", branchy), ("vendor/b.go", branchy), ("gone.go", branchy, "deleted"), ("r.rb", ["+def f", *["+return 1 if x"] * 10]),
        ("p.py", ["+def f(a, b, c=(1, 2), d: dict[str, int] = {}, e=0, g=1):", "+" + " " * 20 + "x", "+" + " " * 28 + "y"]), ("q.java", ["+int f(int a) {", *["+if (a) {"] * 3, "+}"]),
    )
    got = sorted((r.file, r.line, r.id, r.severity) for r in pipeline.analyse(pipeline.Context(diff, enabled=frozenset({"complexity"}))).collect())
    assert got == [
        ("a.go", 1, "complexity-cyclomatic-a.go-1", "warning"), ("a.go", 5, "complexity-nesting-a.go-5", "warning"), ("a.go", 6, "complexity-nesting-a.go-6", "warning"), ("a.go", 7, "complexity-nesting-a.go-7", "warning"),
        ("p.py", 1, "complexity-params-p.py-1", "warning"), ("p.py", 2, "complexity-nesting-p.py-2", "warning"), ("p.py", 3, "complexity-nesting-p.py-3", "error"), ("r.rb", 1, "complexity-cyclomatic-r.rb-1", "warning"), ("r.rb", 1, "complexity-returns-r.rb-1", "warning"),
    ]


def test_length_where_the_end_is_shown(spark):
    body = [f"+\tx{i}()" for i in range(90)]
    diff = files(
        spark, ("a.go", ["+func Long() {", *body, "+}", "+func Short() {", "+\tx()", "+}"]), ("b.go", ["+func Cut() {", *body]), ("c.py", ["+class C:", "+    def f(self):", *["+        x()"] * 160, "+", "+    def g(self):", "+        y()", "+z = 1"]),
    )
    got = sorted((r.id, r.severity, r.message) for r in pipeline.found_by(pipeline.Context(diff), ["complexity"]).collect())
    assert got == [
        ("complexity-func-length-a.go-1", "warning", 'Function "Long" is 91 lines long (consider splitting at 80+)'), ("complexity-func-length-c.py-2", "error", 'Function "f" is 161 lines long (max recommended: 150)'),
    ]


@pytest.mark.parametrize(("text", "want"), [("func (s *T) F(a int, b map[string]int) (int, error) {", 2), ("def f():", 0), ("function f(a, b: Map<string, number>,) {", 2), ("def f(a,", None), ("func F(g func(a, b int), c int) {", 2)])
def test_parameters(spark, text, want):
    assert spark.range(1).select(complexity.parameters(F.lit(text)).alias("n")).first().n == want


def test_manifests_of_a_diff_ask_only_their_languages(spark):
    diff = files(
        spark, ("svc/requirements.txt", ["-old==1", "+numpy==1", "+scikit-learn", " spare"]), ("go.sum", ["+x.test/y v1.0.0 h1:abc="]), ("s.py", ["+import ghost", "+import numpy.linalg", "+import scikit_learn"]), ("g.go", ['+import "x.test/none"']), ("w.rs", ["+use ghost::a;"]),
        ("gone/requirements.txt", ["-ghost"], "deleted"),
    )
    told = specs.diff_manifests(diff)
    assert sorted((r.file, r.key) for r in specs.manifests(told).collect()) == [("go.sum", "x.test/y"), ("svc/requirements.txt", "numpy"), ("svc/requirements.txt", "scikit-learn"), ("svc/requirements.txt", "spare")]
    got = pipeline.analyse(pipeline.Context(diff, extra={"manifests": told}), ["hallucination", "depgraph"]).collect()
    assert sorted((r.file, r.id, r.message.split(": ")[1]) for r in got) == [("s.py", "hallucination/phantom-import", "ghost"), ("svc/requirements.txt", "depgraph/unused-dependency", "spare")]
