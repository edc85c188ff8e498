"""Edits by fix id and language."""
import pytest
from pyspark.sql import functions as F

from tessella.sinks import fixes, reports


@pytest.mark.parametrize(("fix", "path", "old", "new"), [
    ("anti-console-log", "a.ts", "  console.log(1)", ""), ("ada-debug-print", "a.adb", "Put_Line(x)", ""), ("sec-hardcoded-secret", "a.go", 'apiKey := "abcdefgh12"', 'apiKey := os.Getenv("API_KEY")'), ("sec-hardcoded-secret", "a.py", "DB_PASS = 'abcdefgh12'", 'DB_PASS = os.environ.get("DB_PASS")'),
    ("sec-hardcoded-secret", "a.ts", 'const userAPIToken: string = "abcdefgh12";', "const userAPIToken: string = process.env.USER_API_TOKEN;"), ("sec-hardcoded-secret", "a.unknown", 'k = "abcdefgh12"', None), ("sec-hardcoded-secret", "a.py", "k = 'short'", None),
    ("sec-insecure-random", "a.js", "x = Math.random()", "x = crypto.randomUUID()"), ("sec-insecure-random", "a.go", "x = rand()", None), ("ts-any-to-unknown", "a.ts", "f(x: any)", "f(x: unknown)"), ("none", "a.ts", "x", None),
])
def test_fix(spark, fix, path, old, new):
    found = spark.createDataFrame([(path, 1, fix)], "file string, line int, fix_id string")
    lines = spark.createDataFrame([(path, 1, old)], "file string, line int, content string")
    got = fixes.edits(found, lines).collect()
    assert [r.new_text for r in got] == ([] if new is None else [new])
    if new:
        assert reports.apply_edits(lines, fixes.edits(found, lines)).collect()[0].content == new


def test_names(spark):
    rows = spark.createDataFrame([("APIKey",), ("a-b.c",), ("XML",), ("userId2Name",)], "n string").select(fixes.env_name(F.col("n")).alias("e")).collect()
    assert [r.e for r in rows] == ["API_KEY", "A_B_C", "XML", "USER_ID2_NAME"]


@pytest.mark.parametrize(("fix", "path", "name", "old", "new"), [
    ("import-broken", "a.ts", None, "import { x } from './gone'", ""), ("import-broken", "a.py", None, "from .gone import x", ""), ("import-broken", "a.go", None, '\t"m.test/gone"', ""), ("import-broken", "a.rs", None, "use gone::x;", ""), ("import-broken", "a.ts", None, "import {", None), ("import-broken", "a.java", None, "import x.Y;", None),
    ("import-missing-export", "a.ts", "y", "import { x, y } from './b'", "import { x } from './b'"), ("import-missing-export", "a.ts", "y", "import { y } from './b'", ""), ("import-missing-export", "a.py", "y", "from b import x, y, z", "from b import x, z"), ("import-missing-export", "a.ts", "q", "import { x } from './b'", None),
    ("import-missing-export", "a.ts", None, "import { x } from './b'", None),
])
def test_imports_are_rewritten(spark, fix, path, name, old, new):
    found = spark.createDataFrame([(path, 1, fix, name)], "file string, line int, fix_id string, name string")
    lines = spark.createDataFrame([(path, 1, old)], "file string, line int, content string")
    assert [r.new_text for r in fixes.edits(found, lines).collect()] == ([] if new is None else [new])
