"""Inserts, upserts, signatures and deliveries of the store, and reports as lines."""
import hashlib
import hmac
import json

from pyspark.sql import functions as F

from tessella.operators import service as S
from tessella.sinks import reports


def test_inserted_runs_are_counted_once(spark):
    runs = spark.createDataFrame([("a", "u", 1, "x")], "id string, user_id string, errors int, note string")
    sent = spark.createDataFrame([("a", "u", 9), ("b", "v", None), (None, "w", 2), (None, "w", 2), (" ", "z", None)], "id string, user_id string, errors int")
    got = sorted((r.user_id, r.errors, r.note) for r in S.insert_runs(runs, sent).collect())
    assert got == [("u", 1, "x"), ("v", 0, None), ("w", 2, None), ("z", 0, None)]
    again = S.insert_runs(S.insert_runs(runs, sent), sent)
    assert again.count() == 4 and all(r.id for r in again.collect())
    assert S.insert_runs(runs.limit(0), sent.limit(0)).count() == 0


def test_identity_keeps_its_first_time(spark):
    shape = "org_id string, issuer string, created_at int, updated_at int"
    got = S.upsert_identity(spark.createDataFrame([("o", "old", 1, 1), ("p", "own", 2, 2)], shape), spark.createDataFrame([("o", "new", 5, 5)], shape)).collect()
    assert sorted(tuple(r) for r in got) == [("o", "new", 1, 5), ("p", "own", 2, 2)]


def test_signatures(spark):
    cases = [("k", "body"), ("", ""), ("s" * 64, "x"), ("s" * 65, "é" * 200), ("schlüssel", '{"a": 1}'), (None, "x"), ("k", None)]
    got = spark.createDataFrame(cases, "k string, b string").select("k", "b", S.hmac_sha256(F.col("k"), F.col("b")).alias("h")).collect()
    for r in got:
        assert r.h == (None if r.k is None or r.b is None else hmac.new(r.k.encode(), r.b.encode(), hashlib.sha256).hexdigest())


def test_deliveries(spark):
    events = spark.createDataFrame([("o", "run.done", "{}"), ("q", "run.done", "{}")], "org_id string, event string, body string")
    hooks = spark.createDataFrame([(1, "o", "u1", "k", ["*"], True), (2, "o", "u2", "k", ["other"], True), (3, "o", "u3", "k", ["run.done"], False)], "id int, org_id string, url string, secret string, events array<string>, active boolean")
    (r,) = S.deliveries(events, hooks).collect()
    assert (r.hook_id, r.waits) == (1, [1, 2, 4]) and r.signature == "sha256=" + hmac.new(b"k", b"{}", hashlib.sha256).hexdigest()


def test_sarif_as_lines_is_the_document(spark):
    rows = [("b.py", 2, "r/1", "error", "c", 'say "no"'), ("a.py", None, "r/2", "info", "c", "m"), ("a.py", 10, "r/1", "error", "c", "n")]
    issues = spark.createDataFrame(rows, "file string, line int, id string, severity string, category string, message string")
    cwe = spark.createDataFrame([("r/1", "CWE-1")], "id string, cwe string")
    told = json.loads("".join(r.text for r in reports.sarif_lines(issues, cwe).orderBy("place").collect()))
    whole = json.loads(reports.sarif(issues, cwe).first().sarif)
    assert sorted(map(str, told["runs"][0]["results"])) == sorted(map(str, whole["runs"][0]["results"])) and told["runs"][0]["tool"] == whole["runs"][0]["tool"]
    assert [r["ruleId"] for r in told["runs"][0]["results"]] == ["r/1", "r/1", "r/2"]
    assert json.loads("".join(r.text for r in reports.sarif_lines(issues.limit(0), cwe).orderBy("place").collect()))["runs"][0]["results"] == []
