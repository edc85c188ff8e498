"""The ledger against a brute-force replay of all assertions."""
from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.operators import bitemporal as B

T0 = datetime(2025, 1, 1)
SCHEMA = "entity_id string, valid_at timestamp, recorded_at timestamp, state string, key string"


def day(n):
    return T0 + timedelta(days=n)


def state_known(rows, key, valid, recorded):
    """State of ``key`` at ``valid`` as known at ``recorded``."""
    known = [r for r in rows if r[0] == key and r[1] is not None and r[2] is not None and r[1] <= valid and r[2] <= recorded]
    return max(known, key=lambda r: (r[1], r[2], r[3]))[3] if known else None


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.integers(0, 60), st.integers(0, 60), st.sampled_from("xyz")), max_size=25))
def test_ledger_matches_replay(spark, told):
    rows = [(k, day(v), day(r), s, "clash") for k, v, r, s in told]
    book = B.ledger(spark.createDataFrame(rows, SCHEMA), slice_seconds=10 * 86_400).collect()
    for key in "ab":
        for valid in range(0, 62, 3):
            for recorded in range(0, 62, 5):
                v, r = day(valid), day(recorded)
                held = [x.state for x in book if x.key == key and x.valid_from <= v and (x.valid_to is None or v < x.valid_to) and x.recorded_from <= r and (x.recorded_to is None or r < x.recorded_to)]
                want = state_known(rows, key, v, r)
                assert held == ([] if want is None else [want])


def test_late_update_splits_and_supersedes(spark):
    told = [("a", day(0), day(0), "x", ""), ("a", day(20), day(20), "z", ""), ("a", day(10), day(30), "y", ""), (None, day(1), day(1), "n", ""), ("a", None, day(1), "n", "")]
    book = B.ledger(spark.createDataFrame(told, SCHEMA))
    assert {(r.valid_from, r.valid_to, r.state) for r in B.as_of(book).collect()} == {(day(0), day(10), "x"), (day(10), day(20), "y"), (day(20), None, "z")}
    before = B.as_of(book, F.lit(day(25)))
    assert {(r.valid_from, r.valid_to, r.state) for r in before.collect()} == {(day(0), day(20), "x"), (day(20), None, "z")}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(0, 60), st.integers(0, 60), st.sampled_from("xyz")), max_size=20), st.integers(0, 20))
def test_merge_of_late_rows_equals_the_ledger_of_all(spark, told, cut):
    rows = [(k, day(v), day(r), s, "clash") for k, v, r, s in told]
    make = lambda part: spark.createDataFrame(part, SCHEMA)
    stored = B.ledger(make(rows[:cut]), slice_seconds=10 * 86_400)
    assert sorted(map(str, B.merge(stored, make(rows[cut:]), slice_seconds=10 * 86_400).collect())) == sorted(map(str, B.ledger(make(rows), slice_seconds=10 * 86_400).collect()))


def test_a_very_late_row_finds_its_neighbours_slices_away(spark):
    told = [("a", day(10 * k), day(10 * k), str(k), "") for k in range(12)] + [("a", day(95), day(25), "early", ""), ("a", day(5), day(300), "late", "")]
    book = B.ledger(spark.createDataFrame(told, SCHEMA), slice_seconds=10 * 86_400)
    now = {(r.valid_from, r.valid_to): r.state for r in B.as_of(book).collect()}
    assert now[day(0), day(5)] == "0" and now[day(5), day(10)] == "late" and now[day(90), day(95)] == "9" and now[day(95), day(100)] == "early"
    then = {(r.valid_from, r.valid_to): r.state for r in B.as_of(book, F.lit(day(26))).collect()}
    assert then == {(day(0), day(10)): "0", (day(10), day(20)): "1", (day(20), day(95)): "2", (day(95), None): "early"}


def test_empty_and_null_states(spark):
    assert B.ledger(spark.createDataFrame([], SCHEMA)).count() == 0
    told = [("a", day(0), day(0), None, ""), ("a", day(1), day(1), None, ""), ("a", day(40), day(40), "x", "")]
    changes = B.versions(B.as_of(B.ledger(spark.createDataFrame(told, SCHEMA)))).collect()
    assert sorted((r.valid_from, r.state) for r in changes) == [(day(0), None), (day(40), "x")]


def test_absent_from_snapshot_starts_anew(spark):
    rows = [("a", day(0), day(0), "s"), ("b", day(15), day(15), "t"), ("a", day(30), day(31), "s")]
    told = B.snapshot_assertions(spark.createDataFrame(rows, "k string, at timestamp, sent timestamp, s string"), "k", "at", "sent", F.col("s"))
    changes = B.versions(B.as_of(B.ledger(told))).where("state.present").collect()
    assert sorted((r.key, r.valid_from) for r in changes) == [("a", day(0)), ("a", day(30)), ("b", day(15))]
