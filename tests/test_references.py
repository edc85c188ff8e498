"""Orphan references against a dictionary lookup."""
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd

from tessella.operators import references as R

T0 = datetime(2025, 1, 1)
REFS = "table_name string, record_id string, ref_field string, kind string, key string, at timestamp, reason string"
PARENTS = "kind string, key string, created_at timestamp, deleted_at timestamp, at timestamp"


def day(n):
    return None if n is None else T0 + timedelta(days=n)


def run(spark, refs, parents, **k):
    found = R.orphans(spark.createDataFrame([(*r, "clash") for r in refs], REFS), spark.createDataFrame([(*p, T0) for p in parents], PARENTS), **k)
    return {(r.table_name, r.record_id, r.ref_field): r.reason for r in found.collect()}


def test_all_reasons_and_nulls(spark):
    parents = [("user", "u", day(10), None), ("user", "gone", day(0), day(20)), ("user", "undated", None, None), ("user", None, day(0), None)]
    refs = [
        ("runs", "1", "user_id", "user", "u", day(10)), ("runs", "2", "user_id", "user", "u", day(9)), ("runs", "3", "user_id", "user", "gone", day(20)), ("runs", "4", "user_id", "user", "gone", day(19)), ("runs", "5", "user_id", "user", "nobody", day(5)),
        ("runs", "6", "user_id", "user", None, day(5)), ("runs", "7", "user_id", "user", "u", None), ("runs", "8", "org_id", "org", "u", day(30)), ("runs", "5", "user_id", "user", "nobody", day(5)), ("runs", "9", "user_id", "user", "undated", day(0)),
    ]
    assert run(spark, refs, parents) == {("runs", "2", "user_id"): "not yet there", ("runs", "3", "user_id"): "deleted", ("runs", "5", "user_id"): "missing", ("runs", "8", "org_id"): "missing"}


def test_empty_sides(spark):
    assert run(spark, [], [("user", "u", day(0), None)]) == {}
    assert run(spark, [("runs", "1", "user_id", "user", "u", day(1))], []) == {("runs", "1", "user_id"): "missing"}


def test_hot_key_and_many_ranges(spark):
    rnd = random.Random(3)
    keys = [f"k{i}" for i in range(300)]
    parents = [("user", k, day(rnd.randint(0, 50)), day(rnd.randint(60, 200)) if rnd.random() < 0.3 else None) for k in keys if rnd.random() < 0.8]
    refs = [("runs", str(i), "user_id", "user", "k0" if i % 3 == 0 else rnd.choice([*keys, "x"]), day(rnd.randint(0, 120))) for i in range(6000)]
    known = {k: (c, d) for _, k, c, d in parents}
    want = {("runs", r[1], "user_id") for r in refs if r[4] not in known or known[r[4]][0] > r[5] or (known[r[4]][1] and known[r[4]][1] <= r[5])}
    assert set(run(spark, refs, parents, ranges=64)) == want
    assert set(run(spark, refs, parents, ranges=4, most=50)) == want  # ranges and the hot key in many parts


def test_keys_with_the_same_first_hash():
    frame = pd.DataFrame({"h": [5, 5, 5, 9], "g": [3, 1, 2, 0], "created_at": pd.to_datetime([None] * 4), "deleted_at": pd.to_datetime(["2025-01-01", None, "2025-01-01", None])})
    got = R._Parents([frame]).reasons(np.array([5, 5, 5, 5, 9, 9, 1, 10]), np.array([1, 2, 3, 4, 0, 1, 1, 1]), np.array(["2025-02-01"] * 8, "datetime64[us]"))
    assert got.tolist() == [None, "deleted", "deleted", "missing", None, "missing", "missing", "missing"]


def test_per_period(spark):
    found = R.orphans(spark.createDataFrame([("runs", "1", "user_id", "user", "a", day(3), ""), ("runs", "2", "user_id", "user", "b", day(40), ""), ("runs", "3", "user_id", "user", "b", day(41), "")], REFS), spark.createDataFrame([], PARENTS))
    assert sorted((r.period, r.orphans) for r in R.per_period(found).collect()) == [("2025-01-01", 1), ("2025-02-01", 2)]
