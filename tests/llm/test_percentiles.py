"""Multi-select against sorting."""
import math
import random

import pytest
from pyspark.sql import functions as F

from tessella.llm import percentiles as P

RANKS = (0.01, 0.25, 0.5, 0.9, 0.99, 1.0)


def brute(rows):
    out = {}
    for g in {r[0] for r in rows}:
        values = sorted(v for k, v in rows if k == g and v is not None and not math.isnan(v))
        for q in RANKS if values else ():
            out[g, q] = values[max(math.ceil(q * len(values) - 1e-9), 1) - 1]
    return out


@pytest.mark.parametrize("leaf", [0, 4, 64, 5000])
def test_exact_for_hot_skewed_and_null_groups(spark, leaf):
    rnd = random.Random(leaf)
    rows = [("hot", float(rnd.randint(0, 10**rnd.randint(1, 6)))) for _ in range(3000)]
    rows += [(None, rnd.choice([1.0, 2.0, 2.0, -5.5])) for _ in range(200)] + [(f"g{rnd.randint(0, 20)}", float(rnd.randint(0, 50))) for _ in range(500)]
    rows += [("none", None), ("nan", float("nan")), ("one", 7.0), ("same", 3.0), ("same", 3.0)]
    facts = spark.createDataFrame(rows, "g string, v double")
    got = P.percentiles(P.summarise(facts, {"g": F.col("g")}, {"v": F.col("v")}), ["g"], RANKS, leaf=leaf).collect()
    assert {(r.g, r["rank"]): r.value for r in got} == brute(rows)
    assert len(got) == len(brute(rows))


def test_merged_days_equal_the_whole_and_error_is_bounded(spark):
    rnd = random.Random(1)
    rows = [("a", rnd.randint(0, 3), float(rnd.randint(-10**6, 10**6))) for _ in range(800)]
    facts = spark.createDataFrame(rows, "g string, day int, v double")
    whole = P.summarise(facts, {"g": F.col("g")}, {"v": F.col("v")})
    days = [P.roll_up(P.summarise(facts.where(F.col("day") == d), {"g": F.col("g"), "day": F.col("day")}, {"v": F.col("v")}), ["g"]) for d in range(4)]
    assert sorted(P.merge(*days).collect()) == sorted(whole.collect())
    short = P.summarise(facts, {"g": F.col("g")}, {"v": F.col("v")}, digits=8)
    exact = {r["rank"]: r.value for r in P.percentiles(whole, ["g"], RANKS, leaf=16).collect()}
    for r in P.percentiles(short, ["g"], RANKS, leaf=16).collect():
        assert abs(r.value - exact[r["rank"]]) <= 2.0**-7 * abs(exact[r["rank"]])


def test_hot_ranges_are_spread_over_slots(spark, monkeypatch):
    monkeypatch.setattr(P, "PER_SLOT", 40)
    rows = [("hot", float(k * 7919 % 5003)) for k in range(5003)] + [("small", float(k)) for k in range(30)]
    facts = spark.createDataFrame(rows, "g string, v double")
    got = P.percentiles(P.summarise(facts, {"g": F.col("g")}, {"v": F.col("v")}), ["g"], RANKS, leaf=16).collect()
    assert {(r.g, r["rank"]): r.value for r in got} == brute(rows) and len(got) == 2 * len(RANKS)


def test_medians_of_batches():
    import pandas as pd

    batch = pd.DataFrame({"range_id": [2, 1, 1, 1, 2], "value": [5.0, 3.0, 1.0, 2.0, 9.0], "n": [1, 1, 5, 1, 4]})
    got = pd.concat(P._weighted_medians(iter([batch, batch.iloc[:0], batch.iloc[1:2]]))).values.tolist()
    assert got == [[1, 1.0, 7], [2, 9.0, 5], [1, 3.0, 1]]


def test_empty(spark):
    facts = spark.createDataFrame([], "g string, v double")
    assert P.percentiles(P.summarise(facts, {"g": F.col("g")}, {"v": F.col("v")}), ["g"], RANKS).count() == 0
