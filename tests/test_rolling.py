"""Trailing totals against loops over days."""
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessella.operators import rolling as R

T0 = datetime(2025, 1, 1, 5)


def run(spark, rows):
    df = spark.createDataFrame(rows, "u string, t timestamp, e int, entity string, day string")
    daily = R.daily_totals(df, F.col("u"), F.col("t"), {"runs": F.lit(1), "errors": F.col("e")})
    span = df.agg(F.min(R.day_number(F.col("t"))).alias("a"), F.max(R.day_number(F.col("t"))).alias("b"))
    return R.trailing(daily, ["runs", "errors"], span.select("a").scalar(), span.select("b").scalar())


def test_against_loops(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice("ab"), T0 + timedelta(days=rnd.randint(0, 70)), rnd.choice([None, 0, 3]), "", "") for _ in range(80)]
    rows += [(None, T0, 1, "", ""), ("a", None, 9, "", "")]
    got = {(r.entity, r.day): r for r in run(spark, rows).collect()}
    days = [(T0 + timedelta(days=n)).date() for n in range(0, 71)]
    days = [d for d in days if min(r[1] for r in rows if r[1]).date() <= d <= max(r[1] for r in rows if r[1]).date()]
    assert len(got) == 2 * len(days)
    for u in "ab":
        for d in days:
            for n in (7, 30):
                mine = [r for r in rows if r[0] == u and r[1] and d - timedelta(days=n) < r[1].date() <= d]
                row = got[u, d]
                assert row[f"runs_{n}d"] == len(mine) and row[f"errors_{n}d"] == sum(r[2] or 0 for r in mine)
                assert abs(row[f"avg_errors_{n}d"] - sum(r[2] or 0 for r in mine) / n) < 1e-6


def test_single_day_and_empty(spark):
    one = run(spark, [("a", T0, 2, "", ""), ("a", T0, 2, "", "")]).collect()
    assert [(r.runs_7d, r.errors_30d) for r in one] == [(2, 4)]
    assert run(spark, []).count() == 0
