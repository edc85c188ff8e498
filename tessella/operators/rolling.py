"""Rolling totals over trailing periods, inactive days included.

Facts are first reduced to sparse daily totals; between two active days, and before the first and after the last
one, calendar rows are generated in place (no join with a calendar). Range frames over integer day numbers then
give each trailing total; averages divide by the fixed length of the period.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def day_number(day: Column) -> Column:
    """Days since 1970-01-01, negative before."""
    return F.datediff(day.cast("date"), F.lit("1970-01-01").cast("date"))


def daily_totals(facts: DataFrame, entity: Column, day: Column, measures: dict[str, Column]) -> DataFrame:
    """(entity, day_no INT, measures...) summed; rows without entity or day are left out, null measures count as 0."""
    return (
        facts.select(entity.alias("entity"), day_number(day).alias("day_no"), *(F.coalesce(m.cast("long"), F.lit(0)).alias(n) for n, m in measures.items()))
        .where("entity is not null and day_no is not null")
        .groupBy("entity", "day_no")
        .agg(*(F.sum(n).alias(n) for n in measures))
    )


def trailing(daily: DataFrame, measures: Sequence[str], first_no: Column, last_no: Column, periods: Sequence[int] = (7, 30)) -> DataFrame:
    """One row per entity and day from ``first_no`` to ``last_no`` (day numbers, e.g. scalar subqueries): per measure and
    period a total ``{m}_{n}d`` and an average per day ``avg_{m}_{n}d``. An empty input gives no rows."""
    w = W.partitionBy("entity").orderBy("day_no")
    gaps = daily.withColumn("from_no", F.when(F.lag("day_no").over(w).isNull(), first_no).otherwise(F.col("day_no"))).withColumn(
        "to_no", F.coalesce(F.lead("day_no").over(w) - 1, last_no)
    )
    dense = gaps.select("entity", F.explode(F.sequence("from_no", "to_no")).alias("day"), "day_no", *measures).select(
        "entity", F.col("day").alias("day_no"), *(F.when(F.col("day") == F.col("day_no"), F.col(m)).otherwise(F.lit(0)).alias(m) for m in measures)
    )
    out = [F.col("entity"), F.date_add(F.lit("1970-01-01").cast("date"), F.col("day_no")).alias("day"), *(F.col(m) for m in measures)]
    for n in periods:
        frame = W.partitionBy("entity").orderBy("day_no").rangeBetween(-(n - 1), 0)
        for m in measures:
            total = F.sum(m).over(frame)
            out += [total.alias(f"{m}_{n}d"), F.round(total / F.lit(n), 6).alias(f"avg_{m}_{n}d")]
    return dense.select(*out)
