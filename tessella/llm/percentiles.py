"""Percentiles per group of very large numeric columns, by distributed multi-select over mergeable summaries.

A summary holds, per group and metric, each value with its count. Summaries of partitions, days or runs of the
pipeline are combined by adding counts; nothing is lost, so the rank error is zero. With ``digits`` values are
kept to that many significant binary digits, which bounds a group's summary whatever its rows: the stated error
is then a relative 2**-digits of the value.

Selection: every batch of a partition proposes the weighted median of what it still holds of a range, the weighted
median of the proposals becomes the range's pivot, one pass counts the weight below, at and above the pivot, and the
side without a wanted rank is discarded. A range splits in two where both sides hold wanted ranks. Ranges that have
become small are finished by one sort. All percentiles of all groups advance in the same passes.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.lineage import durable

#: A range with at most this many distinct values left is finished by a sort; it bounds the passes, not what is found.
LEAF = 256
#: A range with more distinct values is spread over slots of about so many where it meets its pivot.
PER_SLOT = 500_000


def shorten(value: Column, digits: int | None) -> Column:
    """``value`` with ``digits`` significant binary digits (towards zero), or unchanged."""
    if digits is None:
        return value.cast("double")
    v = value.cast("double")
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(v))) - (digits - 1), F.lit(-1074)))
    return F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * F.floor(F.abs(v) / step) * step)


def summarise(facts: DataFrame, groups: dict[str, Column], metrics: dict[str, Column], digits: int | None = None) -> DataFrame:
    """(groups..., metric, value DOUBLE, n): the mergeable summary. Null and NaN values are left out, null groups are kept.

    The counts are formed before the shuffle, so a group with a large share of the rows moves only its distinct
    values of each partition.
    """
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), shorten(c, digits).alias("value")) for m, c in metrics.items()))).alias("m")
    rows = facts.select(*(c.alias(g) for g, c in groups.items()), each).select(*groups, "m.metric", "m.value")
    return rows.where("value is not null and not isnan(value)").groupBy(*groups, "metric", "value").agg(F.count("*").alias("n"))


def merge(*summaries: DataFrame) -> DataFrame:
    """One summary of several with the same columns."""
    both = summaries[0]
    for more in summaries[1:]:
        both = both.unionByName(more)
    keys = [c for c in both.columns if c != "n"]
    return both.groupBy(*keys).agg(F.sum("n").alias("n"))


def roll_up(summary: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The summary over fewer groups, e.g. without the day."""
    return summary.groupBy(*groups, "metric", "value").agg(F.sum("n").alias("n"))


def _weighted_medians(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The weighted median of each range over one batch (range_id, value, n); nothing is kept from batch to batch."""
    for frame in frames:
        if not len(frame):
            continue
        frame = frame.sort_values(["range_id", "value"], kind="stable")
        ids, n = frame["range_id"].to_numpy(), frame["n"].to_numpy(np.float64)
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        size = np.diff(np.r_[first, len(ids)])
        total = np.add.reduceat(n, first)
        running = np.cumsum(n) - np.repeat(np.cumsum(total) - total, size)
        reached = np.flatnonzero(running * 2 >= np.repeat(total, size) - 1e-9)
        at = reached[np.searchsorted(reached, first)]  # the first place of each range that reaches half its weight
        yield pd.DataFrame({"range_id": ids[first], "proposal": frame["value"].to_numpy()[at], "weight": total.astype(np.int64)})


def _slots(distinct: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(distinct / F.lit(PER_SLOT))).cast("int")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _finished(points: DataFrame, ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The wanted ranks of the small ranges of all passes, by one sort of their values."""
    own = points.join(ranges, ["turn", "range_id"])
    upto = own.withColumn("upto", F.sum("n").over(W.partitionBy("turn", "range_id").orderBy("value")))
    here = F.filter("wanted", lambda w: (w["need"] <= F.col("upto")) & (w["need"] > F.col("upto") - F.col("n")))
    return upto.select(*keys, F.explode(here).alias("w"), "value", "rows").select(*keys, F.col("w.rank").alias("rank"), "value", "rows")


def percentiles(summary: DataFrame, groups: Sequence[str], ranks: Sequence[float], leaf: int = LEAF) -> DataFrame:
    """(groups..., metric, rank, value, rows): for every rank q the least value with at least q of the group's rows at or below it.

    Values stay where the summary's own shuffle has put them, spread over all tasks whatever the size of their group;
    only pivots and counts travel, and the sizes of the groups once (a group with very many values is split by the
    engine's handling of skewed joins). A range holds the ranks that are wanted from it, as places among its own rows.
    An empty summary gives no rows.
    """
    keys = [*groups, "metric"]
    points = durable(summary.select(*keys, "value", "n"))
    sizes = points.groupBy(*keys).agg(F.sum("n").alias("rows"), F.count("*").alias("distinct"))
    wanted = F.array(*(F.struct(F.lit(float(q)).alias("rank"), F.greatest(F.ceil(F.lit(float(q)) * F.col("rows") - F.lit(1e-9)), F.lit(1)).cast("long").alias("need")) for q in ranks))
    ranges = durable(sizes.select(F.monotonically_increasing_id().alias("range_id"), *keys, "rows", "distinct", wanted.alias("wanted")))
    a = ranges.select("range_id", "distinct", *(F.col(k).alias(f"r_{k}") for k in keys))
    points = points.join(a, [points[k].eqNullSafe(a[f"r_{k}"]) for k in keys]).select("range_id", "value", "n", F.pmod(F.xxhash64("value"), _slots(F.col("distinct"))).cast("int").alias("slot"))
    large = F.col("distinct") > leaf
    tagged = lambda df, turn: df.select(F.lit(turn).alias("turn"), "range_id", "value", "n")
    small = lambda df, turn: df.where(~large).select(F.lit(turn).alias("turn"), "range_id", "wanted", *keys, "rows")
    turn, answers, held, ends = 0, [], [tagged(points, 0)], [small(ranges, 0)]
    ranges = ranges.where(large)
    points = durable(points.join(ranges.select("range_id"), "range_id", "left_semi")) if not ranges.isEmpty() else None
    while points is not None:
        proposals = points.select("range_id", "value", "n").mapInPandas(_weighted_medians, "range_id bigint, proposal double, weight bigint")
        proposals = proposals.groupBy("range_id", "proposal").agg(F.sum("weight").alias("weight"))
        of_range = W.partitionBy("range_id")
        pivots = (
            proposals.withColumn("upto", F.sum("weight").over(of_range.orderBy("proposal"))).withColumn("total", F.sum("weight").over(of_range))
            .where(F.col("upto") * 2 >= F.col("total")).groupBy("range_id").agg(F.min("proposal").alias("pivot"))
        )
        pivots = pivots.join(ranges.select("range_id", "distinct"), "range_id")
        spread = lambda df: df.withColumn("slot", F.explode(F.sequence(F.lit(0), _slots(F.col("distinct")) - 1)))
        value, pivot, zero = F.col("value"), F.col("pivot"), F.lit(0).cast("long")
        counted = points.join(spread(pivots).drop("distinct"), ["range_id", "slot"]).groupBy("range_id").agg(
            F.sum(F.when(value < pivot, F.col("n")).otherwise(zero)).alias("less"), F.sum(F.when(value == pivot, F.col("n")).otherwise(zero)).alias("equal"),
            F.count_if(value < pivot).alias("lesser"), F.count_if(value > pivot).alias("greater"), F.first("pivot").alias("pivot"),
        )
        less, upto = F.col("less"), F.col("less") + F.col("equal")
        split = durable(
            ranges.join(counted, "range_id").select(
                "*", F.monotonically_increasing_id().alias("fresh"),
                F.filter("wanted", lambda w: w["need"] <= less).alias("low"),
                F.filter("wanted", lambda w: (w["need"] > less) & (w["need"] <= upto)).alias("hit"),
                F.transform(F.filter("wanted", lambda w: w["need"] > upto), lambda w: F.struct(w["rank"].alias("rank"), (w["need"] - upto).alias("need"))).alias("high"),
            )
        )
        answers.append(split.select(*keys, F.explode("hit").alias("w"), F.col("pivot").alias("value"), "rows").select(*keys, F.col("w.rank").alias("rank"), "value", "rows"))
        side = lambda name, count, k: F.struct((F.col("fresh") * 2 + k).alias("range_id"), F.col(count).alias("distinct"), F.col(name).alias("wanted"))
        both = split.select(*keys, "rows", F.explode(F.array(side("low", "lesser", 0), side("high", "greater", 1))).alias("s")).select(*keys, "rows", "s.*")
        kept = both.where(F.size("wanted") > 0)
        sides = split.select("range_id", "distinct", "pivot", (F.col("fresh") * 2).alias("left_id"), (F.size("low") > 0).alias("left"), (F.size("high") > 0).alias("right"), "lesser", "greater")
        moved = points.join(spread(sides).drop("distinct"), ["range_id", "slot"]).where(((value < pivot) & F.col("left")) | ((value > pivot) & F.col("right")))
        moved = moved.select(
            F.when(value < pivot, F.col("left_id")).otherwise(F.col("left_id") + 1).alias("range_id"), "value", "n",
            F.pmod(F.xxhash64("value"), _slots(F.when(value < pivot, F.col("lesser")).otherwise(F.col("greater")))).cast("int").alias("slot"),
        )
        points, turn = durable(moved), turn + 1
        held.append(tagged(points, turn))
        ends.append(small(kept, turn))
        ranges = kept.where(large)
        if ranges.isEmpty():
            break
        # the points of finished ranges meet no pivot any more and fall away with the next pass
    return _all([_finished(_all(held), _all(ends), keys), *answers])
