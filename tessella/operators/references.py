"""References to records that do not exist.

Keys become two 64-bit hashes; the first lays them out in ranges, and the pair of both stands for the key, so two
keys are taken for one with a chance of 2^-128. A task receives the parents of a range, holds them as sorted arrays of
integers, and probes the batches of references that follow by binary search. How many references lie in each range
is counted first: a range with more than its share is split by record into parts, each with the range's parents, so
neither a hot key nor a hot range makes a long task.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

RANGES = 4096
#: A range is split where it holds more references than this, or than twice the mean of all ranges.
MOST_PER_PART = 20_000

PARENT_COLUMNS = "kind, key, created_at, deleted_at"
REFERENCE_COLUMNS = "table_name, record_id, ref_field, kind, key, at"
_OUT = "table_name string, record_id string, ref_field string, at timestamp, reason string"


class _Parents:
    """Sorted arrays of one range of parents (h, g, created_at, deleted_at), probed by binary search."""

    def __init__(self, frames: list[pd.DataFrame]):
        take = lambda c, t: np.concatenate([f[c].to_numpy(t) for f in frames]) if frames else np.zeros(0, t)
        h, g = take("h", np.int64), take("g", np.int64)
        order = np.lexsort((g, h))
        self.h, self.g = h[order], g[order]
        self.created, self.deleted = take("created_at", "datetime64[us]")[order], take("deleted_at", "datetime64[us]")[order]

    def reasons(self, h: np.ndarray, g: np.ndarray, at: np.ndarray) -> np.ndarray:
        """'missing', 'deleted', 'not yet there' or None for each probe."""
        out = np.full(len(h), None, object)
        if not len(self.h):
            out[:] = "missing"
            return out
        place = np.searchsorted(self.h, h)
        while True:  # keys with the same first hash stand side by side, in the order of the second
            other = (place < len(self.h)) & (self.h[np.minimum(place, len(self.h) - 1)] == h) & (self.g[np.minimum(place, len(self.h) - 1)] < g)
            if not other.any():
                break
            place = place + other
        place = np.minimum(place, len(self.h) - 1)
        known = (self.h[place] == h) & (self.g[place] == g)
        out[self.created[place] > at] = "not yet there"
        out[self.deleted[place] <= at] = "deleted"
        out[~known] = "missing"
        return out


def _hashes(kind: Column, key: Column) -> tuple[Column, Column]:
    return F.xxhash64(kind, key), F.xxhash64(key, F.lit(17), kind)


def _range_of(h: Column, ranges: int) -> Column:
    return F.floor((h.cast("double") + F.lit(2.0**63)) / F.lit(2.0**64) * ranges).cast("int")


def _probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (part of a range, parents first): the arrays of the part that is open are all that is held."""
    held: list[pd.DataFrame] = []
    current: tuple | None = None
    index: _Parents | None = None
    for frame in frames:
        for span, part in frame.groupby(["range", "part"], sort=False):
            if span != current:
                current, held, index = span, [], None
            parents = part["role"].to_numpy() == 0
            if parents.any():
                held.append(part.loc[parents, ["h", "g", "created_at", "deleted_at"]])
                index = None
            asked = part.loc[~parents]
            if len(asked):
                index = index or _Parents(held)
                reason = index.reasons(asked["h"].to_numpy(np.int64), asked["g"].to_numpy(np.int64), asked["created_at"].to_numpy("datetime64[us]"))
                bad = np.flatnonzero(reason != None)  # noqa: E711
                if len(bad):
                    yield asked.iloc[bad][["table_name", "record_id", "ref_field", "created_at"]].rename(columns={"created_at": "at"}).assign(reason=reason[bad])


def orphans(references: DataFrame, parents: DataFrame, ranges: int = RANGES, most: int = MOST_PER_PART) -> DataFrame:
    """(table_name, record_id, ref_field, at, reason) of references that do not hold at their time ``at``.

    references: table_name, record_id, ref_field, kind (which parent table), key, at; null keys are no references.
    parents: kind, key, created_at, deleted_at; of repeated keys any one is used, so they should agree.
    A reference fails if the key is missing, was deleted at or before ``at`` or created after it; a null time on
    either side proves nothing. Repeated failing references are given once. Without parents all are missing.
    """
    h, g = _hashes(F.col("kind"), F.col("key"))
    refs = references.selectExpr(*REFERENCE_COLUMNS.split(", ")).where("key is not null and record_id is not null")
    refs = refs.select(
        h.alias("h"), g.alias("g"), F.lit(1).alias("role"), F.col("at").cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("deleted_at"),
        F.col("table_name").cast("string").alias("table_name"), F.col("record_id").cast("string").alias("record_id"), F.col("ref_field").cast("string").alias("ref_field"),
    ).withColumn("range", _range_of(F.col("h"), ranges))
    kept = (
        parents.selectExpr(*PARENT_COLUMNS.split(", ")).where("key is not null").groupBy(h.alias("h"), g.alias("g")).agg(F.max(F.struct("created_at", "deleted_at")).alias("p"))
        .select("h", "g", F.lit(0).alias("role"), F.col("p.created_at").cast("timestamp").alias("created_at"), F.col("p.deleted_at").cast("timestamp").alias("deleted_at"))
        .withColumn("range", _range_of(F.col("h"), ranges))
    )
    loads = refs.groupBy("range").count().withColumn("mean", F.avg("count").over(W.partitionBy()))  # one row per range, at most ``ranges``
    parts = loads.select("range", F.ceil(F.col("count") / F.greatest(F.lit(most), 2 * F.col("mean"))).cast("int").alias("parts")).where("parts > 1")
    parts = F.broadcast(parts)  # at most one row of two integers per range
    one = F.coalesce("parts", F.lit(1))
    asked = refs.join(parts, "range", "left").withColumn("part", F.pmod(F.xxhash64("record_id"), one).cast("int")).drop("parts")
    held = kept.join(parts, "range", "left").withColumn("part", F.explode(F.sequence(F.lit(0), one - 1))).drop("parts")
    both = held.unionByName(asked, allowMissingColumns=True).repartition("range", "part").sortWithinPartitions("range", "part", "role")
    found = both.mapInPandas(_probe, _OUT)
    return found.groupBy("table_name", "record_id", "ref_field").agg(F.min("at").alias("at"), F.min("reason").alias("reason"))


def per_period(found: DataFrame, period: str = "month") -> DataFrame:
    """Failing references per table, field, reason and period (null times form a period of their own)."""
    return found.groupBy("table_name", "ref_field", "reason", F.date_format(F.date_trunc(period, "at"), "yyyy-MM-dd").alias("period")).agg(F.count("*").alias("orphans"))


__all__ = ["orphans", "per_period"]
