"""Bitemporal history of entity attributes: periods of validity, kept for every time of recording.

An *assertion* (key, valid_at, recorded_at, state) says that from ``valid_at`` on the entity has ``state``,
until the next assertion about the same key begins, and that this became known at ``recorded_at``.
The ledger holds one row per period and per belief: a late assertion splits the period that it falls into;
the row it supersedes keeps its content and only receives the end of its recorded period.

The sweep over each key's timeline is done in slices of valid time, so that no key has to fit into a task:
inside a slice a stack finds for every assertion the nearest earlier and later one that was already known when
it was recorded. What a slice leaves open is asked of the nearest slice that can answer (known by the slice's
earliest recording), and answered there by a running extreme over the rows in order of recording: one sort, no pairs.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tessella.lineage import durable

SLICE_SECONDS = 14 * 86_400


@dataclass(frozen=True)
class Assertions:
    """Names of the columns that hold an assertion; every other column of the input is ignored."""

    key: str = "entity_id"
    valid_at: str = "valid_at"
    recorded_at: str = "recorded_at"
    state: str = "state"


def _nearest_known(valid: np.ndarray, recorded: np.ndarray, order: range) -> np.ndarray:
    """Walking in ``order`` along the timeline: position of the last row passed that has another ``valid`` and was
    recorded no later than the row itself, or -1. Rows are sorted by (valid, recorded)."""
    found = np.full(len(valid), -1, np.int64)
    stack: list[int] = []  # recorded rises towards the top
    group: list[int] = []
    for i in [*order, None]:
        if group and (i is None or valid[i] != valid[group[0]]):
            rising = sorted(group, key=lambda j: recorded[j])
            for j in reversed(rising):
                while stack and recorded[stack[-1]] > recorded[j]:
                    stack.pop()
                found[j] = stack[-1] if stack else -1
            stack += rising
            group = []
        if i is not None:
            group.append(i)
    return found


def _linked(frame: pd.DataFrame) -> pd.DataFrame:
    """Rows of whole slices, sorted by (key, slice, v, r), each once and with the instants of their neighbours."""
    again = ~_new_slice(frame) & (frame["v"] == frame["v"].shift()).to_numpy() & (frame["r"] == frame["r"].shift()).to_numpy()
    frame = frame[~again] if again.any() else frame
    v, r = frame["v"].to_numpy(np.int64), frame["r"].to_numpy(np.int64)
    left, right = np.full(len(v), -1, np.int64), np.full(len(v), -1, np.int64)
    starts = [*np.flatnonzero(_new_slice(frame)).tolist(), len(v)]
    for a, b in zip(starts, starts[1:]):
        if b - a > 1:
            own = _nearest_known(v[a:b], r[a:b], range(b - a)), _nearest_known(v[a:b], r[a:b], range(b - a - 1, -1, -1))
            left[a:b], right[a:b] = (np.where(x >= 0, x + a, -1) for x in own)
    return frame[["key", "slice", "v", "r"]].assign(
        pred_v=pd.Series(v[left], index=frame.index).astype("Int64").mask(left < 0), succ_v=pd.Series(v[right], index=frame.index).astype("Int64").mask(right < 0)
    )


def _new_slice(frame: pd.DataFrame) -> np.ndarray:
    key, part = frame["key"], frame["slice"]
    return ((key != key.shift()) | (part != part.shift())).to_numpy()


def _sweep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Streams sorted rows; only the slice that is still open waits for the next batch."""
    rest: pd.DataFrame | None = None
    for frame in frames:
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        if not len(frame):
            continue
        last = int(np.flatnonzero(_new_slice(frame))[-1])
        done, rest = frame.iloc[:last], frame.iloc[last:]
        if len(done):
            yield _linked(done)
    if rest is not None and len(rest):
        yield _linked(rest)


def _neighbours(slices: DataFrame) -> DataFrame:
    """Per slice of a key what the slices beside it know: (key, slice, and for pred and succ: near slice, its least and
    greatest recording, its outermost valid time towards this slice, and the least recording of all slices on that side)."""
    out = slices.select("key", "slice", "min_r", "max_r", "min_v", "max_v")
    for side, order, edge in (("pred", F.col("slice"), "max_v"), ("succ", F.col("slice").desc(), "min_v")):
        w = W.partitionBy("key").orderBy(order)
        out = out.withColumns({
            f"{side}_slice": F.lag("slice").over(w), f"{side}_min": F.lag("min_r").over(w), f"{side}_max": F.lag("max_r").over(w), f"{side}_edge": F.lag(edge).over(w),
            f"{side}_best": F.min("min_r").over(w.rowsBetween(W.unboundedPreceding, -1)),
        })
    return out.drop("min_r", "max_r", "min_v", "max_v")


def _resolve_open(links: DataFrame) -> DataFrame:
    """Fill ``pred_v`` and ``succ_v`` that the own slice could not answer.

    A link recorded after all rows of the slice beside its own is answered by that slice's outermost row, and one recorded
    before all rows of that side has no neighbour there; one row per slice tells both. Only late links between the two
    look for their slice among those of their key, and for their row by a running extreme over that slice.
    """
    slices = links.groupBy("key", "slice").agg(F.min("r").alias("min_r"), F.max("r").alias("max_r"), F.min("v").alias("min_v"), F.max("v").alias("max_v"))
    rows = links.join(_neighbours(slices), ["key", "slice"], "left")
    late = None
    for side, pick in (("pred", F.max), ("succ", F.min)):
        unanswered = F.col(f"{side}_v").isNull() & (F.col(f"{side}_best") <= F.col("r"))
        asks = rows.where(unanswered & (F.col(f"{side}_max") > F.col("r"))).select("key", "slice", "v", "r", F.col(f"{side}_slice").alias("near"), F.col(f"{side}_min").alias("near_r"))
        quick = asks.where("near_r <= r").select("key", F.col("near").alias("slice"), "v", "r")
        edge = slices.select(F.col("key").alias("s_key"), F.col("slice").alias("s_slice"), "min_r")
        nearer = (F.col("s_slice") < F.col("slice")) if side == "pred" else (F.col("s_slice") > F.col("slice"))
        far = asks.where("near_r > r").join(edge, (F.col("key") == F.col("s_key")) & nearer & (F.col("min_r") <= F.col("r")))
        far = far.groupBy("key", "v", "r").agg(pick("s_slice").alias("slice")).select("key", "slice", "v", "r")
        one = quick.unionByName(far).withColumn("side", F.lit(side))
        late = one if late is None else late.unionByName(one)
        rows = rows.withColumn(f"{side}_v", F.when(unanswered & (F.col(f"{side}_max") <= F.col("r")), F.col(f"{side}_edge")).otherwise(F.col(f"{side}_v")))
    late = durable(late)  # few, and read twice
    rows = rows.select("key", "v", "r", "pred_v", "succ_v")
    if late.isEmpty():
        return rows
    told = links.join(late.select("key", "slice").distinct(), ["key", "slice"], "left_semi").select("key", "slice", "v", "r", F.lit(None).cast("string").alias("side"))
    known = W.partitionBy("key", "slice").orderBy("r", F.col("side").isNotNull()).rowsBetween(W.unboundedPreceding, 0)  # rows of the slice stand before questions of the same time
    own = F.when(F.col("side").isNull(), F.col("v"))
    answered = told.unionByName(late).withColumn("last_v", F.max(own).over(known)).withColumn("first_v", F.min(own).over(known)).where("side is not null")
    found = answered.groupBy("key", "v", "r").agg(F.max(F.when(F.col("side") == "pred", F.col("last_v"))).alias("far_pred"), F.min(F.when(F.col("side") == "succ", F.col("first_v"))).alias("far_succ"))
    return rows.join(found, ["key", "v", "r"], "left").select("key", "v", "r", F.coalesce("pred_v", "far_pred").alias("pred_v"), F.coalesce("succ_v", "far_succ").alias("succ_v"))


def ledger(assertions: DataFrame, names: Assertions = Assertions(), slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """The bitemporal ledger: (key, valid_from, valid_to, recorded_from, recorded_to, state, asserted).

    ``asserted`` tells the rows that an assertion opened from those that another one's arrival split off. Open ends are null. Assertions without key, valid or recorded time are left out. Exactly repeated assertions
    count once; of several with one key, valid and recorded time the one with the greatest state holds.
    An empty input gives an empty ledger.
    """
    base = (
        assertions.select(F.col(names.key).alias("key"), F.col(names.valid_at).alias("valid_at"), F.col(names.recorded_at).alias("recorded_at"), F.col(names.state).alias("state"))
        .where("key is not null and valid_at is not null and recorded_at is not null")
        .select("key", F.unix_micros(F.col("valid_at").cast("timestamp")).alias("v"), F.unix_micros(F.col("recorded_at").cast("timestamp")).alias("r"), "state")
    )
    sliced = base.select("key", "v", "r", F.floor(F.col("v") / F.lit(slice_seconds * 1_000_000)).alias("slice"))
    out = T.StructType([T.StructField("key", base.schema["key"].dataType), *(T.StructField(c, T.LongType()) for c in ("slice", "v", "r", "pred_v", "succ_v"))])
    links = _resolve_open(durable(sliced.repartition("key", "slice").sortWithinPartitions("key", "slice", "v", "r").mapInPandas(_sweep, out)))
    # each assertion opens a row, and closes the one of its predecessor with a shorter successor
    none = F.lit(None).cast(T.StructType([T.StructField("state", base.schema["state"].dataType)]))
    piece = lambda at, ends: F.struct(F.col(at).alias("at"), F.col(ends).alias("ends"))
    ends = links.select("key", F.col("r").alias("recorded"), F.explode(F.array_compact(F.array(piece("v", "succ_v"), F.when(F.col("pred_v").isNotNull(), piece("pred_v", "v"))))).alias("x"))
    ends = ends.select("key", "x.at", "recorded", "x.ends", none.alias("own"))
    told = base.select("key", F.col("v").alias("at"), F.col("r").alias("recorded"), F.lit(None).cast("bigint").alias("ends"), F.struct("state").alias("own"))
    rows = ends.unionByName(told).repartition("key", "at").groupBy("key", "at", "recorded").agg(F.min("ends").alias("ends"), F.max("own").alias("own"))
    w = W.partitionBy("key", "at").orderBy("recorded")
    held = rows.select(
        "key", "at", "recorded", "ends",
        F.last("own", ignorenulls=True).over(w).alias("held"), F.col("own").isNotNull().alias("asserted"),
        F.lead("recorded").over(w).alias("superseded"),
    )
    ts = lambda c: F.timestamp_micros(F.col(c))
    return held.where("held is not null").select(
        "key", ts("at").alias("valid_from"), ts("ends").alias("valid_to"), ts("recorded").alias("recorded_from"), ts("superseded").alias("recorded_to"), F.col("held.state").alias("state"), "asserted"
    )


def merge(book: DataFrame, late: DataFrame, names: Assertions = Assertions(), slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """A stored ledger with further assertions: the ledger of all of them, whatever the order or number of deliveries.

    Only keys that ``late`` tells about are swept again, from their own assertions in the book; all other rows are
    passed on as they are. Superseded rows keep their content; write the result beside the book, not over it.
    """
    told = late.select(F.col(names.key).alias("entity_id"), F.col(names.valid_at).alias("valid_at"), F.col(names.recorded_at).alias("recorded_at"), F.col(names.state).alias("state"))
    touched = told.where("entity_id is not null and valid_at is not null and recorded_at is not null").select(F.col("entity_id").alias("key")).distinct()
    before = book.where("asserted").join(touched, "key", "left_semi").select(F.col("key").alias("entity_id"), F.col("valid_from").alias("valid_at"), F.col("recorded_from").alias("recorded_at"), "state")
    return book.join(touched, "key", "left_anti").unionByName(ledger(before.unionByName(told), slice_seconds=slice_seconds))


def as_of(book: DataFrame, recorded_at: Column | None = None) -> DataFrame:
    """The history as it was known at ``recorded_at``, by default as it is known now."""
    if recorded_at is None:
        return book.where("recorded_to is null")
    return book.where((F.col("recorded_from") <= recorded_at) & (F.col("recorded_to").isNull() | (F.col("recorded_to") > recorded_at)))


def versions(history: DataFrame) -> DataFrame:
    """Merge neighbouring periods of equal state: (key, valid_from, state), one row per change, absent states included.

    ``history`` (``as_of`` of a ledger) has a period end where the next begins, so the end of one and the start of the next
    meet by equality of key and time: one shuffle, whatever the length of a key's history.
    """
    ends = F.array_compact(F.array(F.struct(F.col("valid_from").alias("at"), F.lit(True).alias("begins")), F.when(F.col("valid_to").isNotNull(), F.struct(F.col("valid_to").alias("at"), F.lit(False).alias("begins")))))
    edges = history.select("key", F.struct("state").alias("held"), F.explode(ends).alias("x")).select("key", "x.at", "x.begins", "held")
    met = edges.groupBy("key", "at").agg(F.max(F.when(F.col("begins"), F.col("held"))).alias("begins"), F.max(F.when(~F.col("begins"), F.col("held"))).alias("ended"))
    return met.where(F.col("begins").isNotNull() & (F.col("ended").isNull() | ~F.col("ended.state").eqNullSafe(F.col("begins.state")))).select("key", F.col("at").alias("valid_from"), F.col("begins.state").alias("state"))


def snapshot_assertions(snapshots: DataFrame, key: str, snapshot_at: str, exported_at: str, state: Column) -> DataFrame:
    """Assertions from full snapshots: a row asserts its state, an entity missing from the next snapshot has none.

    The absence counts as recorded at the snapshot itself, so that a row delivered late supersedes it.
    """
    rows = snapshots.select(F.col(key).alias("entity_id"), F.col(snapshot_at).alias("valid_at"), F.col(exported_at).alias("recorded_at"), F.struct(F.lit(True).alias("present"), state.alias("value")).alias("state")).where("valid_at is not null")
    value_type = rows.schema["state"].dataType["value"].dataType
    # the times of all snapshots in order, and of each entity: as many as there are snapshots
    calendar = rows.agg(F.sort_array(F.collect_set("valid_at")).alias("c")).scalar()
    own = rows.where("entity_id is not null").groupBy("entity_id").agg(F.collect_set("valid_at").alias("own")).withColumn("calendar", calendar)
    missed = F.filter(F.transform("own", lambda at: F.try_element_at("calendar", F.array_position("calendar", at).cast("int") + 1)), lambda at: at.isNotNull() & ~F.array_contains("own", at))
    gone = own.select("entity_id", F.explode(missed).alias("valid_at")).select(
        "entity_id", "valid_at", F.col("valid_at").alias("recorded_at"), F.struct(F.lit(False).alias("present"), F.lit(None).cast(value_type).alias("value")).alias("state")
    )
    return rows.unionByName(gone)
