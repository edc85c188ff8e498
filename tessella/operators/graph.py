"""Cycles of import graphs, each once and in a canonical rotation."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.lineage import durable


def canonical(nodes: Column) -> Column:
    """The rotation of a cycle's nodes that starts with the least."""
    at = F.array_position(nodes, F.array_min(nodes)).cast("int")
    return F.concat(F.slice(nodes, at, F.size(nodes)), F.slice(nodes, F.lit(1), at - 1))


def core(edges: DataFrame) -> DataFrame:
    """``edges`` (src, dst) without those that lie on no path between cycles: sources and sinks are dropped until none is left."""
    e = durable(edges.where("src is not null and dst is not null").select("src", "dst").distinct())
    n = e.count()
    while n:
        e = durable(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        n, before = e.count(), n
        if n == before:
            break
    return e


#: Cycles that are listed per start, the least node of each.
PER_START = 5


def cycles(edges: DataFrame, per_start: int = PER_START) -> DataFrame:
    """(cycle ARRAY, key STRING) of simple cycles of any length in ``edges`` (src, dst), ``per_start`` for each least node; self loops included.

    Paths start at the least node of their cycle, never pass a smaller one and grow breadth first, so every cycle is found
    once and short ones first. A start that has its cycles grows no further, and of the paths from one start to one node
    the least ``per_start`` go on: that many ways are enough to list as many cycles, and no more are ever held. Null ends
    are no edges; repeated edges are one.
    """
    e = core(edges)
    step = e.select(F.col("src").alias("last"), F.col("dst").alias("next"))
    paths = durable(e.where("dst >= src").select(F.array("src").alias("path"), F.col("src").alias("first"), F.col("dst").alias("head")))
    found: DataFrame | None = None
    while not paths.isEmpty():
        closed = paths.where("head = first").select("first", F.col("path").alias("cycle"))
        every = closed if found is None else found.unionByName(closed)
        order = W.partitionBy("first").orderBy(F.size("cycle"), "cycle")
        found = durable(every.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_start).drop("k"))
        full = found.groupBy("first").count().where(F.col("count") >= per_start).select("first")
        grown = paths.where("head > first").join(full, "first", "left_anti").withColumn("path", F.concat("path", F.array("head")))
        ahead = grown.join(step, grown["head"] == step["last"]).where("next >= first and (next = first or not array_contains(path, next))").select("path", "first", F.col("next").alias("head"))
        ways = W.partitionBy("first", "head").orderBy("path")
        paths = durable(ahead.withColumn("k", F.row_number().over(ways)).where(F.col("k") <= per_start).drop("k"))
    if found is None:
        found = paths.select("first", F.col("path").alias("cycle"))
    return found.select("cycle", F.array_join("cycle", "->").alias("key"))


def circles(edges: DataFrame, per_start: int = PER_START) -> DataFrame:
    """(cycle, key): the cycles that ``cycles`` lists, and for each other node that lies on a cycle a shortest one through
    it, so that no node of a cycle is missed.

    Walks start at every node of the core that no listed cycle covers and go on breadth first; a node is entered once per
    start, by the least path, until a walk is back or has nowhere to go.
    """
    e = core(edges)
    short = durable(cycles(e, per_start))
    covered = short.select(F.explode("cycle").alias("start")).distinct()
    walks = e.select(F.col("src").alias("start")).distinct().join(covered, "start", "left_anti").withColumn("head", F.col("start")).withColumn("path", F.array("start"))
    walks, seen, closed = durable(walks), None, []
    while not walks.isEmpty():
        grown = walks.join(e, walks["head"] == e["src"]).select("start", F.col("dst").alias("head"), "path")
        back = durable(grown.where("head = start").groupBy("start").agg(F.min("path").alias("cycle")))
        closed.append(back)
        ahead = grown.groupBy("start", "head").agg(F.min("path").alias("path")).join(back, "start", "left_anti")
        if seen is not None:
            ahead = ahead.join(seen, ["start", "head"], "left_anti")
        walks = durable(ahead.select("start", "head", F.concat("path", F.array("head")).alias("path")))
        now = walks.select("start", "head")
        seen = now if seen is None else durable(seen.unionByName(now))
    long = [c.select(canonical(F.col("cycle")).alias("cycle")) for c in closed]
    found = short.select("cycle")
    for c in long:
        found = found.unionByName(c)
    return found.distinct().select("cycle", F.array_join("cycle", "->").alias("key"))
