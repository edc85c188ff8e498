"""Lines of diffs and the window-like operators over them.

A hunk is the unit of order: every window is partitioned by file and hunk and ordered by place, so all of them
share one exchange; a file's hunks may lie in different partitions.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.functions import paths

COMMENT = r"^\s*(//|#|/\*|\*)"


def diff_lines(files: DataFrame) -> DataFrame:
    """One row per line of every hunk: file_id, file, ext, status, is_binary, hunk_no, pos, type, content, old_num, new_num.

    Null hunks and lines give no rows; a null content stays null and matches nothing.
    """
    hunks = files.select("file_id", paths.unix(F.col("path")).alias("file"), "status", "is_binary", F.posexplode("hunks").alias("hunk_no", "h"))
    lines = hunks.select("file_id", "file", "status", "is_binary", "hunk_no", F.posexplode("h.lines").alias("pos", "l"))
    return lines.select("file_id", "file", paths.extension(F.col("file")).alias("ext"), "status", "is_binary", "hunk_no", "pos", "l.type", "l.content", "l.old_num", "l.new_num")


def analyzable(lines: DataFrame) -> DataFrame:
    """Lines of files that are neither deleted nor binary."""
    return lines.where((F.col("status") != "deleted") & ~F.coalesce("is_binary", F.lit(False)))


def added(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("type") == "added")


def is_comment(content: Column) -> Column:
    return F.coalesce(content.rlike(COMMENT), F.lit(False))


def in_hunk() -> W:
    return W.partitionBy("file_id", "hunk_no").orderBy("pos")


def near(hit: Column, first: int, last: int, order: W | None = None) -> Column:
    """Whether ``hit`` holds for a line between ``first`` and ``last`` places from this one (negative: before)."""
    return F.coalesce(F.max(hit).over((order or in_hunk()).rowsBetween(first, last)), F.lit(False))


def before_stop(hit: Column, stop: Column, last: int) -> Column:
    """Whether ``hit`` holds within the next ``last`` lines, no later than the first line where ``stop`` holds."""
    ahead = in_hunk().rowsBetween(1, last)
    first = lambda c: F.min(F.when(c, F.col("pos"))).over(ahead)
    return first(hit).isNotNull() & (first(stop).isNull() | (first(hit) <= first(stop)))


def islands(lines: DataFrame, member: Column) -> DataFrame:
    """Adds ``island``: equal for neighbouring lines of a hunk where ``member`` holds, null elsewhere."""
    flagged = lines.withColumn("__in", F.coalesce(member, F.lit(False)))
    rank = F.row_number().over(W.partitionBy("file_id", "hunk_no", "__in").orderBy("pos"))
    return flagged.withColumn("island", F.when(F.col("__in"), F.col("pos") - rank)).drop("__in")


def regions(lines: DataFrame, header: Column) -> DataFrame:
    """Adds ``region``: the place of the last header at or before a line of its hunk."""
    return lines.withColumn("region", F.last(F.when(header, F.col("pos")), ignorenulls=True).over(in_hunk().rowsBetween(W.unboundedPreceding, 0)))


def sticky(turns_on: Column, turns_off: Column, order: W | None = None) -> Column:
    """A flag that the last marker at or before a line has set; unset before the first marker."""
    mark = F.when(turns_on, F.lit(True)).when(turns_off, F.lit(False))
    return F.coalesce(F.last(mark, ignorenulls=True).over((order or in_hunk()).rowsBetween(W.unboundedPreceding, 0)), F.lit(False))


def brace_steps(content: Column) -> tuple[Column, Column]:
    """(net, lowest) of the walk over a line's braces, +1 for { and -1 for }; lowest is 0 at most."""
    marks = F.filter(F.split(F.regexp_replace(F.coalesce(content, F.lit("")), r"[^{}]", ""), ""), lambda c: c != "")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("low"))

    def step(acc: Column, mark: Column) -> Column:
        at = acc["at"] + F.when(mark == "{", 1).otherwise(-1)
        return F.struct(at.alias("at"), F.least(acc["low"], at).alias("low"))

    walk = F.aggregate(marks, start, step)
    return walk["at"], walk["low"]


def clamped_depth(lines: DataFrame) -> DataFrame:
    """Adds ``depth``: brace depth after each line, never below 0 inside a hunk.

    With S the plain running depth, the clamped one is S - min(0, lowest S so far), so no row-by-row loop is needed.
    """
    walked = lines.withColumn("__net", brace_steps(F.col("content"))[0]).withColumn("__low", brace_steps(F.col("content"))[1])
    upto = in_hunk().rowsBetween(W.unboundedPreceding, 0)
    summed = walked.withColumn("__s", F.sum("__net").over(upto))
    lowest = F.min(F.col("__s") - F.col("__net") + F.col("__low")).over(upto)
    return summed.withColumn("depth", (F.col("__s") - F.least(F.lit(0), lowest)).cast("int")).drop("__net", "__low", "__s")


def indent_depth(content: Column) -> Column:
    """Tabs, or else blanks over four, before the first other character."""
    lead = F.regexp_extract(content, r"^([ \t]*)", 1)
    tabs = F.length(lead) - F.length(F.replace(lead, F.lit("\t"), F.lit("")))
    return F.when(tabs > 0, tabs).otherwise(F.floor(F.length(lead) / 4)).cast("int")


def indent_level(content: Column) -> Column:
    """Characters of leading blanks and tabs."""
    return F.length(F.regexp_extract(content, r"^([ \t]*)", 1))
