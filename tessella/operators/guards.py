"""Rules about what must stand near a line: something is opened, started or caught, and its counterpart is missing.

A rule fires on an added line where ``when`` matches and neither ``unless`` (same line) nor its guard does. The
guard is sought in the lines from ``before`` places ahead of it to ``after`` behind, or anywhere in the hunk; with
``requires`` the hunk must also hold that pattern. All rules share one partitioning and sort of the lines.
"""
from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.operators import lines as L
from tessella.operators.rules import quoted


@dataclass(frozen=True)
class Guarded:
    id: str
    extensions: tuple[str, ...]
    when: str
    message: str
    guard: str = ""
    before: int = 0
    after: int = 0
    hunk: bool = False
    unless: str = ""
    requires: str = ""
    #: removed and comment lines keep their place in the distance but don't count as guards
    live: bool = False
    severity: str = "warning"
    category: str = ""
    fix_id: str = ""
    #: what a comment begins with, where it isn't one of the usual marks
    marks: str = ""
    #: the message ends with the line's text
    quotes: bool = False
    #: (on, off): the line must lie behind an added one that switches on and before one that switches off
    scope: tuple[str, str] | tuple = ()
    #: (pattern, first, last, added only): all must match some line from ``first`` to ``last`` places away
    needs: tuple[tuple[str, int, int, bool], ...] = ()
    #: (pattern, stop, n): the guard may stand within the next n lines, no later than the first that ``stop`` matches
    chain: tuple[str, str, int] | tuple = ()


def _told(rule: Guarded) -> str:
    return rule.marks or L.COMMENT


def _hit(pattern: str, live: bool) -> Column:
    c = F.col("content")
    found = F.coalesce(c.rlike(pattern), F.lit(False))
    return found & (F.col("type") != "removed") & ~L.is_comment(c) if live else found


def guarded_issues(lines: DataFrame, rules: Iterable[Guarded]) -> DataFrame:
    """file_id, hunk_no, pos, file, line, id, severity, category, message of every rule that fires; a line may fire several."""
    rules = tuple(rules)
    exts = sorted({e for r in rules for e in r.extensions})
    rows = L.analyzable(lines).where(F.col("ext").isin(exts))
    part = W.partitionBy("file_id", "hunk_no")
    flags: dict[tuple, str] = {}
    for r in rules:
        for key in ((r.guard, r.live, "hunk") if r.hunk else (r.guard, r.live, r.before, r.after)) if r.guard else None, (r.requires, False, "hunk") if r.requires else None:
            if key and key not in flags:
                flags[key] = f"__f{len(flags)}"
    for key, name in flags.items():
        hit = _hit(key[0], key[1])
        rows = rows.withColumn(name, F.coalesce(F.max(hit).over(part), F.lit(False)) if key[2] == "hunk" else L.near(hit, key[2], key[3]))
    c, found, texts = F.col("content"), [], []
    match = lambda p: F.coalesce(c.rlike(p), F.lit(False))
    is_added = F.col("type") == "added"
    extra: dict[tuple, str] = {}
    for r in rules:
        for key in (*(("scope", *r.scope),) * bool(r.scope), *(("needs", *n) for n in r.needs), *(("chain", *r.chain),) * bool(r.chain)):
            if key in extra:
                continue
            extra[key] = f"__x{len(extra)}"
            if key[0] == "scope":
                flag = L.sticky(is_added & match(key[1]), is_added & match(key[2]))
            elif key[0] == "needs":
                flag = L.near(match(key[1]) & is_added if key[4] else match(key[1]), key[2], key[3])
            else:
                flag = L.before_stop(match(key[1]), match(key[2]), key[3])
            rows = rows.withColumn(extra[key], flag)
    for k, r in enumerate(rules):
        fires = F.col("ext").isin(*r.extensions) & c.rlike(r.when) & ~c.rlike(_told(r))
        if r.unless:
            fires = fires & ~c.rlike(r.unless)
        if r.guard:
            fires = fires & ~F.col(flags[(r.guard, r.live, "hunk") if r.hunk else (r.guard, r.live, r.before, r.after)])
        if r.requires:
            fires = fires & F.col(flags[(r.requires, False, "hunk")])
        for n in r.needs:
            fires = fires & F.col(extra[("needs", *n)])
        if r.scope:
            fires = fires & F.col(extra[("scope", *r.scope)])
        if r.chain:
            fires = fires & ~F.col(extra[("chain", *r.chain)])
        texts.append(F.struct(F.lit(r.id).alias("id"), F.lit(r.severity).alias("severity"), F.lit(r.category or r.id.split("/")[0]).alias("category"), (F.concat(F.lit(r.message), F.trim(c)) if r.quotes else F.lit(r.message)).alias("message")))
        found.append(F.when(fires, F.lit(k + 1)))
    live = L.added(rows).where(c.isNotNull())
    return live.select("file_id", "hunk_no", "pos", "file", F.col("new_num").alias("line"), F.explode(F.array_compact(F.array(*found))).alias("k")).select(
        "file_id", "hunk_no", "pos", "file", "line", F.element_at(F.array(*texts), F.col("k")).alias("i")
    ).select("file_id", "hunk_no", "pos", "file", "line", "i.*")


def guarded_sql(rules: Iterable[Guarded]) -> str:
    """SELECT of the same issues over the CTE every_line."""
    comment = f"coalesce(regexp_matches(content, {quoted(L.COMMENT)}), false)"

    def hit(pattern: str, live: bool) -> str:
        found = f"coalesce(regexp_matches(content, {quoted(pattern)}), false)"
        return f"({found} AND type <> 'removed' AND NOT {comment})" if live else found

    def flag(pattern: str, live: bool, frame: str) -> str:
        return f"coalesce(max(CAST({hit(pattern, live)} AS INT)) OVER (PARTITION BY file_id, hunk_no {frame}), 0)"

    out = []
    for r in rules:
        cols, conds = [], ["type = 'added'", "content IS NOT NULL", f"NOT regexp_matches(content, {quoted(_told(r))})", f"regexp_matches(content, {quoted(r.when)})"]
        if r.unless:
            conds.append(f"NOT regexp_matches(content, {quoted(r.unless)})")
        if r.guard:
            at = lambda n: "CURRENT ROW" if n == 0 else f"{abs(n)} {'PRECEDING' if n < 0 else 'FOLLOWING'}"
            frame = "" if r.hunk else f"ORDER BY pos ROWS BETWEEN {at(r.before)} AND {at(r.after)}"
            cols.append(flag(r.guard, r.live, frame) + " AS g")
            conds.append("g = 0")
        if r.requires:
            cols.append(flag(r.requires, False, "") + " AS q")
            conds.append("q = 1")
        match = lambda p: f"coalesce(regexp_matches(content, {quoted(p)}), false)"
        place = lambda n: "CURRENT ROW" if n == 0 else f"{abs(n)} {'PRECEDING' if n < 0 else 'FOLLOWING'}"
        hunk = "PARTITION BY file_id, hunk_no ORDER BY pos"
        for k, n in enumerate(r.needs):
            seen = match(n[0]) + (" AND type = 'added'" if n[3] else "")
            cols.append(f"coalesce(max(CAST(({seen}) AS INT)) OVER ({hunk} ROWS BETWEEN {place(n[1])} AND {place(n[2])}), 0) AS n{k}")
            conds.append(f"n{k} = 1")
        if r.scope:
            cols.append(f"coalesce(last_value(CASE WHEN type = 'added' AND {match(r.scope[0])} THEN 1 WHEN type = 'added' AND {match(r.scope[1])} THEN 0 END IGNORE NULLS) OVER ({hunk} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS sc")
            conds.append("sc = 1")
        if r.chain:
            ahead = f"OVER ({hunk} ROWS BETWEEN 1 FOLLOWING AND {r.chain[2]} FOLLOWING)"
            cols += [f"min(CASE WHEN {match(r.chain[0])} THEN pos END) {ahead} AS c_hit", f"min(CASE WHEN {match(r.chain[1])} THEN pos END) {ahead} AS c_stop"]
            conds.append("NOT (c_hit IS NOT NULL AND (c_stop IS NULL OR c_hit <= c_stop))")
        exts = ", ".join(map(quoted, r.extensions))
        inner = f"SELECT *{''.join(', ' + x for x in cols)} FROM every_line WHERE status <> 'deleted' AND NOT coalesce(is_binary, false) AND ext IN ({exts})"
        out.append(f"SELECT file_id, hunk_no, pos, {quoted(r.id)} AS id, {quoted(r.severity)} AS severity FROM ({inner}) WHERE " + " AND ".join(conds))
    return "\nUNION ALL\n".join(out)
