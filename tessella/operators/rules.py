"""Rule packs: regular expressions with exclusions, compiled to built-in column expressions.

In a group the first rule that fires on a line wins; a rule whose exclusion matches lets the next one try. Groups
marked ``every`` emit all rules that fire. Rules are literals of the plan, so a line is read once for all groups.
"""
from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import paths
from tessella.functions.patterns import literals
from tessella.operators import lines as L


@dataclass(frozen=True)
class Rule:
    pattern: str
    message: str
    id: str = ""
    severity: str = "error"
    fix_id: str = ""
    suggestion: str = ""
    unless: tuple[str, ...] = ()


@dataclass(frozen=True)
class Group:
    name: str
    category: str
    rules: tuple[Rule, ...]
    id: str = ""
    extensions: tuple[str, ...] = ()
    unless: tuple[str, ...] = ()
    comments: bool = False
    every: bool = False
    #: the message ends with the line's text
    quotes: bool = False
    #: paths that the group leaves alone, and those that it is for (empty: all)
    skip: str = ""
    only: str = ""
    #: what a comment begins with, where it isn't one of the usual marks
    marks: str = ""
    #: an issue's id goes on with its file and line
    located: bool = False


@dataclass(frozen=True)
class CustomRule:
    """A user's rule: pattern, glob of files ('' for all), severity and message."""

    id: str
    pattern: str
    files: str = ""
    severity: str = "warning"
    message: str = ""


def text(value: str) -> str:
    """A literal of Spark's SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(pattern: str) -> str:
    """A line matches ``pattern``; one without the pattern's literals isn't tried."""
    held = " OR ".join(f"contains(__lower, {text(x)})" for x in literals(pattern))
    tried = f"content RLIKE {text(pattern)}"
    return f"(({held}) AND {tried})" if held else f"({tried})"


def _fires(rule: Rule, group: Group) -> str:
    return " AND ".join([_matches(rule.pattern), *(f"NOT {_matches(x)}" for x in (*rule.unless, *group.unless))])


def _applies(g: Group) -> str:
    parts = [f"ext IN ({', '.join(map(text, g.extensions))})"] if g.extensions else []
    if not g.comments:
        parts.append(f"NOT content RLIKE {text(g.marks)}" if g.marks else "NOT __comment")
    if g.skip:
        parts.append(f"NOT file RLIKE {text(g.skip)}")
    if g.only:
        parts.append(f"file RLIKE {text(g.only)}")
    return " AND ".join(parts) or "true"


def _told(rule: Rule, group: Group) -> str:
    fields = {"grp": group.name, "id": rule.id or group.id, "fix_id": rule.fix_id, "severity": rule.severity, "category": group.category, "message": rule.message, "suggestion": rule.suggestion}
    return "named_struct(" + ", ".join(f"'{k}', {text(v)}" for k, v in fields.items()) + f", 'quotes', {str(group.quotes).lower()}, 'located', {str(group.located).lower()})"


def scan(lines: DataFrame, groups: Iterable[Group]) -> DataFrame:
    """Issues of all groups over the added lines of ``lines`` (diff_lines): file_id, hunk_no, pos, file, line, grp, id, ...

    Rules become one SQL expression per group. A group's extensions are asked first, then whether the line holds a
    literal that the pattern needs; only then is the pattern tried. Lines carry a rule's number, and its texts are looked
    up for those that fire.
    """
    hits, texts = [], []
    for g in groups:
        cases = []
        for r in g.rules:
            texts.append(_told(r, g))
            cases.append(f"WHEN {_fires(r, g)} THEN {len(texts)}")
        hits += [f"CASE WHEN {_applies(g)} THEN (CASE {c} END) END" for c in (cases if g.every else [" ".join(cases)])]
    rows = L.added(L.analyzable(lines)).where("content is not null").withColumn("__comment", L.is_comment(F.col("content"))).withColumn("__lower", F.lower("content"))
    each = rows.select("file_id", "hunk_no", "pos", "file", F.col("new_num").alias("line"), "content", F.explode(F.expr(f"array_compact(array({', '.join(hits)}))")).alias("k"))
    told = each.select("file_id", "hunk_no", "pos", "file", "line", "content", F.expr(f"element_at(array({', '.join(texts)}), k)").alias("hit"))
    message = F.concat("hit.message", F.when(F.col("hit.quotes"), F.trim("content")).otherwise(F.lit("")))
    ident = F.when(F.col("hit.located"), F.concat_ws("-", "hit.id", "file", "line")).otherwise(F.col("hit.id"))
    return told.select("file_id", "hunk_no", "pos", "file", "line", "hit.grp", ident.alias("id"), "hit.fix_id", "hit.severity", "hit.category", message.alias("message"), "hit.suggestion")


def scan_custom(lines: DataFrame, rules: Iterable[CustomRule]) -> DataFrame:
    """Issues of user rules: every rule that matches a line of a file its glob (on the name or the whole path) admits.

    A pattern that Spark can't compile is left out; an unknown severity becomes warning.
    """
    spark, kept = lines.sparkSession, []
    for r in rules:
        try:
            spark.sparkContext._jvm.java.util.regex.Pattern.compile(r.pattern)
        except Exception:
            continue
        where = F.lit(True)
        if r.files:
            glob = paths.glob_regex(r.files)
            where = F.col("file").rlike(glob) | paths.basename(F.col("file")).rlike(glob)
        severity = r.severity if r.severity in ("error", "warning", "info") else "warning"
        issue = F.struct(F.lit(r.id).alias("id"), F.lit(severity).alias("severity"), F.lit(r.message).alias("message"))
        kept.append(F.when(where & F.col("content").rlike(r.pattern), issue))
    rows = L.added(L.analyzable(lines)).where("content is not null")
    hits = F.array_compact(F.array(*kept)) if kept else F.array().cast("array<struct<id:string,severity:string,message:string>>")
    return rows.select("file_id", "hunk_no", "pos", "file", F.col("new_num").alias("line"), F.explode(hits).alias("i")).select("file_id", "hunk_no", "pos", "file", "line", F.lit("custom").alias("category"), "i.*")


# SQL of the same packs, for the oracle

def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def fires_sql(rule: Rule, group: Group) -> str:
    parts = [f"regexp_matches(content, {quoted(rule.pattern)})", *(f"NOT regexp_matches(content, {quoted(x)})" for x in (*rule.unless, *group.unless))]
    if not group.comments:
        parts.append(f"NOT regexp_matches(content, {quoted(group.marks or L.COMMENT)})")
    if group.skip:
        parts.append(f"NOT regexp_matches(file, {quoted(group.skip)})")
    if group.only:
        parts.append(f"regexp_matches(file, {quoted(group.only)})")
    if group.extensions:
        parts.append("ext IN (" + ", ".join(map(quoted, group.extensions)) + ")")
    return "(" + " AND ".join(parts) + ")"


def group_sql(group: Group, source: str = "lines") -> str:
    """SELECT of a group's issues over the CTE ``source`` of analyzable added lines."""
    head = "SELECT file_id, hunk_no, pos, file, new_num AS line, {g} AS grp, {id} AS id, {severity} AS severity, {category} AS category, {message} AS message FROM " + source
    place = " || '-' || file || '-' || new_num" if group.located else ""
    if group.every:
        return "\nUNION ALL\n".join(
            head.format(g=quoted(group.name), id=quoted(r.id or group.id) + place, severity=quoted(r.severity), category=quoted(group.category), message=quoted(r.message) + (" || trim(content)" if group.quotes else "")) + " WHERE " + fires_sql(r, group) for r in group.rules
        )
    case = lambda value: "CASE " + " ".join(f"WHEN {fires_sql(r, group)} THEN {quoted(value(r))}" for r in group.rules) + " END"
    any_of = " OR ".join(fires_sql(r, group) for r in group.rules)
    return head.format(g=quoted(group.name), id=case(lambda r: r.id or group.id) + place, severity=case(lambda r: r.severity), category=quoted(group.category), message=case(lambda r: r.message) + (" || trim(content)" if group.quotes else "")) + f" WHERE {any_of}"
