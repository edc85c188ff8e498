"""Checks of whole hunks and files: stubs, commented and unreachable code, and what a file as a whole lacks.

All take the lines of a diff (diff_lines) and give (file_id, file, line, id, severity, category, message). Patterns, ids
and messages are fixed values: results are compared by them.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators import lines as L
from tessella.plans import packs, pattern_packs

# fixed values: headers of functions by extension, tried on the trimmed line
HEADERS = {
    ".go": r"^func\s+",
    **dict.fromkeys((".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"), r"^(export\s+)?(async\s+)?function\s+\w+|^(export\s+)?(const|let|var)\s+\w+\s*=\s*(async\s+)?\(|^(export\s+)?(const|let|var)\s+\w+\s*=\s*(async\s+)?\w+\s*=>"),
    ".py": r"^def\s+\w+\(",
    ".java": r"^\s*(?:public|protected|private)?\s*(?:static\s+)?(?:final\s+)?(?:\w[\w<>\[\],\s?]*?\s+)(\w+)\s*\(",
    ".rs": r"^(?:pub(?:\((?:crate|super)\))?\s+)?(?:async\s+)?fn\s+\w+",
    **dict.fromkeys((".kt", ".kts"), r"^\s*(?:(?:public|protected|private|internal)\s+)?(?:override\s+)?(?:suspend\s+)?(?:inline\s+)?fun\s+"),
    ".cs": r"^\s*(?:public|protected|private|internal)?\s*(?:static\s+)?(?:async\s+)?(?:virtual\s+)?(?:override\s+)?(?:\w[\w<>\[\],\s?]*?\s+)(\w+)\s*\(",
    ".php": r"^\s*(?:public|protected|private)?\s*(?:static\s+)?function\s+\w+",
    ".swift": r"^(?:open|public|internal|fileprivate|private)?\s*(?:static\s+|class\s+)?(?:override\s+)?func\s+\w+",
    **dict.fromkeys((".c", ".h", ".cpp", ".cc", ".cxx", ".hpp", ".hxx"), r"^(?:static\s+)?(?:inline\s+)?(?:extern\s+)?(?:const\s+)?(?:\w[\w*\s]*?\s+\*?)(\w+)\s*\("),
    **dict.fromkeys((".m", ".mm"), r"^[-+]\s*\("),
    ".dart": r"^\s*(?:static\s+)?(?:Future\s*<[^>]*>\s+|void\s+|int\s+|double\s+|String\s+|bool\s+|List\s*<[^>]*>\s+|Map\s*<[^>]*>\s+|\w+\s+)(\w+)\s*\(",
    **dict.fromkeys((".scala", ".sc"), r"^\s*(?:(?:private|protected|override)\s+)*def\s+\w+"),
    ".r": r"^\s*\w+\s*<-\s*function\s*\(",
    **dict.fromkeys((".ex", ".exs"), r"^\s*(?:def|defp)\s+\w+"),
    ".lua": r"^(?:local\s+)?function\s+\w+",
    **dict.fromkeys((".sh", ".bash"), r"^(?:\w+\s*\(\)\s*\{|function\s+\w+)"),
}
# fixed values: bodies that do nothing yet
STUB = (
    r"^\s*return\s+(nil|\"\"|0|false|\[\]|\{\}|None|null)\s*;?\s*$|^\s*return;?\s*$|^\s*pass\s*$|^\s*throw\s+new\s+Error\(\s*[\"'](?i:not implemented|TODO)|^\s*(?i:throw\s+new\s+UnsupportedOperationException)\s*\("
    r"|^\s*(?i:panic)\(\s*\"(?i:not implemented|TODO)|^\s*//\s*(?i:TODO)\b|^\s*#\s*(?i:TODO)\b|^\s*todo!\(|^\s*unimplemented!\("
)
# fixed values: what makes a comment look like code, and lines that nothing follows
CODE_LIKE = r"[{;]|\w+\.\w+\(|\w+\s*:=\s*|^\s*(if|for|while|switch|case)\s|^\s*(return|import|from|var|let|const|func|def|class)\b"
LEAVES = r"^\s*return\b|^\s*throw\b|^\s*panic\("


def _issue(df: DataFrame, rule: Column | str, severity: str, category: str, message: Column | str, line: Column) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select("file_id", "file", line.cast("int").alias("line"), lit(rule).alias("id"), F.lit(severity).alias("severity"), F.lit(category).alias("category"), lit(message).alias("message"))


def _header() -> Column:
    out = F.lit(False)
    for pattern in dict.fromkeys(HEADERS.values()):
        out = F.when(F.col("ext").isin(*(e for e, p in HEADERS.items() if p == pattern)), F.col("t").rlike(pattern)).otherwise(out)
    return out


def stubs(lines: DataFrame) -> DataFrame:
    """Added functions whose body, as far as added lines show it, is one line that does nothing yet."""
    rows = L.analyzable(lines).where(F.col("ext").isin(*HEADERS)).withColumn("t", F.trim(F.coalesce("content", F.lit(""))))
    # up to five lines of body stand within the next lines; blank ones and an opening brace are passed over
    ahead = F.collect_list(F.struct("type", "t")).over(L.in_hunk().rowsBetween(1, 12))
    stop = lambda x: (x["type"] != "added") | x["t"].isin("}", "})", "};") | x["t"].rlike(HEADERS[".go"]) | x["t"].rlike(HEADERS[".py"])
    heads = rows.withColumn("ahead", ahead).where((F.col("type") == "added") & _header())
    at = F.array_position(F.transform("ahead", stop), True).cast("int")
    body = F.filter(F.when(at > 0, F.slice("ahead", 1, at - 1)).otherwise(F.col("ahead")), lambda x: ~x["t"].isin("", "{"))
    hit = heads.withColumn("body", body).where((F.size("body") == 1) & F.element_at("body", 1)["t"].rlike(STUB))
    return _issue(hit, "hallucination/stub-implementation", "warning", "hallucination", F.concat(F.lit("Possibly incomplete implementation: "), F.col("t")), F.col("new_num"))


def _source(lines: DataFrame) -> DataFrame:
    return L.analyzable(lines).where(~F.col("file").rlike(pattern_packs.NOT_SOURCE))


def commented_code(lines: DataFrame) -> DataFrame:
    """Blocks of at least three added comment lines of which one looks like code."""
    rows = L.islands(_source(lines), (F.col("type") == "added") & L.is_comment(F.col("content"))).where("island is not null")
    body = F.trim(F.regexp_replace(F.trim("content"), r"^(//|#|/\*|\*)+", ""))
    blocks = rows.groupBy("file_id", "file", "hunk_no", "island").agg(F.count("*").alias("n"), F.bool_or((body != "") & body.rlike(CODE_LIKE)).alias("code"), F.min("new_num").alias("line"))
    return _issue(blocks.where("n >= 3 and code"), "patterns/commented-code", "warning", "patterns", "Large block of commented-out code detected", F.col("line"))


def unreachable_code(lines: DataFrame) -> DataFrame:
    """Added lines at the indentation of an added return, throw or panic that stands right before them."""
    t = F.trim(F.coalesce("content", F.lit("")))
    rows = _source(lines).withColumn("t", t).where(t != "")
    rows = rows.where(~L.is_comment(F.col("content")) | F.col("t").isin("}", "})")).withColumn("indent", L.indent_level(F.col("content")))
    before = lambda c: F.lag(c).over(L.in_hunk())
    rows = rows.withColumn("leaves", before((F.col("type") == "added") & F.col("content").rlike(LEAVES))).withColumn("left_at", before("indent"))
    hit = rows.where("leaves and type = 'added' and indent = left_at").where(~F.col("t").isin("}", "})") & ~F.col("t").startswith("case ") & ~F.col("t").startswith("default:"))
    return _issue(hit, "patterns/unreachable-code", "warning", "patterns", "Potentially unreachable code after return/throw/panic", F.col("new_num"))


def shell_without_set_e(lines: DataFrame) -> DataFrame:
    """Shell scripts with added lines, none of which sets -e within the first ten lines."""
    rows = L.added(L.analyzable(lines)).where(F.col("ext").isin(".sh", ".bash"))
    t = F.trim(F.coalesce("content", F.lit("")))
    sets = (t != "") & ~t.startswith("#") & (F.col("new_num") <= 10) & t.contains("set -e")
    bare = rows.groupBy("file_id", "file").agg(F.bool_or(F.coalesce(sets, F.lit(False))).alias("sets")).where("not sets")
    return _issue(bare, "patterns/bash-no-set-e", "info", "patterns", "Bash script missing 'set -e' — errors may be silently ignored", F.lit(1))


def scope_without_failure(lines: DataFrame) -> DataFrame:
    """D files that clean up on every exit but never on failure."""
    rows = L.added(L.analyzable(lines)).where(F.col("ext") == ".d").where(~F.coalesce(F.col("content").rlike(r"^\s*(//|/\*|/\+)"), F.lit(False)))
    has = lambda p: F.bool_or(F.coalesce(F.col("content").rlike(p), F.lit(False)))
    hit = rows.groupBy("file_id", "file").agg(has(r"scope\s*\(\s*exit\s*\)").alias("exits"), has(r"scope\s*\(\s*failure\s*\)").alias("fails")).where("exits and not fails")
    return _issue(hit, "patterns/dlang-scope-without-failure", "info", "patterns", "scope(exit) used without scope(failure) — cleanup may mask errors", F.lit(0))


def migration_files(lines: DataFrame) -> DataFrame:
    """SQL migrations without a transaction, and up migrations without a down migration in the diff."""
    rows = L.analyzable(lines).where((F.col("ext") == ".sql") & F.col("file").rlike(packs.MIGRATION_FILES))
    t = F.upper(F.trim(F.coalesce("content", F.lit(""))))
    kept = rows.where("type <> 'removed'").withColumn("t", t).where(~F.col("t").startswith("--") & (F.col("t") != ""))
    bare = kept.groupBy("file_id", "file").agg(F.bool_or(F.col("t").contains("BEGIN") | F.col("t").contains("START TRANSACTION")).alias("wraps")).where("not wraps")
    named = lambda rule: F.concat(F.lit(f"migration-{rule}-"), F.col("file"))
    out = _issue(bare, named("no-transaction"), "warning", "migration", "Migration lacks a transaction wrapper (BEGIN/COMMIT)", F.lit(1))
    ups = rows.select("file_id", "file").distinct().where(F.lower("file").endswith(".up.sql")).withColumn("down", F.concat(F.expr("left(file, length(file) - 7)"), F.lit(".down.sql")))
    alone = ups.join(lines.select(F.col("file").alias("down")).distinct(), "down", "left_anti")
    return out.unionByName(_issue(alone, named("no-down"), "info", "migration", "Up migration has no corresponding down migration", F.lit(1)))


__all__ = ["commented_code", "migration_files", "scope_without_failure", "shell_without_set_e", "stubs", "unreachable_code"]
