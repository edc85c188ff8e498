"""Complexity of changed functions: length, branching, returns, nesting and parameters, by language.

A function region runs from one added header to the next in its hunk; the header itself isn't counted. A function's
length is known where its hunk shows its end: the closing line at the header's indentation, or for Python the last line
before one that is indented no deeper.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.functions import lang as langs
from tessella.functions import paths
from tessella.operators import lines as L
from tessella.sources import parsers

# fixed values: thresholds (warning, error), all strict
CYCLOMATIC, DEPTH, PARAMETERS, RETURNS, LENGTH = (10, 20), (4, 6), (5, 8), 8, (80, 150)
_FAMILY = r"^[^(]*?([^\s(]+)\s*\("
# fixed values: pattern of a function's header whose group is its name
HEADERS = {
    "go": r"^func (?:\(.*?\) )?(\w+)", "typescript": r"^(?:export )?(?:async )?function ([\w$]+)", "python": r"^(?:async )?def ([^\s(]+)", "rust": r"^(?:pub |pub\(crate\) |async |pub async )?fn (\w+)",
    **dict.fromkeys(("java", "kotlin", "csharp", "dart", "scala", "groovy", "swift", "c", "cpp"), _FAMILY), "php": r"function (\w+)", "ruby": r"^def ([^\s(;]+)", "elixir": r"^defp? ([^\s(,]+)",
}
# fixed values: what stands before a parenthesis without being a function's name
NO_NAMES = ["if", "for", "while", "switch", "catch", "return"]
_JAVA = r"(?<![A-Za-z_])(?:if|case|for|while|catch) |&&|\|\||\?"
# fixed values: decision points
DECISIONS = {
    "go": r"(?<![A-Za-z_])(?:if|case|for) |&&|\|\|", "python": r"(?<![A-Za-z_])(?:(?<!else )if|elif|for|while|except|and|or) ", "rust": r"(?<![A-Za-z_])(?:if|match|for|while) |&&|\|\||\?",
    **dict.fromkeys(("typescript", "java", "kotlin", "csharp", "dart", "scala", "groovy", "c", "cpp", "swift"), _JAVA), "php": r"(?<![A-Za-z_])(?:if|elseif|case|for|while|foreach|catch) |&&|\|\||\?",
    "ruby": r"(?<![A-Za-z_])(?:(?<!else )if|elsif|when|unless|while|until|rescue) |&&|\|\|", "elixir": r"(?<![A-Za-z_])(?:(?<!else )if|cond|case|with|rescue|and|or) ",
}
BRACES = ["go", "java", "typescript", "rust", "c", "cpp", "csharp", "php", "swift", "kotlin", "dart", "scala", "groovy", "zig", "crystal", "dlang"]


def _by_lang(table: dict[str, str], make) -> Column:
    """``make(pattern)`` of a line's language; languages that share a pattern share a branch."""
    out = F.lit(None)
    for pattern in dict.fromkeys(table.values()):
        out = F.when(F.col("lang").isin(*(k for k, p in table.items() if p == pattern)), make(pattern)).otherwise(out)
    return out


def level(value: Column, bounds: tuple[int, int]) -> Column:
    return F.when(value > bounds[1], "error").when(value > bounds[0], "warning")


def parameters(signature: Column) -> Column:
    """How many parameters a signature lists, receivers aside; null if the list doesn't end on the line."""
    c = F.regexp_replace(signature, r"^func\s*\([^)]*\)", "func")
    c = F.regexp_extract(c, r"^[^(]*\((.*)$", 1)
    for _ in range(3):  # lists inside the list
        c = F.regexp_replace(c, r"\([^()]*\)|\[[^\[\]]*\]|<[^<>]*>|\{[^{}]*\}", "")
    body = F.trim(F.regexp_replace(F.regexp_extract(c, r"^([^)]*)\)", 1), r",\s*$", ""))
    return F.when(c.contains(")"), F.when(body == "", 0).otherwise(F.length(body) - F.length(F.replace(body, F.lit(","), F.lit(""))) + 1))


def function_ends(lines: DataFrame) -> DataFrame:
    """``lines`` with ``end_line``: the line number where a function that begins on the line ends, null if its hunk doesn't show it."""
    shown = lines.where("type <> 'removed' and content is not null").withColumn("indent", L.indent_level(F.col("content"))).withColumn("filled", F.trim("content") != "")
    here = F.struct("pos", "new_num")
    closes = F.col("content").rlike(r"^\s*(\}|end\b)")
    level = W.partitionBy("file_id", "hunk_no", "indent").orderBy("pos").rowsBetween(1, W.unboundedFollowing)
    ahead = L.in_hunk().rowsBetween(1, W.unboundedFollowing)
    closed = F.min(F.when(closes, here)).over(level)["new_num"]
    dedent = F.lit(None)
    for k in (12, 8, 4, 2, 1, 0):  # the widths that Python's blocks are indented by
        dedent = F.when(F.col("indent") <= k, F.min(F.when(F.col("filled") & (F.col("indent") <= k), here)).over(ahead)["new_num"] - 1).otherwise(dedent)
    return shown.withColumn("end_line", F.when(F.col("lang") == "python", dedent).otherwise(closed))


def issues(lines: DataFrame) -> DataFrame:
    """(file_id, file, line, id, severity, category, message) of ``lines`` (diff_lines); tests and vendored files are left alone."""
    own = L.analyzable(lines).withColumn("lang", langs.language(F.col("file")))
    own = own.where(F.col("lang").isNotNull() & ~langs.is_test(F.col("file")) & ~paths.has_part(F.col("file"), ["vendor", "node_modules"]))
    rows = L.added(own).where("content is not null")
    named = F.regexp_replace(F.coalesce(_by_lang(HEADERS, lambda p: F.regexp_extract("t", p, 1)), F.lit("")), r"^[*&]+", "")
    code = rows.where(F.col("lang").isin(*HEADERS)).withColumn("t", F.regexp_replace("content", r"^\s+|\s+$", "")).withColumn("name", named)
    header = (F.col("name") != "") & ~(F.col("name").isin(*NO_NAMES) & F.col("lang").isin(*(k for k, p in HEADERS.items() if p == _FAMILY)))
    inside = L.regions(code.withColumn("header", header), F.col("header")).where("region is not null")
    decides = F.when(F.col("header"), 0).otherwise(_by_lang(DECISIONS, lambda p: F.regexp_count("t", F.lit(p))))
    first = lambda c: F.max(F.when(F.col("header"), F.col(c)))
    f = inside.groupBy("file_id", "file", "hunk_no", "region").agg(
        (F.lit(1) + F.sum(decides)).alias("n"), F.count_if(~F.col("header") & F.col("t").rlike(r"(?<![A-Za-z_])return")).alias("returns"), first("new_num").alias("line"), first("name").alias("name"),
    )
    deep = L.clamped_depth(rows.where(F.col("lang").isin(*BRACES))).select("file_id", "file", F.col("new_num").alias("line"), "depth")
    deep = deep.unionByName(rows.where("lang = 'python' and trim(content) <> ''").select("file_id", "file", F.col("new_num").alias("line"), L.indent_depth(F.col("content")).alias("depth")))
    symbols = parsers.symbols(own).where("kind in ('function', 'method')").withColumn("n", parameters(F.col("signature")))
    ends = function_ends(own).where("end_line is not null and type = 'added'").select("file_id", F.col("new_num").alias("line"), (F.col("end_line") - F.col("new_num")).alias("length"))
    long = symbols.join(ends, ["file_id", "line"])
    quoted = F.concat(F.lit('Function "'), F.col("name"), F.lit('" '))

    def found(df: DataFrame, rule: str, value: Column, bounds: tuple[int, int] | int, before: Column, what: str, further: str) -> DataFrame:
        """Issues of rows whose ``value`` passes a bound; the text names the value and the bound that it passes."""
        number = value.cast("string")
        one = bounds if isinstance(bounds, int) else bounds[0]
        told = lambda tail: F.concat(before, F.lit(what.split("#")[0]), number, F.lit(what.split("#")[1]), F.lit(tail))
        soft = told(f" (consider {further} at {one}+)")
        severity = F.when(value > one, "warning") if isinstance(bounds, int) else level(value, bounds)
        message = soft if isinstance(bounds, int) else F.when(value > bounds[1], told(f" (max recommended: {bounds[1]})")).otherwise(soft)
        ident = F.concat(F.lit(f"complexity-{rule}-"), F.col("file"), F.lit("-"), F.col("line").cast("string"))
        return df.select("file_id", "file", F.col("line").cast("int").alias("line"), ident.alias("id"), severity.alias("severity"), F.lit("complexity").alias("category"), message.alias("message")).where("severity is not null")

    none, n = F.lit(""), F.col("n")
    out = found(f, "cyclomatic", n, CYCLOMATIC, quoted, "has cyclomatic complexity #", "simplifying")
    out = out.unionByName(found(f, "returns", F.col("returns"), RETURNS, quoted, "has # return statements", "reducing"))
    out = out.unionByName(found(deep, "nesting", F.col("depth"), DEPTH, none, "Code is nested # levels deep", "flattening"))
    out = out.unionByName(found(long, "func-length", F.col("length"), LENGTH, quoted, "is # lines long", "splitting"))
    return out.unionByName(found(symbols, "params", n, PARAMETERS, quoted, "has # parameters", "reducing"))
