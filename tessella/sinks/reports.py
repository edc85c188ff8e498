"""Reports of issues: JSON, SARIF, terminal lines and review comments."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.operators import issues as I

# fixed values: levels of the interchange format
SARIF_LEVEL = {"error": "error", "warning": "warning", "info": "note"}


def json_report(issues: DataFrame, by: str) -> DataFrame:
    """(by, report): one JSON document per run, issues in report order."""
    row = F.struct(I.rank(F.col("severity")).alias("r"), "file", "line", "id", "message", "severity", "category")
    listed = F.transform(F.sort_array(F.collect_list(row)), lambda x: F.struct(*(x[c].alias(c) for c in ("id", "severity", "category", "file", "line", "message"))))
    return issues.groupBy(by).agg(listed.alias("issues")).select(by, F.to_json(F.struct(F.col(by), F.size("issues").alias("total"), "issues")).alias("report"))


def sarif_rules(issues: DataFrame, cwe_of: DataFrame) -> DataFrame:
    """(id, level, cwe, results): the distinct rules of a report with their weakness, by id."""
    level = F.create_map(*(F.lit(x) for pair in SARIF_LEVEL.items() for x in pair))
    rules = issues.groupBy("id").agg(F.min(I.rank(F.col("severity"))).alias("r"), F.min_by("severity", I.rank(F.col("severity"))).alias("severity"), F.count("*").alias("results"))
    return rules.join(cwe_of, "id", "left").select("id", F.coalesce(F.try_element_at(level, F.col("severity")), F.lit("note")).alias("level"), "cwe", "results")


def sarif(issues: DataFrame, cwe_of: DataFrame, tool: str = "tessella", version: str = "0") -> DataFrame:
    """One row with the whole report as SARIF 2.1.0 text. A report is one document by definition; split issues by run first."""
    level = F.create_map(*(F.lit(x) for pair in SARIF_LEVEL.items() for x in pair))
    place = F.array(F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.greatest("line", F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation")))
    result = F.struct(F.col("id").alias("ruleId"), F.coalesce(F.try_element_at(level, F.col("severity")), F.lit("note")).alias("level"), F.struct(F.col("message").alias("text")).alias("message"), place.alias("locations"))
    rules = sarif_rules(issues, cwe_of).agg(F.sort_array(F.collect_list(F.struct(F.col("id"), F.struct(F.col("level")).alias("defaultConfiguration"), F.struct("cwe").alias("properties")))).alias("rules"), F.sort_array(F.collect_set("cwe")).alias("taxa"))
    results = issues.agg(F.sort_array(F.collect_list(result)).alias("results"))
    taxa = F.transform("taxa", lambda c: F.struct(c.alias("id")))
    run = F.struct(
        F.struct(F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version"), F.col("rules")).alias("driver")).alias("tool"),
        F.array(F.struct(F.lit("CWE").alias("name"), taxa.alias("taxa"))).alias("taxonomies"), F.col("results"),
    )
    told = rules.select(F.struct("rules", "taxa").alias("t")).scalar()
    both = results.withColumn("t", told).select("results", "t.rules", "t.taxa")
    return both.select(F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))


def sarif_lines(issues: DataFrame, cwe_of: DataFrame, tool: str = "tessella", version: str = "0") -> DataFrame:
    """(place, text): the same document as lines in order, one per result, for reports that are too large for a row.

    Sorted by place and written as text, the parts joined are the document; only the distinct rules are brought together.
    """
    rules = sarif_rules(issues, cwe_of).agg(F.to_json(F.sort_array(F.collect_list(F.struct(F.col("id"), F.struct(F.col("level")).alias("defaultConfiguration"), F.struct("cwe").alias("properties"))))).alias("rules"))
    name = F.to_json(F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version")))
    head = rules.select(F.lit("").alias("place"), F.concat(F.lit('{"version":"2.1.0","runs":[{"tool":{"driver":'), F.substring_index(name, "}", 1), F.lit(',"rules":'), "rules", F.lit("}},\"results\":[")).alias("text"))
    level = F.create_map(*(F.lit(x) for pair in SARIF_LEVEL.items() for x in pair))
    at = F.array(F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.greatest("line", F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation")))
    result = F.to_json(F.struct(F.col("id").alias("ruleId"), F.coalesce(F.try_element_at(level, F.col("severity")), F.lit("note")).alias("level"), F.struct(F.col("message").alias("text")).alias("message"), at.alias("locations")))
    key = F.concat_ws("\x1f", I.rank(F.col("severity")).cast("string"), "file", F.lpad(F.coalesce("line", F.lit(0)).cast("string"), 10, "0"), "id", "message")
    rows = issues.select(F.concat(F.lit("1"), key).alias("place"), result.alias("text"))
    least = rows.agg(F.min(F.struct("place", "text")).alias("m")).select("m.place", "m.text")  # it alone has no comma before it
    first = least.select("place", "text", F.lit(True).alias("first"))
    rows = rows.join(F.broadcast(first), ["place", "text"], "left").select("place", F.when(F.col("first"), F.col("text")).otherwise(F.concat(F.lit(","), "text")).alias("text"))
    tail = rules.select(F.lit("2").alias("place"), F.lit("]}]}").alias("text"))
    return head.unionByName(rows).unionByName(tail)


def terminal_lines(issues: DataFrame, compact: bool = False) -> DataFrame:
    """(file, line, text) as a terminal shows it."""
    head = F.format_string("%s:%d: %s [%s] %s", "file", F.coalesce("line", F.lit(0)), "severity", "id", "message")
    more = F.when(F.coalesce("suggestion", F.lit("")) != "", F.concat(head, F.lit("\n    -> "), F.col("suggestion"))).otherwise(head)
    return issues.select("file", "line", (head if compact else more).alias("text"))


def review(issues: DataFrame, shown: DataFrame, by: list[str]) -> DataFrame:
    """Comments of a review: issues on lines that the diff shows (``shown``: by..., line) are placed there, the rest goes into the summary."""
    at = shown.select(*by, "line").where("line > 0").distinct().withColumn("placed", F.lit(True))
    return issues.join(at, [*by, "line"], "left").withColumn("placed", F.coalesce("placed", F.lit(False)))


def apply_edits(lines: DataFrame, edits: DataFrame) -> DataFrame:
    """(file, line, content, state) of ``lines`` (file, line, content) after ``edits`` (file, line, old_text, new_text).

    An edit applies if the line's trimmed text is its trimmed old text; the line's indentation stays, and an empty new
    text deletes the line (content null). state is kept, changed, deleted or mismatch. Of several edits of a line the first by text applies.
    """
    one = edits.groupBy("file", "line").agg(F.min(F.struct("old_text", "new_text")).alias("e"))
    j = lines.join(one, ["file", "line"], "left")
    fits, empty = F.trim("content") == F.trim("e.old_text"), F.trim("e.new_text") == ""
    indent = F.regexp_extract("content", r"^([ \t]*)", 1)
    state = F.when(F.col("e").isNull(), "kept").when(~F.coalesce(fits, F.lit(False)), "mismatch").when(empty, "deleted").otherwise("changed")
    return j.select("file", "line", F.when(state == "changed", F.concat(indent, F.ltrim("e.new_text"))).when(state == "deleted", F.lit(None)).otherwise(F.col("content")).alias("content"), state.alias("state"))


def rejoin(lines: DataFrame) -> DataFrame:
    """(file, text): the files again, from their lines; a file's lines are one text by definition."""
    return lines.where("content is not null").groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "content"))), lambda x: x["content"]), "\n").alias("text"))


def with_context(lines: DataFrame, before: int = 3, after: int = 3, order: tuple[str, ...] = ("file", "hunk_no")) -> Column:
    """The text around a line, for display."""
    return F.array_join(F.collect_list(F.coalesce("content", F.lit(""))).over(W.partitionBy(*order).orderBy("pos").rowsBetween(-before, after)), "\n")
