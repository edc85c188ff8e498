"""What happens to issues after they are found: suppression, baseline, compliance, order, counts and summary."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.lineage import durable

# fixed values: order of severities, and spellings of categories that mean the same
SEVERITY_RANK = {"error": 0, "warning": 1, "info": 2}
SAME_CATEGORY = {"import": "imports", "reference": "references", "test": "tests"}


def normal_category(c: Column) -> Column:
    folded, out = F.lower(F.trim(c)), F.lower(F.trim(c))
    for a, b in SAME_CATEGORY.items():
        out = F.when(folded == a, F.lit(b)).otherwise(out)
    return out


def directives(lines: DataFrame, marker: str) -> DataFrame:
    """(file, line, category) of suppression comments: the words behind ``marker`` up to the end of the comment, '*' where there are none."""
    rest = F.trim(F.regexp_replace(F.substr(F.col("content"), F.locate(marker, F.col("content")) + len(marker)), r"(^|[ \t,])(\*/|//)([ \t,].*)?$", ""))
    words = F.filter(F.split(rest, r"[ \t,]+"), lambda w: w != "")
    found = lines.where(F.contains(F.col("content"), F.lit(marker)))
    return found.select("file", "line", F.explode(F.when(F.size(words) == 0, F.array(F.lit("*"))).otherwise(words)).alias("category"))


def unsuppressed(issues: DataFrame, marks: DataFrame) -> DataFrame:
    """Issues that no directive on their own line or the line above covers; issues without a line are kept."""
    both = marks.select(F.col("file").alias("m_file"), normal_category(F.col("category")).alias("m_category"), F.explode(F.array("line", F.col("line") + 1)).alias("m_line")).distinct()
    wide = both.where("m_category = '*'").select("m_file", "m_line").distinct()
    kept = issues.join(wide, (issues["file"] == wide["m_file"]) & (issues["line"] == wide["m_line"]) & (issues["line"] > 0), "left_anti")
    return kept.join(both, (kept["file"] == both["m_file"]) & (kept["line"] == both["m_line"]) & (kept["line"] > 0) & (normal_category(kept["category"]) == both["m_category"]), "left_anti")


def not_in_baseline(issues: DataFrame, baseline: DataFrame) -> DataFrame:
    """Issues without a baseline entry (category, file, message) of equal category and file whose message contains theirs or the other way round."""
    b = baseline.select(normal_category(F.col("category")).alias("b_category"), F.col("file").alias("b_file"), F.col("message").alias("b_message")).distinct()
    alike = F.contains(issues["message"], b["b_message"]) | F.contains(b["b_message"], issues["message"])
    return issues.join(b, (normal_category(issues["category"]) == b["b_category"]) & (issues["file"] == b["b_file"]) & alike, "left_anti")


def rank(severity: Column) -> Column:
    out = F.lit(3)
    for name, n in SEVERITY_RANK.items():
        out = F.when(severity == name, F.lit(n)).otherwise(out)
    return out


def ordered(issues: DataFrame) -> DataFrame:
    """By severity, file and line; rule and message break ties."""
    return issues.orderBy(rank(F.col("severity")), "file", "line", "id", "message")


def numbered(rows: DataFrame, keys: list, parts: int | None = None) -> DataFrame:
    """Adds ``place``, the 1-based place of every row in the order of ``keys`` (which should be unique), without one task
    that sees all rows: rows are laid out by ranges, written, counted per range and numbered inside."""
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = durable(rows.repartitionByRange(n, *keys).withColumn("__part", F.spark_partition_id()))
    sizes = laid.groupBy("__part").count()
    before = F.coalesce(F.sum("count").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row per range
    inside = F.row_number().over(W.partitionBy("__part").orderBy(*keys))
    return laid.withColumn("__inside", inside).join(sizes.select("__part", before.alias("__before")), "__part").withColumn("place", F.col("__before") + F.col("__inside")).drop("__part", "__inside", "__before")


def counts(issues: DataFrame, *by: str) -> DataFrame:
    """errors, warnings, infos, total and whether a run that blocks on errors would stop."""
    n = lambda s: F.count_if(F.col("severity") == s)
    return issues.groupBy(*by).agg(n("error").alias("errors"), n("warning").alias("warnings"), n("info").alias("infos"), F.count("*").alias("total"), F.coalesce(F.bool_or(F.col("severity") == "error"), F.lit(False)).alias("blocks"))


def summary_text(errors: Column, warnings: Column, infos: Column, total: Column, files: Column) -> Column:
    """The one-line summary of a result."""
    part = lambda c, name: F.when(c > 0, F.concat(c.cast("string"), F.lit(name)))
    inner = F.concat_ws(", ", part(errors, " errors"), part(warnings, " warnings"), part(infos, " info"))
    of_files = F.concat(F.lit(" in "), files.cast("string"), F.lit(" files"))
    return F.when(total == 0, F.concat(F.lit("No issues found"), of_files)).otherwise(F.concat(F.lit("Found "), total.cast("string"), F.lit(" issues"), F.when(inner != "", F.concat(F.lit(" ("), inner, F.lit(")"))).otherwise(F.lit("")), of_files))


def violations(issues: DataFrame, cwe_of: DataFrame, packs: DataFrame) -> DataFrame:
    """(pack, cwe, id, n): issues by the weakness of a compliance pack that their id stands for.

    ``cwe_of``: id, cwe; ``packs``: pack, cwe. Issues are counted before they meet the small tables.
    """
    n = issues.groupBy("id").agg(F.count("*").alias("n"))
    return n.join(cwe_of, "id").join(packs, "cwe").select("pack", "cwe", "id", "n")


def compliance(issues: DataFrame, cwe_of: DataFrame, packs: DataFrame) -> DataFrame:
    """Per pack: total and violated weaknesses, and whether there are none."""
    bad = violations(issues, cwe_of, packs).groupBy("pack").agg(F.count_distinct("cwe").alias("violated"))
    total = packs.groupBy("pack").agg(F.count("*").alias("total"))
    v = F.coalesce("violated", F.lit(0))
    return total.join(bad, "pack", "left").select("pack", "total", v.alias("violated"), (v == 0).alias("compliant"))


def slashed(issue_id: Column) -> Column:
    """An id with its category slash as the hyphen of the weakness table; the tables' own spelling needs none."""
    return F.replace(issue_id, F.lit("/"), F.lit("-"))
