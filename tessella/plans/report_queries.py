"""Queries of sources and sinks over the driver's tables, each beside its SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import paths
from tessella.operators import lines as L
from tessella.operators import rules as R
from tessella.plans import join_queries, packs
from tessella.plans import line_queries as Q
from tessella.sinks import reports
from tessella.sources import diff, specs
from tessella.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("SELECT file_id, path, status, CAST(coalesce(len(hunks), 0) AS INT) AS hunks, CAST(coalesce(list_sum(list_transform(hunks, lambda h: len(h.lines))), 0) AS BIGINT) AS lines, CAST(coalesce(list_sum(list_transform(hunks, lambda h: len(list_filter(h.lines, lambda l: l.type = 'added')))), 0) AS BIGINT) AS added FROM file_diffs")
def diff_round_trip(spark, sf_dir):
    """Every file written as unified diff text and read back by the diff source; files without hunks, such as most binary ones, come back without."""
    f = table(spark, sf_dir, "file_diffs")
    texts = f.select("file_id", diff.render(F.col("path"), F.col("old_path"), F.col("status"), F.col("is_binary"), F.col("hunks")).alias("text"))
    back = diff.file_diffs(texts, "file_id")
    n = lambda cond: F.aggregate(F.transform("hunks", lambda h: F.size(F.filter(h["lines"], cond))), F.lit(0), lambda a, x: a + x).cast("long")
    return back.select("file_id", "path", "status", F.size("hunks").alias("hunks"), n(lambda x: F.lit(True)).alias("lines"), n(lambda x: x["type"] == "added").alias("added"))


_DOC_LINES = "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE text IS NOT NULL)"


def _doc_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    each = docs.select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("p", "content"))
    return each.select("file", (F.col("p") + 1).alias("line"), "content")


@query(f"{_DOC_LINES}, a AS (SELECT doc_id AS file, line, unnest(regexp_extract_all(content, '(REQ-[0-9]+)', 1)) AS req_id FROM l) SELECT req_id, count(*) AS anchors, min(file) AS first_file FROM a GROUP BY ALL")
def anchors_by_requirement(spark, sf_dir):
    a = specs.grouped(specs.anchors(_doc_lines(spark, sf_dir), r"(REQ-[0-9]+)"))
    return a.select("req_id", "anchors", F.col("first.file").alias("first_file"))


@query(f"""{_DOC_LINES}, a AS (SELECT DISTINCT unnest(regexp_extract_all(content, '(REQ-[0-9]+)', 1)) AS req_id FROM l), r AS (SELECT DISTINCT unnest(regexp_extract_all(result_json, 'REQ-[0-9]+')) AS req_id FROM spec_results)
SELECT 'no requirement' AS problem, req_id FROM a ANTI JOIN r USING (req_id) UNION ALL SELECT 'no anchor', req_id FROM r ANTI JOIN a USING (req_id)""")
def spec_orphans(spark, sf_dir):
    a = specs.anchors(_doc_lines(spark, sf_dir), r"(REQ-[0-9]+)")
    r = table(spark, sf_dir, "spec_results").select(F.explode(F.regexp_extract_all("result_json", F.lit("REQ-[0-9]+"), 0)).alias("req_id"))
    without, unanchored = specs.orphans(r, a)
    return without.select(F.lit("no requirement").alias("problem"), "req_id").unionByName(unanchored.select(F.lit("no anchor").alias("problem"), "req_id"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS content, generate_subscripts(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 1) AS line FROM documents WHERE text IS NOT NULL),
f AS (SELECT *, regexp_matches(content, '^\s*```') AS fence FROM l),
i AS (SELECT *, coalesce(sum(CAST(fence AS INT)) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM f),
h AS (SELECT doc_id, line, length(regexp_extract(content, '^(#{2,3})\s', 1)) AS level, regexp_extract(content, '^#{2,3}[\s\p{Z}]+(.*[^\s\p{Z}])[\s\p{Z}]*$', 1) AS title FROM i WHERE NOT fence AND NOT inside AND regexp_matches(content, '^#{2,3}[\s\p{Z}]+.*[^\s\p{Z}]')),
n AS (SELECT *, sum(CAST(level = 2 AS INT)) OVER (PARTITION BY doc_id ORDER BY line) AS n FROM h),
m AS (SELECT *, sum(CAST(level = 3 AS INT)) OVER (PARTITION BY doc_id, n ORDER BY line) AS m FROM n)
SELECT doc_id, 'SEC-' || n || CASE WHEN level = 3 THEN '-' || m ELSE '' END AS req_id, title FROM m""")
def spec_sections(spark, sf_dir):
    """The sections of all documents that are Markdown with headings, numbered as requirements."""
    return specs.requirements(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "req_id", "title")


_FOUND = f"WITH {Q.LINES_SQL}, i AS ({Q._custom_sql()})"


@query(f"""{_FOUND}, every AS (SELECT file_id, line FROM i UNION ALL SELECT file_id, 0 FROM file_diffs), shown AS (SELECT DISTINCT file_id, new_num AS line FROM every_line WHERE type <> 'removed' AND new_num > 0)
SELECT e.file_id, s.line IS NOT NULL AS placed, count(*) AS n FROM every e LEFT JOIN shown s ON s.file_id = e.file_id AND s.line = e.line GROUP BY ALL""")
def review_split(spark, sf_dir):
    """Issues that a review can place on a line that the diff shows, and those for its summary: one about each file as a whole."""
    lines = Q.lines_of(spark, sf_dir)
    shown = lines.where("type <> 'removed'").select("file_id", F.col("new_num").alias("line"))
    whole = table(spark, sf_dir, "file_diffs").select("file_id", F.lit(0).alias("line"))
    found = R.scan_custom(lines, Q.CUSTOM).select("file_id", "line").unionByName(whole)
    return reports.review(found, shown, ["file_id"]).groupBy("file_id", "placed").agg(F.count("*").alias("n"))


@query(f"WITH {Q.LINES_SQL}{join_queries._CWE_SQL}, found AS (" + "\nUNION ALL\n".join(R.group_sql(g) for g in packs.ALL) + "), n AS (SELECT replace(id, '/', '-') AS id, min(CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END) AS r, count(*) AS results FROM found GROUP BY 1) SELECT n.id, CASE r WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'note' END AS level, c.cwe, results FROM n LEFT JOIN cwe_of c USING (id)")
def sarif_rules(spark, sf_dir):
    from tessella.operators import issues

    found = R.scan(Q.lines_of(spark, sf_dir), packs.ALL).withColumn("id", issues.slashed(F.col("id")))
    return reports.sarif_rules(found, join_queries._small_tables(spark)[0])


@query(f"WITH {Q.LINES_SQL}, i AS (SELECT * FROM lines WHERE regexp_matches(content, 'console\\.warn\\(')) SELECT file_id, count(*) AS changed FROM i GROUP BY ALL")
def fix_apply(spark, sf_dir):
    """Debug output replaced in the added lines; an edit applies only where the text is still what it was made for."""
    rows = L.added(L.analyzable(Q.lines_of(spark, sf_dir))).where("content is not null")
    lines = rows.select(F.concat_ws("/", "file_id", "hunk_no").alias("file"), F.col("pos").alias("line"), "content")
    edits = lines.where(F.col("content").rlike(r"console\.warn\(")).select("file", "line", F.trim("content").alias("old_text"), F.regexp_replace(F.trim("content"), r"console\.warn\(", "log.warn(").alias("new_text"))
    done = reports.apply_edits(lines, edits).where("state = 'changed'")
    return done.groupBy(F.substring_index("file", "/", 1).cast("long").alias("file_id")).agg(F.count("*").alias("changed"))


@query(r"SELECT file_id, CASE WHEN contains(p, '/') THEN regexp_extract(p, '^(.*)/[^/]*$', 1) ELSE '.' END AS dir, regexp_extract(p, '([^/]*)$', 1) AS base, lower(regexp_extract(regexp_extract(p, '([^/]*)$', 1), '(\.[^.]*)$', 1)) AS ext FROM (SELECT file_id, regexp_replace(replace(path, '\', '/'), '^(\./|/)+', '') AS p FROM file_diffs)")
def path_parts(spark, sf_dir):
    p = table(spark, sf_dir, "file_diffs").select("file_id", paths.unix(F.col("path")).alias("p"))
    c = F.col("p")
    return p.select("file_id", paths.dirname(c).alias("dir"), paths.basename(c).alias("base"), paths.extension(c).alias("ext"))


@query(r"""WITH c AS (SELECT DISTINCT org_id, regexp_replace(config_yaml, '\r\n?', chr(10), 'g') || chr(10) AS y FROM org_configs WHERE config_yaml IS NOT NULL)
SELECT DISTINCT org_id, regexp_extract(y, 'block_on: (\w+)', 1) AS block_on, CAST(len(regexp_extract_all(regexp_extract(y, 'languages:[ \t]*\n((?:  - [^\n]*\n)*)', 1), '  - ')) AS BIGINT) AS languages,
  CAST(len(regexp_extract_all(regexp_extract(y, 'analyzers:[ \t]*\n((?:  \w+: [^\n]*\n)*)', 1), ': true')) AS BIGINT) AS analyzers_on, CAST(len(regexp_extract_all(regexp_extract(y, 'analyzers:[ \t]*\n((?:  \w+: [^\n]*\n)*)', 1), ': false')) AS BIGINT) AS analyzers_off FROM c""")
def config_settings(spark, sf_dir):
    """What the stored configurations of each organization set."""
    from tessella.sources import config

    return config.settings_table(table(spark, sf_dir, "org_configs").where("config_yaml is not null"), "org_id", "config_yaml").select("org_id", "block_on", "languages", "analyzers_on", "analyzers_off").distinct()
