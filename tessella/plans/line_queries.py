"""Queries of the operators over diff lines, each beside its SQL. The lines are those of file_diffs."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.lineage import spread
from tessella.operators import lines as L
from tessella.operators import rules as R
from tessella.plans import packs
from tessella.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

LINES_SQL = r"""
hk AS (
  SELECT file_id, regexp_replace(replace(path, '\', '/'), '^(\./|/)+', '') AS file, status, is_binary, unnest(hunks) AS h, generate_subscripts(hunks, 1) - 1 AS hunk_no FROM file_diffs
), raw AS (
  SELECT file_id, file, status, is_binary, hunk_no, unnest(h.lines) AS l, generate_subscripts(h.lines, 1) - 1 AS pos FROM hk
), every_line AS (
  SELECT file_id, file, lower(regexp_extract(regexp_extract(file, '([^/]*)$', 1), '(\.[^.]*)$', 1)) AS ext, status, is_binary, hunk_no, pos, l.type AS type, l.content AS content, l.old_num AS old_num, l.new_num AS new_num FROM raw
), lines AS (
  SELECT * FROM every_line WHERE type = 'added' AND status <> 'deleted' AND NOT coalesce(is_binary, false) AND content IS NOT NULL
)
"""
HUNK = "(PARTITION BY file_id, hunk_no ORDER BY pos"


def query(sql: str | None = None, name: str | None = None):
    """Registers a query and its SQL (a SELECT after the shared CTEs)."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE[name or f.__name__] = f"WITH {LINES_SQL}{sql}" if sql.lstrip().startswith(",") else f"WITH {LINES_SQL} {sql}"
        return f

    return add


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.diff_lines(spread(table(spark, sf_dir, "file_diffs")))


_ISSUES = "\nUNION ALL\n".join(R.group_sql(g) for g in packs.ALL)


@query("SELECT file_id, hunk_no, pos, line, id, message FROM (" + R.group_sql(packs.SECRETS) + ")")
def rule_scan_secrets(spark, sf_dir):
    return R.scan(lines_of(spark, sf_dir), [packs.SECRETS]).select("file_id", "hunk_no", "pos", "line", "id", "message")


@query("SELECT grp, id, count(*) AS n FROM (" + "\nUNION ALL\n".join(R.group_sql(g) for g in packs.SECURITY) + ") GROUP BY ALL")
def rule_scan_first_match(spark, sf_dir):
    return R.scan(lines_of(spark, sf_dir), packs.SECURITY).groupBy("grp", "id").agg(F.count("*").alias("n"))


@query(
    "SELECT CASE WHEN " + R.fires_sql(R.Rule(packs.SECRETS.rules[-1].pattern, ""), R.Group("", "", (), comments=True)) + " THEN 'matched' ELSE 'not' END AS outcome, "
    "coalesce(bool_or(" + " OR ".join(f"regexp_matches(content, {R.quoted(x)})" for x in packs.SECRETS.unless) + "), false) AS any_excluded, count(*) AS n FROM lines GROUP BY 1"
)
def rule_scan_exclusions(spark, sf_dir):
    rows = L.added(L.analyzable(lines_of(spark, sf_dir))).where("content is not null")
    excluded = F.lit(False)
    for x in packs.SECRETS.unless:
        excluded = excluded | F.col("content").rlike(x)
    outcome = F.when(F.col("content").rlike(packs.SECRETS.rules[-1].pattern), "matched").otherwise("not")
    return rows.groupBy(outcome.alias("outcome")).agg(F.coalesce(F.bool_or(excluded), F.lit(False)).alias("any_excluded"), F.count("*").alias("n"))


@query("SELECT grp, id, severity, category, count(*) AS n FROM (" + _ISSUES + ") GROUP BY ALL")
def rule_scan_all(spark, sf_dir):
    return R.scan(lines_of(spark, sf_dir), packs.ALL).groupBy("grp", "id", "severity", "category").agg(F.count("*").alias("n"))


CUSTOM = (
    R.CustomRule("own/limit", r"limit\s*[:=]\s*\d+", "*.py", "info", "Literal limit"), R.CustomRule("own/lock", r"\bself\.\w+_lock\b", "src/*/*.py", "error", "Lock use"),
    R.CustomRule("own/throws", r"\bthrow new \w+", "", "fatal", "Throws"), R.CustomRule("own/broken", r"([", "", "error", "Never compiled"),
)


def _custom_sql() -> str:
    from tessella.functions.paths import glob_regex

    out = []
    for r in CUSTOM[:3]:
        glob = f" AND (regexp_matches(file, {R.quoted(glob_regex(r.files))}) OR regexp_matches(regexp_extract(file, '([^/]*)$', 1), {R.quoted(glob_regex(r.files))}))" if r.files else ""
        severity = r.severity if r.severity in ("error", "warning", "info") else "warning"
        out.append(f"SELECT file_id, hunk_no, pos, file, new_num AS line, 'custom' AS category, {R.quoted(r.id)} AS id, {R.quoted(severity)} AS severity, {R.quoted(r.message)} AS message FROM lines WHERE regexp_matches(content, {R.quoted(r.pattern)}){glob}")
    return "\nUNION ALL\n".join(out)


@query(_custom_sql())
def custom_rules_glob(spark, sf_dir):
    return R.scan_custom(lines_of(spark, sf_dir), CUSTOM)


# window-like operators
_GO = "ext = '.go' AND status <> 'deleted'"


@query(
    rf""", w AS (SELECT *, coalesce(max(CAST(type <> 'removed' AND NOT coalesce(regexp_matches(content, '^\s*(//|#|/\*|\*)'), false) AND regexp_matches(content, 'err\s*!=\s*nil') AS INT)) OVER {HUNK} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 0) AS checked FROM every_line)
SELECT file_id, hunk_no, pos FROM w WHERE ext = '.go' AND type = 'added' AND regexp_matches(content, ',\s*err\s*:?=') AND checked = 0"""
)
def lookahead_k(spark, sf_dir):
    """Errors of Go calls that none of the next three lines checks (removed and comment lines count but don't match)."""
    c = F.col("content")
    hit = (F.col("type") != "removed") & ~L.is_comment(c) & c.rlike(r"err\s*!=\s*nil")
    rows = lines_of(spark, sf_dir).where("ext = '.go'").withColumn("checked", L.near(hit, 1, 3))
    return rows.where((F.col("type") == "added") & c.rlike(r",\s*err\s*:?=") & ~F.col("checked")).select("file_id", "hunk_no", "pos")


@query(
    rf""", w AS (SELECT *, coalesce(max(CAST(coalesce(regexp_matches(content, 'try\s*\{{'), false) AS INT)) OVER {HUNK} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0) AS tried FROM every_line)
SELECT file_id, hunk_no, pos FROM w WHERE ext IN ('.ts', '.js') AND type = 'added' AND regexp_matches(content, '\bawait\b') AND tried = 0"""
)
def lookbehind_k(spark, sf_dir):
    """Awaited calls without a try in the twenty lines before."""
    rows = lines_of(spark, sf_dir).where(F.col("ext").isin(".ts", ".js")).withColumn("tried", L.near(F.col("content").rlike(r"try\s*\{"), -20, -1))
    return rows.where((F.col("type") == "added") & F.col("content").rlike(r"\bawait\b") & ~F.col("tried")).select("file_id", "hunk_no", "pos")


@query(
    rf""", m AS (SELECT *, coalesce(regexp_matches(content, '^\s*\}}'), false) AS hit, coalesce(regexp_matches(trim(content), '^(return|throw)\b'), false) AS stop FROM every_line),
w AS (SELECT *, min(CASE WHEN hit THEN pos END) OVER {HUNK} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS h, min(CASE WHEN stop THEN pos END) OVER {HUNK} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS s FROM m)
SELECT file_id, hunk_no, pos FROM w WHERE regexp_matches(content, '\bif\b') AND type = 'added' AND h IS NOT NULL AND (s IS NULL OR h <= s)"""
)
def lookahead_early_stop(spark, sf_dir):
    """Conditions whose block closes within five lines, before any return or throw."""
    c = F.col("content")
    hit, stop = F.coalesce(c.rlike(r"^\s*\}"), F.lit(False)), F.coalesce(F.trim(c).rlike(r"^(return|throw)\b"), F.lit(False))
    rows = lines_of(spark, sf_dir).withColumn("hit", hit).withColumn("stop", stop).withColumn("closes", L.before_stop(F.col("hit"), F.col("stop"), 5))
    return rows.where(c.rlike(r"\bif\b") & (F.col("type") == "added") & F.col("closes")).select("file_id", "hunk_no", "pos")


@query(rf""", w AS (SELECT *, max(CAST(coalesce(content LIKE '%lock%', false) AS INT)) OVER {HUNK} ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING) AS n FROM every_line)
SELECT file_id, hunk_no, count(*) AS lines FROM w WHERE n = 1 GROUP BY ALL""")
def symmetric_neighbourhood(spark, sf_dir):
    rows = lines_of(spark, sf_dir).withColumn("near", L.near(F.col("content").contains("lock"), -10, 9))
    return rows.where("near").groupBy("file_id", "hunk_no").agg(F.count("*").alias("lines"))


@query(rf""", w AS (SELECT *, lead(content) OVER {HUNK}) AS nc, lead(type) OVER {HUNK}) AS nt FROM every_line)
SELECT file_id, hunk_no, pos, nc AS next_content FROM w WHERE type = 'added' AND regexp_matches(content, '\)\s*(:|\{{)\s*$') AND nt = 'added' AND regexp_matches(nc, '^\s*(return|pass)\b')""")
def next_line(spark, sf_dir):
    """Headers that an added line with return or pass follows at once."""
    w = L.in_hunk()
    rows = lines_of(spark, sf_dir).withColumn("next_content", F.lead("content").over(w)).withColumn("next_type", F.lead("type").over(w))
    return rows.where((F.col("type") == "added") & F.col("content").rlike(r"\)\s*(:|\{)\s*\z") & (F.col("next_type") == "added") & F.col("next_content").rlike(r"^\s*(return|pass)\b")).select("file_id", "hunk_no", "pos", "next_content")


_CODELIKE = r"[;{}=]|\w+\("


@query(
    rf""", f AS (SELECT *, type = 'added' AND coalesce(regexp_matches(content, '^\s*(//|#|/\*|\*)'), false) AS c FROM every_line),
r AS (SELECT *, pos - row_number() OVER (PARTITION BY file_id, hunk_no, c ORDER BY pos) AS island FROM f)
SELECT file_id, hunk_no, min(new_num) AS line, max(new_num) AS end_line, count(*) AS comments FROM r WHERE c GROUP BY file_id, hunk_no, island HAVING count(*) >= 3 AND bool_or(regexp_matches(content, '{_CODELIKE}'))"""
)
def islands_comments(spark, sf_dir):
    """Blocks of three or more added comment lines of which one looks like code."""
    c = F.col("content")
    rows = L.islands(lines_of(spark, sf_dir), (F.col("type") == "added") & L.is_comment(c)).where("island is not null")
    blocks = rows.groupBy("file_id", "hunk_no", "island").agg(F.min("new_num").alias("line"), F.max("new_num").alias("end_line"), F.count("*").alias("comments"), F.bool_or(c.rlike(_CODELIKE)).alias("code"))
    return blocks.where("comments >= 3 and code").select("file_id", "hunk_no", "line", "end_line", "comments")


@query(
    rf""", m AS (SELECT *, trim(coalesce(content, '')) AS t, length(regexp_extract(coalesce(content, ''), '^([ \t]*)', 1)) AS ind FROM every_line),
k AS (SELECT *, t <> '' AND (t IN ('}}', '}})') OR NOT regexp_matches(t, '^(//|#|/\*|\*)')) AS meaningful FROM m),
w AS (SELECT *, first(CASE WHEN meaningful THEN struct_pack(t := t, ind := ind, type := type, n := new_num) END IGNORE NULLS) OVER {HUNK} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM k)
SELECT file_id, hunk_no, nx.n AS line FROM w WHERE type = 'added' AND regexp_matches(content, '^\s*(return\b|throw\b|panic\()') AND nx.t NOT IN ('}}', '}})') AND NOT regexp_matches(nx.t, '^(case |default:)') AND nx.ind = ind AND nx.type = 'added'"""
)
def unreachable_next(spark, sf_dir):
    """Added lines at the indent of a return, throw or panic right before them."""
    c = F.coalesce("content", F.lit(""))
    rows = lines_of(spark, sf_dir).withColumn("t", F.trim(c)).withColumn("ind", L.indent_level(c))
    meaningful = (F.col("t") != "") & (F.col("t").isin("}", "})") | ~F.col("t").rlike(r"^(//|#|/\*|\*)"))
    nxt = F.first(F.when(meaningful, F.struct("t", "ind", "type", F.col("new_num").alias("n"))), ignorenulls=True).over(L.in_hunk().rowsBetween(1, W.unboundedFollowing))
    rows = rows.withColumn("nx", nxt)
    same = (F.col("nx.ind") == F.col("ind")) & (F.col("nx.type") == "added") & ~F.col("nx.t").isin("}", "})") & ~F.col("nx.t").rlike(r"^(case |default:)")
    return rows.where((F.col("type") == "added") & F.col("content").rlike(r"^\s*(return\b|throw\b|panic\()") & same).select("file_id", "hunk_no", F.col("nx.n").alias("line"))


_HEADER = r"^(func |(export )?(async )?function |(async )?def )"
_DECIDES = r"\b(if|for|while|case|catch|elif|except|and|or) |&&|\|\|"


@query(
    rf""", a AS (SELECT *, trim(content) AS t FROM every_line WHERE type = 'added' AND content IS NOT NULL AND ext IN ('.go', '.py', '.ts', '.js')),
r AS (SELECT *, regexp_matches(t, '{_HEADER}') AS header, max(CASE WHEN regexp_matches(t, '{_HEADER}') THEN pos END) OVER {HUNK} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS region FROM a)
SELECT file_id, hunk_no, region, CAST(1 + sum(CASE WHEN header THEN 0 ELSE len(regexp_extract_all(t, '{_DECIDES}')) END) AS BIGINT) AS complexity, CAST(count_if(NOT header AND regexp_matches(t, '\breturn\b')) AS BIGINT) AS returns FROM r WHERE region IS NOT NULL GROUP BY ALL"""
)
def function_regions(spark, sf_dir):
    """Cyclomatic complexity and return lines of every function region; the header itself isn't counted."""
    rows = L.added(lines_of(spark, sf_dir)).where(F.col("content").isNotNull() & F.col("ext").isin(".go", ".py", ".ts", ".js")).withColumn("t", F.trim("content"))
    rows = L.regions(rows.withColumn("header", F.col("t").rlike(_HEADER)), F.col("header")).where("region is not null")
    decisions = F.when(F.col("header"), 0).otherwise(F.regexp_count("t", F.lit(_DECIDES)))
    return rows.groupBy("file_id", "hunk_no", "region").agg((F.lit(1) + F.sum(decisions)).cast("long").alias("complexity"), F.count_if(~F.col("header") & F.col("t").rlike(r"\breturn\b")).alias("returns"))


@query(
    rf""", b AS (SELECT *, regexp_replace(coalesce(content, ''), '[^{{}}]', '', 'g') AS br FROM every_line WHERE type = 'added'),
s AS (SELECT *, 2 * length(replace(br, '}}', '')) - length(br) AS net, least(0, coalesce(list_min(list_transform(range(1, length(br) + 1), lambda k: 2 * length(replace(substr(br, 1, k), '}}', '')) - k)), 0)) AS low FROM b),
t AS (SELECT *, sum(net) OVER {HUNK} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ss FROM s),
u AS (SELECT *, ss - least(0, min(ss - net + low) OVER {HUNK} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS depth FROM t)
SELECT file_id, hunk_no, CAST(max(depth) AS INT) AS max_depth FROM u GROUP BY ALL"""
)
def clamped_depth(spark, sf_dir):
    return L.clamped_depth(L.added(lines_of(spark, sf_dir))).groupBy("file_id", "hunk_no").agg(F.max("depth").alias("max_depth"))


@query(r""", d AS (SELECT ext, regexp_extract(content, '^([ \t]*)', 1) AS lead FROM every_line WHERE type = 'added' AND content IS NOT NULL AND trim(content) <> '')
SELECT ext, CAST(CASE WHEN contains(lead, chr(9)) THEN length(lead) - length(replace(lead, chr(9), '')) ELSE length(lead) // 4 END AS INT) AS depth, count(*) AS n FROM d GROUP BY ALL""")
def indent_depth(spark, sf_dir):
    rows = L.added(lines_of(spark, sf_dir)).where("content is not null and trim(content) <> ''")
    return rows.groupBy("ext", L.indent_depth(F.col("content")).alias("depth")).agg(F.count("*").alias("n"))


@query(rf""", w AS (SELECT *, bool_or(coalesce(content LIKE '%for %', false)) OVER (PARTITION BY file_id, hunk_no) AS loops, bool_and(coalesce(type = 'added', false)) OVER (PARTITION BY file_id, hunk_no) AS all_new FROM every_line)
SELECT file_id, hunk_no, pos FROM w WHERE loops AND NOT all_new AND type = 'added' AND content LIKE '%append%'""")
def hunk_flags(spark, sf_dir):
    """Appending lines of hunks that also loop and aren't new as a whole."""
    part = W.partitionBy("file_id", "hunk_no")
    rows = lines_of(spark, sf_dir).withColumn("loops", F.bool_or(F.coalesce(F.col("content").contains("for "), F.lit(False))).over(part)).withColumn("all_new", F.bool_and(F.coalesce(F.col("type") == "added", F.lit(False))).over(part))
    return rows.where(F.col("loops") & ~F.col("all_new") & (F.col("type") == "added") & F.col("content").contains("append")).select("file_id", "hunk_no", "pos")


@query(r""", f AS (SELECT file_id, any_value(file) AS file, bool_or(regexp_matches(content, '(?i)^\s*(BEGIN|START TRANSACTION)\b')) AS wrapped, bool_or(regexp_matches(content, '(?i)\b(ALTER|CREATE|DROP)\s+(TABLE|INDEX)\b')) AS changes FROM lines WHERE ext = '.sql' GROUP BY file_id)
SELECT file_id, file FROM f WHERE changes AND NOT wrapped""")
def file_flags(spark, sf_dir):
    """Migrations that change tables outside a transaction."""
    rows = L.added(L.analyzable(lines_of(spark, sf_dir))).where("ext = '.sql' and content is not null")
    flags = rows.groupBy("file_id").agg(F.first("file").alias("file"), F.bool_or(F.col("content").rlike(r"(?i)^\s*(BEGIN|START TRANSACTION)\b")).alias("wrapped"), F.bool_or(F.col("content").rlike(r"(?i)\b(ALTER|CREATE|DROP)\s+(TABLE|INDEX)\b")).alias("changes"))
    return flags.where("changes and not wrapped").select("file_id", "file")


@query(rf""", w AS (SELECT *, array_to_string(list(coalesce(content, '')) OVER {HUNK} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), chr(10)) AS context FROM every_line)
SELECT file_id, hunk_no, pos, context FROM w WHERE type = 'added' AND regexp_matches(content, '\bpanic\(|\bthrow\b|\braise\b')""")
def context_pm3(spark, sf_dir):
    """Three lines before and after every added line that raises."""
    rows = lines_of(spark, sf_dir).withColumn("context", F.array_join(F.collect_list(F.coalesce("content", F.lit(""))).over(L.in_hunk().rowsBetween(-3, 3)), "\n"))
    return rows.where((F.col("type") == "added") & F.col("content").rlike(r"\bpanic\(|\bthrow\b|\braise\b")).select("file_id", "hunk_no", "pos", "context")


@query(rf""", w AS (SELECT *, coalesce(last(CASE WHEN regexp_matches(content, '^\s*(export )?async ') THEN true WHEN regexp_matches(content, '^\s*(export )?(function|const) ') THEN false END IGNORE NULLS) OVER {HUNK} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS inside FROM every_line)
SELECT file_id, hunk_no, count(*) AS lines FROM w WHERE inside AND type = 'added' GROUP BY ALL""")
def sticky_async(spark, sf_dir):
    """Added lines inside async functions, by the last header before them."""
    c = F.col("content")
    rows = lines_of(spark, sf_dir).withColumn("inside", L.sticky(c.rlike(r"^\s*(export )?async "), c.rlike(r"^\s*(export )?(function|const) ")))
    return rows.where("inside and type = 'added'").groupBy("file_id", "hunk_no").agg(F.count("*").alias("lines"))


@query(rf""", w AS (SELECT *, coalesce(last(CASE WHEN regexp_matches(content, '\b(throw|raise|panic)\b') THEN true WHEN regexp_matches(content, '^\s*(def|function|func|public) ') THEN false END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY hunk_no, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS inside FROM every_line)
SELECT file_id, count(*) AS lines FROM w WHERE inside GROUP BY ALL""")
def sticky_across_hunks(spark, sf_dir):
    """The same with a flag that a file carries from hunk to hunk."""
    c = F.col("content")
    order = W.partitionBy("file_id").orderBy("hunk_no", "pos")
    rows = lines_of(spark, sf_dir).withColumn("inside", L.sticky(c.rlike(r"\b(throw|raise|panic)\b"), c.rlike(r"^\s*(def|function|func|public) "), order))
    return rows.where("inside").groupBy("file_id").agg(F.count("*").alias("lines"))


@query(rf""", d AS (SELECT *, type = 'context' AND coalesce(regexp_matches(content, '^\s*(//|#|\*)'), false) AS doc FROM every_line),
w AS (SELECT *, coalesce(max(CASE WHEN NOT doc THEN pos END) OVER {HUNK} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS other FROM d)
SELECT file_id, hunk_no, pos, CAST(pos - 1 - other AS BIGINT) AS doc_lines FROM w WHERE type = 'added' AND regexp_matches(content, '^\s*(func|def|function|pub fn|static int)\b') AND pos - 1 - other > 0""")
def doc_block_above(spark, sf_dir):
    """Unchanged comment lines right above an added signature."""
    rows = lines_of(spark, sf_dir).withColumn("doc", (F.col("type") == "context") & F.coalesce(F.col("content").rlike(r"^\s*(//|#|\*)"), F.lit(False)))
    rows = rows.withColumn("other", F.coalesce(F.max(F.when(~F.col("doc"), F.col("pos"))).over(L.in_hunk().rowsBetween(W.unboundedPreceding, -1)), F.lit(-1)))
    n = (F.col("pos") - 1 - F.col("other")).cast("long")
    return rows.where((F.col("type") == "added") & F.col("content").rlike(r"^\s*(func|def|function|pub fn|static int)\b") & (n > 0)).select("file_id", "hunk_no", "pos", n.alias("doc_lines"))


@query(rf""", w AS (SELECT *, list(struct_pack(t := trim(coalesce(content, '')), y := type)) OVER {HUNK} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS body FROM every_line),
k AS (SELECT file_id, hunk_no, pos, list_transform(body, lambda x: x.y <> 'added' OR regexp_matches(x.t, '^[}})]') OR regexp_matches(x.t, '{_HEADER}')) AS ends, list_transform(body, lambda x: x.t <> '' AND NOT regexp_matches(x.t, '^(//|#|/\*|\*)')) AS means FROM w WHERE type = 'added' AND regexp_matches(trim(content), '{_HEADER}')),
c AS (SELECT *, CASE WHEN coalesce(list_position(ends, true), 0) = 0 THEN len(ends) ELSE list_position(ends, true) - 1 END AS upto FROM k)
SELECT file_id, hunk_no, pos FROM c WHERE len(list_filter(means[1:upto], lambda m: m)) = 1""")
def stub_body(spark, sf_dir):
    """Functions whose body, as far as shown within five lines, is one meaningful line."""
    body = F.collect_list(F.struct(F.trim(F.coalesce("content", F.lit(""))).alias("t"), F.col("type").alias("y"))).over(L.in_hunk().rowsBetween(1, 5))
    rows = lines_of(spark, sf_dir).withColumn("body", body).where((F.col("type") == "added") & F.trim("content").rlike(_HEADER))
    ends = F.transform("body", lambda x: (x["y"] != "added") | x["t"].rlike(r"^[})]") | x["t"].rlike(_HEADER))
    means = F.transform("body", lambda x: (x["t"] != "") & ~x["t"].rlike(r"^(//|#|/\*|\*)"))
    stop = F.array_position(ends, True)
    upto = F.when(stop == 0, F.size(ends)).otherwise(stop - 1).cast("int")
    return rows.where(F.size(F.filter(F.slice(means, 1, upto), lambda m: m)) == 1).select("file_id", "hunk_no", "pos")


@query("SELECT file_id, count_if(type = 'added') AS added, count_if(type = 'removed') AS removed, count(*) AS lines FROM every_line GROUP BY file_id")
def diff_stat(spark, sf_dir):
    return lines_of(spark, sf_dir).groupBy("file_id").agg(F.count_if(F.col("type") == "added").alias("added"), F.count_if(F.col("type") == "removed").alias("removed"), F.count("*").alias("lines"))


@query(", w AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY hunk_no, pos) AS rn FROM every_line) SELECT file_id, string_agg(content, chr(10) ORDER BY hunk_no, pos) AS head FROM w WHERE rn <= 100 AND type <> 'context' GROUP BY file_id")
def diff_head(spark, sf_dir):
    """What a summary of a file shows: its changed lines among the first hundred."""
    rn = F.row_number().over(W.partitionBy("file_id").orderBy("hunk_no", "pos"))
    rows = lines_of(spark, sf_dir).withColumn("rn", rn).where("rn <= 100 and type <> 'context'")
    one = rows.where("content is not null").groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hunk_no", "pos", "content"))), lambda x: x["content"]), "\n").alias("head"))
    return rows.select("file_id").distinct().join(one, "file_id", "left")
