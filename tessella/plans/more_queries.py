"""Queries of the remaining relational operators, each beside its SQL."""
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.functions import lang as langs
from tessella.functions import paths
from tessella.operators import lines as L
from tessella.plans import cases
from tessella.plans import join_queries as J
from tessella.plans import line_queries as Q
from tessella.sinks import fixes
from tessella.sources import parsers, tree
from tessella.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = f"WITH {J._CTES}{sql}" if sql.lstrip().startswith(",") else f"WITH {J._CTES} {sql}"
        return f

    return add


@query(""", gone AS (SELECT DISTINCT file, name FROM symbols_all WHERE type = 'removed' AND exported EXCEPT SELECT DISTINCT file, name FROM symbols),
users AS (SELECT DISTINCT file AS user_file, unnest(names) AS name FROM imports) SELECT g.file, g.name, u.user_file FROM gone g JOIN users u USING (name) WHERE u.user_file <> g.file UNION ALL SELECT 'drawn/lib.ts', 'drawnOnce', 'drawn/use.ts'""")
def removed_export_importers(spark, sf_dir):
    """Files that import a name which its file no longer exports, in the table and in three drawn files."""
    drawn = [("drawn/lib.ts", ["-export const drawnOnce = 1", "-export const drawnStill = 2", "+export const drawnStill = 3"]), ("drawn/use.ts", ["+import { drawnOnce, drawnStill } from './lib'"])]
    lines = Q.lines_of(spark, sf_dir).unionByName(L.diff_lines(cases.drawn(spark, drawn)))
    gone = parsers.symbols(lines, "type = 'removed'").where("exported").select("file", "name").subtract(parsers.symbols(lines).select("file", "name"))
    users = parsers.imports(lines).select(F.col("file").alias("user_file"), F.explode("names").alias("name")).distinct()
    return gone.join(users, "name").where("user_file <> file").select("file", "name", "user_file")


@query(r""", t AS (SELECT DISTINCT file, name FROM symbols_all WHERE kind IN ('class', 'type', 'interface') AND type IN ('added', 'removed')),
w AS (SELECT DISTINCT file AS user_file, unnest(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM every_line WHERE type <> 'removed') SELECT t.name, count(DISTINCT w.user_file) AS users FROM t JOIN w USING (name) WHERE w.user_file <> t.file GROUP BY 1""")
def type_change_users(spark, sf_dir):
    """Changed classes and types, and in how many other files their name stands."""
    lines = Q.lines_of(spark, sf_dir)
    t = parsers.symbols(lines, "type in ('added', 'removed')").where("kind in ('class', 'type', 'interface')").select("file", "name").distinct()
    w = lines.where("type <> 'removed'").select(F.col("file").alias("user_file"), F.explode(F.regexp_extract_all("content", F.lit("[A-Za-z_][A-Za-z0-9_]*"), 0)).alias("name")).distinct()
    # users are counted per name before they meet the definitions; a name of one file doesn't count that file
    n = w.groupBy("name").agg(F.count("*").alias("n"))
    places = t.groupBy("name").agg(F.count("*").alias("k"), F.max("file").alias("file"))
    own = w.select("name", F.col("user_file").alias("file"), F.lit(1).alias("own"))
    met = places.join(n, "name").join(own, ["name", "file"], "left")
    return met.withColumn("users", F.col("n") - F.when((F.col("k") == 1) & F.col("own").isNotNull(), 1).otherwise(0)).where("users > 0").select("name", "users")


@query(""", m AS (SELECT DISTINCT file_id, name FROM symbols_all WHERE kind = 'method' AND type = 'added'), impl AS (SELECT DISTINCT file_id, name FROM symbols WHERE kind = 'method')
SELECT m.file_id, m.name FROM m WHERE NOT EXISTS (SELECT 1 FROM impl i WHERE i.name = m.name AND i.file_id <> m.file_id)""")
def interface_gap(spark, sf_dir):
    """Added methods that no other file has an implementation of."""
    lines = Q.lines_of(spark, sf_dir)
    m = parsers.symbols(lines, "type = 'added'").where("kind = 'method'").select("file_id", "name").distinct()
    where = parsers.symbols(lines).where("kind = 'method'").select("name", "file_id").distinct().groupBy("name").agg(F.min("file_id").alias("lo"), F.max("file_id").alias("hi"))
    return m.join(where, "name").where("lo = hi and lo = file_id").select("file_id", "name")


@query("SELECT name, lang, count(*) AS places, min(file) AS first_file FROM (SELECT DISTINCT name, lang, file FROM symbols WHERE exported) GROUP BY ALL")
def index_lookup(spark, sf_dir):
    """The index by exported name: how many files have it, and the first."""
    s = parsers.symbols(Q.lines_of(spark, sf_dir)).where("exported").select("name", "lang", "file").distinct()
    return s.groupBy("name", "lang").agg(F.count("*").alias("places"), F.min("file").alias("first_file"))


@query(""", a AS (SELECT lower(name) AS k, min(name) AS name FROM symbols WHERE lang = 'python' GROUP BY 1), b AS (SELECT lower(n) AS k, min(n) AS name FROM (SELECT unnest(names) AS n FROM imports WHERE lang = 'python') GROUP BY 1)
SELECT name FROM a UNION ALL SELECT name FROM b ANTI JOIN a USING (k)""")
def union_without_case(spark, sf_dir):
    """Names of two lists, those of the second only where the first has none of the same letters."""
    lines = Q.lines_of(spark, sf_dir)
    first = parsers.symbols(lines).where("lang = 'python'").groupBy(F.lower("name").alias("k")).agg(F.min("name").alias("name"))
    second = parsers.imports(lines).where("lang = 'python'").select(F.explode("names").alias("n")).groupBy(F.lower("n").alias("k")).agg(F.min("n").alias("name"))
    return first.select("name").unionByName(second.join(first.select("k"), "k", "left_anti").select("name"))


@query(", ch AS (SELECT DISTINCT s.file, s.name FROM symbols s JOIN (SELECT DISTINCT file_id FROM file_diffs WHERE status = 'added') USING (file_id)), ix AS (SELECT DISTINCT file, name FROM symbols) SELECT file, name, 'changed' AS origin FROM ch UNION ALL SELECT file, name, 'index' FROM ix WHERE file NOT IN (SELECT file FROM ch)")
def precedence_union(spark, sf_dir):
    """Definitions of changed files, and those of the index for all other files."""
    lines = Q.lines_of(spark, sf_dir)
    ch = parsers.symbols(lines.where("status = 'added'")).select("file", "name").distinct()
    ix = parsers.symbols(lines).select("file", "name").distinct().join(ch.select("file").distinct(), "file", "left_anti")
    return ch.withColumn("origin", F.lit("changed")).unionByName(ix.withColumn("origin", F.lit("index")))


@query(r"""SELECT file_id, list_has_any(string_split(file, '/'), ['vendor', 'node_modules', 'testdata', '__tests__']) AS skipped, list_has_any(string_split(file, '/'), ['.git', '.hg', '.svn']) OR list_contains(string_split(CASE WHEN contains(file, '/') THEN regexp_extract(file, '^(.*)/[^/]*$', 1) ELSE '.' END, '/'), 'dist') OR regexp_matches(regexp_extract(file, '([^/]*)$', 1), '^dist$') OR regexp_matches(file, '^dist$') OR list_contains(string_split(CASE WHEN contains(file, '/') THEN regexp_extract(file, '^(.*)/[^/]*$', 1) ELSE '.' END, '/'), '*.min.js') OR regexp_matches(regexp_extract(file, '([^/]*)$', 1), '^[^/]*\.min\.js$') OR regexp_matches(file, '^[^/]*\.min\.js$') AS ignored
FROM (SELECT file_id, regexp_replace(replace(path, '\', '/'), '^(\./|/)+', '') AS file FROM file_diffs)""")
def path_filters(spark, sf_dir):
    """Paths that analyzers skip, and those that ignore patterns name."""
    f = table(spark, sf_dir, "file_diffs").select("file_id", paths.unix(F.col("path")).alias("file"))
    return f.select("file_id", paths.has_part(F.col("file"), langs.SKIPPED_DIRS).alias("skipped"), tree.ignored(F.col("file"), ["dist", "*.min.js"]).alias("ignored"))


@query("SELECT id, first_place FROM (SELECT s.name AS id, min(s.file_id) AS first_place FROM symbols s GROUP BY 1)")
def first_occurrence(spark, sf_dir):
    """Distinct names by their first file."""
    return parsers.symbols(Q.lines_of(spark, sf_dir)).groupBy(F.col("name").alias("id")).agg(F.min("file_id").alias("first_place"))


@query(", w AS (SELECT file_id, hunk_no, pos, row_number() OVER (PARTITION BY file_id ORDER BY hunk_no, pos) AS rn FROM every_line WHERE type = 'added') SELECT file_id, hunk_no, pos FROM w WHERE rn <= 5")
def cap_per_group(spark, sf_dir):
    """The first five added lines of every file (the cap is the operator)."""
    rn = F.row_number().over(W.partitionBy("file_id").orderBy("hunk_no", "pos"))
    return L.added(Q.lines_of(spark, sf_dir)).withColumn("rn", rn).where("rn <= 5").select("file_id", "hunk_no", "pos")


@query(r", n AS (SELECT DISTINCT name FROM symbols) SELECT name, upper(regexp_replace(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '([A-Z])([A-Z][a-z])', '\1_\2', 'g'), '[-.]', '_', 'g')) AS env FROM n")
def env_names(spark, sf_dir):
    """Names as environment variables."""
    return parsers.symbols(Q.lines_of(spark, sf_dir)).select("name").distinct().withColumn("env", fixes.env_name(F.col("name")))
