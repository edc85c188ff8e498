"""Queries of the joins, set operations and graph operators over imports, symbols and issues, each beside its SQL."""
from __future__ import annotations

import sys

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.functions import lang as langs
from tessella.functions import paths
from tessella.operators import graph, issues, resolve
from tessella.operators import lines as L
from tessella.operators import rules as R
from tessella.plans import line_queries as Q
from tessella.plans import cases, packs
from tessella.sources import parsers
from tessella.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

_CTES = (
    Q.LINES_SQL
    + f", imports AS ({parsers.imports_sql()}), symbols AS ({parsers.symbols_sql()}), symbols_all AS ({parsers.symbols_sql('true')})"
    + r", files AS (SELECT DISTINCT regexp_replace(replace(path, '\', '/'), '^(\./|/)+', '') AS file FROM file_diffs WHERE path IS NOT NULL)"
)
DIR = "CASE WHEN contains({0}, '/') THEN regexp_extract({0}, '^(.*)/[^/]*$', 1) ELSE '.' END"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = f"WITH {_CTES}{sql}" if sql.lstrip().startswith(",") else f"WITH {_CTES} {sql}"
        return f

    return add


def imports_of(spark, sf_dir):
    return parsers.imports(Q.lines_of(spark, sf_dir))


def files_of(spark, sf_dir):
    return table(spark, sf_dir, "file_diffs").select(paths.unix(F.col("path")).alias("file")).where("file is not null").distinct()


@query("SELECT lang, path, array_to_string(names, '|') AS names, count(*) AS n FROM imports GROUP BY ALL")
def parsed_imports(spark, sf_dir):
    return imports_of(spark, sf_dir).groupBy("lang", "path", F.array_join("names", "|").alias("names")).agg(F.count("*").alias("n"))


@query("SELECT lang, kind, exported, name, count(*) AS n FROM symbols GROUP BY ALL")
def parsed_symbols(spark, sf_dir):
    return parsers.symbols(Q.lines_of(spark, sf_dir)).groupBy("lang", "kind", "exported", "name").agg(F.count("*").alias("n"))


_SCRIPT_BASE = r"""
, rel AS (SELECT DISTINCT file_id, file, path, len(regexp_extract_all(path, '\.\./')) AS ups, regexp_replace(path, '^(\.{1,2}/)+', '') AS rest FROM imports WHERE lang = 'typescript' AND regexp_matches(path, '^\.{1,2}(/|$)')),
based AS (SELECT *, CASE WHEN contains(file, '/') THEN string_split(regexp_extract(file, '^(.*)/[^/]*$', 1), '/') ELSE [] END AS d FROM rel),
cand AS (SELECT file_id, file, path, array_to_string(list_concat(list_transform(range(greatest(ups - len(d), 0)), lambda x: '..'), list_slice(d, 1, greatest(len(d) - ups, 0)), [rest]), '/') AS base FROM based),
tails AS (SELECT unnest(['', '.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs', '/index.ts', '/index.tsx', '/index.js', '/index.jsx', '/index.mjs', '/index.cjs']) AS tail, unnest(range(13)) AS priority),
hits AS (SELECT c.file_id, c.path, arg_min(f.file, t.priority) AS target FROM cand c CROSS JOIN tails t JOIN files f ON f.file = c.base || t.tail GROUP BY ALL)
"""


def _script_imports(spark, sf_dir):
    return imports_of(spark, sf_dir).where((F.col("lang") == "typescript") & resolve.is_relative(F.col("path")))


def _resolved_scripts(spark, sf_dir):
    imp = _script_imports(spark, sf_dir)
    return resolve.resolve(imp, files_of(spark, sf_dir), resolve.script_base(F.col("file"), F.col("path")), resolve.SCRIPT_TAILS, ["file_id", "file", "path"])


@query(_SCRIPT_BASE + "SELECT r.file_id, r.path, h.target FROM rel r LEFT JOIN hits h USING (file_id, path)")
def candidate_resolution(spark, sf_dir):
    return _resolved_scripts(spark, sf_dir).select("file_id", "path", "target")


@query(_SCRIPT_BASE + "SELECT r.file, count(*) AS broken FROM rel r LEFT JOIN hits h USING (file_id, path) WHERE h.target IS NULL GROUP BY ALL")
def broken_imports(spark, sf_dir):
    return _resolved_scripts(spark, sf_dir).where("target is null").groupBy("file").agg(F.count("*").alias("broken"))


@query(r""", gone AS (SELECT DISTINCT regexp_replace(replace(path, '\', '/'), '^(\./|/)+', '') AS file FROM file_diffs WHERE status = 'deleted'),
renamed AS (SELECT DISTINCT regexp_replace(replace(old_path, '\', '/'), '^(\./|/)+', '') AS file FROM file_diffs WHERE status = 'renamed' AND old_path <> ''),
away AS (SELECT file, 'deleted' AS how FROM gone UNION SELECT file, 'renamed' FROM renamed),
stems AS (SELECT how, regexp_replace(regexp_extract(file, '([^/]*)$', 1), '\.[^.]*$', '') AS stem, file FROM away)
SELECT s.how, s.file, count(DISTINCT l.file_id) AS mentions FROM stems s JOIN (SELECT DISTINCT file_id, unnest(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_\-]*')) AS stem FROM lines WHERE NOT regexp_matches(content, '^\s*(//|#|/\*|\*)')) l USING (stem) GROUP BY ALL""")
def removed_file_references(spark, sf_dir):
    """Added lines that still mention the name of a deleted or renamed file."""
    diffs = table(spark, sf_dir, "file_diffs")
    away = diffs.where("status = 'deleted'").select(paths.unix(F.col("path")).alias("file"), F.lit("deleted").alias("how")).union(diffs.where("status = 'renamed' and old_path <> ''").select(paths.unix(F.col("old_path")).alias("file"), F.lit("renamed").alias("how"))).distinct()
    rows = L.added(L.analyzable(Q.lines_of(spark, sf_dir))).where("content is not null").where(~L.is_comment(F.col("content")))
    words = rows.select("file_id", F.explode(F.regexp_extract_all("content", F.lit(r"[A-Za-z_][A-Za-z0-9_\-]*"), 0)).alias("stem")).distinct()
    return away.where("file is not null").withColumn("stem", paths.stem(F.col("file"))).join(words, "stem").groupBy("how", "file").agg(F.count_distinct("file_id").alias("mentions"))


_GO_TARGETS = f"""
, folders AS (SELECT {DIR.format('file')} AS folder, min(file) AS first_file FROM files GROUP BY 1),
go AS (SELECT DISTINCT path FROM imports WHERE lang = 'go'),
tails2 AS (SELECT path, array_to_string(list_slice(string_split(path, '/'), n, len(string_split(path, '/'))), '/') AS folder FROM (SELECT path, unnest(range(1, len(string_split(path, '/')) + 1)) AS n FROM go)),
pkg AS (SELECT path, min(first_file) AS target FROM tails2 JOIN folders USING (folder) WHERE folder <> '.' GROUP BY path)
"""


@query(_GO_TARGETS + "SELECT go.path, pkg.target FROM go LEFT JOIN pkg USING (path)")
def suffix_join(spark, sf_dir):
    go = imports_of(spark, sf_dir).where("lang = 'go'")
    return resolve.resolve_package(go, files_of(spark, sf_dir), ["path"])


@query(""", mods AS (SELECT DISTINCT path, unnest(names) AS name, regexp_replace(path, '\\.', '/', 'g') || '.py' AS a, regexp_replace(path, '\\.', '/', 'g') AS top FROM imports WHERE lang = 'python' AND len(names) > 0),
tops AS (SELECT DISTINCT regexp_extract(file, '^([^/]+)/', 1) AS top FROM files WHERE contains(file, '/')),
exp AS (SELECT DISTINCT regexp_extract(file, '^([^/]+)/', 1) AS top, name FROM symbols WHERE lang = 'python' AND exported AND contains(file, '/'))
SELECT m.path, m.name FROM mods m WHERE m.top IN (SELECT top FROM exp) AND NOT EXISTS (SELECT 1 FROM exp e WHERE e.top = m.top AND e.name = m.name)""")
def missing_export_anti(spark, sf_dir):
    """Names imported from a top folder that none of its shown Python files defines."""
    lines = Q.lines_of(spark, sf_dir)
    imp = parsers.imports(lines).where("lang = 'python' and size(names) > 0").select("path", "names", F.replace("path", F.lit("."), F.lit("/")).alias("target")).distinct()
    top = F.regexp_extract("file", r"^([^/]+)/", 1)
    exports = parsers.symbols(lines).where("lang = 'python' and exported").where(F.contains("file", F.lit("/"))).select(top.alias("file"), "name")
    return resolve.missing_exports(imp, exports, ["path"]).select("path", "name").distinct()


@query(""", std AS (SELECT unnest(string_split('""" + " ".join(sorted(sys.stdlib_module_names)) + """', ' ')) AS key), tops AS (SELECT DISTINCT regexp_extract(file, '^([^/]+)/', 1) AS key FROM files WHERE contains(file, '/') AND regexp_matches(file, '\\.py$')),
known AS (SELECT key FROM std UNION SELECT key FROM tops)
SELECT file_id, path FROM imports WHERE lang = 'python' AND string_split(path, '.')[1] NOT IN (SELECT key FROM known) GROUP BY ALL""")
def phantom_import_top(spark, sf_dir):
    """Python imports whose first part is neither the standard library nor a folder with Python files."""
    imp = imports_of(spark, sf_dir).where("lang = 'python'").select("file_id", "path").distinct()
    std = spark.createDataFrame([(n,) for n in sorted(sys.stdlib_module_names)], "key string")
    tops = files_of(spark, sf_dir).where(F.col("file").rlike(r"/.*\.py$")).select(F.regexp_extract("file", r"^([^/]+)/", 1).alias("key"))
    return resolve.phantom(imp, std.union(tops), F.col("path"), "top", ".")


_MODULES = r", modules AS (SELECT DISTINCT regexp_extract(content, '^(\S+) v\S+ h1:', 1) AS key FROM every_line WHERE regexp_matches(file, '(^|/)go\.sum$') AND regexp_matches(content, '^(\S+) v\S+ h1:'))"


def _modules(spark, sf_dir):
    """Modules that go.sum files list."""
    rows = Q.lines_of(spark, sf_dir).where(F.col("file").rlike(r"(^|/)go\.sum$") & F.col("content").rlike(r"^(\S+) v\S+ h1:"))
    return rows.select(F.regexp_extract("content", r"^(\S+) v\S+ h1:", 1).alias("key")).distinct()


@query(_MODULES + """, pre AS (SELECT file_id, path, unnest(list_transform(range(1, len(string_split(path, '/')) + 1), lambda n: array_to_string(list_slice(string_split(path, '/'), 1, n), '/'))) AS p FROM imports WHERE lang = 'go' AND contains(string_split(path, '/')[1], '.')),
covered AS (SELECT DISTINCT file_id, path FROM pre JOIN modules ON p = key) SELECT DISTINCT file_id, path FROM pre ANTI JOIN covered USING (file_id, path)""")
def phantom_import_prefix(spark, sf_dir):
    """Go imports with a host (the standard library has none) that lie below no listed module."""
    imp = imports_of(spark, sf_dir).where(F.col("lang") == "go").where(F.contains(F.substring_index("path", "/", 1), F.lit("."))).select("file_id", "path").distinct()
    return resolve.phantom(imp, _modules(spark, sf_dir), F.col("path"), "prefix")


@query(_MODULES + """, used AS (SELECT DISTINCT unnest(list_transform(range(1, len(string_split(path, '/')) + 1), lambda n: array_to_string(list_slice(string_split(path, '/'), 1, n), '/'))) AS key FROM imports WHERE lang = 'go') SELECT key FROM modules ANTI JOIN used USING (key)""")
def unused_dep_anti(spark, sf_dir):
    return resolve.unused(_modules(spark, sf_dir), imports_of(spark, sf_dir).where("lang = 'go'"))


@query(""", ex AS (SELECT DISTINCT lang, file, name FROM symbols WHERE exported AND lang IN ('typescript', 'python') AND NOT starts_with(name, '_') AND name <> 'main'), used AS (SELECT DISTINCT lang, unnest(names) AS name FROM imports) SELECT lang, file, name FROM ex ANTI JOIN used USING (lang, name)""")
def dead_exports(spark, sf_dir):
    lines = Q.lines_of(spark, sf_dir)
    ex = parsers.symbols(lines).where("exported and lang in ('typescript', 'python') and name not like '\\\\_%' and name <> 'main'").select("lang", "file", "name").distinct()
    used = parsers.imports(lines).select("lang", F.explode("names").alias("name")).distinct()
    return ex.join(used, ["lang", "name"], "left_anti").select("lang", "file", "name")


@query(""", r AS (SELECT DISTINCT file_id, hunk_no, name, signature FROM symbols_all WHERE type = 'removed'), a AS (SELECT DISTINCT file_id, hunk_no, name, signature FROM symbols_all WHERE type = 'added')
SELECT r.file_id, r.hunk_no, r.name, r.signature AS before, a.signature AS after FROM r JOIN a USING (file_id, hunk_no, name) WHERE r.signature <> a.signature""")
def signature_change_selfjoin(spark, sf_dir):
    every = parsers.symbols(Q.lines_of(spark, sf_dir), "true")
    side = lambda t, n: every.where(F.col("type") == t).select("file_id", "hunk_no", "name", F.col("signature").alias(n)).distinct()
    return side("removed", "before").join(side("added", "after"), ["file_id", "hunk_no", "name"]).where("before <> after").select("file_id", "hunk_no", "name", "before", "after")


@query(""", r AS (SELECT DISTINCT file_id, name FROM symbols_all WHERE type = 'removed'), a AS (SELECT DISTINCT file_id, name FROM symbols WHERE true) SELECT file_id, name FROM r EXCEPT SELECT file_id, name FROM a""")
def removed_minus_current(spark, sf_dir):
    """Definitions that a file lost: removed and no longer among its shown lines."""
    lines = Q.lines_of(spark, sf_dir)
    return parsers.symbols(lines, "type = 'removed'").select("file_id", "name").subtract(parsers.symbols(lines).select("file_id", "name"))


@query(""", r AS (SELECT DISTINCT file_id, name FROM symbols_all WHERE type = 'removed'), a AS (SELECT DISTINCT file_id, name FROM symbols_all WHERE type = 'added') SELECT file_id, name FROM r INTERSECT SELECT file_id, name FROM a""")
def removed_and_added(spark, sf_dir):
    lines = Q.lines_of(spark, sf_dir)
    return parsers.symbols(lines, "type = 'removed'").select("file_id", "name").intersect(parsers.symbols(lines, "type = 'added'").select("file_id", "name"))


@query(""", lost AS (SELECT file_id, name FROM symbols_all WHERE type = 'removed' EXCEPT SELECT file_id, name FROM symbols),
words AS (SELECT DISTINCT file_id, unnest(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM every_line WHERE type <> 'removed')
SELECT l.file_id, l.name, count(DISTINCT w.file_id) AS users FROM lost l JOIN words w ON w.name = l.name AND w.file_id <> l.file_id GROUP BY ALL""")
def deleted_symbol_references(spark, sf_dir):
    """Lost definitions that other files still mention."""
    lines = Q.lines_of(spark, sf_dir)
    lost = parsers.symbols(lines, "type = 'removed'").select("file_id", "name").subtract(parsers.symbols(lines).select("file_id", "name"))
    words = lines.where("type <> 'removed'").select("file_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit("[A-Za-z_][A-Za-z0-9_]*"), 0))).alias("name")).join(lost.select("name").distinct(), "name", "left_semi").distinct()
    # users are counted per name before they meet the definitions, so a word that stands everywhere makes no pairs
    all_users = words.groupBy("name").agg(F.count("*").alias("n"))
    own = words.withColumn("own", F.lit(1))
    met = lost.join(all_users, "name").join(own, ["file_id", "name"], "left").withColumn("users", F.col("n") - F.coalesce("own", F.lit(0)))
    return met.where("users > 0").select("file_id", "name", "users")


@query(r""", sig AS (SELECT file_id, hunk_no, name, type, list_filter(list_transform(string_split(regexp_extract(signature, '\(([^()]*)\)', 1), ','), lambda p: regexp_extract(trim(p), '^[*&]*(?:final )?([A-Za-z_][A-Za-z0-9_]*)', 1)), lambda p: p <> '') AS params FROM symbols_all WHERE kind = 'function'),
j AS (SELECT r.file_id, r.hunk_no, r.name, r.params AS old_p, a.params AS new_p FROM sig r JOIN sig a USING (file_id, hunk_no, name) WHERE r.type = 'removed' AND a.type = 'added')
SELECT DISTINCT file_id, hunk_no, name, array_to_string(list_sort(list_distinct(list_filter(old_p, lambda p: NOT list_contains(new_p, p)))), ',') AS dropped, array_to_string(list_sort(list_distinct(list_filter(new_p, lambda p: NOT list_contains(old_p, p)))), ',') AS gained FROM j""")
def parameter_drift(spark, sf_dir):
    """Parameters that a rewritten signature dropped and gained."""
    names = F.filter(F.transform(F.split(F.regexp_extract("signature", r"\(([^()]*)\)", 1), ","), lambda p: F.regexp_extract(F.trim(p), r"^[*&]*(?:final )?([A-Za-z_][A-Za-z0-9_]*)", 1)), lambda p: p != "")
    sig = parsers.symbols(Q.lines_of(spark, sf_dir), "true").where("kind = 'function'").select("file_id", "hunk_no", "name", "type", names.alias("params"))
    old, new = sig.where("type = 'removed'").drop("type").withColumnRenamed("params", "old_p"), sig.where("type = 'added'").drop("type").withColumnRenamed("params", "new_p")
    less = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)), ",")
    return old.join(new, ["file_id", "hunk_no", "name"]).select("file_id", "hunk_no", "name", less("old_p", "new_p").alias("dropped"), less("new_p", "old_p").alias("gained")).distinct()


_ANCHORS = r", anchors AS (SELECT DISTINCT file, name, line FROM symbols WHERE lang IN ('go', 'python')), spans AS (SELECT DISTINCT regexp_replace(replace(path, '\', '/'), '^(\./|/)+', '') AS file, h.new_start AS a, h.new_start + h.new_count AS b FROM (SELECT path, unnest(hunks) AS h FROM file_diffs))"


def _anchors(spark, sf_dir):
    anchors = parsers.symbols(Q.lines_of(spark, sf_dir)).where("lang in ('go', 'python')").select("file", "name", "line").distinct()
    spans = table(spark, sf_dir, "file_diffs").select(paths.unix(F.col("path")).alias("file"), F.explode("hunks").alias("h")).select("file", F.col("h.new_start").alias("a"), (F.col("h.new_start") + F.col("h.new_count")).alias("b")).distinct()
    return anchors, spans


@query(_ANCHORS + " SELECT file, name, line FROM anchors x WHERE EXISTS (SELECT 1 FROM spans s WHERE s.file = x.file AND x.line BETWEEN s.a - 5 AND s.b + 5)")
def range_near_anchor(spark, sf_dir):
    """Definitions within five lines of any change of their file."""
    x, s = _anchors(spark, sf_dir)
    return x.join(s, (x["file"] == s["file"]) & x["line"].between(s["a"] - 5, s["b"] + 5), "left_semi")


@query(_ANCHORS + ", blocks AS (SELECT file, name, line, coalesce(lead(line) OVER (PARTITION BY file ORDER BY line, name) - 1, line) AS end_line FROM anchors) SELECT file, name, line, end_line FROM blocks x WHERE EXISTS (SELECT 1 FROM spans s WHERE s.file = x.file AND x.line <= s.b AND x.end_line >= s.a)")
def interval_overlap(spark, sf_dir):
    """Definitions whose extent overlaps a change."""
    x, s = _anchors(spark, sf_dir)
    end = F.coalesce(F.lead("line").over(W.partitionBy("file").orderBy("line", "name")) - 1, F.col("line"))
    x = x.withColumn("end_line", end)
    return x.join(s, (x["file"] == s["file"]) & (x["line"] <= s["b"]) & (x["end_line"] >= s["a"]), "left_semi")


_EDGES = _GO_TARGETS + f", edges AS (SELECT DISTINCT {DIR.format('i.file')} AS src, {DIR.format('p.target')} AS dst FROM imports i JOIN pkg p USING (path) WHERE i.lang = 'go')"


def _edges(spark, sf_dir):
    go = imports_of(spark, sf_dir).where("lang = 'go'")
    pkg = resolve.resolve_package(go, files_of(spark, sf_dir), ["path"]).where("target is not null")
    return go.join(pkg, "path").select(paths.dirname(F.col("file")).alias("src"), paths.dirname(F.col("target")).alias("dst")).distinct()


@query(_EDGES + "SELECT src, dst FROM edges")
def import_graph(spark, sf_dir):
    return _edges(spark, sf_dir)


@query("""
, tops AS (SELECT DISTINCT regexp_extract(file, '^([^/]+)/', 1) AS src, string_split(path, '.')[1] AS dst FROM imports WHERE lang = 'python' AND contains(file, '/')),
RECURSIVE_walk AS (
  WITH RECURSIVE walk AS (
    SELECT src AS first, [src] AS path, dst AS head FROM tops WHERE dst >= src
    UNION ALL SELECT w.first, list_append(w.path, w.head), t.dst FROM walk w JOIN tops t ON t.src = w.head WHERE w.head > w.first AND t.dst >= w.first AND (t.dst = w.first OR NOT list_contains(list_append(w.path, w.head), t.dst))
  ) SELECT * FROM walk WHERE head = first
), ranked AS (SELECT *, row_number() OVER (PARTITION BY first ORDER BY len(path), path) AS k FROM RECURSIVE_walk)
SELECT array_to_string(path, '->') AS key FROM ranked WHERE k <= 5""")
def cycles_canonical(spark, sf_dir):
    """Cycles of any length of top folders whose Python files import one another, five per least folder."""
    imp = imports_of(spark, sf_dir).where(F.col("lang") == "python").where(F.contains("file", F.lit("/")))
    tops = imp.select(F.regexp_extract("file", r"^([^/]+)/", 1).alias("src"), F.substring_index("path", ".", 1).alias("dst")).distinct()
    return graph.cycles(tops).select("key")


# rings of 2 to 8 nodes, a self loop, a figure of eight, a hub with six rings, and edges that lie on no cycle
RING_EDGES = (
    *((f"r{n}_{i}", f"r{n}_{(i + 1) % n}") for n in range(2, 9) for i in range(n)), ("loop", "loop"), ("e1", "e2"), ("e2", "e1"), ("e2", "e3"), ("e3", "e2"),
    *(x for i in range(6) for x in (("hub", f"hub{i}"), (f"hub{i}", "hub"))), ("tail1", "tail2"), ("tail2", "r2_0"),
)


@query(", told(key) AS (VALUES ('r2_0->r2_1'), ('r3_0->r3_1->r3_2'), ('r4_0->r4_1->r4_2->r4_3'), ('r5_0->r5_1->r5_2->r5_3->r5_4'), ('r6_0->r6_1->r6_2->r6_3->r6_4->r6_5'), ('r7_0->r7_1->r7_2->r7_3->r7_4->r7_5->r7_6'), ('r8_0->r8_1->r8_2->r8_3->r8_4->r8_5->r8_6->r8_7'), ('loop'), ('e1->e2'), ('e2->e3'), ('hub->hub0'), ('hub->hub1'), ('hub->hub2'), ('hub->hub3'), ('hub->hub4')) SELECT key FROM told")
def cycles_of_rings(spark, sf_dir):
    """Cycles of a drawn graph; the expected ones are written by hand."""
    return graph.cycles(spark.createDataFrame(list(RING_EDGES), "src string, dst string")).select("key")


_LANG = parsers.language_sql()


@query(f""", f AS (SELECT file, {_LANG} AS lang, {DIR.format('file')} AS d, regexp_replace(regexp_extract(file, '([^/]*)$', 1), '\\.[^.]*$', '') AS n, lower(regexp_extract(regexp_extract(file, '([^/]*)$', 1), '(\\.[^.]*)$', 1)) AS e FROM files),
src AS (SELECT * FROM f WHERE (lang = 'go' AND NOT ends_with(n, '_test')) OR (lang = 'python' AND NOT (ends_with(n, '_test') OR starts_with(n, 'test_') OR list_has_any(string_split(d, '/'), ['tests', 'test'])))),
c AS (SELECT file, unnest(CASE lang WHEN 'go' THEN [d || '/' || n || '_test.go'] ELSE [d || '/test_' || n || e, d || '/tests/test_' || n || e] END) AS t FROM src)
SELECT file FROM src WHERE file NOT IN (SELECT c.file FROM c JOIN files ON files.file = c.t)""")
def missing_test_file(spark, sf_dir):
    """Go and Python sources without a test at any conventional place."""
    f = files_of(spark, sf_dir).withColumn("lang", langs.language(F.col("file"))).where("lang in ('go', 'python')")
    src = f.where(~langs.is_test(F.col("file")))
    places = src.select("file", F.explode(langs.test_places(F.col("file"), F.col("lang"))).alias("place"))
    tested = places.join(f.select(F.col("file").alias("place")), "place", "left_semi").select("file").distinct()
    return src.join(tested, "file", "left_anti").select("file")


@query(f"SELECT {_LANG} AS lang, count(*) AS files FROM files GROUP BY 1")
def language_lookup(spark, sf_dir):
    return files_of(spark, sf_dir).groupBy(langs.language(F.col("file")).alias("lang")).agg(F.count("*").alias("files"))


# issues
_CUSTOM = Q._custom_sql()


def _issues(spark, sf_dir):
    return R.scan_custom(Q.lines_of(spark, sf_dir), Q.CUSTOM)


@query(f", i AS ({_CUSTOM}) SELECT file_id, count_if(severity = 'error') AS errors, count_if(severity = 'warning') AS warnings, count_if(severity = 'info') AS infos, count(*) AS total, bool_or(severity = 'error') AS blocks FROM i GROUP BY file_id")
def severity_counts(spark, sf_dir):
    return issues.counts(_issues(spark, sf_dir), "file_id")


@query(f", i AS ({_CUSTOM}) SELECT file_id, hunk_no, pos, id, CAST(row_number() OVER (ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 WHEN 'info' THEN 2 ELSE 3 END, file, line, id, message, file_id, hunk_no, pos) AS BIGINT) AS place FROM i")
def issue_sort(spark, sf_dir):
    """The place of every issue in the report's order."""
    found = _issues(spark, sf_dir).withColumn("r", issues.rank(F.col("severity")))
    return issues.numbered(found, ["r", "file", "line", "id", "message", "file_id", "hunk_no", "pos"]).select("file_id", "hunk_no", "pos", "id", "place")


@query(f""", i AS ({_CUSTOM}), c AS (SELECT file_id, count_if(severity = 'error') AS e, count_if(severity = 'warning') AS w, count_if(severity = 'info') AS n, count(*) AS t FROM i GROUP BY file_id),
a AS (SELECT f.file_id, coalesce(e, 0) AS e, coalesce(w, 0) AS w, coalesce(n, 0) AS n, coalesce(t, 0) AS t FROM file_diffs f LEFT JOIN c USING (file_id))
SELECT file_id, CASE WHEN t = 0 THEN 'No issues found in 1 files' ELSE 'Found ' || t || ' issues (' || array_to_string(list_filter([CASE WHEN e > 0 THEN e || ' errors' END, CASE WHEN w > 0 THEN w || ' warnings' END, CASE WHEN n > 0 THEN n || ' info' END], lambda x: x IS NOT NULL), ', ') || ') in 1 files' END AS summary FROM a""")
def summary_text(spark, sf_dir):
    c = issues.counts(_issues(spark, sf_dir), "file_id")
    zero = lambda n: F.coalesce(F.col(n), F.lit(0))
    rows = table(spark, sf_dir, "file_diffs").select("file_id").join(c, "file_id", "left")
    return rows.select("file_id", issues.summary_text(zero("errors"), zero("warnings"), zero("infos"), zero("total"), F.lit(1)).alias("summary"))


_MARK = "keep the"
_MARKS = rf""", marks AS (SELECT file, line, unnest(CASE WHEN len(w) = 0 THEN ['*'] ELSE w END) AS category FROM (SELECT file, new_num AS line, list_filter(regexp_split_to_array(trim(regexp_replace(substr(content, strpos(content, '{_MARK}') + {len(_MARK)}), '(^|[ \t,])(\*/|//)([ \t,].*)?$', '')), '[ \t,]+'), lambda x: x <> '') AS w FROM every_line WHERE contains(content, '{_MARK}')))"""


@query(_MARKS + rf""", i AS (SELECT file_id, file, new_num AS line, 'Closed' AS category FROM lines WHERE contains(content, 'console'))
SELECT file_id, file, line FROM i WHERE NOT EXISTS (SELECT 1 FROM marks m WHERE m.file = i.file AND i.line > 0 AND m.line IN (i.line, i.line - 1) AND (m.category = '*' OR lower(m.category) = 'closed'))""")
def suppression_anti(spark, sf_dir):
    """Issues that the words behind a marker, on the line or the one above, don't name. The marker is a parameter."""
    lines = Q.lines_of(spark, sf_dir)
    marks = issues.directives(lines.select("file", F.col("new_num").alias("line"), "content"), _MARK)
    found = L.added(L.analyzable(lines)).where(F.contains("content", F.lit("console"))).select("file_id", "file", F.col("new_num").alias("line"), F.lit("Closed").alias("category"))
    return issues.unsuppressed(found, marks).select("file_id", "file", "line")


_BASELINE = f", i AS ({_CUSTOM}), base AS (SELECT DISTINCT ' Custom' AS category, file, substr(message, 1, 7) AS message FROM i WHERE hunk_no = 0 AND severity = 'warning')"


@query(_BASELINE + " SELECT file_id, hunk_no, pos, id FROM i WHERE NOT EXISTS (SELECT 1 FROM base b WHERE lower(trim(b.category)) = i.category AND b.file = i.file AND (contains(i.message, b.message) OR contains(b.message, i.message)))")
def baseline_fuzzy_anti(spark, sf_dir):
    found = _issues(spark, sf_dir)
    base = found.where("hunk_no = 0 and severity = 'warning'").select(F.lit(" Custom").alias("category"), "file", F.substring("message", 1, 7).alias("message"))
    return issues.not_in_baseline(found, base).select("file_id", "hunk_no", "pos", "id")


def _small_tables(spark):
    cwe = spark.createDataFrame(list(packs.ISSUE_CWE.items()), "id string, cwe string")
    listed = spark.createDataFrame([(p, c) for p, cs in packs.COMPLIANCE_PACKS.items() for c in cs], "pack string, cwe string")
    return cwe, listed


_VALUES = "(VALUES {}) AS t"
_CWE_SQL = ", cwe_of(id, cwe) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in packs.ISSUE_CWE.items()) + "), packs(pack, cwe) AS (VALUES " + ", ".join(f"('{p}', '{c}')" for p, cs in packs.COMPLIANCE_PACKS.items() for c in cs) + ")"
_FOUND = ", found AS (" + "\nUNION ALL\n".join(R.group_sql(g) for g in packs.SECURITY) + " UNION ALL SELECT -1, 0, 0, '', 0, '', id, '', '', '' FROM (VALUES ('security/sql-injection'), ('security/sql-injection'), ('security/insecure-crypto'), ('security/insecure-crypto'), ('security/xss')) t(id)), n AS (SELECT replace(id, '/', '-') AS id, count(*) AS n FROM found GROUP BY 1), v AS (SELECT pack, cwe, id, n FROM n JOIN cwe_of USING (id) JOIN packs USING (cwe))"


def _normalised(spark, sf_dir):
    """Issues of the general security rules in the table and in drawn files, with the weakness table's spelling of ids."""
    lines = Q.lines_of(spark, sf_dir).unionByName(L.diff_lines(cases.drawn(spark, cases.SECURITY[0])))
    return R.scan(lines, packs.SECURITY).withColumn("id", issues.slashed(F.col("id")))


@query(_CWE_SQL + _FOUND + " SELECT pack, cwe, id, n FROM v")
def compliance_agg(spark, sf_dir):
    return issues.violations(_normalised(spark, sf_dir), *_small_tables(spark))


@query(_CWE_SQL + _FOUND + " SELECT t.pack, t.total, coalesce(b.violated, 0) AS violated, coalesce(b.violated, 0) = 0 AS compliant FROM (SELECT pack, count(*) AS total FROM packs GROUP BY 1) t LEFT JOIN (SELECT pack, count(DISTINCT cwe) AS violated FROM v GROUP BY 1) b USING (pack)")
def compliance_result(spark, sf_dir):
    return issues.compliance(_normalised(spark, sf_dir), *_small_tables(spark))


@query(""", a AS (SELECT DISTINCT name FROM symbols WHERE length(name) > 4), b AS (SELECT DISTINCT unnest(names) AS word FROM imports) SELECT a.name, b.word FROM a, b WHERE contains(a.name, b.word) OR contains(b.word, a.name)""")
def substring_match(spark, sf_dir):
    """Defined and imported names of which one contains the other, by equality of q-grams."""
    lines = Q.lines_of(spark, sf_dir)
    a = parsers.symbols(lines).where("length(name) > 4").select("name").distinct()
    b = parsers.imports(lines).select(F.explode("names").alias("word")).distinct()
    return resolve.substring_pairs(a, b, "name", "word")
