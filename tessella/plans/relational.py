"""Analyzers that relate files to one another: imports, consistency, references, tests, docs, dependencies, dead code.

Each takes a Context and gives issues (file_id, file, line, id, severity, category, message). The tree is what the
context holds of the repository (``extra["tree"]``: lines like those of a diff); without one it is the diff itself.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import lang as langs
from tessella.functions import paths
from tessella.operators import graph, resolve
from tessella.operators import lines as L
from tessella.sources import parsers, specs


def tree_of(ctx) -> DataFrame:
    return ctx.extra.get("tree", ctx.lines)


def imports_of(ctx) -> DataFrame:
    return ctx.once("imports", lambda: parsers.imports(tree_of(ctx)))


def symbols_of(ctx) -> DataFrame:
    return ctx.once("symbols", lambda: parsers.symbols(tree_of(ctx)))


def files_of(ctx) -> DataFrame:
    gone = ctx.files.where("status = 'deleted'").select(paths.unix(F.col("path")).alias("file"))
    here = tree_of(ctx).select("file").union(ctx.files.where("status <> 'deleted'").select(paths.unix(F.col("path")).alias("file"))).distinct()
    return here.join(gone, "file", "left_anti")


def issue(df: DataFrame, rule: str, severity: str, category: str, message: Column, line: Column | None = None, file_id: Column | None = None, place: tuple = ()) -> DataFrame:
    """Issues of all rows; ``place``: what the rule's id goes on with (columns), as the id of an issue names where it stands."""
    ident = F.concat_ws("-", F.lit(rule), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in place)) if place else F.lit(rule)
    return df.select(
        (F.lit(None).cast("long") if file_id is None else file_id).alias("file_id"), "file", (F.lit(0) if line is None else line).cast("int").alias("line"), ident.alias("id"),
        F.lit(severity).alias("severity"), F.lit(category).alias("category"), message.alias("message"),
    )


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _linked(imp: DataFrame, files: DataFrame, by: list[str]) -> DataFrame:
    """``by`` (with lang, file and path) and ``target`` of every relative import of scripts, Python and Ruby; null where none of ``files`` is meant."""
    known = files.select("file").union(files.where("file not like '%/%'").select(F.concat(F.lit("./"), "file")))  # the top folder as a package
    f, p = F.col("file"), F.col("path")
    scripts = resolve.resolve(imp.where((F.col("lang") == "typescript") & resolve.is_relative(p)), known, resolve.script_base(f, p), resolve.SCRIPT_TAILS, by)
    python = resolve.resolve(imp.where((F.col("lang") == "python") & p.startswith(".")), known, resolve.python_base(f, p), resolve.PYTHON_TAILS, by)
    ruby = resolve.resolve(imp.where((F.col("lang") == "ruby") & resolve.is_relative(p)), known, resolve.script_base(f, p), ["", ".rb"], by)
    return scripts.unionByName(python).unionByName(ruby).withColumn("target", F.regexp_replace("target", r"^\./", ""))


def imports(ctx) -> DataFrame:
    """Imports of deleted or unknown files and names that their target doesn't export (any more).

    Python's relative imports are judged more mildly: an unknown module is none of the diff's, and a name may be bound in
    ways that line patterns don't see. A name may be a module of the package as well. Go's imports name no files or names.
    """
    keys = ["file_id", "lang", "file", "path", "line"]
    imp = parsers.imports(ctx.lines)
    files = files_of(ctx)
    found = ctx.once("linked", lambda: _linked(imp, files, keys))
    lost = found.where("target is null").drop("target")
    gone = ctx.files.where("status = 'deleted'").select(paths.unix(F.col("path")).alias("file"))
    deleted = _linked(lost, gone, keys)
    exports = symbols_of(ctx).where("exported").select("file", "name")
    used = found.where("target is not null").join(imp.select(*keys, "names"), keys)
    submodules = files.where("file like '%.py'").select(F.regexp_replace("file", r"(/__init__)?\.py$", "").alias("m"))
    modules = submodules.where("m like '%/%'").select(F.concat(paths.dirname(F.col("m")), F.lit("/__init__.py")).alias("target"), F.regexp_extract("m", r"([^/]*)$", 1).alias("name"))
    modules = modules.unionByName(submodules.where("m not like '%/%'").select(F.lit("__init__.py").alias("target"), F.col("m").alias("name")))
    names = resolve.missing_exports(used, exports, keys).join(modules, ["target", "name"], "left_anti")
    removed = parsers.symbols(ctx.lines, "type = 'removed'").where("exported").select(F.col("file").alias("target"), "name").join(exports.withColumnRenamed("file", "target"), ["target", "name"], "left_anti").distinct()
    once_there = used.select(*keys, "target", F.explode("names").alias("name")).join(removed, ["target", "name"], "left_semi").join(names, [*keys, "name"], "left_anti")
    p, n, i, at = _quoted(F.col("path")), _quoted(F.col("name")), F.col("file_id"), ("file", "line")
    text = lambda script, python: F.when(F.col("lang") == "python", python).otherwise(script)
    is_script = F.col("lang") == "typescript"
    return _union([
        issue(deleted.where("target is not null"), "import-deleted", "error", "imports", text(F.concat(F.lit("Import "), p, F.lit(" points to a deleted file")), F.concat(F.lit("Import from "), p, F.lit(" points to a deleted module"))), F.col("line"), i, at),
        issue(deleted.where(is_script & F.col("target").isNull()), "import-broken", "error", "imports", F.concat(F.lit("Import "), p, F.lit(" could not be resolved to any known file")), F.col("line"), i, at),
        issue(names.where(is_script), "import-name", "error", "imports", F.concat(F.lit("Name "), n, F.lit(" is not exported from "), p), F.col("line"), i, (*at, "name")),
        issue(names.where(~is_script), "import-name", "warning", "imports", F.concat(F.lit("Name "), n, F.lit(" may not be exported from "), p), F.col("line"), i, (*at, "name")),
        issue(once_there, "export-removed", "warning", "imports", F.concat(F.lit("Import "), n, F.lit(" was removed from "), _quoted(F.col("target")), F.lit(" but is still imported here")), F.col("line"), i, ("target", "file", "name")),
    ])


def _changed_signatures(ctx) -> DataFrame:
    every = parsers.symbols(ctx.lines, "true").where("kind in ('function', 'method')")
    side = lambda t, n: every.where(F.col("type") == t).select("file_id", "file", "hunk_no", "name", F.col("signature").alias(n)).distinct()
    return side("removed", "before").join(side("added", "after").drop("file"), ["file_id", "hunk_no", "name"]).where("before <> after")


def _touched(ctx) -> DataFrame:
    return ctx.files.select(paths.unix(F.col("path")).alias("file"), F.lit(True).alias("touched")).distinct()


def consistency(ctx) -> DataFrame:
    """Users of a function whose signature changed, of a type that was rewritten, and methods of an interface that gained some.

    Importers use what they import by name; the files of a Go package use what their words name. Files that the diff
    touches as well are only informed about signatures, and left alone otherwise.
    """
    touched = _touched(ctx)
    moved = _changed_signatures(ctx).select(F.col("file").alias("defined"), "name").distinct()
    users = lambda of: imports_of(ctx).select("file", F.explode("names").alias("name"), "line").join(of, "name").where("file <> defined")
    go = tree_of(ctx).where("ext = '.go' and type <> 'removed' and content is not null").select("file", F.explode(F.regexp_extract_all("content", F.lit(r"[A-Za-z_]\w*"), F.lit(0))).alias("name"))
    words = go.join(moved.where("defined like '%.go'").select("name").distinct(), "name", "left_semi").distinct()
    near = words.join(moved.where("defined like '%.go'"), "name").where((F.col("file") != F.col("defined")) & (paths.dirname(F.col("file")) == paths.dirname(F.col("defined")))).select("name", "file", F.lit(0).alias("line"), "defined")
    both = users(moved).unionByName(near).join(touched, "file", "left")
    n, d, at = _quoted(F.col("name")), F.col("defined"), ("defined", "file", "name")
    text = F.concat(F.lit("Function "), n, F.lit(" signature changed in "), d)
    types = parsers.symbols(ctx.lines, "type <> 'context'").where("exported and kind in ('type', 'interface', 'struct', 'class', 'enum')").select(F.col("file").alias("defined"), "name").distinct()
    stale = users(types).join(touched, "file", "left_anti")
    gained = _interface_methods(ctx)
    methods = parsers.symbols(tree_of(ctx)).where("lang = 'go' and signature like 'func (%'").join(touched, "file", "left_anti").join(gained, "name")
    return _union([
        issue(both.where("touched is null"), "sig-change", "warning", "consistency", F.concat(text, F.lit(" but this file was not updated")), F.col("line"), place=at),
        issue(both.where("touched"), "sig-change-partial", "info", "consistency", F.concat(text, F.lit("; verify call sites in this file are updated")), F.col("line"), place=at),
        issue(stale, "type-change", "warning", "consistency", F.concat(F.lit("Type "), n, F.lit(" was modified in "), d, F.lit(" but this file using it was not updated")), place=at),
        issue(methods, "iface-gap", "warning", "consistency", F.concat(F.lit("Interface "), _quoted(F.col("interface")), F.lit(" method "), n, F.lit(" was changed but this implementation was not updated")), F.col("line"), place=("interface", "file", "name")),
    ])


def _interface_methods(ctx) -> DataFrame:
    """(interface, name): methods that added lines give to an exported Go interface whose header its hunk shows."""
    rows = ctx.lines.where("ext = '.go' and type <> 'removed' and content is not null").withColumn("interface", F.regexp_extract("content", r"^type\s+([A-Z]\w*)\s+interface\s*\{", 1))
    inside = L.regions(rows.withColumn("header", F.col("interface") != ""), F.col("header") | F.col("content").rlike(r"^\}"))
    heads = rows.where("interface <> ''").select("file_id", "hunk_no", F.col("pos").alias("region"), "interface")
    method = F.regexp_extract("content", r"^\s+([A-Z]\w*)\s*\(", 1)
    return inside.where("type = 'added'").select("file_id", "hunk_no", "region", method.alias("name")).where("name <> ''").join(heads, ["file_id", "hunk_no", "region"]).select("interface", "name").distinct()


def references(ctx) -> DataFrame:
    """Imports that still lead to deleted or renamed files, and imports of symbols that a file doesn't define any more."""
    out = []
    for status, column, severity, rule, says in (("deleted", "path", "error", "ref-deleted", " references deleted file "), ("renamed", "old_path", "warning", "ref-renamed", " references old path ")):
        away = ctx.files.where((F.col("status") == status) & (F.coalesce(column, F.lit("")) != "")).select(paths.unix(F.col(column)).alias("file"), paths.unix(F.col("path")).alias("now"))
        hit = _linked(imports_of(ctx), away.select("file"), ["lang", "file", "path", "line"]).where("target is not null")
        text = F.concat(F.lit("Import "), _quoted(F.col("path")), F.lit(says), _quoted(F.col("target")))
        if status == "renamed":
            hit = hit.join(away.select(F.col("file").alias("target"), "now").distinct(), "target")
            text = F.concat(text, F.lit(" which was renamed to "), _quoted(F.col("now")))
        out.append(issue(hit, rule, severity, "references", text, F.col("line"), place=("file", "line", "target")))
    lost = parsers.symbols(ctx.lines, "type = 'removed'").select(F.col("file").alias("defined"), "name").distinct()
    lost = lost.join(symbols_of(ctx).select(F.col("file").alias("defined"), "name"), ["defined", "name"], "left_anti")
    users = imports_of(ctx).select("file", "line", F.explode("names").alias("name")).join(lost, "name").where("file <> defined")
    text = lambda says: F.concat(F.lit("Symbol "), _quoted(F.col("name")), F.lit(" was removed from "), _quoted(F.col("defined")), F.lit(says))
    out.append(issue(users, "ref-symbol-deleted", "warning", "references", text(" but is still imported here"), F.col("line"), place=("defined", "file", "name")))
    words = tree_of(ctx).where("type <> 'removed' and content is not null").select("file", "new_num", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"[A-Za-z_]\w*"), F.lit(0)))).alias("name"))
    used = words.join(lost.select("name").distinct(), "name", "left_semi").groupBy("file", "name").agg(F.min("new_num").alias("line"))  # a word counts once per file
    here = used.join(lost, "name").where((F.col("file") != F.col("defined")) & (paths.dirname(F.col("file")) == paths.dirname(F.col("defined"))) & (paths.extension(F.col("file")) == paths.extension(F.col("defined"))))
    here = here.join(users.select("file", "name").distinct(), ["file", "name"], "left_anti")
    out.append(issue(here, "ref-symbol-usage", "warning", "references", text(" but may still be used in this file"), F.col("line"), place=("defined", "file", "name")))
    return _union(out)


def tests(ctx) -> DataFrame:
    f = ctx.files.where("status in ('added', 'modified')").select("file_id", "status", paths.unix(F.col("path")).alias("file")).withColumn("lang", langs.language(F.col("file")))
    known = files_of(ctx).select(F.col("file").alias("place"))
    src = f.where(F.col("lang").isNotNull() & ~langs.is_test(F.col("file")) & ~paths.has_part(F.col("file"), langs.SKIPPED_DIRS))
    places = src.select("file_id", "file", F.explode(langs.test_places(F.col("file"), F.col("lang"))).alias("place"))
    tested = places.join(known, "place", "left_semi").select("file_id").distinct()
    src = src.where(~F.col("file").rlike(r"cmd/.*?(^|/)main\.go$|migration|^scripts/"))  # entry points, migrations and scripts need no tests
    bare = src.join(places.select("file_id").distinct(), "file_id", "left_semi").join(tested, "file_id", "left_anti")
    only = f.where(langs.is_test(F.col("file")) & (F.col("status") == "modified"))
    sources = places.join(f.select(F.col("file").alias("place")), "place", "left_semi").select("place").distinct()
    alone = only.join(sources, only["file"] == sources["place"], "left_anti")
    i = F.col("file_id")
    return _union([
        issue(bare.where("status = 'added'"), "tests/new-file-no-test", "warning", "tests", F.lit("New source file has no corresponding test file"), None, i),
        issue(bare.where("status = 'modified'"), "tests/changed-no-test", "warning", "tests", F.lit("Changed source file has no corresponding test file"), None, i),
        issue(alone, "tests/test-only-change", "info", "tests", F.lit("Test file modified without corresponding source change"), None, i),
    ])


def docdrift(ctx) -> DataFrame:
    """Signatures that changed under a doc comment that didn't: stale as a whole, in its parameters, return type or examples."""
    comment = (F.col("type") == "context") & F.coalesce(F.col("content").rlike(r"^\s*(//|#|\*|/\*)"), F.lit(False))
    own = ctx.lines.where(~F.col("file").rlike("vendor/|node_modules/"))
    blocks = L.islands(own, comment).where("island is not null").groupBy("file_id", "hunk_no", "island").agg(
        (F.max("pos") + 1).alias("pos"), F.min("new_num").alias("line"), F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"])).alias("doc")
    )
    every = parsers.symbols(own, "true", place=True).where("kind in ('function', 'method')")
    names = F.filter(F.transform(F.split(F.regexp_extract("signature", r"\w\s*\(([^()]*)\)", 1), ","), lambda x: F.regexp_extract(F.trim(x), r"^[*&.]*(?:final )?([A-Za-z_]\w*)", 1)), lambda x: x != "")
    gives = F.trim(F.regexp_extract("signature", r"\)\s*(?:->|:)?\s*([^(){}:;]*?)\s*[{:;]?\s*$", 1))
    side = lambda t, k: every.where(F.col("type") == t).select("file_id", "file", "hunk_no", "name", *(x.alias(k + y) for x, y in ((F.col("pos"), "pos"), (F.col("line"), "line"), (F.col("signature"), "text"), (names, "params"), (gives, "gives"))))
    pair = side("removed", "old_").join(side("added", "new_").drop("file"), ["file_id", "hunk_no", "name"]).where("old_text <> new_text")
    pair = pair.join(blocks, (pair["file_id"] == blocks["file_id"]) & (pair["hunk_no"] == blocks["hunk_no"]) & blocks["pos"].isin(pair["old_pos"], pair["new_pos"])).select(pair["*"], blocks["line"], blocks["doc"]).withColumn("at", F.col("new_line"))
    words = F.regexp_extract_all("doc", F.lit(r"\w+"), F.lit(0))
    pair = pair.withColumn("stale", F.array_intersect(F.array_except("old_params", "new_params"), words))
    calls = F.exists(F.regexp_extract_all("doc", F.lit(r"([A-Za-z_]\w*)\s*\("), F.lit(1)), lambda x: x == F.col("name"))
    i, n, at = F.col("file_id"), F.col("name"), ("file", "name", "at")
    shown = F.array_join(F.transform("stale", _quoted), ", ")
    return _union([
        issue(pair.where(F.size("stale") > 0), "docdrift-param-mismatch", "warning", "docdrift", F.concat(F.lit("Documentation for "), n, F.lit(" references parameters "), shown, F.lit(" that no longer exist in the function signature")), F.col("line"), i, at),
        issue(pair.where("old_gives <> '' and new_gives <> '' and old_gives <> new_gives"), "docdrift-return-type", "info", "docdrift", F.concat(F.lit("Return type of "), n, F.lit(" changed from "), F.col("old_gives"), F.lit(" to "), F.col("new_gives"), F.lit(" but documentation was not updated")), F.col("line"), i, at),
        issue(pair.where((F.size("old_params") != F.size("new_params")) & calls), "docdrift-stale-example", "info", "docdrift", F.concat(F.lit("Documentation for "), n, F.lit(" contains code examples that may reference outdated parameter patterns")), F.col("line"), i, at),
        issue(pair, "docdrift-stale-doc", "warning", "docdrift", F.concat(F.lit("Function "), n, F.lit(" signature changed but documentation was not updated")), F.col("line"), i, at),
    ])


def deadcode(ctx) -> DataFrame:
    """Exports of changed files that nothing in the tree imports; entry points, tests and private names are left alone."""
    ex = parsers.symbols(L.added(ctx.lines)).where("exported and lang in ('typescript', 'python') and name not like '\\\\_%' and name <> 'main'")
    entry = F.col("file").rlike(r"vendor/|node_modules/|_test\.go$|(^|/)(main|cmd)/[^/]*\.go$|(^|/)index\.(ts|tsx|js|jsx|mjs|cjs)$|(^|/)_[^/]*\.py$")
    ex = ex.where(~entry & ~langs.is_test(F.col("file")))
    used = imports_of(ctx).select("lang", F.explode("names").alias("name")).distinct()
    return issue(ex.join(used, ["lang", "name"], "left_anti"), "deadcode", "warning", "deadcode", F.concat(F.lit("Exported symbol '"), F.col("name"), F.lit("' appears unused in the codebase")), F.col("line"), F.col("file_id"), ("file", "name", "line"))


# fixed values: first parts of Go's own packages, and folders whose imports are nobody's
GO_OWN = "archive bufio builtin bytes C cmp compress container context crypto database debug embed encoding errors expvar flag fmt go hash html image index io iter log maps math mime net os path plugin reflect regexp runtime slices sort strconv strings structs sync syscall testing text time unicode unique unsafe weak".split()
OUTSIDE = ["vendor", "node_modules", "testdata"]


def _go_edges(ctx) -> DataFrame:
    """(src, dst, at) of Go's packages, which are folders: the one that the longest trailing run of an import names, or else
    one that ends with the whole import; ``at`` is the least file that imports it. Tests may import what imports them."""
    own = lambda df: df.where(F.col("file").endswith(".go") & ~F.col("file").endswith("_test.go") & ~paths.has_part(F.col("file"), OUTSIDE))
    imp = own(imports_of(ctx)).where(~F.substring_index("path", "/", 1).isin(*GO_OWN)).select("file", "path").distinct()
    folders = own(files_of(ctx)).select(paths.dirname(F.col("file")).alias("folder")).where("folder <> '.'").distinct()
    ends = imp.select("path", F.explode(paths.suffixes(F.col("path"))).alias("folder")).distinct().join(folders, "folder")
    wholes = folders.select("folder", F.explode(paths.suffixes(F.col("folder"))).alias("path")).join(imp.select("path").distinct(), "path").select("path", "folder")
    one = ends.unionByName(wholes).groupBy("path").agg(F.max_by("folder", F.struct(F.length("folder") <= F.length("path"), F.length("folder"), "folder")).alias("dst"))
    return imp.join(one, "path").select(paths.dirname(F.col("file")).alias("src"), "dst", "file").where("src <> dst").groupBy("src", "dst").agg(F.min("file").alias("at"))


def edges_of(ctx) -> DataFrame:
    """(src, dst, at): what imports what; files of scripts, Python and Ruby, folders of Go."""
    imp = imports_of(ctx).where(~paths.has_part(F.col("file"), OUTSIDE))
    linked = _linked(imp, files_of(ctx), ["lang", "file", "path"]).where("target is not null and not (lang = 'python' and file = target)")  # a package that imports its own modules
    return linked.select(F.col("file").alias("src"), F.col("target").alias("dst"), F.col("file").alias("at")).distinct().unionByName(_go_edges(ctx))


def depgraph(ctx) -> DataFrame:
    """Circular imports of any length (see graph.circles), and declared packages that nothing imports."""
    edges = ctx.once("edges", lambda: edges_of(ctx))
    circles = graph.circles(edges).withColumn("src", F.element_at("cycle", 1)).withColumn("dst", F.try_element_at("cycle", F.lit(2))).withColumn("dst", F.coalesce("dst", "src"))
    circles = circles.join(edges.withColumnRenamed("at", "file"), ["src", "dst"])
    out = [issue(circles, "depgraph/circular-dependency", "warning", "depgraph", F.concat(F.lit("Circular dependency detected: "), F.col("key")))]
    if "manifests" in ctx.extra:
        deps = specs.manifests(ctx.extra["manifests"]).where(~F.lower("file").endswith("go.sum"))  # which lists what others need as well
        parts = F.regexp_replace("path", r"\.|::", "/")  # modules below a package, and the spellings of package names
        spelled = imports_of(ctx).select(F.explode(F.array(F.col("path"), parts, F.translate(F.lower(parts), "_", "-"))).alias("path"))
        unused = resolve.unused(deps, spelled)
        out.append(issue(unused, "depgraph/unused-dependency", "info", "depgraph", F.concat(F.lit("Dependency appears unused: "), F.col("key"))))
    return _union(out)


def hallucination(ctx) -> DataFrame:
    """Imports of packages that neither the language, a manifest nor the tree knows (see phantoms)."""
    from tessella.plans.phantoms import phantom_imports

    own = files_of(ctx).select(F.regexp_extract("file", r"^([^/.]+)", 1).alias("key"))
    packages = None
    if "manifests" in ctx.extra:
        told = ctx.extra["manifests"]
        packages = specs.manifests(told).select(specs.manifest_languages(F.col("file")).alias("langs"), "key")
        module = told.where(F.lower("file").endswith("go.mod")).select(F.regexp_extract("content", r"(?m)^\s*module\s+(\S+)", 1).alias("key"))
        own = own.unionByName(module).where("key <> ''")
    found = phantom_imports(parsers.imports(L.added(ctx.lines)), packages, own)
    text = F.concat(F.lit("Import references unknown package: "), F.col("path"))
    relative = parsers.imports(L.added(ctx.lines)).where((F.col("lang") == "typescript") & resolve.is_relative(F.col("path")))
    nowhere = _linked(relative, files_of(ctx), ["file_id", "lang", "file", "path", "line"]).where("target is null")
    missing = issue(nowhere, "hallucination/missing-import-target", "error", "hallucination", F.concat(F.lit("Import target does not exist: "), F.col("path")), F.col("line"), F.col("file_id"))
    return missing.unionByName(found.select(
        "file_id", "file", "line", F.lit("hallucination/phantom-import").alias("id"), "severity", F.lit("hallucination").alias("category"), text.alias("message")
    ))


def spec(ctx) -> DataFrame:
    """Anchors without a requirement, requirements without an anchor, and changes within five lines of an anchor."""
    wanted = ctx.extra.get("requirements")
    if wanted is None:
        return issue(ctx.lines.limit(0), "spec", "info", "spec", F.lit(""))
    a = specs.anchors(tree_of(ctx).where("type <> 'removed'").select("file", F.col("new_num").alias("line"), "content"))
    without = a.join(wanted.select("req_id").distinct(), "req_id", "left_anti")
    bare = wanted.join(a.select("req_id").distinct(), "req_id", "left_anti").withColumn("file", F.lit(""))
    spans = ctx.files.select(paths.unix(F.col("path")).alias("s_file"), F.explode("hunks").alias("h")).select("s_file", F.col("h.new_start").alias("a"), (F.col("h.new_start") + F.col("h.new_count")).alias("b"))
    near = a.join(spans, (a["file"] == spans["s_file"]) & a["line"].between(spans["a"] - 5, spans["b"] + 5), "left_semi")
    r, at = F.col("req_id"), ("req_id", "file", "line")
    out = [
        issue(without, "spec-orphan", "error", "spec", F.concat(F.lit("Orphaned spec anchor: spec:"), r, F.lit(" has no matching requirement")), F.col("line"), place=at), issue(bare, "spec-unanchored", "warning", "spec", F.concat(F.lit("Requirement "), r, F.lit(" has no code anchor")), place=("req_id",)),
        issue(near, "spec-modified", "info", "spec", F.concat(F.lit("Code near spec anchor for "), r, F.lit(" was modified")), F.col("line"), place=at),
    ]
    if "targets" in wanted.columns:
        told = a.join(wanted.where(F.size("targets") > 0).select("req_id", "targets"), "req_id")
        inside = F.exists("targets", lambda t: F.col("file").startswith(F.rtrim(F.regexp_replace(t, r"[*/]+$", ""))))
        away = told.where(~inside)
        out.append(issue(away, "spec-target", "warning", "spec", F.concat(F.lit("Spec anchor for "), r, F.lit(" is outside its target paths ["), F.array_join("targets", " "), F.lit("]")), F.col("line"), place=at))
    return _union(out)


ANALYZERS = {"imports": imports, "consistency": consistency, "references": references, "tests": tests, "docdrift": docdrift, "deadcode": deadcode, "depgraph": depgraph, "hallucination": hallucination, "spec": spec}
