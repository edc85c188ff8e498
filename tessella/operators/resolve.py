"""Resolution of imports to files, and what is missing or unused around them.

Candidates of an import are generated as rows with a priority and meet the files by equality; suffixes of paths
are generated the same way instead of comparing every import with every folder.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import paths

# fixed values: what is tried behind a relative import of TypeScript or JavaScript, in this order
SCRIPT_TAILS = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.mjs", "/index.cjs"]
PYTHON_TAILS = ["", ".py", "/__init__.py"]


def is_relative(path: Column) -> Column:
    return path.rlike(r"^\.{1,2}(/|$)")


def script_base(file: Column, path: Column) -> Column:
    return paths.join(paths.dirname(file), path)


def python_base(file: Column, path: Column) -> Column:
    """A dotted relative module as a path: one dot is the own folder, each further dot a parent."""
    dots = F.length(F.regexp_extract(path, r"^(\.*)", 1))
    ups = F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0)))
    rest = F.replace(F.regexp_replace(path, r"^\.+", ""), F.lit("."), F.lit("/"))
    return paths.join(paths.dirname(file), F.concat(ups, rest))


def candidates(imports: DataFrame, base: Column, tails: list[str]) -> DataFrame:
    """Adds ``candidate`` and ``priority``, one row per tail."""
    each = F.posexplode(F.transform(F.array(*map(F.lit, tails)), lambda t: F.concat(F.col("__base"), t))).alias("priority", "candidate")
    return imports.withColumn("__base", base).select(*imports.columns, each)


def resolve(imports: DataFrame, files: DataFrame, base: Column, tails: list[str], by: list[str]) -> DataFrame:
    """``by`` columns of every import and ``target``: its first existing candidate among ``files`` (file), else null."""
    known = files.select(F.col("file").alias("candidate")).distinct()
    hits = candidates(imports, base, tails).join(known, "candidate").groupBy(*by).agg(F.min_by("candidate", "priority").alias("target"))
    return imports.select(*by).distinct().join(hits, by, "left")


def resolve_package(imports: DataFrame, files: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and ``target``: the least file of a folder that a trailing run of the import's parts names."""
    folders = files.select(paths.dirname(F.col("file")).alias("suffix"), "file").where("suffix <> '.'").groupBy("suffix").agg(F.min("file").alias("first_file"))
    each = imports.select(*by, F.explode(paths.suffixes(F.col("path"))).alias("suffix"))
    hits = each.join(folders, "suffix").groupBy(*by).agg(F.min("first_file").alias("target"))
    return imports.select(*by).distinct().join(hits, by, "left")


def missing_exports(resolved: DataFrame, exports: DataFrame, by: list[str]) -> DataFrame:
    """Imported names (by..., name) that their target doesn't export; default and * are never missing, and targets without any known export are left alone.

    ``resolved``: by..., target, names; ``exports``: file, name.
    """
    names = resolved.where("target is not null").select(*by, "target", F.explode("names").alias("name")).where("name not in ('default', '*')")
    told = names.join(exports.select(F.col("file").alias("target")).distinct(), "target", "left_semi")
    return told.join(exports.select(F.col("file").alias("target"), "name").distinct(), ["target", "name"], "left_anti")


def phantom(imports: DataFrame, known: DataFrame, key: Column, mode: str = "exact", separator: str = "/") -> DataFrame:
    """Imports whose key isn't among ``known`` (key): 'exact', 'top' (first part) or 'prefix' (any leading run of parts).

    Without any known key there is nothing to compare with, and no import is reported.
    """
    keyed = imports.withColumn("__key", key)
    wanted = known.select(F.col("key").alias("__known")).where("__known is not null").distinct()
    if wanted.isEmpty():
        return imports.limit(0)
    if mode == "prefix":
        keyed = keyed.withColumn("__id", F.monotonically_increasing_id())
        covered = keyed.select("__id", F.explode(paths.prefixes(F.col("__key"), separator)).alias("__known")).join(wanted, "__known", "left_semi").select("__id").distinct()
        return keyed.join(covered, "__id", "left_anti").select(*imports.columns)
    if mode == "top":
        keyed = keyed.withColumn("__key", F.substring_index("__key", separator, 1))
    return keyed.join(wanted, keyed["__key"] == wanted["__known"], "left_anti").select(*imports.columns)


def unused(dependencies: DataFrame, imports: DataFrame, separator: str = "/") -> DataFrame:
    """Dependencies (key) that no import path (path) equals or lies below."""
    used = imports.select(F.explode(paths.prefixes(F.col("path"), separator)).alias("key")).distinct()
    return dependencies.join(used, "key", "left_anti")


def substring_pairs(left: DataFrame, right: DataFrame, a: str, b: str, q: int = 3) -> DataFrame:
    """Pairs of rows where one text contains the other, found by equality of q-grams: the first q characters of the
    contained text must occur in the other. Texts shorter than q meet by their first character."""
    def gram(c: Column, n: int) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda k: F.substr(c, k, F.lit(n))))

    def one_way(small: DataFrame, s: str, large: DataFrame, t: str) -> DataFrame:
        parts = []
        for n, cond in ((q, F.length(s) >= q), (1, (F.length(s) < q) & (F.length(s) > 0))):
            heads = small.where(cond).withColumn("__g", F.substr(F.col(s), F.lit(1), F.lit(n)))
            bodies = large.withColumn("__g", F.explode(gram(F.col(t), n)))
            parts.append(heads.join(bodies, "__g").where(F.contains(F.col(t), F.col(s))).drop("__g"))
        return parts[0].unionByName(parts[1])

    return one_way(left, a, right, b).unionByName(one_way(right, b, left, a)).distinct()
