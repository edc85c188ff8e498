"""Files that nobody wrote by hand: generated, minified, vendored, data kept as code, binary.

Two sources of evidence are joined. Merkle hashes, built bottom-up over the directory tree of every delivery,
tell equal subtrees; a subtree of several files that lives in unrelated repositories is a copy from a third
party. A single file that unrelated owners hold alike is one only if its header says so as well: whoever delivers
a change twice holds it twice. Header and layout rules look at each file: its name, its comment lines, the density
of its lines and the share of lines that are plain data. A licence or copyright line alone proves nothing, for
own code has such lines too; it is the weak evidence that a shared file needs.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.lineage import durable

#: A shared subtree needs this many files, and owners of repositories that hold it: one file alone may be a plain redelivery.
MIN_FILES, MIN_OWNERS = 2, 3
#: A single shared file with a foreign header needs this many owners.
FILE_OWNERS = 2

# fixed values: names
VENDOR_DIRS = {"node_modules", "vendor", "third_party", "thirdparty", "third-party", "external", "externals", "bower_components", "jspm_packages", "pods", "carthage", "site-packages", "dist-packages", "vendored", "_vendor"}
LOCK_NAMES = {"package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "go.sum", "go.work.sum", "cargo.lock", "poetry.lock", "pipfile.lock", "composer.lock", "gemfile.lock", "podfile.lock", "pubspec.lock", "mix.lock", "flake.lock", "uv.lock", "bun.lockb", "packages.lock.json", "gradle.lockfile"}
GENERATED_NAME = re.compile(r"(?i)\.(?:pb\.(?:go|cc|h|dart)|pb\.gw\.go|g\.dart|freezed\.dart|designer\.(?:cs|vb)|gen\.\w+|generated\.\w+|g\.cs|snap|map)$|_pb2(?:_grpc)?\.pyi?$|_pb\.(?:js|d\.ts)$|(?:^|/)mock_[^/]*\.go$|(?:^|/)__snapshots__/|(?:^|/)zz_generated")
MINIFIED_NAME = re.compile(r"(?i)[.\-](?:min|bundle)\.(?:js|mjs|cjs|css)$")
BINARY_EXT = {"png", "jpg", "jpeg", "gif", "ico", "bmp", "webp", "pdf", "zip", "gz", "tgz", "jar", "war", "class", "so", "dll", "dylib", "exe", "bin", "wasm", "woff", "woff2", "ttf", "otf", "eot", "mp3", "mp4", "o", "a", "pyc", "db", "sqlite", "7z", "tar"}
#: configuration, documents, keys and certificates are nobody's source, but no cases either
EXEMPT_EXT = {"md", "rst", "txt", "adoc", "pem", "crt", "cer", "key", "pub", "csr", "env", "ini", "toml", "cfg", "conf", "properties", "xml", "yaml", "yml", "npmrc", "netrc", "pgpass", "asc", "p12"}
EXEMPT_NAMES = re.compile(r"(?i)^(?:\.env(?:\..*)?|\.?npmrc|\.netrc|\.pgpass|id_\w+|readme.*|license.*|config\.json|package\.json|tsconfig.*\.json)$")

# fixed values: comments that generators leave, in English, German, French and Spanish
GENERATED_TEXT = re.compile(
    r"(?i)code generated .{0,80}do not edit|\bauto-?generated\b|<auto-generated|@generated\b|\bmachine[- ]generated\b"
    r"|generated (?:automatically )?(?:by|from|with|using)\b.{0,120}(?:do not|don't|never|changes|by hand)|(?:created|produced|written) automatically (?:by|from)\b"
    r"|\bdo not (?:edit|modify)\b.{0,60}(?:generated|overwritten|by hand|manually)|automatisch (?:erzeugt|generiert|erstellt)|nicht von hand (?:bearbeiten|ändern)"
    r"|g[ée]n[ée]r[ée] automatiquement|ne pas modifier (?:à la main|manuellement)|generado autom[aá]ticamente|no (?:editar|modificar) (?:a mano|manualmente)"
)
NOT_GENERATED = re.compile(r"(?i)\bnot (?:auto-?)?generated\b|\bisn't generated\b|edit freely|output of this|this generator")
THIRD_PARTY_TEXT = re.compile(
    r"(?i)\bimported from [\w.\-/]+@v?\d|\bvendored from\b|\bcopied (?:verbatim )?from (?:https?://|git)|single file distribution"
    r"|^\W*upstream:\s|^\W*[A-Z][\w\-]+ (?:toolkit|library|framework|js)? ?v?\d+\.\d+\.\d+\s*(?:--|—|$)"
)
# fixed values: licence and copyright lines, which own code has as well
LICENCE_TEXT = re.compile(
    r"(?i)is distributed under the terms of the|^\W*spdx-license-identifier:|\(c\) .{1,60} project authors|copyright (?:\(c\) )?(?:the )?[\w\- ]{1,60} (?:contributors|authors)\b"
    r"|^\W*released under the [\w\-. ]{2,30} licen[cs]e"
)
OWN_TEXT = re.compile(r"(?i)\bour own\b|internal use|all rights reserved by us")

_COMMENT = re.compile(r"^\s*(?://|#(?!!)|/\*|\*|--|;|<!--|\"\"\"|'''|%|rem\b)", re.I)
_SOURCE_MAP = re.compile(r"^\s*(?://|/\*)[#@]\s*source(?:Mapping)?URL=")
_NUMBERS = re.compile(r"^\s*[\[\]{(]?\s*(?:[+\-]?(?:0x[0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][+\-]?\d+)?)[fFLuU]?\s*,\s*){3,}[+\-]?(?:0x[0-9a-fA-F]+|\d*\.?\d*)[fFLuU]?\s*[\]})]*[,;]?\s*$")
_BLOB = re.compile(r"^\s*(?:[\"'][A-Za-z0-9+/=\\]{32,}[\"']|(?:\\x[0-9a-fA-F]{2}){8,}|[\"'](?:\\x[0-9a-fA-F]{2}){8,}[\"'])\s*[+,;)]*\s*$")
_RECORD = re.compile(r"^\s*(?:\{(?:\s*\"[\w$]+\"\s*:\s*(?:\"[^\"]*\"|-?[\d.eE+\-]+|true|false|null)\s*,?)+\}|\[(?:\s*(?:\"[^\"]*\"|-?[\d.eE+\-]+|null)\s*,?)+\])\s*,?\s*$|^\s*INSERT INTO \S+(?: \([^)]*\))? VALUES\b", re.I)
_DATA_HEAD = re.compile(r"^\s*(?:(?:export\s+|static\s+|public\s+|private\s+|final\s+)*(?:const|let|var|val|unsigned char|float|double|int|uint8_t)[\w\s\[\]*:.<>]*|[A-Z][A-Z0-9_]*|\w+)\s*(?::[\w\[\]<> ]+)?=\s*(?:\[\]\w+|new \w+\[\]\s*)?[\[{(]\s*$")
_CLOSER = re.compile(r"^\s*[\[\]{}()]*[,;]?\s*$")
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\ufffd]")


def _dense(line: str) -> bool:
    """A line of code without layout: long, hardly any blanks, full of code punctuation."""
    n = len(line)
    if n < 160:
        return False
    blanks = line.count(" ") + line.count("\t")
    marks = sum(line.count(c) for c in "{}();=:")
    return blanks / n < 0.12 and marks / n > 0.06


def readable(lines: list[str]) -> bool:
    text = "".join(lines)
    if not text.strip() or re.match(r"^(?:Binary files .* differ|GIT binary patch)", text.strip()):
        return False
    strange = len(_CONTROL.findall(text)) + sum(c in "\u0080\u00ff" for c in text)
    return strange / len(text) < 0.05


def judge(path: str | None, is_binary: bool | None, lines: list[str | None]) -> str | None:
    """What kind of file nobody wrote this is, or None for source, configuration and documents."""
    return verdict(path, is_binary, lines)[0]


def verdict(path: str | None, is_binary: bool | None, lines: list[str | None]) -> tuple[str | None, str]:
    """(kind or None, evidence): evidence is 'name', 'header', 'layout' or 'bytes'; 'licence' without a kind is weak evidence."""
    name = re.sub(r"^(?:\./)+", "", (path or "").replace("\\", "/")).strip("/")
    parts = name.split("/")
    base = parts[-1].lower()
    ext = base.rpartition(".")[2] if "." in base else ""
    texts = [x for x in lines if x]
    if not readable(texts):
        if is_binary or texts or ext in BINARY_EXT:
            return ("binary", "bytes") if is_binary or "".join(texts).strip() or ext in BINARY_EXT else (None, "")
        return None, ""
    if base in LOCK_NAMES or base.endswith((".lock", ".lockfile")) or GENERATED_NAME.search(name):
        return "generated", "name"
    if any(p.lower() in VENDOR_DIRS for p in parts[:-1]):
        return "third party", "name"
    if MINIFIED_NAME.search(name):
        return "minified", "name"
    for text in texts:
        if _COMMENT.match(text) and GENERATED_TEXT.search(text) and not NOT_GENERATED.search(text):
            return "generated", "header"
    exempt = ext in EXEMPT_EXT or EXEMPT_NAMES.match(base) is not None or any("-----BEGIN" in t for t in texts) and ext not in ("js", "css", "ts")
    licence = ""
    for text in texts:
        if _COMMENT.match(text) and not OWN_TEXT.search(text):
            if THIRD_PARTY_TEXT.search(text):
                return "third party", "header"
            if not licence and LICENCE_TEXT.search(text):
                licence = "licence"
    if exempt:
        return None, ""
    filled = [t for t in texts if t.strip()]
    total = sum(map(len, filled))
    if filled and (any(_SOURCE_MAP.match(t) for t in filled) or sum(len(t) for t in filled if _dense(t)) >= 0.6 * total):
        return "minified", "layout"
    data = sum(bool(_NUMBERS.match(t) or _BLOB.match(t) or _RECORD.match(t)) for t in filled)
    frame = sum(bool(_DATA_HEAD.match(t) or _CLOSER.match(t)) for t in filled)
    if data >= 3 and data >= 0.6 * max(1, len(filled) - min(frame, data)):
        return "data", "layout"
    return None, licence


def rule_verdicts(files: DataFrame) -> DataFrame:
    """(file_id, kind, evidence) by the header and layout rules alone; files with weak evidence only have a null kind."""
    texts = files.select("file_id", "path", "is_binary", F.flatten(F.coalesce(F.transform("hunks", lambda h: F.coalesce(F.transform(h["lines"], lambda x: x["content"]), F.array().cast("array<string>"))), F.array().cast("array<array<string>>"))).alias("texts")).where("file_id is not null")

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            told = [verdict(p, None if b is None or b != b else bool(b), list(t) if t is not None else []) for p, b, t in zip(frame["path"], frame["is_binary"], frame["texts"])]
            hit = [why != "" for _, why in told]
            if any(hit):
                yield pd.DataFrame({"file_id": frame["file_id"][hit], "kind": [k for k, why in told if why], "evidence": [why for _, why in told if why]})

    return texts.mapInPandas(look, "file_id bigint, kind string, evidence string")


def shown_files(files: DataFrame) -> DataFrame:
    """(file_id, run_id, dirs, name, a, b): each file's place and two hashes of its new side; files without text are left out."""
    clean = F.regexp_replace(F.regexp_replace("path", r"\\", "/"), r"^(\./|/)+", "")
    text = F.array_join(F.flatten(F.transform("hunks", lambda h: F.coalesce(F.transform(F.filter(h["lines"], lambda x: ~x["type"].eqNullSafe("removed")), lambda x: F.coalesce(x["content"], F.lit(""))), F.array().cast("array<string>")))), "\n")
    return (
        files.where("file_id is not null and run_id is not null and path is not null")
        .select("file_id", "run_id", F.split(clean, "/").alias("parts"), text.alias("text"))
        .where("length(text) > 0")
        .select("file_id", "run_id", F.slice("parts", 1, F.size("parts") - 1).alias("dirs"), F.element_at("parts", -1).alias("name"), F.xxhash64("text").alias("a"), F.xxhash64(F.lit(7), "text").alias("b"))
    )


def _combined(name: str, part: str, salt: int) -> list[Column]:
    """Sums of the halves of the children's hashes: no order, and equal children add up instead of cancelling."""
    h = F.xxhash64(F.lit(salt), name, part)
    return [F.sum(h.bitwiseAND(0xFFFFFFFF)).alias(f"{part}_low"), F.sum(F.shiftrightunsigned(h, 32)).alias(f"{part}_high")]


def shared_subtrees(files: DataFrame, owners: DataFrame, min_files: int = MIN_FILES, min_owners: int = MIN_OWNERS, shown: DataFrame | None = None) -> DataFrame:
    """(file_id) of the files below subtrees that repositories of several owners hold alike.

    ``files``: file_id, run_id, path, hunks; ``owners``: run_id, owner. One delivery (run) shows one tree, in which a
    file delivered twice with the same text counts once. A folder's hash combines the names and hashes of its
    children, whatever their order, so folders of any width are hashed by partial aggregation; folders are built
    level by level from the deepest one up, at any depth.
    """
    leaf = shown if shown is not None else durable(shown_files(files))
    deepest = leaf.agg(F.max(F.size("dirs"))).first()[0] or 0
    own = leaf.select("run_id", F.array_join("dirs", "/").alias("parent"), F.size("dirs").alias("depth"), "name", "a", "b", F.lit(1).cast("long").alias("files")).distinct()
    folders, from_below = None, None
    for depth in range(deepest, 0, -1):
        children = own.where(F.col("depth") == depth)
        if from_below is not None:
            children = children.unionByName(from_below)
        level = durable(  # each level is written, so the plan of a deep tree doesn't repeat the levels below
            children.groupBy("run_id", "parent").agg(*_combined("name", "a", 5), *_combined("name", "b", 11), F.count("*").alias("width"), F.sum("files").alias("files"))
            .select("run_id", "parent", F.xxhash64("width", "a_low", "a_high").alias("a"), F.xxhash64(F.lit(3), "width", "b_low", "b_high").alias("b"), "files")
        )
        folders = level if folders is None else folders.unionByName(level)
        from_below = level.select(
            "run_id", F.when(F.lit(depth) > 1, F.substring_index("parent", "/", depth - 1)).otherwise(F.lit("")).alias("parent"), F.lit(depth - 1).alias("depth"),
            F.substring_index("parent", "/", -1).alias("name"), "a", "b", "files",
        )
    if folders is None:
        return files.select("file_id").limit(0)
    held = folders.where(F.col("files") >= min_files).join(owners, "run_id")
    common = held.groupBy("a", "b").agg(F.count_distinct("owner").alias("owners")).where(F.col("owners") >= min_owners)
    marked = held.join(common, ["a", "b"], "left_semi").select("run_id", F.col("parent").alias("folder")).distinct()
    ancestors = leaf.select("file_id", "run_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("dirs")), lambda n: F.array_join(F.slice("dirs", 1, n), "/"))).alias("folder")).where("folder <> ''")
    return ancestors.join(marked, ["run_id", "folder"], "left_semi").select("file_id").distinct()


def shared_files(shown: DataFrame, owners: DataFrame, min_owners: int = FILE_OWNERS) -> DataFrame:
    """(file_id) of single files, the leaves of the trees, that repositories of several owners hold alike."""
    held = shown.select("file_id", "run_id", "a", "b").join(owners, "run_id")
    common = held.groupBy("a", "b").agg(F.count_distinct("owner").alias("owners")).where(F.col("owners") >= min_owners)
    return shown.select("file_id", "a", "b").join(common, ["a", "b"], "left_semi").select("file_id").distinct()


def weighed(files: DataFrame, owners: DataFrame) -> DataFrame:
    """(file_id, kind, evidence) with one row per evidence that a file was not written by hand.

    Evidence: 'name', 'header', 'layout', 'bytes' (rules), 'subtree' (Merkle hash of a shared folder) and 'shared
    file' (Merkle hash of a shared leaf, on a file that another evidence marks already or whose header names a licence).
    """
    shown = durable(shown_files(files))
    ruled = durable(rule_verdicts(files))  # read twice
    copied = shared_subtrees(files, owners, shown=shown).select("file_id", F.lit("third party").alias("kind"), F.lit("subtree").alias("evidence"))
    alike = ruled.join(shared_files(shown, owners), "file_id", "left_semi").select("file_id", F.coalesce("kind", F.lit("third party")).alias("kind"), F.lit("shared file").alias("evidence"))
    return ruled.where("kind is not null").unionByName(copied).unionByName(alike)


def unwritten_files(files: DataFrame, owners: DataFrame) -> DataFrame:
    """(file_id, kind) of every file that nobody wrote by hand; the rest is source, configuration or documents.

    Null paths, flags and hunks are no evidence; files without any evidence are taken as written. A file id given
    several times is judged once per row and reported once. Without files there are no rows.
    """
    return weighed(files, owners).groupBy("file_id").agg(F.min("kind").alias("kind"))
