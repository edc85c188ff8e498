"""Specifications, anchors, baselines, manifests, configuration and commit logs."""
from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ANCHOR = r"spec:\s*([A-Za-z]+-[\w\-]+)"
MAX_DESCRIPTION = 300
# fixed values: names of manifests (patterns, lower case) and the languages they speak for
MANIFESTS = {
    r"go\.mod": "go", r"package\.json": "typescript", r"requirements\.txt|pyproject\.toml": "python", r"cargo\.toml": "rust", r"composer\.json": "php", r"dub\.json": "dlang", r"project\.toml": "julia", r"gemfile": "ruby",
    r"pom\.xml|build\.gradle(\.kts)?|build\.sbt": "java kotlin scala groovy", r"pubspec\.yaml": "dart", r"shard\.yml": "crystal", r"description": "r", r"mix\.exs": "elixir", r"build\.zig\.zon": "zig", r"project\.clj|deps\.edn": "clojure",
    r"package\.swift|podfile": "swift objc", r"cpanfile": "perl", r"cmakelists\.txt": "c cpp objc", r".*\.cabal": "haskell", r".*\.nimble": "nim", r".*\.rockspec": "lua", r".*\.opam|dune-project": "ocaml", r"v\.mod": "vlang", r".*\.fsproj|paket\.dependencies": "fsharp",
}


def anchors(lines: DataFrame, pattern: str = ANCHOR) -> DataFrame:
    """(file, line, req_id) of every anchor of ``lines`` (file, line, content), several per line included."""
    return lines.select("file", "line", F.explode(F.regexp_extract_all("content", F.lit(pattern), 1)).alias("req_id"))


def grouped(anchors_: DataFrame) -> DataFrame:
    """Anchors by requirement: how many, and the first place."""
    return anchors_.groupBy("req_id").agg(F.count("*").alias("anchors"), F.min(F.struct("file", "line")).alias("first"))


def parse_markdown(text: str | None) -> list[tuple[str, str, str]]:
    """(id, title, description) of the sections of a specification: level 2 is SEC-n, level 3 SEC-n-m; headings inside
    fences are text; the description is the first paragraph, cut after MAX_DESCRIPTION characters."""
    out: list[list[str]] = []
    fence, n, m, open_paragraph = False, 0, 0, False
    for line in (text or "").replace("\r\n", "\n").split("\n"):
        bare = line.strip()
        if bare.startswith("```"):
            fence = not fence
            continue
        head = re.match(r"^(#{2,3})\s+(.*\S)\s*$", line) if not fence else None
        if head:
            if len(head[1]) == 2:
                n, m = n + 1, 0
                out.append([f"SEC-{n}", head[2], ""])
            else:
                m += 1
                out.append([f"SEC-{n}-{m}", head[2], ""])
            open_paragraph = True
        elif out and open_paragraph and not fence:
            if bare and not bare.startswith("#"):
                out[-1][2] = f"{out[-1][2]} {bare}".strip()[:MAX_DESCRIPTION]
            elif out[-1][2]:
                open_paragraph = False
    return [(a, b, c) for a, b, c in out]


# fixed values: the form of a requirement's id, and what its priority and status may be
REQUIREMENT_ID = r"[A-Za-z][A-Za-z0-9_-]*-\d+"
PRIORITIES, STATUSES = ("high", "medium", "low"), ("planned", "in-progress", "implemented", "verified")


def parse_yaml_spec(text: str | None) -> tuple[list[dict], str]:
    """(requirements, what is wrong) of a specification in YAML; requirements (id, description, priority, status, targets,
    tags) are given only where nothing is wrong."""
    from tessella.sources.config import read_yaml

    data = read_yaml(text)
    if not isinstance(data, dict) or data.get("version") != 1:
        return [], f"unsupported version: {data.get('version') if isinstance(data, dict) else None}"
    if not data.get("title"):
        return [], "title is required"
    out, seen = [], set()
    rows = data.get("requirements") or []
    for k, r in enumerate(rows if isinstance(rows, list) else [rows]):
        r = r if isinstance(r, dict) else {}
        ident = str(r.get("id") or "")
        if not ident:
            return [], f"requirement {k}: id is required"
        if not re.fullmatch(REQUIREMENT_ID, ident):
            return [], f"requirement {ident}: malformed id"
        if ident in seen:
            return [], f"requirement {ident}: duplicate id"
        seen.add(ident)
        if not r.get("description"):
            return [], f"requirement {ident}: description is required"
        if r.get("priority") and r["priority"] not in PRIORITIES:
            return [], f"requirement {ident}: invalid priority {r['priority']}"
        if r.get("status") and r["status"] not in STATUSES:
            return [], f"requirement {ident}: invalid status {r['status']}"
        many = lambda v: [str(x) for x in (v if isinstance(v, list) else [v]) if x is not None]
        out.append({"id": ident, "description": str(r["description"]), "priority": r.get("priority"), "status": r.get("status"), "targets": many(r.get("targets")), "tags": many(r.get("tags"))})
    return out, ""


def requirements(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, req_id, title, description, priority, status, targets, tags) of specifications: as YAML where a text is a valid
    one, else the sections of Markdown, which have a title but no priority, status, targets or tags."""
    kind = texts.schema[key].dataType.simpleString()
    names = [key, "req_id", "title", "description", "priority", "status", "targets", "tags"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, t in zip(frame[key], frame[text]):
                told, _ = parse_yaml_spec(t)
                rows += [(k, r["id"], None, r["description"], r["priority"], r["status"], r["targets"], r["tags"]) for r in told] or [(k, *r, None, None, [], []) for r in parse_markdown(t)]
            yield pd.DataFrame(rows, columns=names)

    return texts.select(key, text).mapInPandas(run, f"`{key}` {kind}, req_id string, title string, description string, priority string, status string, targets array<string>, tags array<string>")


SPEC_BASELINE = "version int, spec_file string, implemented array<string>, accepted_unexpected array<string>, updated_at timestamp"


def spec_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(spec_file, kind, item): what a stored baseline of a specification holds as implemented or accepted though unexpected."""
    raw = spark.read.schema(SPEC_BASELINE).json(path, multiLine=True)
    part = lambda c: raw.select("spec_file", F.lit(c).alias("kind"), F.explode(c).alias("item"))
    return part("implemented").unionByName(part("accepted_unexpected"))


def write_spec_baseline(held: DataFrame, path: str, spec_file: str) -> None:
    """The baseline of a specification (kind, item), one document, its lists sorted and each item once."""
    of = lambda k: F.sort_array(F.collect_set(F.when(F.col("kind") == k, F.col("item")))).alias(k)
    one = held.groupBy().agg(of("implemented"), of("accepted_unexpected"))
    one.select(F.lit(1).alias("version"), F.lit(spec_file).alias("spec_file"), "implemented", "accepted_unexpected", F.current_timestamp().alias("updated_at")).coalesce(1).write.mode("overwrite").json(path)


def beyond_spec_baseline(found: DataFrame, held: DataFrame) -> DataFrame:
    """What was found (kind, item) and a stored baseline doesn't hold: regressions of nothing, news of either kind."""
    return found.join(held.select("kind", "item").distinct(), ["kind", "item"], "left_anti")


def parse_manifest(name: str, text: str) -> list[str]:
    """Names of the packages that a manifest declares."""
    base = name.rsplit("/", 1)[-1].lower()
    if base == "go.mod":
        return re.findall(r"^\s*(?:require\s+)?([\w.\-]+(?:/[\w.\-]+)*)\s+v[\d.]+", text, re.M)
    if base == "go.sum":
        return re.findall(r"^\s*(\S+)\s+v\d\S*\s+h1:", text, re.M)
    if base in ("package.json", "composer.json", "dub.json"):
        try:
            data = json.loads(text)
        except ValueError:
            return []
        return [k for field in ("dependencies", "devDependencies", "peerDependencies", "require", "require-dev") for k in (data.get(field) or {}) if isinstance(data.get(field), dict)]
    if base == "requirements.txt":
        return [m.lower() for m in re.findall(r"^\s*([A-Za-z0-9][\w.\-]*)", text, re.M)]
    if base in ("cargo.toml", "pyproject.toml", "project.toml"):
        section, out = "", []
        for line in text.split("\n"):
            if m := re.match(r"^\s*\[+([^\]]+)\]+", line):
                section = m[1]
            elif section.endswith(("dependencies", "deps")) and (m := re.match(r"^\s*\"?([\w\-]+)\"?\s*=", line)):
                out.append(m[1])
            elif m := re.match(r"^\s*\"([A-Za-z][\w.\-]*)\s*(?:[<>=~!\[;].*)?\",?\s*$", line):
                out.append(m[1].lower())
        return out
    if base == "pom.xml":
        return re.findall(r"<groupId>\s*([\w.\-]+)\s*</groupId>", text)
    if base.startswith("build.gradle"):
        return re.findall(r"[\"']([\w.\-]+):[\w.\-]+(?::[\w.\-]+)?[\"']", text)
    if base == "gemfile":
        return re.findall(r"^\s*gem\s+[\"']([\w\-]+)", text, re.M)
    if base in ("pubspec.yaml", "shard.yml"):
        return re.findall(r"^ {2}([\w\-]+):", text.partition("dependencies:")[2], re.M)
    if base == "description":
        return re.findall(r"[\w.]+", " ".join(re.findall(r"^(?:Imports|Depends):\s*([^\n]*(?:\n\s+[^\n]*)*)", text, re.M)))
    if base in ("mix.exs", "build.zig.zon", "project.clj", "deps.edn"):
        return re.findall(r"\{:(\w+)\s*,|^\s*\.(\w+)\s*=\s*\.\{|\[?([\w.\-]+/[\w.\-]+)\s", text, re.M) and [next(x for x in m if x) for m in re.findall(r"\{:(\w+)\s*,|^\s*\.(\w+)\s*=\s*\.\{|\[?([\w.\-]+/[\w.\-]+)\s", text, re.M)]
    if base in ("package.swift", "podfile", "cpanfile", "cmakelists.txt"):
        return re.findall(r"(?:\.package\([^)]*?/([\w\-]+?)(?:\.git)?\"|pod\s+['\"]([\w\-/]+)|requires\s+['\"]([\w:]+)|find_package\((\w+))", text) and [next(x for x in m if x) for m in re.findall(r"(?:\.package\([^)]*?/([\w\-]+?)(?:\.git)?\"|pod\s+['\"]([\w\-/]+)|requires\s+['\"]([\w:]+)|find_package\((\w+))", text)]
    return re.findall(r"^\s*(?:requires|dependencies|build-depends)\s*[:=]?\s*[\"']?([\w\-]+)", text, re.M | re.I)


def manifest_languages(file: Column) -> Column:
    """Languages whose imports a manifest declares; none for go.sum, which doesn't name the module itself."""
    base, out = F.lower(F.regexp_extract(file, r"([^/]*)$", 1)), F.array().cast("array<string>")
    for pattern, languages in MANIFESTS.items():
        out = F.when(base.rlike(f"^(?:{pattern})$"), F.array(*map(F.lit, languages.split()))).otherwise(out)
    return out


def diff_manifests(files: DataFrame) -> DataFrame:
    """(file, content) of the manifests among the files of a diff, as far as its hunks show them."""
    path = F.regexp_replace(F.regexp_replace("path", r"\\", "/"), r"^(\./|/)+", "")
    base = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    shown = F.flatten(F.transform(F.filter("hunks", lambda h: h["lines"].isNotNull()), lambda h: F.transform(F.filter(h["lines"], lambda x: x["type"] != "removed"), lambda x: F.coalesce(x["content"], F.lit("")))))
    kept = files.where("status <> 'deleted'").where(base.rlike("^(?:" + "|".join([*MANIFESTS, r"go\.sum"]) + ")$"))
    return kept.select(path.alias("file"), F.array_join(shown, "\n").alias("content"))


def manifests(files: DataFrame) -> DataFrame:
    """(file, key) of every package that a manifest among ``files`` (file, content) declares."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(f, k) for f, t in zip(frame["file"], frame["content"]) for k in dict.fromkeys(parse_manifest(f, t or ""))], columns=["file", "key"])

    return files.select("file", "content").mapInPandas(run, "file string, key string")


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """(id, category, file, message) of a stored baseline."""
    raw = spark.read.schema("version int, issues array<struct<id:string,category:string,file:string,message:string>>").json(path, multiLine=True)
    return raw.select(F.inline("issues"))


def write_baseline(issues: DataFrame, path: str) -> None:
    """The baseline of the given issues, one document."""
    listed = F.sort_array(F.collect_set(F.struct("id", "category", "file", "message"))).alias("issues")
    issues.groupBy().agg(F.lit(1).alias("version"), listed).coalesce(1).write.mode("overwrite").json(path)


def commits(log: DataFrame, line: str = "value") -> DataFrame:
    """(sha, author, subject) of log lines whose fields a unit separator divides."""
    parts = F.split(F.col(line), "\x1f", 3)
    return log.select(*(F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(("sha", "author", "subject"))))


def merge_config(base: dict, team: dict | None) -> dict:
    """Settings of a team over one's own: values that are set win, the analyzers as a whole, compliance and own rules stay."""
    out = dict(base)
    for k, v in (team or {}).items():
        if k in ("compliance", "custom_rules"):
            continue
        if k == "analyzers" or v not in (None, "", 0, [], {}):
            out[k] = v
    return out


def orphans(requirement_ids: DataFrame, anchors_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(anchors without a requirement, requirements without an anchor), both by req_id."""
    r, a = requirement_ids.select("req_id").distinct(), anchors_.select("req_id").distinct()
    return a.join(r, "req_id", "left_anti"), r.join(a, "req_id", "left_anti")


def lenient_json(c: Column) -> Column:
    """The JSON object or array inside a model's answer, fenced or embedded, as text; null if there is none."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(c)
    inner = F.regexp_extract(body, r"(?s)([\[{].*[\]}])", 1)
    return F.when(F.try_parse_json(inner).isNotNull(), inner)
