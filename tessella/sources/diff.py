"""Unified diff text as a source, and the same relation written back as text."""
from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.schema import FILE_DIFF

_FILE = re.compile(r'^diff --git "?a/(.*?)"? "?b/(.*?)"?$')
_RANGES = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def parse_diff(text: str | None) -> list[dict]:
    """The files of a unified diff. A count left out of a hunk's head is 1; text before the first file is ignored."""
    files: list[dict] = []
    cur: dict | None = None
    hunk: dict | None = None
    old = new = left_old = left_new = 0
    for line in (text or "").split("\n"):
        if hunk is not None and (left_old > 0 or left_new > 0) and line[:1] in ("+", "-", " ", "") and not (line == "" and left_old <= 0 and left_new <= 0):
            kind = {"+": "added", "-": "removed"}.get(line[:1], "context")
            hunk["lines"].append({"type": kind, "content": line[1:], "old_num": 0 if kind == "added" else old, "new_num": 0 if kind == "removed" else new})
            if kind != "added":
                old, left_old = old + 1, left_old - 1
            if kind != "removed":
                new, left_new = new + 1, left_new - 1
            continue
        if m := _FILE.match(line):
            cur = {"path": m[2], "old_path": m[1] if m[1] != m[2] else "", "status": "modified", "is_binary": False, "hunks": []}
            files.append(cur)
            hunk = None
        elif cur is None:
            continue
        elif m := _RANGES.match(line):
            a, b, c, d = (int(x) if x is not None else 1 for x in m.groups())
            hunk = {"old_start": a, "old_count": b, "new_start": c, "new_count": d, "lines": []}
            cur["hunks"].append(hunk)
            old, new, left_old, left_new = a, c, b, d
        elif line.startswith("new file mode"):
            cur["status"] = "added"
        elif line.startswith("deleted file mode"):
            cur["status"] = "deleted"
        elif line.startswith("rename from "):
            cur["status"], cur["old_path"] = "renamed", line[12:]
        elif line.startswith("rename to "):
            cur["path"] = line[10:]
        elif line.startswith(("Binary files ", "GIT binary patch")):
            cur["is_binary"] = True
    return files


def file_diffs(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, path, old_path, status, is_binary, hunks): the files of every diff text; null and empty texts have none."""
    kind = texts.schema[key].dataType.simpleString()
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in FILE_DIFF.fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [{key: k, **f} for k, t in zip(frame[key], frame[text]) for f in parse_diff(t)]
            yield pd.DataFrame(rows, columns=[key, *(f.name for f in FILE_DIFF.fields)])

    return texts.select(key, text).mapInPandas(run, f"`{key}` {kind}, {shape}")


def render(path: Column, old_path: Column, status: Column, is_binary: Column, hunks: Column) -> Column:
    """One file's unified diff text, by built-in expressions."""
    old = F.when(F.coalesce(old_path, F.lit("")) != "", old_path).otherwise(path)
    head = F.concat(F.lit("diff --git a/"), old, F.lit(" b/"), path)
    kind = (
        F.when(status == "added", F.lit("\nnew file mode 100644")).when(status == "deleted", F.lit("\ndeleted file mode 100644"))
        .when(status == "renamed", F.concat(F.lit("\nrename from "), old, F.lit("\nrename to "), path)).otherwise(F.lit(""))
    )
    binary = F.when(F.coalesce(is_binary, F.lit(False)), F.lit("\nBinary files differ")).otherwise(F.lit(""))
    n = lambda x: x.cast("string")

    def lines(h: Column) -> Column:
        texts = F.transform(h["lines"], lambda x: F.concat(F.when(x["type"] == "added", "+").when(x["type"] == "removed", "-").otherwise(" "), F.coalesce(x["content"], F.lit(""))))
        # the counts that the shown lines add up to, so that the text can be read back whatever the head said
        olds = F.size(F.filter(h["lines"], lambda x: x["type"] != "added"))
        news = F.size(F.filter(h["lines"], lambda x: x["type"] != "removed"))
        return F.concat(F.lit("\n@@ -"), n(h["old_start"]), F.lit(","), n(olds), F.lit(" +"), n(h["new_start"]), F.lit(","), n(news), F.lit(" @@\n"), F.array_join(texts, "\n"))

    body = F.array_join(F.transform(F.coalesce(hunks, F.array().cast(hunks_type())), lines), "")
    return F.concat(head, kind, binary, body)


def hunks_type() -> str:
    return FILE_DIFF["hunks"].dataType.simpleString()
