"""Ingestion from a working copy: diff text by mode and the commit log. Runs git on the driver; the engine reads its text."""
from __future__ import annotations

import pathlib
import subprocess
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

CONTEXT = 3
#: fixed value: git's name of the empty tree, against which a whole repository is a diff
EMPTY_TREE = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"


def _git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True, text=True, errors="replace").stdout


def diff_text(repo: str, mode: str = "auto", ref: str = "") -> str:
    """Unified diff text: staged, unstaged, branch (since ``ref`` forked), ref, tree (all files), or auto: staged if there is any, else unstaged."""
    unified = f"-U{CONTEXT}"
    if mode == "auto":
        return diff_text(repo, "staged") or diff_text(repo, "unstaged")
    args = {"staged": ["--cached"], "unstaged": [], "branch": [f"{ref}...HEAD"], "ref": [f"{ref}...HEAD"], "tree": [EMPTY_TREE, "HEAD"]}[mode]
    return _git(repo, "diff", "--no-color", unified, *args)


def commit_lines(spark: SparkSession, repo: str, since: str = "") -> DataFrame:
    """(value): log lines with unit separators, for specs.commits."""
    text = _git(repo, "log", "--format=%H%x1f%an%x1f%s", *([f"--since={since}"] if since else []))
    return spark.createDataFrame([(x,) for x in text.splitlines() if x], "value string")


def content(repo: str, path: str, ref: str = "") -> str | None:
    """The text of a file in the working copy, or with ``ref`` as that revision holds it; None where there is none."""
    if not ref:
        place = pathlib.Path(repo, path)
        return place.read_text(errors="replace") if place.is_file() else None
    try:
        return _git(repo, "show", f"{ref}:{path}")
    except subprocess.CalledProcessError:
        return None


def contents(spark: SparkSession, repo: str, paths: Sequence[str], ref: str = "") -> DataFrame:
    """(file, content) of those of ``paths`` that exist, by one call of git for all of a revision."""
    rows: list[tuple[str, str]] = []
    if not ref:
        rows = [(p, t) for p in paths if (t := content(repo, p)) is not None]
    elif paths:
        asked = "".join(f"{ref}:{p}\n" for p in paths).encode()
        raw = subprocess.run(["git", "-C", repo, "cat-file", "--batch"], input=asked, check=True, capture_output=True).stdout
        at = 0
        for p in paths:
            end = raw.index(b"\n", at)
            head = raw[at:end].split()
            at = end + 1
            if len(head) == 3 and head[2].isdigit():
                size = int(head[2])
                if head[1] == b"blob":
                    rows.append((p, raw[at : at + size].decode("utf-8", "replace")))
                at += size + 1
    return spark.createDataFrame(rows, "file string, content string")
