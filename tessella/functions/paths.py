"""Path functions as built-in expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unix(c: Column) -> Column:
    """Forward slashes, no leading ./ or /."""
    return F.regexp_replace(F.regexp_replace(c, r"\\", "/"), r"^(\./|/)+", "")


def basename(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/]*)$", 1)


def dirname(c: Column) -> Column:
    """The folder, '.' for a bare name."""
    return F.when(c.contains("/"), F.regexp_extract(c, r"^(.*)/[^/]*$", 1)).otherwise(F.lit("."))


def extension(c: Column) -> Column:
    """The last extension in lower case with its dot, or ''."""
    return F.lower(F.regexp_extract(basename(c), r"(\.[^.]*)$", 1))


def stem(c: Column) -> Column:
    return F.regexp_replace(basename(c), r"\.[^.]*$", "")


def clean(c: Column) -> Column:
    """Without '.', empty and resolvable '..' parts."""
    parts = F.filter(F.split(c, "/"), lambda p: (p != "") & (p != "."))
    step = lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.concat(acc, F.array(p)))
    # element_at fails on an empty array only when evaluated: an empty accumulator is asked for its size first
    safe = lambda acc, p: F.when(F.size(acc) == 0, F.array(p)).otherwise(step(acc, p))
    folded = F.aggregate(parts, F.array().cast("array<string>"), safe)
    return F.when(F.size(folded) == 0, F.lit(".")).otherwise(F.array_join(folded, "/"))


def join(folder: Column, name: Column) -> Column:
    return clean(F.concat_ws("/", folder, name))


def suffixes(c: Column) -> Column:
    """All trailing runs of parts of a path, the whole included."""
    parts = F.split(c, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))


def prefixes(c: Column, separator: str = "/") -> Column:
    """All leading runs of parts, the whole included."""
    parts = F.split(c, f"\\Q{separator}\\E")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), separator))


def has_part(c: Column, names: list[str]) -> Column:
    """Whether one of ``names`` is a part of the path."""
    return F.arrays_overlap(F.split(c, "/"), F.array(*map(F.lit, names)))


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a shell pattern in which * and ? don't cross a slash."""
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "*":
            out += "[^/]*"
        elif ch == "?":
            out += "[^/]"
        elif ch == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            body = pattern[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[:1] in "!^" else body).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += "\\" + ch if ch in r"\.+^$(){}|[]" else ch
        i += 1
    return f"^{out}$"
