"""Normalisation of keys and texts as built-in column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold_key(c: Column) -> Column:
    """A key without letter case and surrounding white space; blank keys are null."""
    return F.nullif(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), F.lit(""))


def fold_layout(c: Column) -> Column:
    """Text with \\n line ends, no blanks at line ends and no empty lines at its end."""
    unix = F.regexp_replace(c, r"\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(unix, r"[ \t]+(?=\n|\z)", ""), r"\n+\z", "")
