"""Readers: driver tables, unified diffs, source trees, baselines."""
from tessella.sources.tables import table

__all__ = ["table"]
