"""Operators over text and source-code corpora. Optional: nothing else in the package imports it."""
