"""Row shapes of the change-analysis relations."""
from __future__ import annotations

from pyspark.sql import types as T

LINE = T.StructType([T.StructField("type", T.StringType()), T.StructField("content", T.StringType()), T.StructField("old_num", T.IntegerType()), T.StructField("new_num", T.IntegerType())])
HUNK = T.StructType([*(T.StructField(c, T.IntegerType()) for c in ("old_start", "old_count", "new_start", "new_count")), T.StructField("lines", T.ArrayType(LINE))])
FILE_DIFF = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("old_path", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("is_binary", T.BooleanType()), T.StructField("hunks", T.ArrayType(HUNK)),
])
ISSUE = T.StructType([
    *(T.StructField(c, T.StringType()) for c in ("id", "fix_id", "severity", "category", "file")), T.StructField("line", T.IntegerType()), T.StructField("end_line", T.IntegerType()),
    T.StructField("message", T.StringType()), T.StructField("suggestion", T.StringType()), T.StructField("related_files", T.ArrayType(T.StringType())),
])
IMPORT = T.StructType([T.StructField("file", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("path", T.StringType()), T.StructField("names", T.ArrayType(T.StringType())), T.StructField("is_type", T.BooleanType()), T.StructField("line", T.IntegerType())])
SYMBOL = T.StructType([*(T.StructField(c, T.StringType()) for c in ("file", "lang", "name", "kind")), T.StructField("exported", T.BooleanType()), T.StructField("line", T.IntegerType()), T.StructField("end_line", T.IntegerType()), T.StructField("signature", T.StringType())])
EDIT = T.StructType([T.StructField("file", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("old_text", T.StringType()), T.StructField("new_text", T.StringType())])
