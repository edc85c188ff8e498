"""Source trees: files with their content, the index over them, and a whole tree as one diff."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import lang as langs
from tessella.functions import paths

# fixed values: folders of version control and caches
HIDDEN = [".git", ".hg", ".svn"]


def ignored(file, patterns: Sequence[str]):
    """Whether a path is ignored: a pattern names one of its folders, or matches its name or the whole path as a glob."""
    out = paths.has_part(file, HIDDEN)
    for p in patterns:
        glob = paths.glob_regex(p.rstrip("/"))
        out = out | paths.has_part(paths.dirname(file), [p.rstrip("/")]) | paths.basename(file).rlike(glob) | file.rlike(glob)
    return out


def repo_files(spark: SparkSession, root: str, ignore: Sequence[str] = ()) -> DataFrame:
    """file, lang, size, changed, content of all files of known languages below ``root``; unreadable files are skipped by the source."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true").load(root)
    file = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), "^" + "\\Q" + root.rstrip("/") + "\\E/", "")
    out = rows.select(file.alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("changed"), F.decode("content", "UTF-8").alias("content"))
    return out.withColumn("lang", langs.language(F.col("file"))).where(F.col("lang").isNotNull() & ~ignored(F.col("file"), ignore))


def tree_lines(files: DataFrame) -> DataFrame:
    """(file, lang, line, content): every line of every file, with \\r\\n as \\n."""
    each = F.posexplode(F.split(F.regexp_replace("content", "\r\n", "\n"), "\n")).alias("p", "content")
    return files.select("file", "lang", each).select("file", "lang", (F.col("p") + 1).alias("line"), "content")


def as_added(files: DataFrame) -> DataFrame:
    """The tree as a diff against nothing: one added file with one hunk of added lines each."""
    lines = F.transform(F.split("content", "\n"), lambda c, i: F.struct(F.lit("added").alias("type"), c.alias("content"), F.lit(0).alias("old_num"), (i + 1).alias("new_num")))
    hunk = F.struct(F.lit(0).alias("old_start"), F.lit(0).alias("old_count"), F.lit(1).alias("new_start"), F.size(lines).alias("new_count"), lines.alias("lines"))
    return files.select(F.xxhash64("file").alias("file_id"), F.col("file").alias("path"), F.lit("").alias("old_path"), F.lit("added").alias("status"), F.lit(False).alias("is_binary"), F.array(hunk).alias("hunks"))


def save_index(index: DataFrame, listing: DataFrame, folder: str) -> None:
    """Keeps an index beside the listing (path, size, changed) of the files that it was made from."""
    listing.select("path", "size", "changed").write.mode("overwrite").parquet(f"{folder}/listing")
    index.write.mode("overwrite").parquet(f"{folder}/index")


def load_index(spark: SparkSession, listing: DataFrame, folder: str) -> DataFrame | None:
    """The kept index if its files are those of ``listing``, unchanged; None if they aren't or none is kept."""
    from tessella.operators.service import cache_valid

    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/index/_SUCCESS")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    kept = spark.read.parquet(f"{folder}/listing")
    return spark.read.parquet(f"{folder}/index") if cache_valid(kept, listing).first().valid else None
