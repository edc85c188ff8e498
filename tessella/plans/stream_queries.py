"""Queries of the continuous operators, each beside its SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions.keys import fold_key
from tessella.plans.histories_sql import fold
from tessella.sources.tables import table
from tessella.streaming import watch

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"SELECT {fold('user_id')} AS user_id, strftime(timestamp, '%Y-%m') AS month, count(*) AS analyses FROM runs GROUP BY ALL")
def stream_metering(spark, sf_dir):
    """Metering of every delivery by a stateful streaming query."""
    runs = watch.table_stream(spark, sf_dir, "runs").select(fold_key(F.col("user_id")).alias("user_id"), "timestamp")
    return watch.drain(watch.metering(runs), "metering")


@query("SELECT count(*) AS runs, CAST(sum(coalesce(total_issues, 0)) AS BIGINT) AS issues FROM (SELECT DISTINCT id, total_issues FROM runs)")
def stream_totals(spark, sf_dir):
    """Running totals of a stream in which every run counts once."""
    runs = watch.table_stream(spark, sf_dir, "runs").select("id", "total_issues").dropDuplicates(["id"])
    return watch.drain(watch.totals(runs), "totals")


@query(f"""WITH e AS (SELECT DISTINCT id, {fold('user_id')} AS user_id, timestamp AS t FROM runs), g AS (SELECT *, CASE WHEN t < lag(t) OVER (PARTITION BY user_id ORDER BY t) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM e),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t, fresh DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM g) SELECT user_id, min(t) AS started, max(t) AS ended, count(*) AS events FROM s GROUP BY user_id, n""")
def debounce_bursts(spark, sf_dir):
    """Bursts of a user's runs that half an hour of quiet ends."""
    runs = table(spark, sf_dir, "runs").select("id", fold_key(F.col("user_id")).alias("user_id"), F.col("timestamp").cast("timestamp").alias("timestamp")).dropDuplicates(["id"])
    return watch.bursts(runs, "user_id", "timestamp", "30 minutes")


@query(r"""WITH f AS (SELECT regexp_replace(replace(path, '\', '/'), '^(\./|/)+', '') AS path, file_id, status FROM file_diffs), a AS (SELECT path, max(file_id) AS changed FROM f WHERE status IN ('added', 'modified') GROUP BY 1), b AS (SELECT path, max(file_id) AS changed FROM f WHERE status IN ('modified', 'renamed') GROUP BY 1)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'new' WHEN b.path IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.path = b.path WHERE a.changed IS DISTINCT FROM b.changed""")
def change_detection(spark, sf_dir):
    """New, changed and deleted files between two listings."""
    from tessella.functions import paths

    f = table(spark, sf_dir, "file_diffs").select(paths.unix(F.col("path")).alias("path"), "file_id", "status")
    listing = lambda cond: f.where(cond).groupBy("path").agg(F.max("file_id").alias("changed"))
    return watch.changes(listing("status in ('added', 'modified')"), listing("status in ('modified', 'renamed')")).select("path", "change")
