"""The service's store as functions over tables: statistics, paging, joins, upserts, deletions and exports."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# fixed values: page sizes (default, most) and the monthly quota of model calls per plan
PAGE, AUDIT_PAGE = (20, 100), (50, 200)
PLAN_LIMITS = {"free": 50, "pro": 1000, "team": 5000}


def run_stats(runs: DataFrame, *by: str) -> DataFrame:
    """Runs, total issues and the averages of issues, files and confidence (to six digits); sums and averages of nothing are 0."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return runs.groupBy(*by).agg(
        F.count("*").alias("total_runs"), zero(F.sum("total_issues")).cast("long").alias("total_issues"), zero(F.avg("total_issues")).alias("avg_issues"),
        zero(F.avg("files_changed")).alias("avg_files"), zero(F.avg(F.round(F.col("confidence_score") * 1e6).cast("long")) / 1e6).alias("avg_confidence"),
    )


def monthly_usage(events: DataFrame, user: str, at: str, **sums: Column) -> DataFrame:
    """(user, month, analyses, sums...): accumulation per user and calendar month."""
    return events.groupBy(F.col(user).alias("user_id"), F.date_format(at, "yyyy-MM").alias("month")).agg(F.count("*").alias("analyses"), *(F.sum(c).alias(n) for n, c in sums.items()))


def usage_limit(usage: DataFrame, users: DataFrame) -> DataFrame:
    """Adds plan, quota, remaining and allowed; unknown plans count as free."""
    limits = F.create_map(*(F.lit(x) for pair in PLAN_LIMITS.items() for x in pair))
    plan = F.lower(F.trim("plan"))
    known = users.groupBy(F.col("id").alias("user_id")).agg(F.max(plan).alias("plan"))
    quota = F.coalesce(F.try_element_at(limits, F.col("plan")), F.lit(PLAN_LIMITS["free"]))
    return usage.join(known, "user_id", "left").withColumn("quota", quota).withColumn("remaining", F.greatest(F.col("quota") - F.col("analyses"), F.lit(0))).withColumn("allowed", F.col("analyses") < F.col("quota"))


def page(rows: DataFrame, order: Sequence[Column], limit: int = 0, offset: int = 0, bounds: tuple[int, int] = PAGE) -> DataFrame:
    """One page; a missing or negative limit is the default, and no page exceeds the most."""
    default, most = bounds
    return rows.orderBy(*order).offset(max(offset, 0)).limit(min(limit if limit > 0 else default, most))


def latest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The latest row of every key, by an aggregation that combines before the shuffle; ties by the whole row."""
    rest = [c for c in rows.columns if c not in (key, at)]
    return rows.groupBy(key).agg(F.max(F.struct(at, *rest)).alias("r")).select(key, f"r.{at}", *(f"r.{c}" for c in rest))


def upsert_add(table: DataFrame, changes: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Insert or add: numbers of equal keys are summed."""
    return table.select(*keys, *sums).unionByName(changes.select(*keys, *sums)).groupBy(*keys).agg(*(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in sums))


def upsert_overwrite(table: DataFrame, changes: DataFrame, key: str, at: str) -> DataFrame:
    """Insert or replace: of equal keys the row with the latest ``at`` stays."""
    return latest(table.unionByName(changes), key, at)


def upsert_version(table: DataFrame, changes: DataFrame, key: str, content: str, version: str) -> DataFrame:
    """Insert with version 1, or replace the content and count the version up."""
    old = table.select(key, F.col(content).alias("__old"), F.col(version).alias("__version"))
    new = changes.select(key, F.col(content).alias("__new"))
    changed = F.col("__new").isNotNull()
    return old.join(new, key, "full").select(key, F.coalesce("__new", "__old").alias(content), F.when(changed, F.coalesce("__version", F.lit(0)) + 1).otherwise(F.col("__version")).alias(version))


def delete_cascade(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows whose key column names a deleted account (``gone``: id)."""
    return {n: df.join(gone.select(F.col("id").alias(c)).distinct(), c, "left_anti") for n, (df, c) in tables.items()}


def wants(events: Column, event: Column, active: Column) -> Column:
    """Whether a webhook's list of events takes an event; * takes all."""
    return active & F.exists(events, lambda e: (e == event) | (e == "*"))


def status_counts(statuses: DataFrame, *by: str) -> DataFrame:
    """implemented, partial, missing, anchored (the first two) and all, from one row per requirement."""
    n = lambda s: F.count_if(F.col("status") == s)
    return statuses.groupBy(*by).agg(n("implemented").alias("implemented"), n("partial").alias("partial"), n("missing").alias("missing"), F.count_if(F.col("status").isin("implemented", "partial")).alias("anchored"), F.count("*").alias("requirements"))


def progress(done: Column, total: Column) -> Column:
    """Whole percent, 0 of nothing."""
    return F.when(total > 0, F.floor(done * 100 / total)).otherwise(F.lit(0)).cast("int")


def clamp(x: Column) -> Column:
    """A confidence between 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def sparkline(rows: DataFrame, key: str, at: str, value: str, n: int = 20) -> DataFrame:
    """The last ``n`` values of every key, oldest first, scaled by their greatest."""
    w = W.partitionBy(key).orderBy(F.desc(at), F.desc("id"))
    last = rows.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n)
    part = W.partitionBy(key)
    top = F.max(value).over(part)
    return last.select(key, "id", (F.count("*").over(part) - F.col("__rn") + 1).cast("int").alias("place"), F.when(top > 0, F.round(F.col(value) / top, 6)).otherwise(F.lit(0.0)).alias("height"))


def cache_valid(cached: DataFrame, current: DataFrame) -> DataFrame:
    """One row: whether two listings (path, size, changed) hold the same files, unchanged."""
    c, n = (df.select("path", F.struct("size", "changed").alias(name)) for df, name in ((cached, "__c"), (current, "__n")))
    differs = ~F.col("__c").eqNullSafe(F.col("__n"))
    return c.join(n, "path", "full").agg(F.coalesce(~F.bool_or(differs), F.lit(True)).alias("valid"), F.count_if(differs).alias("changed"))


def export_bundle(user: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """(id, bundle): a JSON document per user with all rows of its parts (each: user_id and columns), unclamped."""
    out = user
    for name, df in parts.items():
        listed = df.groupBy(F.col("user_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct(*[c for c in df.columns if c != "user_id"]))).alias(name))
        out = out.join(listed, "id", "left")
    return out.select("id", F.to_json(F.struct(*out.columns)).alias("bundle"))


def insert_runs(runs: DataFrame, uploads: DataFrame) -> DataFrame:
    """``runs`` with the uploads appended: each gets an id of its own where it has none, and a repeated id is taken once.

    Counters that an upload doesn't give are 0. An id is the hash of the upload's content, so that a task that runs again,
    or an upload that is sent again, makes the same row.
    """
    own = [c for c in runs.columns if c in uploads.columns]
    content = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in own if c != "id")), 256)
    ident = F.regexp_replace(F.substring(content, 1, 32), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    given = F.nullif(F.trim("id"), F.lit("")) if "id" in own else F.lit(None).cast("string")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in ("errors", "warnings", "infos", "total_issues", "files_changed") else F.col(c)
    new = uploads.select(F.coalesce(given, ident).alias("id"), *(zero(c).cast(runs.schema[c].dataType).alias(c) for c in own if c != "id")).dropDuplicates(["id"])
    fresh = new.join(runs.select("id"), "id", "left_anti")
    return runs.unionByName(fresh, allowMissingColumns=True)


def upsert_identity(table: DataFrame, changes: DataFrame, key: str = "org_id", at: str = "updated_at") -> DataFrame:
    """One identity provider per organization: the latest setting replaces the one before, but its ``created_at`` stays the first."""
    both = table.unionByName(changes)
    first = both.groupBy(key).agg(F.min("created_at").alias("created_at"))
    return latest(both.drop("created_at"), key, at).join(first, key).select(*table.columns)


def _bytes_xor(hex_text: Column, pad: int) -> Column:
    """The binary whose bytes are those of ``hex_text`` (64 bytes) xor ``pad``."""
    each = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.lpad(F.hex(F.conv(F.substring(hex_text, i * 2 + 1, F.lit(2)), 16, 10).cast("int").bitwiseXOR(F.lit(pad))), 2, "0"))
    return F.unhex(F.array_join(each, ""))


def hmac_sha256(secret: Column, body: Column) -> Column:
    """HMAC-SHA256 of ``body`` under ``secret`` in hexadecimal digits: the signature of a webhook's delivery; null of nulls."""
    key = F.when(F.octet_length(secret) > 64, F.unhex(F.sha2(secret, 256))).otherwise(F.encode(secret, "UTF-8"))
    padded = F.rpad(F.hex(key), 128, "0")
    inner = F.unhex(F.sha2(F.concat(_bytes_xor(padded, 0x36), F.encode(body, "UTF-8")), 256))
    return F.when(secret.isNotNull() & body.isNotNull(), F.lower(F.sha2(F.concat(_bytes_xor(padded, 0x5C), inner), 256)))


def deliveries(events: DataFrame, hooks: DataFrame) -> DataFrame:
    """(hook_id, url, event, body, signature, waits): what is sent to every active hook that takes an event, with the seconds to wait before each further try."""
    meet = (events["org_id"] == hooks["org_id"]) & wants(hooks["events"], events["event"], hooks["active"])
    both = events.join(hooks, meet).select(hooks["id"].alias("hook_id"), hooks["url"], events["event"], events["body"], hooks["secret"])
    return both.select("hook_id", "url", "event", "body", F.concat(F.lit("sha256="), hmac_sha256(F.col("secret"), F.col("body"))).alias("signature"), F.array(F.lit(1), F.lit(2), F.lit(4)).alias("waits"))
