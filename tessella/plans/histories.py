"""Queries of problems 1, 3, 6 and 7 over the service tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.lineage import durable
from tessella.functions.keys import fold_key, fold_layout
from tessella.operators import bitemporal, nested, references, rolling
from tessella.sources.tables import table


# problem 1: history of changing attributes
def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assertions about both entities: entity_id ('entity:id'), valid_at, recorded_at, state (present, value (a, b)).

    The value of a config is its text and version, that of a subscription its plan and status.
    """
    pair = lambda a, b: F.struct(a.cast("string").alias("a"), b.cast("string").alias("b"))
    entity = lambda name, c: F.concat(F.lit(name + ":"), c)
    configs = bitemporal.snapshot_assertions(table(spark, sf_dir, "org_configs"), "org_id", "snapshot_at", "exported_at", pair(fold_layout(F.col("config_yaml")), F.col("version")))
    folded = lambda c: F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    updates = table(spark, sf_dir, "subscriptions").select(
        entity("subscription", F.col("id")).alias("entity_id"), F.col("updated_at").alias("valid_at"), F.col("received_at").alias("recorded_at"),
        F.struct(F.lit(True).alias("present"), pair(folded("plan"), folded("status")).alias("value")).alias("state"),
    )
    return configs.withColumn("entity_id", entity("org_config", F.col("entity_id"))).unionByName(updates)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = bitemporal.versions(bitemporal.as_of(bitemporal.ledger(_told(spark, sf_dir)))).where("state.present")
    return changes.select(F.substring_index("key", ":", 1).alias("entity"), _id(F.col("key")).alias("entity_id"), F.date_format("valid_from", "yyyy-MM-dd HH:mm:ss").alias("valid_from"))


def _id(key: Column) -> Column:
    return F.regexp_replace(key, r"^\w+:", "")


def _subscription_book(book: DataFrame) -> DataFrame:
    return book.select(_id(F.col("key")).alias("id"), "valid_from", "valid_to", "recorded_from", "recorded_to", F.col("state.value.a").alias("plan"), F.col("state.value.b").alias("status"))


def p1_subscription_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every belief about every subscription: valid and recorded periods."""
    return _subscription_book(bitemporal.ledger(_told(spark, sf_dir).where("entity_id like 'subscription:%'")))


def p1_merged_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ledger from a stored one of what was recorded by the middle of the year, and the rest merged into it."""
    told = _told(spark, sf_dir).where("entity_id like 'subscription:%'")
    early = F.col("recorded_at") < F.lit("2025-07-01").cast("timestamp")
    return _subscription_book(bitemporal.merge(durable(bitemporal.ledger(told.where(early))), told.where(~early)))


# problem 3: nested records
LEAVES = ("related_files", "relatedFiles")


def _nested(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """(parent_id, sent_at, items) of one source table."""
    key, sent, text, envelopes = {
        "runs": ("id", "created_at", "issues", ["issues"]),
        "spec_results": ("id", "created_at", "result_json", ["requirements"]),
        "analysis_results": ("record_id", "received_at", "payload", ["issues"]),
    }[name]
    rows = table(spark, sf_dir, name).select(F.col(key).cast("string").alias("parent_id"), F.col(sent).alias("sent_at"), F.col(text).alias("text"))
    rows = nested.with_held(rows, "text")
    record = name == "analysis_results"
    if record:  # the record may stand in an envelope, and only its issues are items
        rows = nested.with_enveloped(rows, "text", ["result"])
    rows = nested.with_enveloped(rows, "text", envelopes, only=record)
    return rows.select("parent_id", "sent_at", nested.nested_items(F.col("text"), LEAVES).alias("items"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for name in ("runs", "spec_results", "analysis_results"):
        places = _nested(spark, sf_dir, name).select("parent_id", "sent_at", nested.leaf_marks(F.col("items")).alias("places")).where("parent_id is not null")
        once = places.groupBy("parent_id").agg(F.max(F.struct("sent_at", "places")).alias("last")).select("parent_id", "last.places")
        parts.append(nested.explode_places(once, ["parent_id"], "places").select(F.lit(name).alias("source_table"), "parent_id", "item_no", "leaf_no"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p3_related_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat tables of the runs joined again by their keys: related files per issue category."""
    parents = _nested(spark, sf_dir, "runs").where("parent_id is not null").groupBy("parent_id").agg(F.max(F.struct("sent_at", "items")).alias("last")).select("parent_id", "last.items")
    items, leaves = nested.child_tables(parents, "parent_id")
    category = items.select("parent_id", "item_no", F.get_json_object("json", "$.category").alias("category"))
    counted = leaves.groupBy("parent_id", "item_no").agg(F.count("*").alias("n"))
    return category.join(counted, ["parent_id", "item_no"], "left").groupBy("category").agg(F.count("*").alias("issues"), F.coalesce(F.sum("n"), F.lit(0)).alias("related_files"))


SOURCES = ("runs", "spec_results", "analysis_results")


def _child_tables(spark: SparkSession, sf_dir: str, which: int) -> DataFrame:
    """The items (0) or leaves (1) of all sources, each with its source and its parent's key; the last delivery of a parent counts."""
    out = None
    for name in SOURCES:
        parents = _nested(spark, sf_dir, name).where("parent_id is not null").groupBy("parent_id").agg(F.max(F.struct("sent_at", "items")).alias("last")).select("parent_id", "last.items")
        one = nested.child_tables(parents, "parent_id")[which].select(F.lit(name).alias("source_table"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def p3_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of items: source_table, parent_id, item_no, json."""
    return _child_tables(spark, sf_dir, 0)


def p3_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of leaves: source_table, parent_id, item_no, leaf_no, leaf."""
    return _child_tables(spark, sf_dir, 1)


# problem 6: references without a record
def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, parents = None, None
    for name, fields in (("runs", ("user_id", "org_id")), ("audit_log", ("user_id",)), ("spec_results", ("user_id",))):
        kinds = {"user_id": "user", "org_id": "org"}
        each = F.array(*(F.struct(F.lit(f).alias("ref_field"), F.lit(kinds[f]).alias("kind"), fold_key(F.col(f)).alias("key")) for f in fields))
        one = table(spark, sf_dir, name).select(F.lit(name).alias("table_name"), F.col("id").alias("record_id"), F.col("created_at").alias("at"), F.inline(each))
        refs = one if refs is None else refs.unionByName(one)
    for kind, name in (("user", "users"), ("org", "organizations")):
        one = table(spark, sf_dir, name).select(F.lit(kind).alias("kind"), fold_key(F.col("id")).alias("key"), "created_at", "deleted_at")
        parents = one if parents is None else parents.unionByName(one)
    return references.orphans(refs, parents)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("table_name", "record_id", "ref_field")


def p6_orphans_per_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.per_period(_orphans(spark, sf_dir))


# problem 7: rolling totals
def p7_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "runs")
    span = runs.agg(F.min(rolling.day_number(F.col("timestamp"))).alias("a"), F.max(rolling.day_number(F.col("timestamp"))).alias("b"))
    run = F.coalesce("id", F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string")))  # rows without an id are runs of their own
    once = runs.select(run.alias("run"), fold_key(F.col("user_id")).alias("user_id"), "timestamp", "errors").dropDuplicates(["run"])
    daily = rolling.daily_totals(once, F.col("user_id"), F.col("timestamp"), {"runs": F.lit(1), "errors": F.col("errors")})
    return rolling.trailing(daily, ["runs", "errors"], span.select("a").scalar(), span.select("b").scalar()).withColumnRenamed("entity", "user_id")


QUERIES = {
    "p1_found": p1_found, "p1_subscription_ledger": p1_subscription_ledger, "p1_merged_ledger": p1_merged_ledger, "p3_found": p3_found, "p3_related_paths": p3_related_paths, "p3_items": p3_items, "p3_leaves": p3_leaves,
    "p6_found": p6_found, "p6_orphans_per_month": p6_orphans_per_month, "p7_rolling": p7_rolling,
}
