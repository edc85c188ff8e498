"""Queries of the service's store, each beside its SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions.keys import fold_key
from tessella.operators import service
from tessella.plans import histories_sql
from tessella.plans.histories_sql import fold
from tessella.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

_RUNS = f"WITH r AS (SELECT DISTINCT id, {fold('user_id')} AS user_id, {fold('org_id')} AS org_id, repo_url, branch, commit_sha, mode, timestamp, duration_ms, files_changed, errors, warnings, infos, total_issues, confidence_score, created_at FROM runs)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def runs_of(spark, sf_dir):
    """Every run once, with folded keys."""
    r = table(spark, sf_dir, "runs").select(
        "id", fold_key(F.col("user_id")).alias("user_id"), fold_key(F.col("org_id")).alias("org_id"), "repo_url", "branch", "commit_sha", "mode", "timestamp", "duration_ms", "files_changed",
        "errors", "warnings", "infos", "total_issues", "confidence_score", "created_at",
    )
    return r.dropDuplicates(["id"])


_STATS = "count(*) AS total_runs, CAST(coalesce(sum(total_issues), 0) AS BIGINT) AS total_issues, coalesce(avg(total_issues), 0) AS avg_issues, coalesce(avg(files_changed), 0) AS avg_files, coalesce(avg(CAST(round(confidence_score * 1e6) AS BIGINT)) / 1e6, 0) AS avg_confidence"


@query(f"{_RUNS} SELECT user_id, {_STATS} FROM r GROUP BY user_id")
def run_stats_user(spark, sf_dir):
    return service.run_stats(runs_of(spark, sf_dir), "user_id")


@query(f"{_RUNS} SELECT org_id, {_STATS} FROM r WHERE org_id IS NOT NULL GROUP BY org_id")
def run_stats_org(spark, sf_dir):
    return service.run_stats(runs_of(spark, sf_dir).where("org_id is not null"), "org_id")


@query(f"{_RUNS} SELECT {_STATS} FROM r")
def run_stats_all(spark, sf_dir):
    return service.run_stats(runs_of(spark, sf_dir))


_USAGE = f"{_RUNS}, u AS (SELECT user_id, strftime(timestamp, '%Y-%m') AS month, count(*) AS analyses, CAST(sum(files_changed) AS BIGINT) AS files FROM r GROUP BY ALL)"


def _usage(spark, sf_dir):
    return service.monthly_usage(runs_of(spark, sf_dir), "user_id", "timestamp", files=F.col("files_changed"))


@query(f"{_USAGE} SELECT * FROM u")
def usage_monthly(spark, sf_dir):
    return _usage(spark, sf_dir)


@query(f"{_USAGE}, k AS (SELECT {fold('id')} AS user_id, max(lower(trim(plan))) AS plan FROM users GROUP BY 1) SELECT u.*, k.plan, q.quota, greatest(q.quota - analyses, 0) AS remaining, analyses < q.quota AS allowed FROM u LEFT JOIN k USING (user_id), LATERAL (SELECT CASE k.plan WHEN 'pro' THEN 1000 WHEN 'team' THEN 5000 ELSE 50 END AS quota) q")
def usage_limit(spark, sf_dir):
    users = table(spark, sf_dir, "users").select(fold_key(F.col("id")).alias("id"), "plan")
    return service.usage_limit(_usage(spark, sf_dir), users)


@query(f"{_RUNS} SELECT id, user_id, timestamp, total_issues FROM r ORDER BY timestamp DESC, id LIMIT 20 OFFSET 40")
def page_offset(spark, sf_dir):
    """The third page of the latest runs; a page is what the operator gives."""
    return service.page(runs_of(spark, sf_dir), [F.desc("timestamp"), F.asc("id")], 0, 40).select("id", "user_id", "timestamp", "total_issues")


@query("SELECT id, org_id, action, created_at FROM (SELECT DISTINCT id, org_id, action, created_at FROM audit_log) ORDER BY created_at DESC, id LIMIT 200 OFFSET 0")
def page_audit(spark, sf_dir):
    rows = table(spark, sf_dir, "audit_log").select("id", "org_id", "action", "created_at").dropDuplicates(["id"])
    return service.page(rows, [F.desc("created_at"), F.asc("id")], 1000, 0, service.AUDIT_PAGE)


@query(f"{_RUNS} SELECT user_id, max(timestamp) AS timestamp, arg_max(id, struct_pack(t := timestamp, i := id)) AS id FROM r WHERE user_id IS NOT NULL GROUP BY user_id")
def latest_per_user(spark, sf_dir):
    return service.latest(runs_of(spark, sf_dir).where("user_id is not null").select("user_id", "timestamp", "id"), "user_id", "timestamp")


_PEOPLE = f"u AS (SELECT {fold('id')} AS user_id, any_value(email) AS email, any_value(nullif(trim(name), '')) AS name FROM users GROUP BY 1), o AS (SELECT {fold('id')} AS org_id, any_value(name) AS org, any_value(slug) AS slug, any_value({fold('owner_id')}) AS owner_id FROM organizations GROUP BY 1)"


def _people(spark, sf_dir):
    u = table(spark, sf_dir, "users").groupBy(fold_key(F.col("id")).alias("user_id")).agg(F.max("email").alias("email"), F.max(F.nullif(F.trim("name"), F.lit(""))).alias("name"))
    o = table(spark, sf_dir, "organizations").groupBy(fold_key(F.col("id")).alias("org_id")).agg(F.max("name").alias("org"), F.max("slug").alias("slug"), F.max(fold_key(F.col("owner_id"))).alias("owner_id"))
    return u, o


@query(f"{_RUNS}, {_PEOPLE}, m AS (SELECT DISTINCT org_id, user_id FROM r WHERE org_id IS NOT NULL) SELECT o.slug, u.email, coalesce(u.name, '') AS name, m.user_id = o.owner_id AS is_owner FROM m JOIN o USING (org_id) JOIN u USING (user_id)")
def org_members(spark, sf_dir):
    """Who works in which organization: members by their runs, joined with organizations and users."""
    u, o = _people(spark, sf_dir)
    m = runs_of(spark, sf_dir).where("org_id is not null").select("org_id", "user_id").distinct()
    return m.join(o, "org_id").join(u, "user_id").select("slug", "email", F.coalesce("name", F.lit("")).alias("name"), (F.col("user_id") == F.col("owner_id")).alias("is_owner"))


@query(f"WITH {_PEOPLE}, a AS (SELECT DISTINCT id, {fold('user_id')} AS user_id, action FROM audit_log) SELECT a.id, a.action, coalesce(u.email, '') AS email FROM a LEFT JOIN u USING (user_id)")
def audit_left_join(spark, sf_dir):
    u, _ = _people(spark, sf_dir)
    a = table(spark, sf_dir, "audit_log").select("id", fold_key(F.col("user_id")).alias("user_id"), "action").dropDuplicates(["id"])
    return a.join(u, "user_id", "left").select("id", "action", F.coalesce("email", F.lit("")).alias("email"))


@query("""WITH hooks AS (SELECT id AS hook, CASE plan WHEN 'team' THEN ['*'] WHEN 'pro' THEN ['run.completed', 'config.update', 'config.updated'] ELSE ['member.added'] END AS events, deleted_at IS NULL AS active FROM organizations),
ev AS (SELECT DISTINCT id, org_id, action FROM audit_log) SELECT ev.action, count(*) AS deliveries FROM ev JOIN hooks ON hooks.hook = ev.org_id WHERE active AND (list_contains(events, ev.action) OR list_contains(events, '*')) GROUP BY ALL""")
def webhook_match(spark, sf_dir):
    """Which audit entries would be delivered, with the hooks' event lists by plan."""
    plan = F.col("plan")
    events = F.when(plan == "team", F.array(F.lit("*"))).when(plan == "pro", F.array(*map(F.lit, ("run.completed", "config.update", "config.updated")))).otherwise(F.array(F.lit("member.added")))
    hooks = table(spark, sf_dir, "organizations").select(F.col("id").alias("org_id"), events.alias("events"), F.col("deleted_at").isNull().alias("active"))
    ev = table(spark, sf_dir, "audit_log").select("id", "org_id", "action").dropDuplicates(["id"])
    return ev.join(hooks, "org_id").where(service.wants(F.col("events"), F.col("action"), F.col("active"))).groupBy("action").agg(F.count("*").alias("deliveries"))


@query(histories_sql.SPEC_COUNTS)
def spec_counts(spark, sf_dir):
    """Requirements by status and the progress in percent, over every stored shape: arrays, envelopes, single objects and
    arrays stored as text, read as p3_found reads them; of an id delivered more than once the last result counts."""
    from tessella.plans import histories

    rows = histories._nested(spark, sf_dir, "spec_results").where("parent_id is not null")
    last = rows.groupBy("parent_id").agg(F.max(F.struct("sent_at", "items")).alias("last")).select(F.col("parent_id").alias("id"), F.explode("last.items").alias("x"))
    c = service.status_counts(last.where("x.json is not null").select("id", F.get_json_object("x.json", "$.status").alias("status")), "id")
    return c.withColumn("percent", service.progress(F.col("implemented"), F.col("requirements")))


@query("SELECT id, least(1.0, greatest(0.0, overall_score)) AS score, CAST(CASE WHEN total_requirements > 0 THEN floor(implemented_count * 100 / total_requirements) ELSE 0 END AS INT) AS percent FROM (SELECT DISTINCT id, overall_score, total_requirements, implemented_count FROM spec_results)")
def spec_progress(spark, sf_dir):
    rows = table(spark, sf_dir, "spec_results").dropDuplicates(["id"])
    return rows.select("id", service.clamp(F.col("overall_score")).alias("score"), service.progress(F.col("implemented_count"), F.col("total_requirements")).alias("percent"))


@query(f"{_RUNS} SELECT id, least(1.0, greatest(0.0, confidence_score)) AS confidence FROM r WHERE confidence_score IS NOT NULL")
def confidence_clamp(spark, sf_dir):
    return runs_of(spark, sf_dir).where("confidence_score is not null").select("id", service.clamp(F.col("confidence_score")).alias("confidence"))


@query("WITH k AS (SELECT DISTINCT id, sha256(email) AS h FROM users WHERE email IS NOT NULL) SELECT a.id, b.h FROM users a JOIN k b ON sha256(a.email) = b.h GROUP BY ALL")
def sha_key_lookup(spark, sf_dir):
    """Accounts found by the hash of a presented key (here: of the e-mail)."""
    users = table(spark, sf_dir, "users").where("email is not null")
    keys = users.select(F.sha2("email", 256).alias("h")).distinct()
    return users.select("id", F.sha2("email", 256).alias("h")).join(keys, "h").select("id", "h").distinct()


@query(f"{_USAGE}, add_all AS (SELECT user_id, month, analyses, files FROM u UNION ALL SELECT user_id, month, 1, 2 FROM u WHERE month >= '2025-07' UNION ALL SELECT user_id, '2026-01', 1, 1 FROM u WHERE month = '2025-12') SELECT user_id, month, CAST(sum(analyses) AS BIGINT) AS analyses, CAST(sum(coalesce(files, 0)) AS BIGINT) AS files FROM add_all GROUP BY ALL")
def upsert_usage(spark, sf_dir):
    usage = _usage(spark, sf_dir)
    change = usage.where("month >= '2025-07'").select("user_id", "month", F.lit(1).alias("analyses"), F.lit(2).alias("files")).union(usage.where("month = '2025-12'").select("user_id", F.lit("2026-01"), F.lit(1), F.lit(1)))
    return service.upsert_add(usage, change, ["user_id", "month"], ["analyses", "files"])


@query("SELECT id, max(received_at) AS received_at, arg_max(plan, struct_pack(r := received_at, p := plan, s := status)) AS plan, arg_max(status, struct_pack(r := received_at, p := plan, s := status)) AS status FROM subscriptions GROUP BY id")
def upsert_subscription(spark, sf_dir):
    rows = table(spark, sf_dir, "subscriptions").select("id", "received_at", "plan", "status")
    early = rows.where(F.month("received_at") < 7)
    return service.upsert_overwrite(early, rows.subtract(early), "id", "received_at")


@query("""WITH base AS (SELECT org_id, arg_max(version, snapshot_at) AS v FROM org_configs WHERE snapshot_at < TIMESTAMP '2025-07-01' GROUP BY 1), upd AS (SELECT DISTINCT org_id FROM org_configs WHERE snapshot_at >= TIMESTAMP '2025-07-01')
SELECT coalesce(b.org_id, u.org_id) AS org_id, CASE WHEN u.org_id IS NOT NULL THEN coalesce(b.v, 0) + 1 ELSE b.v END AS version FROM base b FULL JOIN upd u ON b.org_id = u.org_id""")
def upsert_org_config(spark, sf_dir):
    rows = table(spark, sf_dir, "org_configs")
    cut = F.lit("2025-07-01").cast("timestamp")
    base = rows.where(F.col("snapshot_at") < cut).groupBy("org_id").agg(F.max_by("version", "snapshot_at").alias("version"), F.max_by("config_yaml", "snapshot_at").alias("config_yaml"))
    upd = rows.where(F.col("snapshot_at") >= cut).groupBy("org_id").agg(F.max_by("config_yaml", "snapshot_at").alias("config_yaml"))
    return service.upsert_version(base, upd, "org_id", "config_yaml", "version").select("org_id", "version")


@query(f"""WITH gone AS (SELECT DISTINCT {fold('id')} AS id FROM users WHERE deleted_at IS NOT NULL),
t AS (SELECT 'runs' AS name, {fold('user_id')} AS k FROM runs UNION ALL SELECT 'spec_results', {fold('user_id')} FROM spec_results UNION ALL SELECT 'audit_log', {fold('user_id')} FROM audit_log UNION ALL SELECT 'subscriptions', {fold('user_id')} FROM subscriptions)
SELECT name, count(*) AS rows_left FROM t WHERE k IS NULL OR k NOT IN (SELECT id FROM gone) GROUP BY name""")
def cascade_delete(spark, sf_dir):
    """What is left of each table once removed accounts are deleted with all their rows."""
    gone = table(spark, sf_dir, "users").where("deleted_at is not null").select(fold_key(F.col("id")).alias("id"))
    tables = {n: (table(spark, sf_dir, n).select(fold_key(F.col("user_id")).alias("user_id")), "user_id") for n in ("runs", "spec_results", "audit_log", "subscriptions")}
    out = None
    for name, df in service.delete_cascade(tables, gone).items():
        one = df.groupBy(F.lit(name).alias("name")).agg(F.count("*").alias("rows_left"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"{_RUNS}, w AS (SELECT user_id, id, total_issues, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, id DESC) AS rn FROM r WHERE user_id IS NOT NULL), l AS (SELECT * FROM w WHERE rn <= 20) SELECT user_id, id, CAST(count(*) OVER (PARTITION BY user_id) - rn + 1 AS INT) AS place, CASE WHEN max(total_issues) OVER (PARTITION BY user_id) > 0 THEN round(total_issues / max(total_issues) OVER (PARTITION BY user_id), 6) ELSE 0.0 END AS height FROM l")
def last20_scaled(spark, sf_dir):
    return service.sparkline(runs_of(spark, sf_dir).where("user_id is not null"), "user_id", "timestamp", "total_issues")


@query(r"""WITH f AS (SELECT regexp_replace(replace(path, '\', '/'), '^(\./|/)+', '') AS path, count(*) AS size, max(file_id) AS changed FROM file_diffs WHERE status <> 'deleted' GROUP BY 1), old AS (SELECT path, count(*) AS size, max(file_id) AS changed FROM (SELECT regexp_replace(replace(path, '\', '/'), '^(\./|/)+', '') AS path, file_id FROM file_diffs WHERE status IN ('added', 'renamed')) GROUP BY 1)
SELECT NOT bool_or(f.path IS NULL OR old.path IS NULL OR f.size <> old.size OR f.changed <> old.changed) AS valid, count_if(f.path IS NULL OR old.path IS NULL OR f.size <> old.size OR f.changed <> old.changed) AS changed FROM f FULL JOIN old ON f.path = old.path""")
def index_cache_valid(spark, sf_dir):
    """Whether a cached listing still equals the tree, by a full join of the two."""
    from tessella.functions import paths

    diffs = table(spark, sf_dir, "file_diffs").select(paths.unix(F.col("path")).alias("path"), "file_id", "status")
    listing = lambda df: df.groupBy("path").agg(F.count("*").alias("size"), F.max("file_id").alias("changed"))
    return service.cache_valid(listing(diffs.where("status in ('added', 'renamed')")), listing(diffs.where("status <> 'deleted'")))


@query(f"{_RUNS}, s AS (SELECT DISTINCT id, {fold('user_id')} AS user_id FROM spec_results) SELECT u.id, coalesce(a.n, 0) AS runs, coalesce(b.n, 0) AS specs FROM (SELECT DISTINCT {fold('id')} AS id FROM users) u LEFT JOIN (SELECT user_id, count(*) AS n FROM r GROUP BY 1) a ON a.user_id = u.id LEFT JOIN (SELECT user_id, count(*) AS n FROM s GROUP BY 1) b ON b.user_id = u.id")
def export_bundle(spark, sf_dir):
    """How much each account's export holds; the documents themselves come from the operator as JSON."""
    users = table(spark, sf_dir, "users").select(fold_key(F.col("id")).alias("id")).distinct()
    specs = table(spark, sf_dir, "spec_results").select("id", fold_key(F.col("user_id")).alias("user_id")).dropDuplicates(["id"])
    bundle = service.export_bundle(users, {"runs": runs_of(spark, sf_dir).select("user_id", "id", "timestamp", "total_issues"), "specs": specs})
    n = lambda p: F.coalesce(F.json_array_length(F.get_json_object("bundle", p)), F.lit(0))
    return bundle.select("id", n("$.runs").alias("runs"), n("$.specs").alias("specs"))
