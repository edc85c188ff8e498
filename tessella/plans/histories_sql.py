"""DuckDB SQL equal to the queries of problems 1, 3, 6 and 7."""

_FOLD = "nullif(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '')"
_LAYOUT = "regexp_replace(regexp_replace(regexp_replace(config_yaml, '\\r\\n?', chr(10), 'g'), '[ \\t]+(\\n|\\z)', '\\1', 'g'), '\\n+\\z', '')"


def fold(c: str) -> str:
    return _FOLD.format(c=c)


P1 = rf"""
WITH held AS (
  SELECT org_id, snapshot_at, arg_max(struct_pack(y := {_LAYOUT}, v := version), exported_at) AS s
  FROM org_configs WHERE org_id IS NOT NULL AND snapshot_at IS NOT NULL GROUP BY ALL
), cal AS (
  SELECT snapshot_at, lag(snapshot_at) OVER (ORDER BY snapshot_at) AS before FROM (SELECT DISTINCT snapshot_at FROM org_configs WHERE snapshot_at IS NOT NULL)
), org AS (
  SELECT h.org_id, h.snapshot_at FROM held h JOIN cal USING (snapshot_at) LEFT JOIN held p ON p.org_id = h.org_id AND p.snapshot_at = cal.before
  WHERE p.org_id IS NULL OR h.s.y IS DISTINCT FROM p.s.y OR h.s.v IS DISTINCT FROM p.s.v
), subs AS (
  SELECT id, updated_at, arg_max(struct_pack(p := lower(trim(plan)), s := lower(trim(status))), received_at) AS s
  FROM subscriptions WHERE id IS NOT NULL AND updated_at IS NOT NULL GROUP BY ALL
), sub AS (
  SELECT *, lag(updated_at) OVER w AS before, lag(s) OVER w AS prior FROM subs WINDOW w AS (PARTITION BY id ORDER BY updated_at)
)
SELECT 'org_config' AS entity, org_id AS entity_id, strftime(snapshot_at, '%Y-%m-%d %H:%M:%S') AS valid_from FROM org
UNION ALL
SELECT 'subscription', id, strftime(updated_at, '%Y-%m-%d %H:%M:%S') FROM sub
WHERE before IS NULL OR s.p IS DISTINCT FROM prior.p OR s.s IS DISTINCT FROM prior.s
"""

#: Beliefs of the ledger: every assertion opens a period, and closes that of its predecessor, as known when it was recorded.
P1_LEDGER = """
WITH a AS (
  SELECT id, updated_at AS v, received_at AS r, max(struct_pack(p := lower(trim(plan)), s := lower(trim(status)))) AS st
  FROM subscriptions WHERE id IS NOT NULL AND updated_at IS NOT NULL AND received_at IS NOT NULL GROUP BY ALL
), links AS (
  SELECT x.id, x.v, x.r, max(y.v) FILTER (y.v < x.v) AS pred, min(y.v) FILTER (y.v > x.v) AS succ
  FROM a x LEFT JOIN a y ON y.id = x.id AND y.r <= x.r GROUP BY ALL
), pieces AS (
  SELECT id, place, recorded, min(ends) AS ends FROM (
    SELECT id, v AS place, r AS recorded, succ AS ends FROM links UNION ALL SELECT id, pred, r, v FROM links WHERE pred IS NOT NULL
  ) GROUP BY ALL
)
SELECT p.id, p.place AS valid_from, p.ends AS valid_to, p.recorded AS recorded_from, lead(p.recorded) OVER (PARTITION BY p.id, p.place ORDER BY p.recorded) AS recorded_to, h.st.p AS plan, h.st.s AS status
FROM pieces p ASOF JOIN a h ON h.id = p.id AND h.v = p.place AND p.recorded >= h.r
"""

_REFS = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, id AS record_id, '{f}' AS ref_field, '{k}' AS kind, {fold(f)} AS key, created_at AS at_time FROM {t}"
    for t, f, k in (("runs", "user_id", "user"), ("runs", "org_id", "org"), ("audit_log", "user_id", "user"), ("spec_results", "user_id", "user"))
)
_ORPHANS = f"""
WITH refs AS (SELECT DISTINCT * FROM ({_REFS}) WHERE key IS NOT NULL AND record_id IS NOT NULL),
parents AS (
  SELECT 'user' AS kind, {fold('id')} AS key, max(created_at) AS created_at, max(deleted_at) AS deleted_at FROM users GROUP BY 2
  UNION ALL SELECT 'org', {fold('id')}, max(created_at), max(deleted_at) FROM organizations GROUP BY 2
), judged AS (
  SELECT table_name, record_id, ref_field, r.at_time, CASE WHEN p.key IS NULL THEN 'missing' WHEN p.deleted_at <= r.at_time THEN 'deleted' WHEN p.created_at > r.at_time THEN 'not yet there' END AS reason
  FROM refs r LEFT JOIN parents p ON p.kind = r.kind AND p.key = r.key
)
"""
P6 = _ORPHANS + "SELECT DISTINCT table_name, record_id, ref_field FROM judged WHERE reason IS NOT NULL"
P6_MONTH = _ORPHANS + "SELECT table_name, ref_field, reason, strftime(date_trunc('month', at_time), '%Y-%m-%d') AS period, count(*) AS orphans FROM judged WHERE reason IS NOT NULL GROUP BY ALL"

P7 = f"""
WITH once AS (SELECT id, any_value({fold('user_id')}) AS user_id, any_value(CAST(timestamp AS DATE)) AS d, any_value(coalesce(errors, 0)) AS errors FROM runs GROUP BY id),
daily AS (SELECT user_id, d, count(*) AS runs, sum(errors) AS errors FROM once WHERE user_id IS NOT NULL AND d IS NOT NULL GROUP BY ALL),
days AS (SELECT CAST(unnest(generate_series(min(CAST(timestamp AS DATE)), max(CAST(timestamp AS DATE)), INTERVAL 1 DAY)) AS DATE) AS d FROM runs),
dense AS (
  SELECT u.user_id, days.d, coalesce(x.runs, 0) AS runs, coalesce(x.errors, 0) AS errors
  FROM (SELECT DISTINCT user_id FROM daily) u CROSS JOIN days LEFT JOIN daily x ON x.user_id = u.user_id AND x.d = days.d
), totals AS (
  SELECT *, sum(runs) OVER w7 AS r7, sum(errors) OVER w7 AS e7, sum(runs) OVER w30 AS r30, sum(errors) OVER w30 AS e30 FROM dense
  WINDOW w7 AS (PARTITION BY user_id ORDER BY d RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW),
         w30 AS (PARTITION BY user_id ORDER BY d RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW)
)
SELECT user_id, d AS day, CAST(runs AS BIGINT) AS runs, CAST(errors AS BIGINT) AS errors,
  CAST(r7 AS BIGINT) AS runs_7d, round(r7 / 7, 6) AS avg_runs_7d, CAST(e7 AS BIGINT) AS errors_7d, round(e7 / 7, 6) AS avg_errors_7d,
  CAST(r30 AS BIGINT) AS runs_30d, round(r30 / 30, 6) AS avg_runs_30d, CAST(e30 AS BIGINT) AS errors_30d, round(e30 / 30, 6) AS avg_errors_30d
FROM totals
"""

_BLANKS = "E' \\t\\r\\n'"


def _held(c: str) -> str:
    """What a JSON text holds that may be a string inside JSON."""
    return f"CASE WHEN json_valid({c}) AND json_type({c}) = 'VARCHAR' THEN trim(json_extract_string({c}, '$'), {_BLANKS}) ELSE {c} END"


def _enveloped(names: list[str], only: bool) -> str:
    member = " ".join(f"WHEN json_exists(t, '$.{n}') THEN trim(CAST(json_extract(t, '$.{n}') AS VARCHAR), {_BLANKS})" for n in names)
    return f"CASE WHEN json_valid(t) AND json_type(t) = 'OBJECT' THEN CASE {member} ELSE {'NULL' if only else 't'} END ELSE t END"


def _listed(c: str) -> str:
    return f"CASE WHEN json_valid({c}) AND json_type({c}) = 'ARRAY' THEN CAST(json_extract({c}, '$[*]') AS VARCHAR[])"


def _source(name: str, key: str, sent: str, text: str, member: str, record: bool) -> str:
    """CTEs that end in ``name``_i: source_table, parent_id, item_no, e (the text of one element of the last delivery)."""
    steps = [_held("t"), _held("t"), *([_enveloped(["result"], False), _held("t")] if record else []), _enveloped([member], record), _held("t")]
    out = [f"{name}_0 AS (SELECT CAST({key} AS VARCHAR) AS parent_id, {sent} AS sent_at, trim({text}, {_BLANKS}) AS t FROM {name} WHERE {key} IS NOT NULL)"]
    out += [f"{name}_{k + 1} AS (SELECT parent_id, sent_at, {step} AS t FROM {name}_{k})" for k, step in enumerate(steps)]
    out.append(f"{name}_e AS (SELECT parent_id, arg_max({_listed('t')} WHEN json_valid(t) AND json_type(t) = 'OBJECT' AND t <> '{{}}' THEN [t] END, sent_at) AS els FROM {name}_{len(steps)} GROUP BY parent_id)")
    out.append(f"{name}_i AS (SELECT '{name}' AS source_table, parent_id, CAST(generate_subscripts(els, 1) - 1 AS INT) AS item_no, unnest(els) AS e FROM {name}_e)")
    return ", ".join(out)


_SOURCES = (("runs", "id", "created_at", "issues", "issues", False), ("spec_results", "id", "created_at", "result_json", "requirements", False), ("analysis_results", "record_id", "received_at", "payload", "issues", True))
_MEMBERS = ", ".join(f"CASE WHEN json_type(e, '$.{n}') <> 'NULL' THEN CAST(json_extract(e, '$.{n}') AS VARCHAR) END" for n in ("related_files", "relatedFiles"))
_NESTED = f"""
WITH {", ".join(_source(*x) for x in _SOURCES)},
every AS ({" UNION ALL ".join(f"SELECT * FROM {x[0]}_i" for x in _SOURCES)}),
items AS (SELECT * FROM (SELECT * REPLACE ({_held("e")} AS e) FROM every) WHERE json_valid(e) AND json_type(e) = 'OBJECT' AND e <> '{{}}'),
members AS (SELECT *, coalesce({_MEMBERS}) AS f FROM items),
lists AS (SELECT *, {_listed("f")} WHEN f <> '' AND f <> '{{}}' THEN [f] END AS ls FROM (SELECT * REPLACE ({_held("f")} AS f) FROM members)),
every_leaf AS (SELECT source_table, parent_id, item_no, e, CAST(generate_subscripts(ls, 1) - 1 AS INT) AS leaf_no, unnest(ls) AS l FROM lists),
leaves AS (SELECT * FROM (SELECT * REPLACE (CASE WHEN json_valid(l) AND json_type(l) = 'NULL' THEN NULL ELSE {_held("l")} END AS l) FROM every_leaf) WHERE l IS NOT NULL AND l <> '' AND l <> '{{}}')
"""
P3 = _NESTED + "SELECT source_table, parent_id, item_no, CAST(-1 AS INT) AS leaf_no FROM items UNION ALL SELECT source_table, parent_id, item_no, leaf_no FROM leaves"
P3_ITEMS = _NESTED + "SELECT source_table, parent_id, item_no, e AS json FROM items"
P3_LEAVES = _NESTED + "SELECT source_table, parent_id, item_no, leaf_no, l AS leaf FROM leaves"
P3_PATHS = _NESTED + """, n AS (SELECT parent_id, item_no, count(*) AS n FROM leaves WHERE source_table = 'runs' GROUP BY ALL)
SELECT json_extract_string(e, '$.category') AS category, count(*) AS issues, CAST(coalesce(sum(n), 0) AS BIGINT) AS related_files FROM items LEFT JOIN n USING (parent_id, item_no) WHERE source_table = 'runs' GROUP BY 1"""

SPEC_COUNTS = _NESTED + """, told AS (SELECT parent_id AS id, json_extract_string(e, '$.status') AS status FROM items WHERE source_table = 'spec_results')
SELECT id, count_if(status = 'implemented') AS implemented, count_if(status = 'partial') AS partial, count_if(status = 'missing') AS missing, count_if(status IN ('implemented', 'partial')) AS anchored, count(*) AS requirements,
  CAST(floor(count_if(status = 'implemented') * 100 / count(*)) AS INT) AS percent FROM told GROUP BY id"""

ORACLE = {"p1_found": P1, "p1_subscription_ledger": P1_LEDGER, "p1_merged_ledger": P1_LEDGER, "p3_found": P3, "p3_items": P3_ITEMS, "p3_leaves": P3_LEAVES, "p3_related_paths": P3_PATHS, "p6_found": P6, "p6_orphans_per_month": P6_MONTH, "p7_rolling": P7}
