"""The queries of this subpackage and the SQL that they are checked against."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import leakage, percentiles, provenance, secrets, tokenize, toxicity
from tessella.functions.keys import fold_key
from tessella.sources.tables import table


def _owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, owner): who owns the repository of a run; runs without a repository have none."""
    owner = F.nullif(F.regexp_extract(F.lower("repo_url"), r"([^/:]+)/[^/]+?(?:\.git)?/?$", 1), F.lit(""))
    return table(spark, sf_dir, "runs").select(F.col("id").alias("run_id"), owner.alias("owner")).where("run_id is not null and owner is not null").dropDuplicates(["run_id"])


RANKS = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def _run_summary(spark: SparkSession, sf_dir: str, digits: int | None = None) -> DataFrame:
    """(org_id, day, metric, value, n) of all runs, each counted once; days can be computed apart and merged."""
    run = F.coalesce("id", F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string")))
    runs = table(spark, sf_dir, "runs").select(run.alias("run"), fold_key(F.col("org_id")).alias("org_id"), F.to_date("timestamp").alias("day"), "duration_ms", "total_issues").dropDuplicates(["run"])
    groups = {"org_id": F.col("org_id"), "day": F.col("day")}
    return percentiles.summarise(runs, groups, {"duration_ms": F.col("duration_ms"), "total_issues": F.col("total_issues")}, digits)


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles per organization (null: runs of none) from the merged summaries of all days."""
    over_days = percentiles.roll_up(_run_summary(spark, sf_dir), ["org_id"])
    return percentiles.percentiles(over_days, ["org_id"], RANKS)


def p2_day_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mergeable form: per organization and day each value, to 10 binary digits (relative error below 0.2 %), with its count."""
    return _run_summary(spark, sf_dir, 10)


def p2_merged_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of two sets of days that are summarised apart and merged by their summaries alone: those of all days."""
    summary = _run_summary(spark, sf_dir)
    odd = F.coalesce(F.datediff("day", F.lit("1970-01-01").cast("date")) % 2 == 1, F.lit(False))
    apart = [percentiles.roll_up(summary.where(c), ["org_id"]) for c in (odd, ~odd)]
    return percentiles.percentiles(percentiles.merge(*apart), ["org_id"], RANKS)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.unwritten_files(table(spark, sf_dir, "file_diffs"), _owners(spark, sf_dir)).select("file_id")


def p4_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files of each kind nobody wrote."""
    return provenance.unwritten_files(table(spark, sf_dir, "file_diffs"), _owners(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("files"))


def p4_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files per evidence: the rules (name, header, layout, bytes) and the Merkle hashes (subtree, shared file)."""
    return provenance.weighed(table(spark, sf_dir, "file_diffs"), _owners(spark, sf_dir)).groupBy("evidence").agg(F.count_distinct("file_id").alias("files"))


def p4_shared_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of the trees that several owners hold alike, by the Merkle hashes alone."""
    return provenance.shared_files(provenance.shown_files(table(spark, sf_dir, "file_diffs")), _owners(spark, sf_dir))


def p4_shared_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files below folders of any number of files that two owners hold alike, by the Merkle hashes alone."""
    return provenance.shared_subtrees(table(spark, sf_dir, "file_diffs"), _owners(spark, sf_dir), 1, 2)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "file_diffs")).select("file_id", "hunk_no", "line_no").distinct()


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that hold credentials, with the credentials masked."""
    return secrets.find_secrets(table(spark, sf_dir, "file_diffs"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.encode(table(spark, sf_dir, "documents"))


def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language: documents, and those whose ids decode to their text again (to an empty one where it is null)."""
    own = table(spark, sf_dir, "documents").select(F.struct("lang", "text").alias("own"), "text")
    back = tokenize.decode(tokenize.encode(own, key="own"), key="own").select("own.*", F.col("text").alias("decoded"))
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return back.groupBy("lang").agg(F.count("*").alias("documents"), F.count_if(same).alias("same"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).where("windows > 0").select("doc_id", "item_id")


def p9_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each item with a leak: in how many documents, and the most windows that one of them shares."""
    found = leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).where("windows > 0")
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), F.max("windows").alias("most_windows"))


def _scored(spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = ()) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    chain = toxicity.fit(toxicity.labelled_texts(documents, table(spark, sf_dir, "moderation_labels")))
    return toxicity.score_documents(documents, chain, extra)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where(F.col("score") >= toxicity.THRESHOLD).select("doc_id").distinct()


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its score and the probabilities of the chain's categories."""
    return _scored(spark, sf_dir)


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of offensive documents per source."""
    return toxicity.rates(_scored(spark, sf_dir, ("source",)))


QUERIES = {
    "p2_percentiles": p2_percentiles, "p2_day_summaries": p2_day_summaries, "p2_merged_days": p2_merged_days,
    "p4_found": p4_found, "p4_kinds": p4_kinds, "p4_evidence": p4_evidence, "p4_shared_files": p4_shared_files, "p4_shared_subtrees": p4_shared_subtrees, "p5_found": p5_found, "p5_redacted": p5_redacted, "p8_ids": p8_ids, "p8_round_trip": p8_round_trip, "p9_found": p9_found, "p9_leaked_items": p9_leaked_items,
    "p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates,
}
_ONCE = """
WITH once AS (
  SELECT id, any_value(nullif(lower(regexp_replace(org_id, '^\\s+|\\s+$', '', 'g')), '')) AS org_id, any_value(duration_ms) AS duration_ms, any_value(total_issues) AS total_issues FROM runs GROUP BY id
), vals AS (
  SELECT org_id, 'duration_ms' AS metric, CAST(duration_ms AS DOUBLE) AS value FROM once WHERE duration_ms IS NOT NULL
  UNION ALL SELECT org_id, 'total_issues', CAST(total_issues AS DOUBLE) FROM once WHERE total_issues IS NOT NULL
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY org_id, metric ORDER BY value) AS i, count(*) OVER (PARTITION BY org_id, metric) AS n FROM vals
)
"""
_P2 = _ONCE + """
SELECT p.org_id, p.metric, CAST(r.rank AS DOUBLE) AS rank, p.value, p.n AS rows
FROM placed p JOIN (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]) AS rank) r ON p.i = greatest(CAST(ceil(CAST(r.rank AS DOUBLE) * p.n - 1e-9) AS BIGINT), 1)
"""
_P2_DAYS = """
WITH once AS (
  SELECT id, any_value(nullif(lower(regexp_replace(org_id, '^\\s+|\\s+$', '', 'g')), '')) AS org_id, any_value(CAST(timestamp AS DATE)) AS day, any_value(duration_ms) AS duration_ms, any_value(total_issues) AS total_issues FROM runs GROUP BY id
), vals AS (
  SELECT org_id, day, 'duration_ms' AS metric, CAST(duration_ms AS DOUBLE) AS v FROM once WHERE duration_ms IS NOT NULL
  UNION ALL SELECT org_id, day, 'total_issues', CAST(total_issues AS DOUBLE) FROM once WHERE total_issues IS NOT NULL
), cut AS (
  SELECT org_id, day, metric, CASE WHEN v = 0 THEN 0.0 ELSE sign(v) * floor(abs(v) / pow(2.0, floor(log2(abs(v))) - 9)) * pow(2.0, floor(log2(abs(v))) - 9) END AS value FROM vals
)
SELECT org_id, day, metric, value, count(*) AS n FROM cut GROUP BY ALL
"""
_SHOWN = r"""
WITH owners AS (SELECT id AS run_id, any_value(nullif(regexp_extract(lower(repo_url), '([^/:]+)/[^/]+?(?:\.git)?/?$', 1), '')) AS owner FROM runs WHERE id IS NOT NULL AND repo_url IS NOT NULL GROUP BY id),
shown AS (
  SELECT file_id, run_id, regexp_replace(replace(path, '\', '/'), '^(\./|/)+', '') AS path,
    array_to_string(list_transform(list_filter(flatten(list_transform(hunks, lambda h: h.lines)), lambda x: x.type IS DISTINCT FROM 'removed'), lambda x: coalesce(x.content, '')), chr(10)) AS text
  FROM file_diffs WHERE file_id IS NOT NULL AND run_id IS NOT NULL AND path IS NOT NULL
), told AS (SELECT * FROM shown WHERE length(text) > 0)
"""
_P4_FILES = _SHOWN + ", common AS (SELECT text FROM told JOIN owners USING (run_id) WHERE owner IS NOT NULL GROUP BY text HAVING count(DISTINCT owner) >= 2) SELECT DISTINCT file_id FROM told WHERE text IN (SELECT text FROM common)"
_P4_TREES = _SHOWN + """, up AS (
  SELECT file_id, run_id, path, text, unnest(range(1, len(string_split(path, '/')))) AS n FROM told
), placed AS (
  SELECT file_id, run_id, text, array_to_string(string_split(path, '/')[1:n], '/') AS folder, array_to_string(string_split(path, '/')[n + 1:], '/') AS rest FROM up
), trees AS (
  SELECT run_id, folder, list(DISTINCT struct_pack(rest, text) ORDER BY struct_pack(rest, text)) AS tree FROM placed GROUP BY ALL
), common AS (SELECT tree FROM trees JOIN owners USING (run_id) WHERE owner IS NOT NULL GROUP BY tree HAVING count(DISTINCT owner) >= 2)
SELECT DISTINCT p.file_id FROM placed p JOIN trees t USING (run_id, folder) JOIN owners o USING (run_id) WHERE o.owner IS NOT NULL AND p.folder <> '' AND t.tree IN (SELECT tree FROM common)"""
_P9 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
dw AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS run FROM d),
iw AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS run FROM i)
"""
_P9_ITEMS = _P9 + """, pairs AS (
  SELECT i.item_id, d.doc_id, count(*) AS windows FROM (SELECT doc_id, any_value(w) AS w FROM d GROUP BY doc_id) x, LATERAL (SELECT x.doc_id, unnest(list_transform(range(1, len(x.w) - 10), lambda k: array_to_string(x.w[k:k + 11], ' '))) AS run) d
  JOIN (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS run FROM i) i USING (run) GROUP BY ALL
) SELECT item_id, count(*) AS documents, max(windows) AS most_windows FROM pairs GROUP BY item_id"""
_P9 += "SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (run)"
#: SQL can't express the other queries; they are tested against brute force, a reference tokenizer and held-out labels.
ORACLE: dict[str, str] = {"p2_percentiles": _P2, "p2_merged_days": _P2, "p2_day_summaries": _P2_DAYS, "p4_shared_files": _P4_FILES, "p4_shared_subtrees": _P4_TREES, "p8_round_trip": "SELECT lang, count(*) AS documents, count(*) AS same FROM documents GROUP BY lang", "p9_found": _P9, "p9_leaked_items": _P9_ITEMS}
