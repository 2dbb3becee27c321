"""Queries over logs, evidence, snapshots, texts and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.columns import log2_bucket
from lodestone.operators import evidence, imports, ledger
from lodestone.operators.context import CATEGORIES, category_of
from lodestone.sources import tables
from lodestone.sources.texts import references

NOW = 10_000_000


def incident_fold(spark, sf_dir):
    return ledger.fold_incidents(tables.incident_log(spark, sf_dir))


def debt_ages(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("opened"), F.when(F.col("o_orderstatus") == "F", F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 90).cast("int"))).alias("closed"))
    return ledger.debts(rows, F.lit("1998-08-02").cast("date"))


def recency(spark, sf_dir):
    rows = tables.evidence(spark, sf_dir).select("model", F.col("success").cast("long").alias("success"), F.col("recorded_at").alias("observed_at"))
    return evidence.recency_weighted(rows, NOW)


def by_group(spark, sf_dir):
    return evidence.confidence(tables.evidence(spark, sf_dir), ["category", "risk"])


def policy_benchmark(spark, sf_dir):
    return evidence.benchmark(tables.evidence(spark, sf_dir), "category", "risk")


def buckets(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").groupBy(log2_bucket(F.col("n_chars")).alias("bucket")).agg(F.count("*").alias("n"))


def latest_per_key(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return ledger.latest(rows, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def keyset_page(spark, sf_dir):
    return ledger.page(tables.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100, 50)


def project_health(spark, sf_dir):
    state = F.when(F.col("event_type") == "error", "failing").when(F.col("event_type") == "click", "pending").when(F.col("event_type") == "view", "stale")
    rows = tables.table(spark, sf_dir, "events").select(F.col("user_id").alias("project"), F.col("event_id").alias("item"), state.alias("state"))
    found = evidence.project_health(rows)
    return found.select("project", "failing", "pending", "stale", F.array_join(F.col("failing_items").cast("array<string>"), ",").alias("failing_items"), "status")


def worst_status(spark, sf_dir):
    status = F.when(F.col("event_type") == "error", "blocked").when(F.col("event_type") == "purchase", "degraded").when(F.col("event_type") == "signup", "optional").otherwise("ready")
    rows = tables.table(spark, sf_dir, "events").select("user_id", status.alias("status"))
    return rows.groupBy("user_id").agg(evidence.worst(rows).alias("status"))


def link_extract(spark, sf_dir):
    return tables.page_links(spark, sf_dir).groupBy("page_id").agg(F.count("*").alias("links"), F.countDistinct("href").alias("targets"))


def import_candidates(spark, sf_dir):
    """Each part's path imported without extension from each folder's index."""
    files = tables.table(spark, sf_dir, "part").select(tables.path_of("part", F.col("p_partkey").cast("long")).alias("path"))
    asked = tables.table(spark, sf_dir, "part").select(F.lit("src/part/index.ts").alias("importer"), F.concat(F.lit("./"), F.col("p_partkey").cast("string")).alias("specifier"))
    return imports.resolve_relative(asked, files).select("importer", "specifier", "target")


def longest_prefix(spark, sf_dir):
    """Customers' names to the longest registered prefix of them."""
    names = tables.table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"))
    prefixes = tables.table(spark, sf_dir, "customer").select(F.expr("substring(c_name, 1, 10 + int(c_custkey % 9))").alias("prefix")).distinct()
    return imports.longest_prefix(names, prefixes)


def text_references(spark, sf_dir):
    return references(tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), "text"), "THAT AND")


def task_categories(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").groupBy(category_of(F.col("text")).alias("category")).agg(F.count("*").alias("n"))


def context_budget(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "documents").select(F.col("source").alias("scope"), F.format_string("%09d", F.col("doc_id")).alias("path"), F.col("n_chars").alias("bytes"))
    return evidence.within_budget(rows, 12, 20_000).groupBy("scope", "verdict").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


def promotion(spark, sf_dir):
    return evidence.promotion(evidence.confidence(tables.evidence(spark, sf_dir), ["category", "risk"])).select("category", "risk", "eligible", "reason")


def snapshot_diff(spark, sf_dir):
    return ledger.snapshot_diff(*tables.snapshots(spark, sf_dir))


QUERIES = {
    "savings": lambda s, d: ledger.savings(tables.usage_log(s, d)),
    "incident_fold": incident_fold,
    "incident_rollup": lambda s, d: ledger.incident_rollup(incident_fold(s, d)),
    "debt_ages": debt_ages,
    "recency_weighted": recency,
    "wilson_by_group": by_group,
    "promotion": promotion,
    "policy_benchmark": policy_benchmark,
    "evidence_summary": lambda s, d: evidence.summary(tables.evidence(s, d), 360_000),
    "log2_buckets": buckets,
    "budget_24h": lambda s, d: evidence.spent(tables.evidence(s, d), 400_000),
    "latest_per_key": latest_per_key,
    "keyset_page": keyset_page,
    "project_health": project_health,
    "worst_status": worst_status,
    "snapshot_diff": snapshot_diff,
    "import_candidates": import_candidates,
    "longest_prefix": longest_prefix,
    "link_extract": link_extract,
    "text_references": text_references,
    "task_categories": task_categories,
    "context_budget": context_budget,
}
E = """e AS (SELECT d.doc_id AS outcome_id, source AS model, lang AS category, CASE d.doc_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS risk,
    CASE d.doc_id % 5 WHEN 0 THEN 'human' WHEN 1 THEN 'ci' ELSE 'machine' END AS provenance, quality AS success, toxic AS severe, d.doc_id * 3600 AS recorded_at, n_chars AS tokens FROM labels JOIN documents d ON d.doc_id = labels.doc_id)"""
Z = "1.959963984540054"


def wilson(s: str, n: str) -> str:
    p = f"({s} / {n}::DOUBLE)"
    return f"CASE WHEN {n} > 0 THEN greatest(0.0, ({p} + {Z} * {Z} / (2 * {n}) - {Z} * sqrt({p} * (1 - {p}) / {n} + {Z} * {Z} / (4 * {n}::DOUBLE * {n}))) / (1 + {Z} * {Z} / {n})) ELSE 0 END"


C = f"""{E}, c AS (SELECT category, risk, count(*) AS n, CAST(sum(success) AS BIGINT) AS successes, CAST(sum(severe) AS BIGINT) AS severe FROM e WHERE provenance <> 'human' GROUP BY ALL)"""
FOLD = """i AS (SELECT event_id AS ord, ts, CASE event_type WHEN 'error' THEN 'occurrence' WHEN 'view' THEN 'ack' ELSE 'resolve' END AS kind, user_id AS fingerprint, CASE user_id % 3 WHEN 0 THEN 'build' WHEN 1 THEN 'query' ELSE 'daemon' END AS class
        FROM events WHERE event_type IN ('error', 'view', 'signup')),
    f AS (SELECT fingerprint, max(class) AS class, count(*) FILTER (kind = 'occurrence') AS occurrences, min(ts) FILTER (kind = 'occurrence') AS first_seen, max(ts) FILTER (kind = 'occurrence') AS last_seen,
          arg_max(kind, ord) FILTER (kind <> 'occurrence') AS l, arg_max(ts, ord) FILTER (kind <> 'occurrence') AS lts FROM i GROUP BY fingerprint HAVING count(*) FILTER (kind = 'occurrence') > 0),
    fold AS (SELECT fingerprint, class, occurrences, first_seen, last_seen, CASE WHEN l IS NULL THEN 'open' WHEN l = 'ack' THEN 'acked' WHEN last_seen > lts THEN 'open' ELSE 'resolved' END AS state FROM f)"""
PART = "'src/part/' || CASE WHEN p_partkey % 10 = 0 THEN 'tests/' ELSE '' END || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.rs' ELSE '.go' END"
CATEGORY = "CASE " + " ".join(f"WHEN {' OR '.join(f"contains(t, '{w}')" for w in ws)} THEN '{c}'" for c, _, ws in CATEGORIES) + " ELSE 'unknown' END"
ORACLE_SQL = {
    "savings": """WITH u AS (SELECT event_type AS cmd, floor(value * 100)::BIGINT AS out, floor(value * 10)::BIGINT AS wall, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) * 100 AS b FROM events),
        t AS (SELECT cmd, greatest(0, 1000 + least(b // 4, 2000) - out // 4) AS t, floor(greatest(0.0, 30.0 - wall / 1000.0::DOUBLE) * 1000)::BIGINT AS ms FROM u)
        SELECT cmd, count(*) AS entries, CAST(sum(t) AS BIGINT) AS tokens, CAST(sum(ms) AS BIGINT) AS saved_ms FROM t GROUP BY ROLLUP (cmd)""",
    "incident_fold": f"WITH {FOLD} SELECT * FROM fold",
    "incident_rollup": f"WITH {FOLD} SELECT class, count(*) FILTER (state = 'open') AS open, count(*) FILTER (state = 'acked') AS acked, count(*) AS total FROM fold GROUP BY class",
    "debt_ages": """WITH d AS (SELECT CASE WHEN o_orderstatus <> 'F' THEN greatest(0, date_diff('day', o_orderdate::DATE, DATE '1998-08-02')) END AS age, CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 90 END AS latency FROM orders)
        SELECT count(age) AS open, count(latency) AS closed, CAST(list_sort(list(age) FILTER (age IS NOT NULL))[count(age) // 2 + 1] AS DOUBLE) AS median_age, CAST(list_sort(list(latency) FILTER (latency IS NOT NULL))[count(latency) // 2 + 1] AS DOUBLE) AS median_latency, max(age) AS oldest FROM d""",
    "recency_weighted": f"WITH {E}, w AS (SELECT model, success, greatest(1, round_even(1000 * pow(0.5, greatest(0, ({NOW} - recorded_at) // 86400) / 30.0::DOUBLE), 0)::BIGINT) AS w FROM e) SELECT model, count(*) AS n, CAST(sum(w) AS BIGINT) AS weight, CAST(sum(w * success * 1000) // sum(w) AS BIGINT) AS permille FROM w GROUP BY model",
    "wilson_by_group": f"WITH {C} SELECT *, round({wilson('successes', 'n')}, 9) AS lower FROM c",
    "promotion": f"""WITH {C}, r AS (SELECT category, risk, CASE WHEN risk = 'high' THEN 'risk' WHEN severe > 0 THEN 'severe_failure' WHEN risk = 'low' AND n < 50 OR risk = 'medium' AND n < 100 THEN 'too_few'
        WHEN risk = 'low' AND {wilson('successes', 'n')} < 0.90 OR risk = 'medium' AND {wilson('successes', 'n')} < 0.95 THEN 'bound' ELSE 'none' END AS reason FROM c) SELECT category, risk, reason = 'none' AS eligible, reason FROM r""",
    "policy_benchmark": f"WITH {E}, g AS (SELECT category, risk, count(*) AS n, sum(success) AS s FROM e GROUP BY ALL), p AS (SELECT category, CAST(sum(n) AS BIGINT) AS n, CAST(sum(s) AS BIGINT) AS successes, min(n) >= 30 AND sum(n) >= 100 AS sufficient FROM g GROUP BY category) SELECT category, n, successes, round({wilson('successes', 'n')}, 9) AS lower, sufficient FROM p",
    "evidence_summary": f"WITH {E} SELECT model, arg_max(success, outcome_id) FILTER (provenance <> 'human') AS latest_success, coalesce(bool_or(severe = 1), false) AS any_severe, count(*) FILTER (provenance = 'human') AS human, count(*) FILTER (recorded_at > 360000) AS since_review FROM e GROUP BY model",
    "log2_buckets": "SELECT CAST(CASE WHEN n_chars > 0 THEN least(20, floor(log2(n_chars)) + 1) ELSE 0 END AS INTEGER) AS bucket, count(*) AS n FROM documents GROUP BY 1",
    "budget_24h": f"WITH {E} SELECT CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens FROM e WHERE recorded_at > 400000 - 86400 AND recorded_at <= 400000",
    "latest_per_key": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "keyset_page": "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderkey > 100) > 50 AS has_more FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 50",
    "project_health": """WITH s AS (SELECT user_id AS project, event_id AS item, event_type AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS p FROM events),
        h AS (SELECT project, count(*) FILTER (t = 'error') AS failing, count(*) FILTER (t = 'click') AS pending, count(*) FILTER (t = 'view') AS stale, coalesce(string_agg(CAST(item AS VARCHAR), ',' ORDER BY item) FILTER (t = 'error' AND p <= 10), '') AS failing_items FROM s GROUP BY project)
        SELECT *, CASE WHEN failing > 0 THEN 'degraded' WHEN pending + stale > 0 THEN 'warning' ELSE 'ok' END AS status FROM h""",
    "worst_status": "SELECT user_id, ['ready', 'optional', 'degraded', 'blocked'][max(CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END)] AS status FROM events GROUP BY user_id",
    "snapshot_diff": """WITH n AS (SELECT 0.8 * count(*) AS a, 0.2 * count(*) AS b FROM documents) SELECT 'docs/' || doc_id || '.md' AS rel_path, CASE WHEN doc_id < b THEN 'removed' WHEN doc_id >= a THEN 'added' ELSE 'changed' END AS change FROM documents, n WHERE doc_id < b OR doc_id >= a OR doc_id % 5 = 0""",
    "import_candidates": f"SELECT 'src/part/index.ts' AS importer, './' || p_partkey AS specifier, CASE WHEN p_partkey % 4 = 1 AND p_partkey % 10 <> 0 THEN {PART} END AS target FROM part",
    "longest_prefix": """WITH p AS (SELECT DISTINCT substring(c_name, 1, 10 + CAST(c_custkey % 9 AS INTEGER)) AS prefix FROM customer)
        SELECT c_name AS name, arg_max(prefix, length(prefix)) AS prefix FROM customer LEFT JOIN p ON starts_with(c_name, prefix) GROUP BY c_name""",
    "link_extract": """SELECT page_id, CAST(len(h) AS BIGINT) AS links, CAST(len(list_distinct(h)) AS BIGINT) AS targets FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages) WHERE len(h) > 0""",
    "text_references": "SELECT file, CAST(i AS INTEGER) AS line, l[i] AS text FROM (SELECT doc_id AS file, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE contains(lower(l[i]), 'that and')",
    "context_budget": """WITH RECURSIVE d AS (SELECT source AS scope, n_chars AS bytes, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS p FROM documents),
        w(scope, p, n, size, verdict, bytes) AS (SELECT DISTINCT scope, 0::BIGINT, 0::BIGINT, 0::BIGINT, '', 0::BIGINT FROM d UNION ALL
            SELECT d.scope, d.p, w.n + CASE WHEN w.n < 12 AND w.size + d.bytes <= 20000 THEN 1 ELSE 0 END, w.size + CASE WHEN w.n < 12 AND w.size + d.bytes <= 20000 THEN d.bytes ELSE 0 END,
                CASE WHEN w.n >= 12 THEN 'max_files' WHEN w.size + d.bytes > 20000 THEN 'max_bytes' ELSE 'taken' END, d.bytes FROM w JOIN d ON d.scope = w.scope AND d.p = w.p + 1)
        SELECT scope, verdict, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM w WHERE p > 0 GROUP BY ALL""",
    "task_categories": f"WITH d AS (SELECT lower(regexp_replace(trim(text), '\\s+', ' ', 'g')) AS t FROM documents) SELECT {CATEGORY} AS category, count(*) AS n FROM d GROUP BY 1",
}
