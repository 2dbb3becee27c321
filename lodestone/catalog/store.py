"""Queries over evidence, authority and channel tables laid over the commerce tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.catalog.graph import LANGUAGE, G, commerce
from lodestone.catalog.logs import E, wilson
from lodestone.operators import authority, channel, evidence, health, ledger
from lodestone.sources import tables

AT, PREVIOUS, NEW, AGENT = 5, 3, 7, "agent_2"


def _table(spark, sf_dir, name):
    return tables.table(spark, sf_dir, name)


def _evidence(spark, sf_dir):
    """Orders are tasks, lineitems executions with an outcome each."""
    lines = _table(spark, sf_dir, "lineitem")
    execution = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("execution_id")
    tasks = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("task_id"), F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("risk"))
    executions = lines.select(execution, F.col("l_orderkey").cast("long").alias("task_id"), (F.col("l_suppkey") % 5).cast("long").alias("model"), F.col("l_returnflag").alias("effort")).distinct()
    provenance = F.element_at(F.array(*[F.lit(x) for x in ("machine_verified", "ci_imported", "human")]), (F.col("l_partkey") % 3 + 1).cast("int"))
    outcomes = lines.select(execution, provenance.alias("provenance"), (F.col("l_quantity") < 40).cast("int").alias("success"), (F.col("l_quantity") > 48).cast("int").alias("severe"))
    return outcomes, executions, tasks


def confidence_stats(spark, sf_dir):
    return authority.confidence_stats(*_evidence(spark, sf_dir))


def _bindings(spark, sf_dir):
    """Customers are snapshots bound to their nation; orders carry them to another one."""
    customer = _table(spark, sf_dir, "customer")
    bindings = customer.select(F.col("c_custkey").cast("long").alias("snapshot"), F.col("c_nationkey").cast("long").alias("identity"))
    snapshots = customer.select(F.col("c_custkey").cast("long").alias("snapshot"), (F.col("c_custkey") % 10).cast("long").alias("expires_at"))
    carries = _table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("long").alias("carry_id"), F.col("o_custkey").cast("long").alias("snapshot"), (F.col("o_orderkey") % 25).cast("long").alias("new_identity"))
    return bindings, carries, snapshots


def _approvals(spark, sf_dir):
    key = F.col("s_suppkey").cast("long")
    status = F.when(key % 4 == 0, "consumed").when(key % 4 == 1, "invalidated").otherwise("issued")
    rows = _table(spark, sf_dir, "supplier")
    approvals = rows.select(key.alias("approval_id"), (key % 7).alias("nonce"), (key % 11).alias("manifest"), status.alias("status"), (key % 100).alias("expires_at"), (key % 13).alias("reserved"))
    return approvals, rows.select(key.alias("approval_id"), F.col("s_nationkey").cast("long").alias("identity"))


def carry_forward(spark, sf_dir):
    bindings, carries, snapshots = _bindings(spark, sf_dir)
    return authority.carry_forward(bindings, carries, snapshots, F.lit(PREVIOUS).cast("long"), F.lit(NEW).cast("long"), AT)


def authority_targets(spark, sf_dir):
    bindings, carries, _ = _bindings(spark, sf_dir)
    approvals, bound = _approvals(spark, sf_dir)
    return authority.authority_targets(bindings, carries, bound, approvals, F.lit(PREVIOUS).cast("long"))


def invalidated_approvals(spark, sf_dir):
    approvals, bound = _approvals(spark, sf_dir)
    return authority.invalidated(approvals, bound, F.lit(PREVIOUS).cast("long")).select("approval_id", "status")


def approval_consumption(spark, sf_dir):
    """Each lineitem asks for an approval."""
    approvals, _ = _approvals(spark, sf_dir)
    key = F.col("l_suppkey").cast("long")
    requests = _table(spark, sf_dir, "lineitem").select((key + F.when(F.col("l_linenumber") == 7, 10**6).otherwise(0)).alias("approval_id"), (key % 7).alias("nonce"), (key % 11).alias("manifest"), (F.col("l_partkey") % 120).cast("long").alias("now"), F.when(F.col("l_returnflag") == "R", key % 13 + 1).otherwise(key % 13).alias("tokens"))
    spent = _table(spark, sf_dir, "nation").select(F.lit("reservation").alias("entry_type"), F.col("n_nationkey").cast("long").alias("tokens"))
    return authority.consumption(requests, approvals, spent, 310).groupBy("code").agg(F.count("*").alias("n"))


def pairwise_reveal(spark, sf_dir):
    verdict = F.when(F.col("o_orderstatus") == "F", "a").when(F.col("o_orderstatus") == "O", "b").when(F.col("o_orderkey") % 3 == 0, "tie")
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("comparison_id"), verdict.alias("verdict"), (F.col("o_custkey") % 2 == 0).alias("a_is_shadow"), F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("shadow"), F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("primary"))
    return authority.revealed(rows)


def retiring_profiles(spark, sf_dir):
    """Orders as profiles that retire on their date."""
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, F.to_date("o_orderdate")).alias("retires"))
    return rows.select("o_orderkey", authority.runway(F.col("retires"), F.lit(dt.date(1995, 6, 1))).alias("eligible"))


def anonymised(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 9).cast("long").alias("model"), F.col("l_returnflag").alias("effort"), F.col("l_linestatus").alias("category"), F.lit("low").alias("risk"), F.lit("ok").alias("outcome"), F.col("l_quantity").cast("long").alias("input"), F.col("l_partkey").cast("long").alias("output"), (F.col("l_orderkey") % 50).cast("long").alias("latency"), (F.col("l_orderkey") * 1000).cast("long").alias("recorded_at"))
    models = _table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("model"))
    out = authority.anonymised(rows, models)
    return out.groupBy(*out.columns).agg(F.count("*").alias("n"))


def identity_changes(spark, sf_dir):
    """Consecutive orders of a customer as identities of one runtime."""
    k = F.col("o_orderkey").cast("long")
    version = F.concat_ws(".", (k % 16 / 8).cast("int").cast("string"), (k % 4 / 2).cast("int").cast("string"), (k % 3).cast("string"))
    field = lambda n: (F.floor(k / n) % 2).cast("string")
    fields = {"version": version, "model_digest": field(32), "routing_policy_digest": field(64), "policy_version": field(128), "runtime_digest": (k % 5).cast("string")}
    kind = F.when(F.col("o_custkey") % 2 == 0, "local_cli").otherwise("endpoint")
    provider = F.when(k % 50 == 0, "y").otherwise("x")
    skills = F.array(F.lit("a"), field(256))
    who = F.struct(F.concat_ws("|", *fields.values(), skills.getItem(1)).alias("digest"), *[c.alias(n) for n, c in fields.items()], skills.alias("capabilities"), provider.alias("provider"), kind.alias("runtime_kind"))
    rows = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", who.alias("after"))
    rows = rows.withColumn("before", F.lag("after").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    return rows.select(authority.identity_change().alias("change")).where("change is not null").groupBy("change").agg(F.count("*").alias("n"))


def newest_events(spark, sf_dir):
    return authority.newest(_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts"), ["ts", "event_id"], 25).select("event_id", "user_id", "event_type")


def row_counts(spark, sf_dir):
    return authority.row_counts(**{t: _table(spark, sf_dir, t) for t in ("events", "orders", "customer")})


def _channel(spark, sf_dir):
    """Orders are rounds, lineitems the events of their states; a twelfth of the rounds supersede another."""
    k = F.col("o_orderkey").cast("long")
    agent = lambda c: F.concat(F.lit("agent_"), (c % 5).cast("string"))
    author = F.when(k % 10 != 0, agent(F.col("o_custkey")))
    rounds = _table(spark, sf_dir, "orders").select(k.alias("round"), author.alias("author"), F.array(agent(k), agent(k + 1)).alias("to"), F.when(k % 12 == 0, k + 10_000_000 * (k % 24 / 24 + k % 2).cast("int") - 1).alias("supersedes"), F.concat(F.lit("rounds/"), k.cast("string"), F.lit(".md")).alias("path"))
    status = F.element_at(F.array(*[F.lit(s) for s in ("delivered", "acknowledged", "done", "withdrawn")]), (F.col("l_partkey") % 4 + 1).cast("int"))
    events = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("round"), (F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")).cast("long").alias("seq"), status.alias("status"), agent(F.col("l_suppkey")).alias("actor"), F.col("l_shipdate").alias("at"), (F.col("l_partkey") % 97 == 0).alias("malformed")).distinct()
    files = _table(spark, sf_dir, "orders").where("o_orderkey % 17 <> 0").select(F.concat(F.lit("rounds/"), k.cast("string"), F.lit(".md")).alias("path"), (k % 19 != 0).alias("tracked"), (k % 23 == 0).alias("dirty"), (1 + F.when(k % 13 == 0, 1).otherwise(0)).cast("long").alias("commits"), author.alias("origin_author"), F.when(k % 29 == 0, F.lit("agent_x")).otherwise(agent(F.col("o_custkey"))).alias("origin_agent"))
    return rounds, events, files


def channel_inbox(spark, sf_dir):
    rounds, events, _ = _channel(spark, sf_dir)
    return channel.inbox(rounds, events, AGENT).select("round", "author")


def _report(spark, sf_dir):
    rounds, events, files = _channel(spark, sf_dir)
    return channel.report(rounds, events, files, F.lit(dt.datetime(1997, 1, 1)).cast("timestamp"), 3)


def channel_report(spark, sf_dir):
    return _report(spark, sf_dir).groupBy("verification", "status", "stalled").agg(F.count("*").alias("n"))


def channel_by_agent(spark, sf_dir):
    return channel.by_agent(_report(spark, sf_dir))


def channel_anomalies(spark, sf_dir):
    rounds, events, _ = _channel(spark, sf_dir)
    return channel.anomalies(rounds, events).groupBy("kind").agg(F.count("*").alias("n"))


def daemon_status(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project"), F.when(F.col("c_acctbal") < 0, "boom").alias("last_error"), (F.col("c_custkey") % 11 == 0).alias("needs_build"))
    return ledger.daemon_status(rows)


def observer_summary(spark, sf_dir):
    return ledger.observer_summary(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("target"), F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("reason")))


def local_day(spark, sf_dir):
    rows = ledger.on_local_day(_table(spark, sf_dir, "events"), "ts", "Asia/Tokyo", F.lit(dt.date(2024, 1, 10)))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"))


def node_languages(spark, sf_dir):
    return health.languages_of(commerce(spark, sf_dir).nodes)


def better_policy(spark, sf_dir):
    rows = tables.evidence(spark, sf_dir).withColumn("p", F.lit("p"))
    a, b = evidence.benchmark(rows.where("category = 'en'"), "p", "risk"), evidence.benchmark(rows.where("category <> 'en'"), "p", "risk")
    return evidence.better(a, b)


def stale_overlays(spark, sf_dir):
    k = F.col("c_custkey")
    was = F.create_map(F.lit("graph"), (k % 3).cast("string"), F.lit("engine"), (k % 5).cast("string"))
    now = F.create_map(F.lit("graph"), (k % 3).cast("string"), F.lit("engine"), F.when(k % 2 == 0, (k % 5).cast("string")).otherwise("new"))
    found = ledger.stale_overlays(_table(spark, sf_dir, "customer").select(k.alias("overlay"), was.alias("digests"), now.alias("current")))
    return found.select("overlay", F.array_join("changed", ",").alias("changed"))


def append_once(spark, sf_dir):
    """Events whose user placed no order are new; each user once."""
    new = _table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("key"))
    return ledger.append_once(_table(spark, sf_dir, "orders").where("o_custkey % 2 = 0").select(F.col("o_custkey").cast("long").alias("key")), new, ["key"])


QUERIES = {f.__name__: f for f in (
    confidence_stats, carry_forward, authority_targets, invalidated_approvals, approval_consumption, pairwise_reveal, retiring_profiles, anonymised, identity_changes, newest_events, row_counts,
    channel_inbox, channel_report, channel_by_agent, channel_anomalies, daemon_status, observer_summary, local_day, node_languages, better_policy, stale_overlays, append_once,
)}

BOUND = """bound AS (SELECT c_custkey AS snapshot, coalesce(now, c_nationkey) AS identity FROM customer LEFT JOIN
    (SELECT o_custkey, arg_max(o_orderkey % 25, o_orderkey) AS now FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) ON o_custkey = c_custkey)"""
STATUS = "CASE s_suppkey % 4 WHEN 0 THEN 'consumed' WHEN 1 THEN 'invalidated' ELSE 'issued' END"
CHANNEL = """r AS (SELECT o_orderkey AS round, CASE WHEN o_orderkey % 10 <> 0 THEN 'agent_' || o_custkey % 5 END AS author, ['agent_' || o_orderkey % 5, 'agent_' || (o_orderkey + 1) % 5] AS tos,
        CASE WHEN o_orderkey % 12 = 0 THEN o_orderkey + 10000000 * CAST(floor((o_orderkey % 24) / 24.0 + o_orderkey % 2) AS INTEGER) - 1 END AS supersedes, o_orderkey AS k, o_custkey FROM orders),
    e AS (SELECT DISTINCT l_orderkey AS round, l_linenumber * 10000000 + l_partkey AS seq, ['delivered', 'acknowledged', 'done', 'withdrawn'][l_partkey % 4 + 1] AS status, 'agent_' || l_suppkey % 5 AS actor, l_shipdate AS w, l_partkey % 97 = 0 AS malformed FROM lineitem),
    l AS (SELECT round, status, w FROM e QUALIFY row_number() OVER (PARTITION BY round ORDER BY seq DESC, w DESC, status DESC, actor DESC) = 1),
    rep AS (SELECT r.round, author, CASE WHEN k % 17 = 0 OR k % 19 = 0 THEN 'uncommitted' WHEN k % 23 = 0 THEN 'modified' WHEN author IS NULL THEN 'legacy' WHEN k % 13 = 0 THEN 'modified' WHEN k % 29 = 0 THEN 'discrepancy' ELSE 'verified' END AS verification,
        status, coalesce(status IN ('delivered', 'acknowledged') AND TIMESTAMP '1997-01-01' - w > INTERVAL 3 DAY, false) AS stalled, coalesce(status NOT IN ('done', 'withdrawn', 'superseded'), true) AS open FROM r LEFT JOIN l USING (round))"""
IDENTITY = """i AS (SELECT o_custkey, o_orderkey AS k, CASE WHEN o_custkey % 2 = 0 THEN 'l' ELSE 'e' END AS kind, CASE WHEN o_orderkey % 50 = 0 THEN 'y' ELSE 'x' END AS provider, (o_orderkey % 16) // 8 AS v0, (o_orderkey % 4) // 2 AS v1, o_orderkey % 3 AS v2,
        (o_orderkey // 32) % 2 AS md, (o_orderkey // 64) % 2 AS rp, (o_orderkey // 128) % 2 AS pv, o_orderkey % 5 AS rd, (o_orderkey // 256) % 2 AS cap FROM orders),
    j AS (SELECT *, lag(i) OVER (PARTITION BY o_custkey ORDER BY k) AS b FROM i)"""
ORACLE_SQL = {
    "confidence_stats": """WITH x AS (SELECT DISTINCT l_orderkey * 8 + l_linenumber AS execution_id, l_orderkey AS task_id, l_suppkey % 5 AS model, l_returnflag AS effort FROM lineitem),
        o AS (SELECT l_orderkey * 8 + l_linenumber AS execution_id, CAST(l_quantity < 40 AS INTEGER) AS success, CAST(l_quantity > 48 AS INTEGER) AS severe FROM lineitem WHERE l_partkey % 3 < 2)
        SELECT CAST(model AS BIGINT) AS model, effort, o_orderpriority AS category, o_orderstatus AS risk, count(*) AS n, CAST(sum(success) AS BIGINT) AS successes, CAST(sum(severe) AS BIGINT) AS severe
        FROM o JOIN x USING (execution_id) JOIN orders ON o_orderkey = task_id GROUP BY ALL""",
    "carry_forward": f"WITH {BOUND} SELECT snapshot, CAST({PREVIOUS} AS BIGINT) AS previous_identity, CAST({NEW} AS BIGINT) AS new_identity, CAST({AT} AS BIGINT) AS carried_at FROM bound WHERE identity = {PREVIOUS} AND snapshot % 10 > {AT}",
    "authority_targets": f"WITH {BOUND} SELECT 'snapshot' AS kind, CAST(snapshot AS VARCHAR) AS target FROM bound WHERE identity = {PREVIOUS} UNION ALL SELECT 'approval', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_nationkey = {PREVIOUS} AND {STATUS} = 'issued'",
    "invalidated_approvals": f"SELECT s_suppkey AS approval_id, CASE WHEN s_nationkey = {PREVIOUS} AND {STATUS} = 'issued' THEN 'invalidated' ELSE {STATUS} END AS status FROM supplier",
    "approval_consumption": f"""WITH q AS (SELECT l_suppkey AS k, l_linenumber = 7 AS lost, l_partkey % 120 AS now, l_suppkey % 13 + CASE l_returnflag WHEN 'R' THEN 1 ELSE 0 END AS tokens FROM lineitem)
        SELECT CASE WHEN lost THEN 'approval_missing' WHEN {STATUS} = 'invalidated' THEN 'approval_lifecycle_stale' WHEN {STATUS} <> 'issued' THEN 'approval_reused' WHEN now >= s_suppkey % 100 THEN 'approval_expired'
            WHEN tokens <> s_suppkey % 13 THEN 'approval_manifest_changed' WHEN (SELECT sum(n_nationkey) FROM nation) + tokens > 310 THEN 'budget_exhausted' ELSE 'consumed' END AS code, count(*) AS n FROM q JOIN supplier ON s_suppkey = k GROUP BY 1""",
    "pairwise_reveal": """SELECT * FROM (SELECT o_orderkey AS comparison_id, CASE WHEN o_orderstatus = 'F' THEN 'a' WHEN o_orderstatus = 'O' THEN 'b' WHEN o_orderkey % 3 = 0 THEN 'tie' END AS verdict,
        CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN NULL WHEN (o_orderstatus = 'F') = (o_custkey % 2 = 0) THEN 's' || o_orderkey ELSE 'p' || o_orderkey END AS winner, 'pairwise' AS provenance, false AS admissible FROM orders) WHERE verdict IS NOT NULL""",
    "retiring_profiles": "SELECT o_orderkey, o_orderkey % 9 = 0 OR CAST(o_orderdate AS DATE) > DATE '1995-07-01' AS eligible FROM orders",
    "anonymised": """WITH b AS (SELECT CAST(l_suppkey % 9 AS BIGINT) AS model, l_returnflag AS effort, l_linestatus AS category, 'low' AS risk, 'ok' AS outcome, l_orderkey * 1000 // 86400 AS day, CAST(l_quantity AS BIGINT) AS i, l_partkey AS o, l_orderkey % 50 AS l FROM lineitem WHERE l_suppkey % 9 IN (SELECT r_regionkey FROM region))
        SELECT model, effort, category, risk, outcome, day, CAST(CASE WHEN i > 0 THEN least(20, floor(log2(i)) + 1) ELSE 0 END AS INTEGER) AS input_bucket, CAST(CASE WHEN o > 0 THEN least(20, floor(log2(o)) + 1) ELSE 0 END AS INTEGER) AS output_bucket,
            CAST(CASE WHEN l > 0 THEN least(20, floor(log2(l)) + 1) ELSE 0 END AS INTEGER) AS latency_bucket, count(*) AS n FROM b GROUP BY ALL""",
    "identity_changes": f"""WITH {IDENTITY} SELECT CASE WHEN provider <> b.provider THEN 'boundary_invalid' WHEN (v0, v1, v2, md, rp, pv, rd, cap) = (b.v0, b.v1, b.v2, b.md, b.rp, b.pv, b.rd, b.cap) THEN 'unchanged' WHEN v0 <> b.v0 THEN 'major' WHEN v1 <> b.v1 THEN 'minor' WHEN md <> b.md THEN 'model_digest'
        WHEN rp <> b.rp THEN 'routing_policy' WHEN cap <> b.cap THEN 'capability' WHEN pv <> b.pv THEN 'policy' WHEN rd <> b.rd AND kind <> 'l' THEN 'endpoint' WHEN v2 <> b.v2 THEN 'patch' WHEN rd <> b.rd THEN 'hash_only' ELSE 'unclassified' END AS change, count(*) AS n FROM j WHERE b IS NOT NULL GROUP BY 1""",
    "newest_events": "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 25",
    "row_counts": "SELECT 'events' AS name, count(*) AS n FROM events UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'customer', count(*) FROM customer",
    "channel_inbox": f"WITH {CHANNEL} SELECT round, author FROM r WHERE list_contains(tos, '{AGENT}') AND NOT EXISTS (SELECT 1 FROM e WHERE e.round = r.round AND status = 'delivered' AND actor = '{AGENT}')",
    "channel_report": f"WITH {CHANNEL} SELECT verification, status, stalled, count(*) AS n FROM rep GROUP BY ALL",
    "channel_by_agent": f"WITH {CHANNEL} SELECT coalesce(author, '(legacy)') AS agent, count(*) AS posted, count(*) FILTER (open) AS open FROM rep GROUP BY 1",
    "channel_anomalies": f"""WITH {CHANNEL}, a AS (SELECT 'malformed_status' AS kind FROM e JOIN r USING (round) WHERE malformed UNION ALL
        SELECT 'status_actor_not_participant' FROM e JOIN r USING (round) WHERE NOT malformed AND NOT (coalesce(actor = author, false) OR list_contains(tos, actor)) UNION ALL
        SELECT 'done_without_delivery' FROM (SELECT round, min(seq) FILTER (status = 'done') AS d, min(seq) FILTER (status = 'delivered') AS g FROM e GROUP BY round) WHERE d IS NOT NULL AND (g IS NULL OR g > d) AND round IN (SELECT round FROM r) UNION ALL
        SELECT 'supersedes_missing' FROM r WHERE supersedes IS NOT NULL AND supersedes NOT IN (SELECT round FROM r)) SELECT kind, count(*) AS n FROM a GROUP BY kind""",
    "daemon_status": "SELECT count(*) AS projects, count(*) FILTER (c_acctbal >= 0 AND c_custkey % 11 <> 0) AS healthy, count(*) FILTER (c_acctbal < 0) AS failing, count(*) FILTER (c_custkey % 11 = 0) AS pending, CASE WHEN count(*) FILTER (c_acctbal < 0) = 0 THEN 'ok' ELSE 'degraded' END AS status FROM customer",
    "observer_summary": "SELECT state, reason, n, CAST(sum(n) OVER (PARTITION BY state) AS BIGINT) AS of_state FROM (SELECT o_orderstatus AS state, o_orderpriority AS reason, count(*) AS n FROM orders GROUP BY ALL)",
    "local_day": "SELECT event_type, count(*) AS n FROM events WHERE CAST(ts + INTERVAL 9 HOUR AS DATE) = DATE '2024-01-10' GROUP BY 1",
    "node_languages": f"WITH {G} SELECT DISTINCT {LANGUAGE} AS language FROM nodes WHERE {LANGUAGE} <> 'other'",
    "better_policy": f"""WITH {E}, g AS (SELECT category = 'en' AS c, risk, count(*) AS n, sum(success) AS s FROM e GROUP BY ALL), p AS (SELECT c, sum(n) AS n, sum(s) AS s, min(n) >= 30 AND sum(n) >= 100 AS ok FROM g GROUP BY c),
        w AS (SELECT c, ok, round({wilson('s', 'n')}, 9) AS lower FROM p) SELECT CASE WHEN a.ok AND b.ok AND a.lower > b.lower THEN 'candidate' ELSE 'baseline' END AS winner FROM w a, w b WHERE a.c AND NOT b.c""",
    "stale_overlays": "SELECT c_custkey AS overlay, 'engine' AS changed FROM customer WHERE c_custkey % 2 <> 0",
    "append_once": "SELECT DISTINCT user_id AS key FROM events WHERE user_id NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 2 = 0)",
}
