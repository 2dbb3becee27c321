"""State of an evidence store: bindings carried forward, approvals, budgets, verdicts, identities.

Every operator maps tables to tables: what a transaction would change comes back as rows to append or as the table's new
state, so that a writer may commit them as one file set. A key may hold any share of the rows: latest rows come from
aggregates, never from a group laid out in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Outcomes whose provenance counts for confidence (fixed values).
ADMITTED = ("machine_verified", "ci_imported")
#: What may come of asking to use an approval; the first that holds counts (fixed values).
REFUSALS = ("approval_missing", "approval_manifest_changed", "approval_lifecycle_stale", "approval_reused", "approval_expired", "budget_exhausted")


def confidence_stats(outcomes: DataFrame, executions: DataFrame, tasks: DataFrame) -> DataFrame:
    """Admitted outcomes, successes and severe failures by model, effort, category and risk: three tables, one shuffle each.

    outcomes: execution_id, provenance, success, severe. executions: execution_id, task_id, model, effort. tasks: task_id,
    category, risk. Outcomes without execution, and executions without task, count nowhere.
    """
    rows = outcomes.where(F.col("provenance").isin(*ADMITTED)).select("execution_id", "success", "severe")
    rows = rows.join(executions.select("execution_id", "task_id", "model", "effort"), "execution_id").join(tasks.select("task_id", "category", "risk"), "task_id")
    return rows.groupBy("model", "effort", "category", "risk").agg(F.count("*").alias("n"), F.sum("success").cast("long").alias("successes"), F.sum("severe").cast("long").alias("severe"))


def bound_identity(bindings: DataFrame, carries: DataFrame) -> DataFrame:
    """(snapshot, identity): where a snapshot's binding stands now, by its latest carry, or else as it was bound.

    bindings: snapshot, identity. carries: carry_id, snapshot, new_identity.
    """
    latest = carries.groupBy("snapshot").agg(F.max_by("new_identity", "carry_id").alias("now"))
    return bindings.join(latest, "snapshot", "left").select("snapshot", F.coalesce("now", "identity").alias("identity"))


def carry_forward(bindings: DataFrame, carries: DataFrame, snapshots: DataFrame, previous: Column, new: Column, at: int) -> DataFrame:
    """The carries to append: of every snapshot that stands at the previous identity and has not expired at the time."""
    live = snapshots.where(F.col("expires_at") > at).select("snapshot")
    found = bound_identity(bindings, carries).where(F.col("identity") == previous).join(live, "snapshot", "left_semi")
    return found.select("snapshot", previous.alias("previous_identity"), new.alias("new_identity"), F.lit(at).cast("long").alias("carried_at"))


def authority_targets(bindings: DataFrame, carries: DataFrame, approval_bindings: DataFrame, approvals: DataFrame, identity: Column) -> DataFrame:
    """(kind, target): the snapshots that stand at an identity, and the issued approvals bound to it."""
    mine = bound_identity(bindings, carries).where(F.col("identity") == identity).select(F.lit("snapshot").alias("kind"), F.col("snapshot").cast("string").alias("target"))
    issued = approval_bindings.where(F.col("identity") == identity).join(approvals.where("status = 'issued'"), "approval_id", "left_semi")
    return mine.union(issued.select(F.lit("approval"), F.col("approval_id").cast("string")))


def invalidated(approvals: DataFrame, approval_bindings: DataFrame, identity: Column) -> DataFrame:
    """approvals with those invalidated that are issued and bound to the identity."""
    hit = approval_bindings.where(F.col("identity") == identity).select("approval_id").distinct().withColumn("hit", F.lit(True))
    status = F.when(F.col("hit") & (F.col("status") == "issued"), "invalidated").otherwise(F.col("status"))
    return approvals.join(hit, "approval_id", "left").select(*[status.alias("status") if c == "status" else F.col(c) for c in approvals.columns])


def consumption(requests: DataFrame, approvals: DataFrame, ledger: DataFrame, quota: int) -> DataFrame:
    """requests with code: consumed, or the first reason why not. Each is judged on the state as it is.

    requests: approval_id, nonce, manifest, now, tokens. approvals: approval_id, nonce, manifest, status, expires_at,
    reserved. ledger: entry_type, tokens. The budget counts every reservation made so far.
    """
    used = ledger.where("entry_type = 'reservation'").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("used"))
    a = approvals.select("approval_id", F.col("nonce").alias("a_nonce"), F.col("manifest").alias("a_manifest"), "status", "expires_at", "reserved", F.lit(True).alias("known"))
    rows = requests.join(a, "approval_id", "left").crossJoin(F.broadcast(used))  # one row
    changed = ~(F.col("nonce").eqNullSafe(F.col("a_nonce")) & F.col("manifest").eqNullSafe(F.col("a_manifest")))
    code = (
        F.when(F.col("known").isNull(), "approval_missing").when(changed, "approval_manifest_changed").when(F.col("status") == "invalidated", "approval_lifecycle_stale")
        .when(F.col("status") != "issued", "approval_reused").when(F.col("now") >= F.col("expires_at"), "approval_expired").when(F.col("reserved") != F.col("tokens"), "approval_manifest_changed")
        .when((F.col("tokens") > quota) | (F.col("used") + F.col("tokens") > quota), "budget_exhausted").otherwise("consumed")
    )
    return rows.select(*requests.columns, code.alias("code"))


def after_consumption(judged: DataFrame, approvals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """approvals with the consumed ones marked, and the reservations to append to the ledger; one request for an approval."""
    won = judged.where("code = 'consumed'").select("approval_id", "tokens", "now").dropDuplicates(["approval_id"])
    marked = approvals.join(won.select("approval_id", F.lit(True).alias("won")), "approval_id", "left")
    status = F.when(F.col("won"), "consumed").otherwise(F.col("status"))
    entries = won.select(F.concat(F.lit("reserve:"), F.col("approval_id").cast("string")).alias("entry_id"), "approval_id", F.lit("reservation").alias("entry_type"), "tokens", F.col("now").alias("created_at"))
    return marked.select(*[status.alias("status") if c == "status" else F.col(c) for c in approvals.columns]), entries


def revealed(comparisons: DataFrame) -> DataFrame:
    """Blind comparisons with a verdict, and the execution that won: a and b are names for the shadow and the primary."""
    shadow = F.when(F.col("verdict") == "a", F.col("a_is_shadow")).when(F.col("verdict") == "b", ~F.col("a_is_shadow"))
    winner = F.when(shadow, F.col("shadow")).when(~shadow, F.col("primary"))
    return comparisons.where("verdict is not null").select("comparison_id", "verdict", winner.alias("winner"), F.lit("pairwise").alias("provenance"), F.lit(False).alias("admissible"))


def runway(retires: Column, today: Column, days: int = 30) -> Column:
    """Whether a profile has strictly more than so many days left; one without a date always has."""
    return retires.isNull() | (retires > F.date_add(today, days))


def anonymised(rows: DataFrame, admitted: DataFrame) -> DataFrame:
    """What may leave the store: typed fields and buckets of executions of admitted models, the time as a day."""
    from lodestone.functions.columns import log2_bucket

    keep = rows.join(admitted.select("model"), "model", "left_semi")
    return keep.select("model", "effort", "category", "risk", "outcome", *[log2_bucket(F.col(c)).alias(f"{c}_bucket") for c in ("input", "output", "latency")], F.expr("recorded_at div 86400").cast("long").alias("day"))


def newest(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last n rows by order: a bounded top-n, partial in every task."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(n)


def row_counts(**tables: DataFrame) -> DataFrame:
    """(name, n) of tables."""
    out = None
    for name, df in sorted(tables.items()):
        row = df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = row if out is None else out.union(row)
    return out


#: Changes of a runtime's identity, the gravest first (fixed values).
CHANGES = ("major", "minor", "model_digest", "routing_policy", "capability", "policy", "endpoint", "patch", "hash_only")


def identity_change(before: str = "before", after: str = "after") -> Column:
    """What changed between two identities, structs with digest, version, model_digest, routing_policy_digest,
    capabilities (an array whose order is no matter), policy_version, runtime_digest, provider and runtime_kind.

    boundary_invalid where provider or kind differ, unchanged where the digests agree, then the first of CHANGES that holds;
    a runtime digest tells of the endpoint unless the runtime is a local_cli. Null where an identity is missing;
    unclassified where the digests differ and nothing else does.
    """
    b, a = F.col(before), F.col(after)
    differs = lambda c: ~b[c].eqNullSafe(a[c])
    part = lambda x, i: F.get(F.split(x["version"], r"\."), F.lit(i)).cast("int")
    moved = lambda i: ~part(b, i).eqNullSafe(part(a, i))
    skills = ~F.sort_array(b["capabilities"]).eqNullSafe(F.sort_array(a["capabilities"]))
    found = F.when(differs("provider") | differs("runtime_kind"), "boundary_invalid").when(~differs("digest"), "unchanged")
    tests = (
        moved(0), moved(1), differs("model_digest"), differs("routing_policy_digest"), skills, differs("policy_version"),
        differs("runtime_digest") & ~a["runtime_kind"].eqNullSafe(F.lit("local_cli")), differs("version"), differs("runtime_digest"),
    )
    for name, test in zip(CHANGES, tests, strict=True):
        found = found.when(test, name)
    return F.when(b.isNotNull() & a.isNotNull(), found.otherwise("unclassified"))
