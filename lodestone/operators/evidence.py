"""Evidence of how models did, and what follows: success rates, promotion, ranking, routes, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.columns import wilson_lower

ADMITTED = ("machine", "ci")
#: Trials and lower bound that promotion takes, by risk; high is never promoted (fixed values).
PROMOTION = {"low": (50, 0.90), "medium": (100, 0.95)}
#: Points that an effort costs (fixed values).
EFFORT_POINTS = {"default": 30, "low": 0, "medium": 10, "high": 30, "xhigh": 60, "max": 80}
USAGE_POINTS = {"medium": 0, "high": 40}
#: Reasons for which a candidate is ruled out, the first counts (names are our own).
REJECTIONS = ("disabled", "unverified", "role", "effort", "context", "policy", "retired", "unavailable", "quota", "recent_failure")


def recency_weighted(rows: DataFrame, now: int, half_life_days: float = 30.0) -> DataFrame:
    """By model: success in thousandths, each observation weighted by its age; integers only, so order is no matter."""
    age = F.greatest(F.lit(0), F.floor((F.lit(now) - F.col("observed_at")) / 86400))
    weight = F.greatest(F.lit(1), F.bround(1000 * F.pow(F.lit(0.5), age / F.lit(half_life_days))).cast("long"))
    rows = rows.select("model", "success", weight.alias("w"))
    return rows.groupBy("model").agg(F.count("*").alias("n"), F.sum("w").alias("weight"), F.expr("sum(w * success * 1000) div sum(w)").alias("permille"))


def confidence(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Trials, successes and severe failures of admitted outcomes, with Wilson's lower bound."""
    found = rows.where(F.col("provenance").isin(*ADMITTED)).groupBy(*keys).agg(F.count("*").alias("n"), F.sum("success").cast("long").alias("successes"), F.sum("severe").cast("long").alias("severe"))
    return found.withColumn("lower", F.round(wilson_lower(F.col("successes"), F.col("n")), 9))


def summary(rows: DataFrame, last_review: int = 0) -> DataFrame:
    """By execution (model): whether the latest admitted outcome succeeded, any severe one, human ones, and those since the review."""
    admitted = F.col("provenance").isin(*ADMITTED)
    return rows.groupBy("model").agg(
        F.max_by(F.when(admitted, F.col("success")), F.when(admitted, F.struct("recorded_at", "outcome_id"))).alias("latest_success"),
        F.coalesce(F.bool_or(F.col("severe") == 1), F.lit(False)).alias("any_severe"),
        F.count_if(F.col("provenance") == "human").alias("human"),
        F.count_if(F.col("recorded_at") > last_review).alias("since_review"),
    )


def promotion(stats: DataFrame) -> DataFrame:
    """stats with risk, n, successes, severe: eligible and why not."""
    lower = wilson_lower(F.col("successes"), F.col("n"))
    reason = F.when(F.col("risk") == "high", "risk").when(F.col("severe") > 0, "severe_failure")
    for risk, (least, bound) in PROMOTION.items():
        reason = reason.when((F.col("risk") == risk) & (F.col("n") < least), "too_few").when((F.col("risk") == risk) & (lower < bound), "bound")
    return stats.withColumn("reason", F.coalesce(reason, F.lit("none"))).withColumn("eligible", F.col("reason") == "none")


def benchmark(rows: DataFrame, policy: str, group: str) -> DataFrame:
    """By policy: sums, Wilson's bound, and whether the sample suffices: 100 in all and 30 in every group."""
    each = rows.groupBy(policy, group).agg(F.count("*").alias("n"), F.sum("success").cast("long").alias("s"))
    found = each.groupBy(policy).agg(F.sum("n").alias("n"), F.sum("s").alias("successes"), F.bool_and(F.col("n") >= 30).alias("each"))
    return found.select(policy, "n", "successes", F.round(wilson_lower(F.col("successes"), F.col("n")), 9).alias("lower"), ((F.col("n") >= 100) & F.col("each")).alias("sufficient"))


def better(candidate: DataFrame, baseline: DataFrame) -> DataFrame:
    """candidate when both samples suffice and its bound is above, else baseline; each is a table of one row."""
    a, b = candidate.select(F.struct("lower", "sufficient").alias("a")), baseline.select(F.struct("lower", "sufficient").alias("b"))
    win = F.col("a.sufficient") & F.col("b.sufficient") & (F.col("a.lower") > F.col("b.lower"))
    return a.limit(1).join(F.broadcast(b.limit(1))).select(F.when(win, "candidate").otherwise("baseline").alias("winner"))


def _points(c: str, table: dict[str, int]) -> Column:
    out = F.lit(0)
    for k, v in table.items():
        out = F.when(F.col(c) == k, v).otherwise(out)
    return out


def _clamped(c: Column) -> Column:
    return F.least(F.lit(1000), F.greatest(F.lit(0), c)).cast("int")


def rank_candidates(rows: DataFrame) -> DataFrame:
    """Models with gate true, by points: reliability and role less usage, tokens, latency, retries, escalations, scarcity."""
    points = (
        F.col("reliability") + F.col("role_bonus") - _points("usage", USAGE_POINTS)
        - F.least(F.lit(250), F.expr("(input_tokens + output_tokens) div 100")) - F.least(F.lit(200), F.expr("latency_ms div 1000"))
        - F.expr("retry div 5") - F.expr("escalation div 5") - F.expr("scarcity div 10")
    )
    return rows.where("gate").withColumn("score", _clamped(points)).orderBy(F.desc("score"), "model", "effort")


def rank_cli(rows: DataFrame) -> DataFrame:
    """Candidates with rejection (the first gate they fail, if any) and score; those left come first, by points.

    A repository's own success counts in place of the global one from five samples on.
    """
    gates = F.lit(None).cast("string")
    for name in reversed(REJECTIONS):
        gates = F.when(F.array_contains("failed", name), name).otherwise(gates)
    own = F.col("repo_n") >= 5
    n, s = F.when(own, F.col("repo_n")).otherwise(F.col("n")), F.when(own, F.col("repo_successes")).otherwise(F.col("successes"))
    sure = F.when(F.coalesce(n, F.lit(0)) < 20, 150).otherwise(F.least(F.lit(200), F.bround((1 - wilson_lower(s, n)) * 200).cast("int")))
    recent = F.when(F.col("age_days").isNull(), 50).otherwise(F.least(F.lit(100), 2 * F.col("age_days")))
    reliability = F.coalesce(F.expr("int((CASE WHEN repo_n >= 5 THEN repo_successes ELSE successes END) * 1000 div nullif(CASE WHEN repo_n >= 5 THEN repo_n ELSE n END, 0))"), F.lit(500))
    points = reliability - F.col("token_points") - F.col("latency_points") - F.expr("scarcity div 10") - _points("effort", EFFORT_POINTS) - sure - recent - F.col("risk_points")
    return rows.withColumn("rejection", gates).withColumn("score", F.when(gates.isNull(), _clamped(points))).orderBy(F.col("rejection").isNotNull(), F.desc("score"), "model", "effort")


def spent(rows: DataFrame, now: int, window: int = 86400) -> DataFrame:
    """Tokens of the last 24 hours."""
    return rows.where((F.col("recorded_at") > now - window) & (F.col("recorded_at") <= now)).agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


def route(candidates: DataFrame, attempts: DataFrame, budget: int) -> DataFrame:
    """The first candidate by ordinal that has not failed and fits in what attempts leave of the budget."""
    used = attempts.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("used"))
    failed = attempts.where("not ok").select("model").distinct()
    left = candidates.join(failed, "model", "left_anti").join(F.broadcast(used))
    return left.where(F.col("reserve") <= budget - F.col("used")).orderBy("ordinal").limit(1)


def reviewer(candidates: DataFrame) -> DataFrame:
    """The cheapest that is not of the author's family; ties by name."""
    return candidates.where("family <> author_family").orderBy("cost", "load", "model").limit(1)


def verified(rows: DataFrame) -> DataFrame:
    """success: built, tested, safe, and neither escalated, reverted nor severe; a human's word or a reversion counts before that."""
    machine = F.col("build") & F.col("tests") & F.col("security") & ~F.col("escalated") & ~F.col("severe")
    return rows.withColumn("verified", F.when(F.col("reverted"), False).when(F.col("human").isNotNull(), F.col("human")).otherwise(machine))


def worst(rows: DataFrame, order: tuple[str, ...] = ("ready", "optional", "degraded", "blocked")) -> Column:
    """The gravest status of a group."""
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("status"))
    return F.max_by("status", rank)


def project_health(rows: DataFrame, cap: int = 10) -> DataFrame:
    """rows: (project, item, state). Counts of failing, pending and stale, and at most `cap` names of each, the least.

    The names come from a row_number that is cut at `cap`, which each task applies before the shuffle; the counts are an
    aggregate. So a project with any share of the rows sends a few of them.
    """
    from pyspark.sql import Window

    states = ("failing", "pending", "stale")
    counts = rows.groupBy("project").agg(*[F.count_if(F.col("state") == s).alias(s) for s in states])
    place = F.row_number().over(Window.partitionBy("project", "state").orderBy("item"))
    named = rows.where(F.col("state").isin(*states)).withColumn("place", place).where(F.col("place") <= cap)
    named = named.groupBy("project").agg(*[F.sort_array(F.collect_list(F.when(F.col("state") == s, F.col("item")))).alias(f"{s}_items") for s in states])
    listed = [F.coalesce(f"{s}_items", F.array().cast(named.schema[f"{s}_items"].dataType)).alias(f"{s}_items") for s in states]
    status = F.when(F.col("failing") > 0, "degraded").when((F.col("pending") > 0) | (F.col("stale") > 0), "warning").otherwise("ok")
    return counts.join(named, "project", "left").select("project", *states, *listed, status.alias("status"))


def within_budget(spark_rows: DataFrame, most_files: int, most_bytes: int) -> DataFrame:
    """(scope, path, bytes): which files of each scope go into a context, by path. One that doesn't fit is passed over.

    Passing over and going on is sequential, so each scope is streamed in order; a scope's state is two numbers.
    """
    import pyarrow as pa

    def run(it):
        scope, n, size = None, 0, 0
        for batch in it:
            out = []
            for s, b in zip(batch["scope"].to_pylist(), batch["bytes"].to_pylist(), strict=True):
                if s != scope:
                    scope, n, size = s, 0, 0
                why = "max_files" if n >= most_files else "max_bytes" if size + b > most_bytes else "taken"
                if why == "taken":
                    n, size = n + 1, size + b
                out.append(why)
            yield pa.RecordBatch.from_arrays([batch["scope"], batch["path"], batch["bytes"], pa.array(out, pa.string())], names=["scope", "path", "bytes", "verdict"])

    rows = spark_rows.select(F.col("scope").cast("string").alias("scope"), F.col("path").cast("string").alias("path"), F.col("bytes").cast("long").alias("bytes"))
    return rows.repartition("scope").sortWithinPartitions("scope", "path").mapInArrow(run, "scope string, path string, bytes long, verdict string")
