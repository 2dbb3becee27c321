"""A channel of numbered rounds between agents: what is undelivered, what can be vouched for, what is stalled.

rounds: round, author, to (array), posted, supersedes, path. events: round, seq, status, actor, at, malformed (their place
in the log is seq). files: path, tracked, dirty, commits, origin_author, origin_agent, as a repository's history has them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States in which a round needs nothing more, and in which it may be stalled; grades that fail an audit (fixed values).
CLOSED, WAITING, FAILING = ("done", "withdrawn", "superseded"), ("delivered", "acknowledged"), ("uncommitted", "modified", "discrepancy")


def inbox(rounds: DataFrame, events: DataFrame, agent: str) -> DataFrame:
    """Rounds addressed to the agent that it was never given."""
    given = events.where((F.col("status") == "delivered") & (F.col("actor") == agent)).select("round").distinct()
    return rounds.where(F.col("round").isNotNull() & F.array_contains("to", agent)).join(given, "round", "left_anti")


def deliveries(pending: DataFrame, agent: str, at) -> DataFrame:
    """The events that record that the pending rounds were handed over."""
    return pending.select("round", F.lit("delivered").alias("status"), F.lit(agent).alias("actor"), at.alias("at"))


def verification():
    """A file's grade by its history, as a column: who wrote it first counts, not what it says now."""
    tracked, dirty = F.coalesce(F.col("tracked"), F.lit(False)), F.coalesce(F.col("dirty"), F.lit(False))
    return (
        F.when(~tracked, "uncommitted").when(dirty, "modified").when(F.coalesce(F.col("commits"), F.lit(0)) == 0, "uncommitted").when(F.col("origin_author").isNull(), "legacy")
        .when(F.col("commits") > 1, "modified").when(~F.col("origin_agent").eqNullSafe(F.col("origin_author")), "discrepancy").otherwise("verified")
    )


def report(rounds: DataFrame, events: DataFrame, files: DataFrame, now, stale_days: int = 3) -> DataFrame:
    """rounds with verification, status (of the last event), stalled and open."""
    last = events.groupBy("round").agg(F.max_by(F.struct("status", "actor", "at"), F.struct("seq", "at", "status", "actor")).alias("last"))
    rows = rounds.join(files, "path", "left").join(last, "round", "left")
    status = F.col("last.status")
    stalled = F.coalesce(status.isin(*WAITING) & (now - F.col("last.at") > F.expr(f"INTERVAL {int(stale_days)} DAYS")), F.lit(False))
    return rows.select("round", "path", "author", verification().alias("verification"), status.alias("status"), stalled.alias("stalled"), (~F.coalesce(status.isin(*CLOSED), F.lit(False))).alias("open"))


def by_agent(rows: DataFrame) -> DataFrame:
    """Rounds posted and still open by author; those without one are (legacy)."""
    return rows.groupBy(F.coalesce("author", F.lit("(legacy)")).alias("agent")).agg(F.count("*").alias("posted"), F.count_if("open").alias("open"))


def anomalies(rounds: DataFrame, events: DataFrame) -> DataFrame:
    """(round, kind): malformed events, actors who take no part, rounds done before delivery, and superseded rounds that are missing.

    The first done and the first delivery of a round are two aggregates, so no round's events meet in a list.
    """
    of = lambda df, kind: df.select("round", F.lit(kind).alias("kind"))
    sound = events.where(~F.coalesce(F.col("malformed"), F.lit(False)))
    party = rounds.select("round", "author", "to")
    strangers = sound.join(party, "round").where(~F.coalesce(F.col("actor").eqNullSafe(F.col("author")) | F.array_contains("to", F.col("actor")), F.lit(False)) | F.col("actor").isNull())
    first = lambda s: F.min(F.when(F.col("status") == s, F.col("seq")))
    early = events.groupBy("round").agg(first("done").alias("done"), first("delivered").alias("given")).where("done is not null and (given is null or given > done)").join(rounds.select("round"), "round", "left_semi")
    lost = rounds.where("supersedes is not null").join(rounds.select(F.col("round").alias("supersedes")).where("supersedes is not null"), "supersedes", "left_anti")
    found = of(events.where("malformed").join(rounds.select("round"), "round", "left_semi"), "malformed_status").union(of(strangers, "status_actor_not_participant"))
    return found.union(of(early, "done_without_delivery")).union(of(lost, "supersedes_missing"))
