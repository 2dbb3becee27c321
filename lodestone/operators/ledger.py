"""Folds of append-only logs: usage and savings, incidents, debts, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A looked-up answer replaces so many searches and reads, in tokens and seconds (fixed values).
SEARCH_TOKENS, FILE_TOKENS, SEARCH_SECONDS, FILE_SECONDS = 1000, 2000, 20.0, 10.0


def saved_tokens() -> Column:
    """Of a usage entry: what searching and reading its files would have cost, less what was printed; never below 0."""
    k = F.size("files")
    read = F.aggregate("files", F.lit(0).cast("long"), lambda n, f: n + F.least(F.floor(f["bytes"] / 4), F.lit(FILE_TOKENS)))
    return F.greatest(F.lit(0).cast("long"), (1 + F.floor(k / 10)) * SEARCH_TOKENS + read - F.floor(F.col("output_bytes") / 4))


def saved_seconds() -> Column:
    k = F.size("files")
    return F.greatest(F.lit(0.0), (1 + F.floor(k / 10)) * SEARCH_SECONDS + k * FILE_SECONDS - F.col("wall_ms") / 1000)


def savings(usage: DataFrame) -> DataFrame:
    """By cmd, and in all where cmd is null."""
    rows = usage.select("cmd", saved_tokens().alias("t"), F.floor(saved_seconds() * 1000).cast("long").alias("ms"))
    return rows.rollup("cmd").agg(F.count("*").alias("entries"), F.sum("t").alias("tokens"), F.sum("ms").alias("saved_ms"))


def format_saving(tokens: int, seconds: float) -> str:
    amount = f"{tokens / 1000:.1f}k" if tokens >= 1000 else str(tokens)
    return f"~{amount} tokens / ~{seconds / 60:.0f} min" if seconds >= 90 else f"~{amount} tokens / ~{seconds:.0f}s"


def fold_incidents(log: DataFrame, order: str = "ord") -> DataFrame:
    """One row for each fingerprint that occurred: first, last, count, class of the last, last lifecycle event and state.

    open without lifecycle event; acked after an ack; resolved after a resolve, open again if it occurred later.
    Every aggregate is partial on the map side, so one fingerprint may hold any share of the log.
    """
    hit, life = F.col("kind") == "occurrence", F.col("kind").isin("ack", "resolve")
    at = F.struct("ts", order)
    folded = log.groupBy("fingerprint").agg(
        F.count_if(hit).alias("occurrences"),
        F.min(F.when(hit, F.col("ts"))).alias("first_seen"),
        F.max(F.when(hit, F.col("ts"))).alias("last_seen"),
        F.max_by(F.when(hit, F.col("class")), F.when(hit, at)).alias("class"),
        F.max(F.when(life, F.struct(F.col(order).alias("o"), F.col("kind").alias("kind"), F.col("ts").alias("ts")))).alias("life"),
    )
    state = F.when(F.col("life").isNull(), "open").when(F.col("life.kind") == "ack", "acked").when(F.col("last_seen") > F.col("life.ts"), "open").otherwise("resolved")
    return folded.where("occurrences > 0").select("fingerprint", "class", "occurrences", "first_seen", "last_seen", state.alias("state"))


def incident_rollup(folded: DataFrame) -> DataFrame:
    return folded.groupBy("class").agg(F.count_if(F.col("state") == "open").alias("open"), F.count_if(F.col("state") == "acked").alias("acked"), F.count("*").alias("total"))


def debts(rows: DataFrame, as_of: Column) -> DataFrame:
    """rows: (opened, closed) dates. Open and closed, the upper median age of the open and latency of the closed, and the oldest.

    The upper median is the value at half of the count: an exact percentile of the discrete kind, from counts by value.
    """
    age = F.greatest(F.lit(0), F.datediff(as_of, "opened"))
    rows = rows.select(F.when(F.col("closed").isNull(), age).alias("age"), F.when(F.col("closed").isNotNull(), F.greatest(F.lit(0), F.datediff("closed", "opened"))).alias("latency"))
    median = lambda c: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c} DESC)")
    return rows.agg(F.count("age").alias("open"), F.count("latency").alias("closed"), median("age").alias("median_age"), median("latency").alias("median_latency"), F.max("age").alias("oldest"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "rel_path", value: str = "content_hash") -> DataFrame:
    """(key, change) of what was added, removed or changed."""
    a, b = old.select(key, F.col(value).alias("was"), F.lit(True).alias("old")), new.select(key, F.col(value).alias("now"), F.lit(True).alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).where("change is not null")


def stale_overlays(overlays: DataFrame) -> DataFrame:
    """overlays with digests and current, maps by name: those of which any digest differs, and which ones."""
    changed = F.filter(F.map_keys("digests"), lambda k: ~F.try_element_at("digests", k).eqNullSafe(F.try_element_at("current", k)))
    return overlays.withColumn("changed", F.sort_array(changed)).where(F.size("changed") > 0)


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, "r.*")


def on_local_day(rows: DataFrame, ts: str, zone: str, day) -> DataFrame:
    """The rows whose UTC time falls on a day of a time zone."""
    return rows.where(F.to_date(F.from_utc_timestamp(ts, zone)) == day)


def upsert_one(stored: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """A table that holds one row at most: the last by order of what is stored and what is new."""
    return stored.unionByName(new).orderBy(F.desc(order)).limit(1)


def daemon_status(projects: DataFrame) -> DataFrame:
    """projects: (project, last_error, needs_build). One row: healthy, failing and pending ones, and ok or degraded."""
    failing, pending = F.col("last_error").isNotNull(), F.coalesce(F.col("needs_build"), F.lit(False))
    found = projects.agg(F.count("*").alias("projects"), F.count_if(~failing & ~pending).alias("healthy"), F.count_if(failing).alias("failing"), F.count_if(pending).alias("pending"))
    return found.withColumn("status", F.when(F.col("failing") == 0, "ok").otherwise("degraded"))


def observer_summary(rows: DataFrame) -> DataFrame:
    """rows: (target, state, reason). Targets by state and reason, with how many there are of the state."""
    each = rows.groupBy("state", "reason").agg(F.count("*").alias("n"))
    return each.join(rows.groupBy("state").agg(F.count("*").alias("of_state")), "state")


def append_once(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The new rows whose key isn't stored yet, one of each."""
    return new.dropDuplicates(key).join(stored.select(*key), key, "left_anti")


def page(rows: DataFrame, key: str, after, size: int) -> DataFrame:
    """The rows after a key, with has_more on each: one row more than the page is read."""
    top = rows.where(F.col(key) > F.lit(after)).orderBy(key).limit(size + 1)
    n = top.agg((F.count("*") > size).alias("has_more"))
    return top.orderBy(key).limit(size).join(F.broadcast(n))
