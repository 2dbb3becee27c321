"""Streams: changes of snapshots, watching with retries, lifecycle transitions, tailing logs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def changes(scans: DataFrame) -> DataFrame:
    """A stream of (rel_path, content_hash, scan) to one of (rel_path, scan, change) against the last state of each path.

    A null hash says that the path is gone. State is one hash a path.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        was = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("scan")
        out = []
        for scan, now in zip(rows.scan, rows.content_hash, strict=True):
            now = None if pd.isna(now) else now
            if now != was:
                out.append((key[0], int(scan), "added" if was is None else "removed" if now is None else "changed"))
            was = now
        if was is None:
            state.remove()
        else:
            state.update((was,))
        yield pd.DataFrame(out, columns=["rel_path", "scan", "change"])

    return scans.groupBy("rel_path").applyInPandasWithState(step, "rel_path string, scan long, change string", "content_hash string", "append", GroupStateTimeout.NoTimeout)


def watch(stream: DataFrame, build: Callable[[DataFrame], None], checkpoint: str, interval: str = "1500 milliseconds", once: bool = False):
    """Calls build with each batch. If it raises, the batch is not committed and comes again after a restart."""
    writer = stream.writeStream.foreachBatch(lambda df, _: build(df)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def settled(snapshot: Callable[[], dict[str, str]], pause: Callable[[], None], rounds: int = 5) -> dict[str, str]:
    """A snapshot that two looks in a row agree on, or the last after `rounds` looks."""
    last = snapshot()
    for _ in range(rounds):
        pause()
        now = snapshot()
        if now == last:
            break
        last = now
    return last


def transitions(events: DataFrame, remember: int = 10_000) -> DataFrame:
    """A stream of (boundary, event_id, expected, next, occurred_at) to verdicts: applied, duplicate, stale or conflict.

    An event applies if its expected state is the current one and it is not older than the last change. A boundary
    remembers the last `remember` ids that it applied; an older one that comes again is older than the last change too,
    hence stale, so it is not applied in any case.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        current, updated, seen = state.get if state.exists else ("new", -1, [])
        seen, out = dict.fromkeys(seen), []
        rows = pd.concat(list(batches)).sort_values(["occurred_at", "event_id"])
        for r in rows.itertuples():
            if r.event_id in seen:
                verdict = "duplicate"
            elif r.occurred_at < updated:
                verdict = "stale"
            elif r.expected != current:
                verdict = "conflict"
            else:
                verdict, current, updated = "applied", r.next, int(r.occurred_at)
                seen[r.event_id] = None
            out.append((key[0], r.event_id, verdict, current))
        state.update((current, updated, list(seen)[-remember:]))
        yield pd.DataFrame(out, columns=["boundary", "event_id", "verdict", "state"])

    return events.groupBy("boundary").applyInPandasWithState(step, "boundary string, event_id string, verdict string, state string", "current string, updated long, seen array<string>", "append", GroupStateTimeout.NoTimeout)


def violations(events: DataFrame, allowed: DataFrame) -> DataFrame:
    """Events whose (before, after) is no allowed transition."""
    return events.join(allowed.select("before", "after").distinct(), ["before", "after"], "left_anti")


def freshness(manifest: DataFrame, scan: DataFrame, engine: str, scanned_engine: str) -> DataFrame:
    """One row: added, changed and removed files, whether the engine differs, and stale."""
    from lodestone.operators.ledger import snapshot_diff

    n = snapshot_diff(manifest, scan).agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "changed", "removed")])
    other = F.lit(engine != scanned_engine)
    return n.select("*", other.alias("engine_changed"), ((F.col("added") + F.col("changed") + F.col("removed") > 0) | other).alias("stale"))


def active(markers: DataFrame, now: int, ttl: int = 3600) -> DataFrame:
    return markers.where((F.lit(now) - F.col("seen_at") <= ttl) & (F.col("seen_at") <= now))


def backoff(failures: int, base: float, most: float, name: str) -> float:
    """Seconds until the next try: doubling, capped, with up to a tenth of jitter fixed by the name."""
    wait = min(most, base * 2 ** min(failures, 40))
    return wait * (1 + int(hashlib.sha256(f"{name}:{failures}".encode()).hexdigest()[:8], 16) / 0xFFFFFFFF / 10)


def tail_jsonl(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New log files as a stream; the checkpoint keeps the place, lines that are no entries have all nulls."""
    return spark.readStream.text(folder).select(F.from_json("value", schema).alias("e"), "value").select("e.*", F.col("e").isNull().alias("malformed"))
