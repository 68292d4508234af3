"""Structured Streaming forms of the activity rules.

State is kept by Spark per key and survives lost executors through the query's checkpoint. Within a micro-batch a key's events are taken
in order of event time and id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.activity import Lock, fold_quota, fold_throttle


def ordered(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    rows = pd.concat(list(parts))
    return rows.sort_values(["at", "event_id"])


def throttle(attempts: DataFrame, rule: Lock, ttl_minutes: int | None = None) -> DataFrame:
    """attempts (key long, event_id long, at double, failed boolean) with the outcome of each.

    With ttl_minutes idle keys are forgotten by processing time; that keeps a query running, so availableNow needs None.
    """
    timeout = GroupStateTimeout.NoTimeout if ttl_minutes is None else GroupStateTimeout.ProcessingTimeTimeout

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else (0, 0.0)
        out = []
        for row in ordered(parts).itertuples():
            held, outcome = fold_throttle(tuple(held), row.at, bool(row.failed), rule)
            out.append((key[0], row.event_id, outcome))
        state.update(held)
        if ttl_minutes is not None:
            state.setTimeoutDuration(ttl_minutes * 60_000)
        yield pd.DataFrame(out, columns=["key", "event_id", "outcome"])

    return attempts.groupBy("key").applyInPandasWithState(
        step, "key long, event_id long, outcome string", "failures int, until double", "append", timeout
    )


#: Buckets that quota() deals keys to by hash. A call of Python for each user and day costs more than its few events; what is kept of a bucket is read and written whole.
BUCKETS = 1 << 14


def quota(uses: DataFrame, limit: int) -> DataFrame:
    """uses (key string, event_id long, at double, kind string) with the outcome of each; key names a user and a local day. State is kept by bucket of keys."""

    def step(bucket: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = dict(zip(*state.get, strict=True)) if state.exists else {}
        rows, out = ordered(parts), []
        for key, kind in zip(rows["key"].tolist(), rows["kind"].tolist(), strict=True):
            used[key], outcome = fold_quota(used.get(key, 0), kind, limit)
            out.append(outcome)
        state.update((list(used), list(used.values())))
        yield rows[["key", "event_id"]].assign(outcome=out)

    dealt = uses.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)))
    return dealt.groupBy("bucket").applyInPandasWithState(step, "key string, event_id long, outcome string", "keys array<string>, used array<int>", "append", GroupStateTimeout.NoTimeout)


WORKFLOW = {
    ("NEW", "start"): "RUNNING",
    ("RUNNING", "step"): "RUNNING",
    ("RUNNING", "ask"): "WAITING",
    ("WAITING", "answer"): "RUNNING",
    ("RUNNING", "finish"): "COMPLETED",
    ("RUNNING", "fail"): "FAILED",
    ("WAITING", "expire"): "FAILED",
}


def fold_workflow(status: str, version: int, command: str, expected: int | None) -> tuple[str, int, str]:
    """One transition: commands against an old version, or that the status does not allow, change nothing."""
    if expected is not None and expected != version:
        return status, version, "STALE"
    after = WORKFLOW.get((status, command))
    return (after, version + 1, "APPLIED") if after else (status, version, "REFUSED")


def workflows(commands: DataFrame) -> DataFrame:
    """commands (key long, event_id long, at double, command string) with status, version and outcome after each."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, version = state.get if state.exists else ("NEW", 0)
        out = []
        for row in ordered(parts).itertuples():
            status, version, outcome = fold_workflow(status, version, row.command, None)
            out.append((key[0], row.event_id, status, version, outcome))
        state.update((status, version))
        yield pd.DataFrame(out, columns=["key", "event_id", "status", "version", "outcome"])

    return commands.groupBy("key").applyInPandasWithState(
        step, "key long, event_id long, status string, version int, outcome string", "status string, version int", "append", GroupStateTimeout.NoTimeout
    )


def timed(events: DataFrame, late: str) -> DataFrame:
    """Event times without a zone are UTC; watermarks need instants."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def daily_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Uses by user and day, in append mode behind a watermark."""
    return timed(events, late).groupBy(F.window("ts", "1 day"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("window.start").alias("day"), "n")


def idle_sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions by user that end after gap without an event, once the watermark has passed them."""
    w = F.session_window("ts", gap)
    return timed(events, late).groupBy(w.alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("first_at"), F.col("w.end").alias("expires_at"), "n")


def stale_claims(claims: DataFrame, minutes: float = 5) -> DataFrame:
    """claims (key long, at double, kind string: claim or release) to key and outcome: HELD, RELEASED, and STALE for a claim that nothing followed for minutes of processing time."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "outcome": ["STALE"]})
            return
        last = pd.concat(list(parts)).sort_values("at").kind.iloc[-1]
        if last == "claim":
            state.update((1,))
            state.setTimeoutDuration(int(minutes * 60_000))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"key": [key[0]], "outcome": ["HELD" if last == "claim" else "RELEASED"]})

    return claims.groupBy("key").applyInPandasWithState(step, "key long, outcome string", "held int", "append", GroupStateTimeout.ProcessingTimeTimeout)
