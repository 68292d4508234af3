"""Activity of users: quotas, locks, sessions. Each rule has a batch form here and a streaming form in tessera.streaming."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.segments import RANGE, in_ranges, replayed, running


def capped(events: DataFrame, keys: list[str], limit: int, order: list[str], ranges: int | None = None) -> DataFrame:
    """events with accepted: the first limit of each group of keys, which may be of any size."""
    counted = running(in_ranges(events, keys, order, ranges), keys, order, sums={"_place": F.lit(1)})
    return counted.withColumn("accepted", F.col("_place") <= limit).drop("_place", RANGE)


def sessions(events: DataFrame, user: str, at: str, gap_seconds: int, tie: str, ranges: int | None = None) -> DataFrame:
    """user, session number, first and last event and count: a session ends after gap_seconds without an event."""
    seconds = F.unix_micros(F.col(at).cast("timestamp")) / 1e6
    placed = in_ranges(events.select(user, at, tie, seconds.alias("_at")), [user], [at, tie], ranges)
    rows = running(placed, [user], [at, tie], maxima={"_last": F.col("_at")}, before=True)
    new = F.coalesce((F.col("_at") - F.col("_last") > gap_seconds).cast("int"), F.lit(0))
    rows = running(rows.withColumn("_new", new), [user], [at, tie], sums={"session": F.col("_new")})
    return rows.groupBy(user, "session").agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count(F.lit(1)).alias("n"))


def failure_runs(events: DataFrame, key: str, order: list[str], failed: Column, trip: int, ranges: int | None = None) -> DataFrame:
    """key, longest run of failures in a row, and runs of trip failures or more."""
    placed = in_ranges(events.withColumn("_bad", failed), [key], order, ranges)
    rows = running(placed, [key], order, sums={"_run": (~F.col("_bad")).cast("int")}).where("_bad")
    runs = rows.groupBy(key, "_run").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy(key).agg(F.max("n").alias("longest"), F.count_if(F.col("n") >= trip).alias("trips"))


def latest_per_user(events: DataFrame, user: str, n: int, order: list[Column]) -> DataFrame:
    """The latest n events of each user. Spark limits groups before the shuffle for this filter on a row number."""
    return events.withColumn("place", F.row_number().over(Window.partitionBy(user).orderBy(*order))).where(F.col("place") <= n)


@dataclass(frozen=True)
class Lock:
    """After max_failures failures in a row a key is locked for lock_seconds; a success clears it."""

    max_failures: int = 5
    lock_seconds: int = 600


def fold_throttle(state: tuple[int, float], at: float, failed: bool, rule: Lock) -> tuple[tuple[int, float], str]:
    """(failures, locked until) after one attempt, and what became of it: LOCKED attempts change nothing."""
    failures, until = state
    if at < until:
        return state, "LOCKED"
    if not failed:
        return (0, 0.0), "SUCCESS"
    failures += 1
    return ((0, at + rule.lock_seconds), "LOCKS") if failures >= rule.max_failures else ((failures, 0.0), "FAILURE")


def fold_quota(used: int, kind: str, limit: int) -> tuple[int, str]:
    """Units used after one event, and its outcome: a use is accepted below limit, a refund gives one back, never below 0."""
    if kind == "refund":
        return max(0, used - 1), "REFUNDED" if used else "NOTHING"
    return (used + 1, "ACCEPTED") if used < limit else (used, "REJECTED")


def lock_summary(at: list[float], failed: list[bool], rule: Lock) -> tuple:
    """What ordered attempts do to a state: the state left for each number of failures, and for locks by when they end.

    left[f] is the state left when entered with f failures; a lock that ends after bounds[i - 1] and no later than bounds[i] leaves after[i]; one that
    outlasts all attempts stays. Found from the back, as a state met again at a later attempt leaves what that one leaves.
    """
    n, none = len(at), (0, 0.0)
    ahead: list[tuple[int, float]] = [(f, 0.0) for f in range(rule.max_failures)]
    clear: list[tuple[int, float]] = [none] * (n + 1)  # left, when entered without failures at an attempt
    for i in range(n - 1, -1, -1):
        if failed[i]:
            until = at[i] + rule.lock_seconds
            j = bisect_left(at, until, i + 1)
            locks = (0, until) if j == n else clear[j]
            ahead = [*ahead[1:], locks]
        else:
            ahead = [ahead[0]] * rule.max_failures
        clear[i] = ahead[0]
    near = bisect_right(at, at[0] + rule.lock_seconds)  # locks from before end by then
    bounds, after = [], []
    for i in range(near):
        if after and after[-1] == clear[i]:
            bounds[-1] = at[i]
        else:
            bounds.append(at[i])
            after.append(clear[i])
    rest = clear[near] if near < n else None
    return ahead, bounds, after, rest


def lock_after(state: tuple[int, float], summary: tuple) -> tuple[int, float]:
    """The state that attempts of a summary leave."""
    left, bounds, after, rest = summary
    failures, until = state
    if not until:
        return left[failures]
    i = bisect_left(bounds, until)
    return after[i] if i < len(bounds) else rest if rest is not None else state


def locked(attempts: DataFrame, rule: Lock, ranges: int | None = None) -> DataFrame:
    """key, event_id, outcome of attempts (key, event_id, at, failed); those without a key are left out."""

    def replay(state: tuple[int, float], part: pd.DataFrame) -> tuple[tuple[int, float], list[str]]:
        out = []
        for moment, failed in zip(part["at"].tolist(), part["failed"].tolist(), strict=True):
            state, outcome = fold_throttle(state, moment, failed, rule)
            out.append(outcome)
        return state, out

    placed = in_ranges(attempts, ["key"], ["at", "event_id"], ranges)
    summary = lambda part: lock_summary(part["at"].tolist(), part["failed"].tolist(), rule)
    return replayed(placed, "key", ["at", "event_id"], summary, lock_after, replay, (0, 0.0), "key long, event_id long", "outcome string")
