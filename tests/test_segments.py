"""Scans in ranges against plain loops, with a key that holds more than a third of all rows."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.operators import activity, flows
from tessera.operators.segments import RANGE, in_ranges, running

RANGES = 9


@pytest.fixture(scope="module")
def events():
    rng = random.Random(4)
    at = sorted(rng.choice([rng.randrange(4000), rng.randrange(400)]) / 2 for _ in range(3000))
    return [(rng.choice([1, 1, 1, 2, 3, None, rng.randrange(200)]), i if i != 11 else 2**53 + 1, t, rng.random() < 0.6) for i, t in enumerate(at)]


@pytest.fixture(scope="module")
def frame(spark, events):
    return spark.createDataFrame(events, "key long, event_id long, at double, failed boolean").repartition(5)


def by_key(events):
    out = defaultdict(list)
    for row in sorted(events, key=lambda r: (r[2], r[1])):
        out[row[0]].append(row)
    return out


def test_ranges_are_even(spark, frame):
    sizes = [r["count"] for r in in_ranges(frame, ["key"], ["at", "event_id"], RANGES).groupBy("key", RANGE).count().collect()]
    assert max(sizes) < 3 * 3000 / RANGES


def test_running(spark, events, frame):
    placed = in_ranges(frame, ["key"], ["at", "event_id"], RANGES)
    for before in (False, True):
        got = running(placed, ["key"], ["at", "event_id"], sums={"n": F.lit(1), "bad": F.col("failed").cast("int")}, maxima={"top": F.col("event_id") % 97}, before=before)
        want = {}
        for rows in by_key(events).values():
            for i, r in enumerate(rows):
                seen = rows[: i + (not before)]
                want[r[1]] = (len(seen), sum(x[3] for x in seen), max((x[1] % 97 for x in seen), default=None))
        assert {r.event_id: (r.n, r.bad, r.top) for r in got.collect()} == want


@pytest.mark.parametrize("rule", [activity.Lock(1, 3), activity.Lock(2, 40), activity.Lock(3, 900), activity.Lock(5, 10**9)])
def test_locks(spark, events, frame, rule):
    want = {}
    for key, rows in by_key(events).items():
        state = (0, 0.0)
        for _, event, at, failed in rows if key is not None else []:
            state, want[event] = activity.fold_throttle(state, at, failed, rule)
    assert {r.event_id: r.outcome for r in activity.locked(frame, rule, RANGES).collect()} == want


def test_summaries_compose():
    rng = random.Random(6)
    for _ in range(300):
        rule = activity.Lock(rng.randint(1, 4), rng.choice([1, 5, 30]))
        at = sorted(float(rng.randrange(1, 40)) for _ in range(rng.randint(1, 12)))
        failed = [rng.random() < 0.6 for _ in at]
        summary = activity.lock_summary(at, failed, rule)
        for state in [(f, 0.0) for f in range(rule.max_failures)] + [(0, at[0] + x / 2) for x in range(2 * rule.lock_seconds + 1)]:
            end = state
            for moment, bad in zip(at, failed, strict=True):
                end, _ = activity.fold_throttle(end, moment, bad, rule)
            assert activity.lock_after(state, summary) == end


def test_sessions(spark, events, frame):
    want = Counter()
    for key, rows in by_key(events).items():
        number, last = 0, None
        for _, _, at, _ in rows:
            number += last is not None and at - last > 20
            want[key, number] += 1
            last = at
    placed = frame.withColumn("ts", F.timestamp_seconds("at"))
    assert {(r.key, r.session): r.n for r in activity.sessions(placed, "key", "ts", 20, "event_id", RANGES).collect()} == want


def test_capped_and_runs(spark, events, frame):
    kept = {r.event_id for r in activity.capped(frame, ["key"], 100, ["at", "event_id"], RANGES).where("accepted").collect()}
    assert kept == {r[1] for rows in by_key(events).values() for r in rows[:100]}
    want = {}
    for key, rows in by_key(events).items():
        runs = "".join("x" if r[3] else " " for r in rows).split()
        if runs:
            want[key] = (max(map(len, runs)), sum(len(r) >= 3 for r in runs))
    assert {r.key: (r.longest, r.trips) for r in activity.failure_runs(frame, "key", ["at", "event_id"], F.col("failed"), 3, RANGES).collect()} == want


@pytest.mark.parametrize("most", [1, 3, 6, 30])
def test_driven(spark, events, frame, most):
    shape = lambda e: (e % 5 == 0, e % 7 > 1 if e // 300 % 2 else e % 7 > 4)
    want = {}
    for rows in by_key(events).values():
        streak = 0
        for _, e, _, _ in sorted(rows, key=lambda r: r[1]):
            done, unexpected = shape(e)
            failed = unexpected or e % 11 == 0
            if streak >= most:
                want[e] = "NOT_STARTED"
                continue
            want[e] = "SKIPPED" if done else "FAILED" if failed else "INDEXED"
            if not done:
                streak = streak + 1 if unexpected else 0
    e = F.col("event_id")
    unexpected = F.when(F.floor(e / 300) % 2 == 1, e % 7 > 1).otherwise(e % 7 > 4)
    sources = frame.select("key", "event_id", (e % 5 == 0).alias("done"), unexpected.alias("unexpected"), (unexpected | (e % 11 == 0)).alias("failed"))
    assert {r.event_id: r.state for r in flows.driven(sources, "key", "event_id", most, RANGES).collect()} == want


@pytest.mark.parametrize("limits", [flows.LIMITS, (("user", 2), ("ip", 3), ("pool", 5), ("service", 9)), (("user", 50), ("ip", 90), ("pool", 150), ("service", 10**6))])
def test_reserved(spark, limits):
    """One day holds most requests; the limits may never be reached, so that all its ranges are read."""
    rng = random.Random(8)
    rows = [(rng.choice(["2024-01-01", "2024-01-01", f"2024-01-0{rng.randint(2, 6)}"]), rng.randrange(500), i, rng.randrange(40), rng.randrange(12), rng.random() < 0.4) for i in range(1500)]
    used, want = Counter(), {}
    for day, _, event, user, ip, trial in sorted(rows, key=lambda r: r[:3]):
        keys = [(k, n, (day, k, {"user": user, "ip": ip}.get(k))) for k, n in limits if k != "pool" or trial]
        full = next((k for k, n, key in keys if used[key] >= n), None)
        want[event] = f"{full}_limit" if full else "ACCEPTED"
        if not full:
            used.update(key for _, _, key in keys)
    requests = spark.createDataFrame(rows, "day string, at long, event_id long, user long, ip long, trial boolean").withColumn("day", F.to_date("day")).repartition(3)
    assert {r.event_id: r.outcome for r in flows.reserved(requests, limits, 5).collect()} == want
