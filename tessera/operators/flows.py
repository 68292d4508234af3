"""Whole runs composed of the other operators: ingestion, indexing, personalised search with evaluation, quotas; and counts on the side."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessera.operators import ingest as g
from tessera.operators.segments import RANGE, in_ranges, running, stored


def ingested(stored: DataFrame, seen: DataFrame, gate: DataFrame, columns: Sequence[str], key: str = "id") -> DataFrame:
    """The table after a run: all of it or nothing. gate: one row with passed (the run may write) and complete (it may also delete what it did not see).

    run_id of gate marks the seen rows. A run that does not pass leaves every stored row as it was and inserts none.
    """
    after = g.merged(stored, seen, columns, "this-run", key).withColumnsRenamed({c: f"_a_{c}" for c in [*columns, "fingerprint", "deleted", "run_id"]})
    before = stored.select(key, F.lit(True).alias("_was"), *columns, "fingerprint", "deleted", "run_id")
    rows = after.join(before, key, "left").join(F.broadcast(gate))
    marked = F.col("_a_run_id") == "this-run"
    unseen = F.col("complete") & ~F.col("_a_deleted") & ~F.coalesce(marked, F.lit(False))
    pick = lambda new, old: F.when(F.col("passed"), new).otherwise(F.col(old)).alias(old)
    return rows.where(F.col("passed") | F.col("_was")).select(
        key,
        *[pick(F.col(f"_a_{c}"), c) for c in columns],
        pick(F.col("_a_fingerprint"), "fingerprint"),
        pick(F.col("_a_deleted") | unseen, "deleted"),
        F.when(F.col("passed") & marked, F.col("gate_run")).otherwise(F.coalesce("run_id", F.col("_a_run_id"))).alias("run_id"),
    )


def ingest_report(actions: DataFrame, deleted: DataFrame, gate: DataFrame) -> DataFrame:
    """One row: what the run did, zero throughout where it did not pass, with the pages it had to read and the invariants that do not hold.

    gate: one row with passed, complete, expected, rows_per_page, n_pages, good_pages, observed, unique_ids, gate_run.
    """
    counts = actions.agg(*[F.count_if(F.col("action") == a).alias(a.lower()) for a in ("INSERTED", "UPDATED", "NOOP")], F.count_if("reactivated").alias("reactivated"))
    gone = deleted.agg(F.count(F.lit(1)).alias("soft_deleted"))
    rows = gate.join(counts).join(gone)
    zero = {c: F.when(F.col("passed"), F.col(c)).otherwise(0) for c in ("inserted", "updated", "noop", "reactivated")}
    rows = rows.withColumns({**zero, "soft_deleted": F.when(F.col("passed") & F.col("complete"), F.col("soft_deleted")).otherwise(0)})
    rows = rows.withColumn("planned_pages", F.greatest(F.lit(1), F.ceil(F.col("expected") / F.col("rows_per_page"))))
    checks = (
        ("pages", F.col("n_pages") == F.col("planned_pages")),
        ("failed_pages", F.col("good_pages") == F.col("n_pages")),
        ("items", (F.col("observed") == F.col("unique_ids")) & F.col("unique_ids").eqNullSafe(F.col("expected"))),
        ("actions", ~F.col("passed") | (F.col("inserted") + F.col("updated") + F.col("noop") == F.col("unique_ids"))),
    )
    broken = F.filter(F.array(*[F.when(~F.coalesce(good, F.lit(False)), name) for name, good in checks]), lambda x: x.isNotNull())
    return rows.withColumn("broken", broken).withColumn("status", F.when(F.col("passed"), "PASS").otherwise("FAIL"))


def index_outcomes(chunks: DataFrame, stored: DataFrame, refused: DataFrame, source: str = "source") -> DataFrame:
    """source, status, chunks, embedded, upserted, stale_deleted, source_points of each source of chunks (source, chunk_id, content_key).

    stored: points there before (source, chunk_id). refused: source, reason; new sources only are refused, and keep their points as they were.
    """
    own = chunks.groupBy(source).agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("content_key").alias("embedded"))
    old = stored.groupBy(source).agg(F.count(F.lit(1)).alias("before"))
    stale = stored.join(chunks.select(source, "chunk_id"), [source, "chunk_id"], "left_anti").groupBy(source).agg(F.count(F.lit(1)).alias("stale"))
    rows = own.join(old, source, "left").join(stale, source, "left").join(refused.groupBy(source).agg(F.min("reason").alias("reason")), source, "left")
    held = F.col("reason").isNotNull() & (F.coalesce("before", F.lit(0)) == 0)
    zero = lambda c: F.when(held, 0).otherwise(F.coalesce(c, F.lit(0)))
    return rows.select(
        source,
        F.when(held, "SKIPPED_INDEX_POLICY").otherwise("INDEXED").alias("status"),
        "chunks",
        zero("embedded").alias("embedded"),
        zero("chunks").alias("upserted"),
        zero("stale").alias("stale_deleted"),
        zero("chunks").alias("source_points"),
        F.when(held, F.col("reason")).alias("reason"),
    )


def driven(sources: DataFrame, shard: str, order: str, most: int, ranges: int | None = None) -> DataFrame:
    """sources with state: SKIPPED where done, else INDEXED or FAILED; NOT_STARTED after most unexpected failures in a row of the shard.

    sources: done, unexpected, and failed (which includes unexpected). Sources that are skipped neither count nor break a row of failures. A shard is
    gone through in ranges, of which there are more the larger it is.
    """
    key, by = [shard], [order]
    bad, good = ~F.col("done") & F.col("unexpected"), ~F.col("done") & ~F.col("unexpected")
    rows = running(in_ranges(sources, key, by, ranges), key, by, sums={"_bad": bad.cast("int")})
    rows = running(rows, key, by, maxima={"_cleared": F.when(good, F.col("_bad"))})
    rows = rows.withColumn("_full", (F.col("_bad") - F.coalesce("_cleared", F.lit(0)) >= most).cast("int"))
    rows = running(rows, key, by, maxima={"_stopped": F.col("_full")}, before=True)
    state = F.when(F.coalesce("_stopped", F.lit(0)) == 1, "NOT_STARTED").when(F.col("done"), "SKIPPED").when(F.col("failed"), "FAILED").otherwise("INDEXED")
    return rows.withColumn("state", state).drop("_bad", "_cleared", "_full", "_stopped", RANGE)


def batch_verdict(items: DataFrame, batch: str) -> DataFrame:
    """batch, verdict, executed, inserted, reused, updated, failed, non_parsed of items (source, status, action); limits on a batch come first."""
    rows = items.groupBy(batch).agg(
        F.count(F.lit(1)).alias("executed"),
        F.count_distinct("source").alias("_unique"),
        *[F.count_if(F.col("action") == a).alias(a.lower()) for a in ("INSERTED", "REUSED", "UPDATED")],
        F.count_if(F.col("action").isNull()).alias("failed"),
        F.count_if(F.col("status") != "PARSED").alias("non_parsed"),
    )
    verdict = (
        F.when(F.col("executed") > 3, "parsing_batch_source_limit")
        .when(F.col("_unique") != F.col("executed"), "duplicate_parsing_batch_source")
        .when((F.col("failed") == 0) & (F.col("non_parsed") == 0), "PASS")
        .otherwise("FAIL")
    )
    return rows.withColumn("verdict", verdict).drop("_unique")


def search_status(closed: Column, conflict: Column, candidates: Column, ranked: Column) -> Column:
    return F.when(closed, "COMPANY_CLOSED").when(conflict.isNotNull(), "CONDITION_CONFLICT").when(candidates == 0, "NO_CANDIDATES").when(ranked == 0, "NO_INDEXED_PROGRAMS").otherwise("LISTED")


LIMITS = (("user", 4), ("ip", 6), ("pool", 40), ("service", 60))


def reserve(used: dict[str, int], keys: Sequence[tuple[str, str]], limits: dict[str, int]) -> str:
    """ACCEPTED if every key in order is below its limit, and then all are used; else the first that is not, and none is."""
    held = []
    for kind, key in keys:
        if used.get(key, 0) >= limits[kind]:
            for other in held:
                used[other] -= 1
            return f"{kind}_limit"
        used[key] = used.get(key, 0) + 1
        held.append(key)
    return "ACCEPTED"


def keys_of(user: object, ip: object, trial: bool) -> list[tuple[str, str]]:
    return [("user", f"u{user}"), ("ip", f"i{ip}"), *([("pool", "pool")] if trial else []), ("service", "service")]


REQUEST = "day date, at long, event_id long, user long, ip long, trial boolean"


def taken(requests: DataFrame, limits: dict[str, int]) -> DataFrame:
    """The requests that are accepted, given those with given set; a day is left once its service limit is reached."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        day, used = None, {}
        for batch in batches:
            kept = []
            for d, user, ip, trial, given in zip(batch.day, batch.user, batch.ip, batch.trial, batch.given, strict=True):
                if d != day:
                    day, used = d, {}
                full = used.get("service", 0) >= limits["service"]
                kept.append(not full and reserve(used, keys_of(user, ip, trial), limits) == "ACCEPTED" and not given)
            yield batch.loc[kept, [c.split()[0] for c in REQUEST.split(", ")]]

    return requests.repartition("day").sortWithinPartitions("day", "at", "event_id").mapInPandas(fold, REQUEST)


def reserved(requests: DataFrame, limits: Sequence[tuple[str, int]] = LIMITS, ranges: int | None = None) -> DataFrame:
    """day, event_id, outcome of requests (day, at, event_id, user, ip, trial): several daily limits at once, in order of time; rows with nulls are left out.

    A day takes as many requests as its service limit at most, and counters only grow. So days are read range by range until they are full, each time
    one range of each day that is not, from what was taken before. The outcome of every other request follows from what its day had taken by then.
    """
    most = dict(limits)
    names = [c.split()[0] for c in REQUEST.split(", ")]
    placed = in_ranges(requests.select(names).dropna(), ["day"], ["at", "event_id"], ranges)
    spans = placed.groupBy("day").agg(F.min(RANGE).alias("_lo"), F.max(RANGE).alias("_hi"))
    held, step = None, 0
    while True:
        left = spans.where(F.col("_lo") + step <= F.col("_hi")).select("day", (F.col("_lo") + step).alias("_now"))
        if held is not None:
            full = held.groupBy("day").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= most["service"]).select("day")
            left = left.join(full, "day", "left_anti")
        if left.isEmpty():
            break
        # One row to a day: the rows of a range are dealt by range, so a day's join key is no hotter than its ranges.
        rows = placed.join(left.withColumnRenamed("_now", RANGE), ["day", RANGE], "left_semi").select(*names, F.lit(False).alias("given"))
        if held is not None:
            rows = rows.union(held.join(left, "day", "left_semi").select(*names, F.lit(True)))
        new = taken(rows, most)
        held, step = stored(new if held is None else held.union(new), "reserved"), step + 1
    before = F.filter("_taken", lambda t: F.struct(t["at"], t["event_id"]) < F.struct("at", "event_id"))
    listed = placed.select("day", RANGE).distinct()
    if held is None:
        return listed.select("day", F.lit(0).cast("long").alias("event_id"), F.lit("").alias("outcome"))
    listed = listed.join(held.groupBy("day").agg(F.collect_list(F.struct("at", "event_id", "user", "ip", "trial")).alias("_taken")), "day")
    rows = placed.join(listed, ["day", RANGE]).withColumn("_before", before)
    same = {"user": lambda t: t["user"] == F.col("user"), "ip": lambda t: t["ip"] == F.col("ip"), "pool": lambda t: t["trial"], "service": lambda t: F.lit(True)}
    outcome = F.lit(None).cast("string")
    for kind, _ in reversed(limits):
        over = F.size(F.filter("_before", same[kind])) >= most[kind]
        outcome = F.when(over & F.col("trial") if kind == "pool" else over, f"{kind}_limit").otherwise(outcome)
    return rows.select("day", "event_id", F.coalesce(outcome, F.lit("ACCEPTED")).alias("outcome"))


def observed(rows: DataFrame, name: str, **metrics: Column) -> dict:
    """Counts of rows taken while they are computed for something else, here for nothing."""
    seen = Observation(name)
    rows.observe(seen, *[m.alias(k) for k, m in metrics.items()]).write.format("noop").mode("overwrite").save()
    return seen.get


def counts_by_route(docs: DataFrame, routes: dict[str, str]) -> DataFrame:
    """docs (id, detected, text) with route, status and the number of characters: unsupported formats and empty texts are statuses, not failures."""
    names = F.create_map(*[F.lit(x) for pair in routes.items() for x in pair])
    route = F.try_element_at(names, F.col("detected"))
    chars = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s", ""))
    status = F.when(route.isNull(), "UNSUPPORTED").when((chars == 0) & (route == "pdf"), "OCR_REQUIRED").when(chars == 0, "EMPTY_TEXT").otherwise("PARSED")
    return docs.select("id", F.coalesce(route, F.lit("none")).alias("route"), status.alias("status"), F.when(status == "PARSED", chars).otherwise(0).alias("chars"))
