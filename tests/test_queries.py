"""Every registered query against its SQL, and those without SQL against plain Python."""

import uuid
from collections import defaultdict

import pytest

from tessera.operators import activity
from tessera.plans import registry
from tessera.plans.activity import RULE
from tests.rows import bag


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    assert bag(got) == bag(duck.sql(registry.ORACLES[name]).df())


def test_uuid5(spark, sf_dir):
    from tessera.plans.ingest import NAMESPACE

    rows = registry.QUERIES["uuid5_ids"](spark, sf_dir).collect()
    assert rows and all(r.point_id == str(uuid.uuid5(NAMESPACE, f"chunk:{r.vec_id}")) for r in rows)


def folded_throttle(duck):
    out, states = {}, defaultdict(lambda: (0, 0.0))
    for user, event, at, kind in duck.sql("SELECT user_id, event_id, epoch_us(ts) / 1e6, event_type FROM events WHERE event_type IN ('error', 'signup') ORDER BY ts, event_id").fetchall():
        states[user], out[event] = activity.fold_throttle(states[user], at, kind == "error", RULE)
    return out


@pytest.mark.parametrize("name", ["throttle_locks", "throttle_stream"])
def test_throttle(spark, duck, sf_dir, name):
    rows = registry.QUERIES[name](spark, sf_dir).collect()
    assert {r.event_id: r.outcome for r in rows} == folded_throttle(duck)


def test_quota_stream(spark, duck, sf_dir):
    want, used = {}, defaultdict(int)
    sql = "SELECT user_id, (ts + INTERVAL 9 HOUR)::DATE, event_id, event_type FROM events WHERE event_type IN ('click', 'purchase', 'error') ORDER BY ts, event_id"
    for user, day, event, kind in duck.sql(sql).fetchall():
        used[user, day], want[event] = activity.fold_quota(used[user, day], "refund" if kind == "error" else "use", 2)
    assert {r.event_id: r.outcome for r in registry.QUERIES["quota_stream"](spark, sf_dir).collect()} == want


def test_workflow_stream(spark, sf_dir):
    from tessera.streaming.stateful import fold_workflow

    rows = registry.QUERIES["workflow_stream"](spark, sf_dir).collect()
    assert {r.outcome for r in rows} == {"APPLIED", "REFUSED"}
    assert fold_workflow("RUNNING", 3, "step", 2) == ("RUNNING", 3, "STALE")
    assert fold_workflow("RUNNING", 3, "finish", 3) == ("COMPLETED", 4, "APPLIED")


def test_greedy_match(spark, sf_dir):
    from tessera.operators.layout import greedy_matches

    pairs = spark.createDataFrame([(1, 1, 5, 0.9), (1, 1, 6, 0.8), (1, 2, 5, 0.7), (1, 2, 6, 0.6), (2, 1, 5, 0.01), (2, 3, 7, 0.5)], "page long, a long, b long, iou double")
    assert sorted(map(tuple, greedy_matches(pairs, "page", 0.05).collect())) == [(1, 1, 5, 0.9), (1, 2, 6, 0.6), (2, 3, 7, 0.5)]
    rows = registry.QUERIES["greedy_match"](spark, sf_dir).collect()
    assert len({(r.page, r.a) for r in rows}) == len(rows) == len({(r.page, r.b) for r in rows})


def test_reading_lines(spark):
    from tessera.operators.layout import reading_lines

    words = [(1, 1, 5.0, 10.0, 10.0), (1, 2, 1.0, 14.0, 10.0), (1, 3, 1.0, 16.0, 10.0), (1, 4, 9.0, 15.0, 10.0)]
    got = reading_lines(spark.createDataFrame(words, "page long, word long, cx double, cy double, height double"), "page")
    assert [r.text for r in got.orderBy("line").collect()] == ["2 1 4", "3"]


def test_streaming_windows(spark, duck, sf_dir):
    from tessera.plans.activity import drained, event_stream
    from tessera.streaming.stateful import daily_counts, idle_sessions

    days = drained(spark, daily_counts(event_stream(spark, sf_dir))).toPandas()
    want = duck.sql("SELECT user_id, ts::DATE::TIMESTAMP AS day, count(*) AS n FROM events GROUP BY ALL").df()
    have = {(r.user_id, str(r.day)[:10]): r.n for r in days.itertuples()}
    known = {(r.user_id, str(r.day)[:10]): r.n for r in want.itertuples()}
    assert have and all(known[k] == n for k, n in have.items())  # the last day stays open behind the watermark
    assert drained(spark, idle_sessions(event_stream(spark, sf_dir), "1 day")).count() > 0


def test_embeddings_of_text(spark, sf_dir):
    length = defaultdict(float)
    for r in registry.QUERIES["embedded_documents"](spark, sf_dir).collect():
        length[r.doc_id] += r.value**2
    assert length and all(abs(x - 1) < 1e-3 for x in length.values())


def test_repeated_criteria(spark, duck, sf_dir):
    import difflib

    want, seen = set(), defaultdict(list)
    rows = duck.sql("SELECT conv_id, turn, text FROM conversations UNION ALL SELECT conv_id, turn + 1000, regexp_replace(text, '^\\S*\\s*', '') FROM conversations WHERE turn % 3 = 0").fetchall()
    for conv, turn, text in sorted(rows):
        if any(difflib.SequenceMatcher(None, s, text, autojunk=False).ratio() >= 0.85 for s in seen[conv]):
            want.add((conv, turn))
        seen[conv].append(text)
    assert want and {tuple(r) for r in registry.QUERIES["repeated_criteria"](spark, sf_dir).collect()} == want


def test_reserved_quota(spark, duck, sf_dir):
    from tessera.operators.flows import LIMITS

    used, want = defaultdict(int), {}
    sql = "SELECT (ts + INTERVAL 9 HOUR)::DATE, user_id, event_id FROM events WHERE user_id IS NOT NULL ORDER BY ts, event_id"
    for day, user, event in duck.sql(sql).fetchall():
        keys = [(kind, limit, (day, kind, {"user": user, "ip": user % 50}.get(kind))) for kind, limit in LIMITS if kind != "pool" or event % 3 == 0]
        full = next((kind for kind, limit, key in keys if used[key] >= limit), None)
        want[event] = f"{full}_limit" if full else "ACCEPTED"
        if not full:
            for _, _, key in keys:
                used[key] += 1
    got = {r.event_id: r.outcome for r in registry.QUERIES["reserved_quota"](spark, sf_dir).collect()}
    assert got == want


def test_reservations_roll_back():
    from tessera.operators.flows import reserve

    used = {"i1": 1}
    assert reserve(used, [("user", "u1"), ("ip", "i1")], {"user": 2, "ip": 1}) == "ip_limit" and used == {"i1": 1, "u1": 0}
    assert reserve(used, [("user", "u1"), ("ip", "i2")], {"user": 2, "ip": 1}) == "ACCEPTED" and used == {"i1": 1, "u1": 1, "i2": 1}


def test_stale_claims(spark, tmp_path):
    """Claims that are followed by nothing become stale once the processing time is up; here a tick of another key lets it be noticed."""
    import time

    from tessera.streaming.stateful import stale_claims

    schema = "key long, at double, kind string"
    write = lambda rows, name: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    write([(1, 1.0, "claim"), (2, 1.0, "claim"), (2, 2.0, "release")], "a")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = stale_claims(stream, minutes=0.02).writeStream.format("memory").queryName("claims").outputMode("append").trigger(processingTime="1 second").start()
    try:
        outcomes = lambda: {tuple(r) for r in spark.sql("select key, outcome from claims").collect()}
        until = time.time() + 90
        while time.time() < until and (1, "STALE") not in outcomes():
            time.sleep(2)
            if (1, "HELD") in outcomes() and not (tmp_path / "in" / "b").exists():
                write([(3, 1.0, "claim")], "b")
        assert outcomes() >= {(1, "HELD"), (2, "RELEASED"), (1, "STALE")} and (2, "STALE") not in outcomes()
    finally:
        query.stop()


def test_contents_shared_by_documents_count_once(spark):
    """Copies, contents that several documents share, and ones told twice in a document: a program has each once; no pair of relation and chunk is made."""
    from tessera.operators.parsing import counted_contents

    texts = {1: "abc", 2: "abc", 3: "cba", 4: "aad", 5: "xx", 6: "d", 7: "efg" * 20}
    keys = lambda text: [f"{ord(x):064x}" for x in text]
    chunks = spark.createDataFrame([(d, k) for d, text in texts.items() for k in keys(text)], "doc_id long, content_key string")
    pairs = [(1, 1), (1, 2), (2, 1), (2, 3), (2, 4), (3, 5), (4, 5), (4, 6), (4, 4), (5, 9), *((p, 7) for p in range(10, 60))]
    found = counted_contents(chunks, spark.createDataFrame(pairs, "program long, doc_id long"), "doc_id", "program")
    want = {p: (sum(len(texts[d]) for q, d in pairs if q == p), len({x for q, d in pairs if q == p for x in texts[d]})) for p, d in pairs if d in texts}
    assert {x.program: (x.chunks, x.contents) for x in found.collect()} == want
    assert "_content" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_quota_state_is_kept_by_bucket(spark, tmp_path, monkeypatch):
    """Keys of a bucket go on from one micro-batch to the next, each with its own count; there are no more groups than buckets."""
    from tessera.streaming import stateful

    monkeypatch.setattr(stateful, "BUCKETS", 3)
    schema = "key string, event_id long, at double, kind string"
    rows = [(f"{i * 7 % 20}/d", i, float(-i % 50), "refund" if i % 5 == 0 else "use") for i in range(200)]
    want, used = {}, defaultdict(int)
    for k, part in enumerate((rows[:100], rows[100:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for key, event, _, kind in sorted(part, key=lambda x: (x[2], x[1])):
            used[key], want[event] = activity.fold_quota(used[key], kind, 2)
        stream = stateful.quota(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 2)
        job = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        job.awaitTermination()
        assert 1 <= job.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {x.event_id: x.outcome for x in found} == want and len(found) == 200
