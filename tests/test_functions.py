"""Scalar rules at their edges."""

from pyspark.sql import functions as F

from tessera.functions import dates, geometry, identity, text, vectors
from tessera.operators import candidates, documents, ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_periods(spark):
    def kind(raw):
        r = one(spark, dates.parsed_period(F.lit(raw).cast("string")))
        return (str(r.start), str(r.end), r.kind)

    assert kind("2026-09-23 ~ 2026-10-08") == ("2026-09-23", "2026-10-08", "DATE_RANGE")
    assert kind("2026.9.3. ～ 2026.10.8.") == ("2026-09-03", "2026-10-08", "DATE_RANGE")
    assert kind("2026년 9월 3일~2026년 9월 4일")[2] == "DATE_RANGE"
    assert kind("2026-02-30 ~ 2026-03-01")[2] == "INVALID_DATE_RANGE"
    assert kind("2026-03-02 ~ 2026-03-01")[2] == "INVALID_DATE_RANGE"
    assert kind("every month")[2] == "FREE_TEXT"
    assert kind(None)[2] == kind("  ")[2] == "UNAVAILABLE"


def test_states_and_months(spark):
    d = lambda s: F.lit(s).cast("date")
    none = F.lit(None).cast("date")
    day = d("2026-09-30")
    assert one(spark, dates.program_state(none, none, day)) == "UNDATED"
    assert one(spark, dates.program_state(d("2026-01-01"), d("2026-03-31"), day)) == "CLOSED"
    assert one(spark, dates.program_state(d("2026-11-01"), none, day)) == "UPCOMING"
    assert one(spark, dates.program_state(none, d("2026-09-30"), day)) == "OPEN"
    assert one(spark, dates.completed_months(d("2024-10-31"), day)) == 22
    assert one(spark, dates.calendar_months(d("2024-10-31"), day)) == 23
    assert one(spark, dates.bucket(F.lit(12), ((12, "a"), (36, "b"), (None, "c")))) == "b"


def test_candidate_table(spark):
    rows = [
        ("P1", "finance", "small", "province", "2026-01-01", "2026-12-31", True),
        ("P2", "technology", "small", "province", None, None, True),
        ("P3", "finance", "small", "province", None, None, True),
        ("P4", "finance", "small", "province", None, None, False),
        ("P5", "finance", "small", "province", "2026-01-01", "2026-03-31", True),
        ("P6", "finance", "small", "province", "2026-11-01", "2026-12-31", True),
        ("P7", "finance", "medium", None, None, None, True),
    ]
    t = spark.createDataFrame(rows, "id string, category string, target string, jurisdiction string, s string, e string, active boolean")
    t = t.select("id", "category", "target", "jurisdiction", F.col("s").cast("date").alias("start_date"), F.col("e").cast("date").alias("end_date"), "active")
    ids = lambda **f: [r.id for r in candidates.candidates(t, candidates.CandidateFilter(**f)).orderBy("id").collect()]
    assert ids() == ["P1", "P2", "P3", "P5", "P6", "P7"]
    assert ids(categories=["finance"], targets=["small"]) == ["P1", "P3", "P5", "P6"]
    assert ids(open_on="2026-09-30") == ["P1", "P2", "P3", "P7"]
    assert ids(not_jurisdictions=["ministry"]) == ["P1", "P2", "P3", "P5", "P6"]
    assert ids(not_jurisdictions=["ministry"], region="x") == ids()
    assert ids(categories=["none"]) == []


def test_text_rules(spark):
    assert one(spark, text.grounded(F.lit("a b"), F.lit("xA a　b"))) is True
    assert one(spark, text.grounded(F.lit("  "), F.lit("abc"))) is False
    assert one(spark, text.clean_lines(F.lit("a \r\nb\x07\rc"))) == "a\nb\nc"
    assert one(spark, text.nfkc(F.lit("Ａ①"))) == "A1"
    assert one(spark, text.leaks(F.lit("x=%73ecret"), "secret")) is True
    kinds = lambda x: [(t.kind, t.token) for t in one(spark, text.critical_tokens(F.lit(x).cast("string")))]
    assert kinds("on 2024-01-02 pay 5% or 1,200") == [("date", "2024-01-02"), ("percent", "5%"), ("number", "1,200")]
    assert kinds("2026년 9월 3일, 5천만 원, 12개월, ３．５ ％") == [("date", "2026년9월3일"), ("period", "12개월"), ("amount", "5천만원"), ("percent", "3.5%")]
    # A match that overlaps an earlier kind is skipped whole: the year of the date is no period, its digits are no number.
    assert kinds("2026.9.3년") == [("date", "2026.9.3")] and kinds(None) == kinds("none") == []


def test_identity_and_vectors(spark):
    assert one(spark, identity.canonical_json_key(F.lit('{"b":1,"a":null}'))) == one(spark, identity.canonical_json_key(F.lit('{ "a": null, "b": 1 }')))
    assert one(spark, identity.canonical_json_key(F.lit('{"a":1,"a":2}'))) is None
    a, b = one(spark, identity.content_key(F.lit("ab"), F.lit("c"))), one(spark, identity.content_key(F.lit("a"), F.lit("bc")))
    assert a != b
    assert abs(one(spark, vectors.cosine(F.lit([3.0, 4.0]), F.lit([3.0, 4.0]))) - 1) < 1e-12
    assert one(spark, vectors.cosine(F.lit([0.0]), F.lit([1.0]))) is None


def test_boxes_and_files(spark):
    x, z = (geometry.box(*map(F.lit, v)) for v in ((0.0, 0.0, 2.0, 2.0), (1.0, 1.0, 3.0, 3.0)))
    assert abs(one(spark, geometry.iou(x, z)) - 1 / 7) < 1e-12
    assert one(spark, geometry.tile_starts(F.lit(2500), 1000, 100)) == [0, 900, 1500]
    assert one(spark, documents.extension(F.lit("a.HWPX"))) == "HWPX"
    assert one(spark, documents.basename(F.lit("a\\b/c.txt"))) == "c.txt"
    assert one(spark, documents.public_url(F.lit("https://h.x/a?k=1"), ["h.x"], ["k"])) is True
    assert one(spark, documents.public_url(F.lit("https://h.x:8443/a"), ["h.x"], ["k"])) is False


def test_lifecycle(spark):
    stored = spark.createDataFrame([(1, "a", False, "r1"), (2, "b", True, "r1"), (3, "c", False, "r1")], "id long, fingerprint string, deleted boolean, run_id string")
    seen = spark.createDataFrame([(1, "a"), (2, "x"), (4, "d")], "id long, fingerprint string")
    got = {r.id: (r.action, r.reactivated) for r in ingest.upsert_actions(stored, seen).collect()}
    assert got == {1: ("NOOP", False), 2: ("UPDATED", True), 3: ("UNSEEN", False), 4: ("INSERTED", False)}
    after = ingest.soft_deleted(ingest.merged(stored, seen, [], "r2"), "r2", allowed=True)
    assert {r.id: r.deleted for r in after.collect()} == {1: False, 2: False, 3: True, 4: False}
    kept = ingest.soft_deleted(ingest.merged(stored, seen, [], "r2"), "r2", allowed=False)
    assert {r.id: r.deleted for r in kept.collect()} == {1: False, 2: False, 3: False, 4: False}
