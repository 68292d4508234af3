"""Queries for whole runs: ingestion, indexing, personalised search with evaluation, batches, quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import dates
from tessera.operators import eligibility as e
from tessera.operators import flows as w
from tessera.operators import ingest as g
from tessera.operators import parsing as p
from tessera.operators import retrieval as r
from tessera.operators import segments
from tessera.operators.candidates import CandidateFilter, candidates
from tessera.plans.base import registrar
from tessera.plans.eligibility import BASE as CRITERIA_SQL
from tessera.plans.eligibility import checked
from tessera.plans.ingest import SNAPSHOTS_SQL, snapshots
from tessera.plans.parsing import WORDS_SQL
from tessera.plans.retrieval import BASE, BOTH, EVERY, REGION, index
from tessera.plans.retrieval import asked as asked_chunks
from tessera.sources.tables import AS_OF, PROGRAMS_SQL, RELATIONS_SQL, chunks, programs, relations, table

QUERIES, ORACLES = {}, {}
query = registrar(QUERIES, ORACLES)

PAGE = 500
RUNS = ("good", "partial", "bad")
RUNS_SQL = SNAPSHOTS_SQL + f""", placed AS (SELECT *, (id - id // 9 - 1) // {PAGE} + 1 AS number FROM seen),
got AS (SELECT run, p.* FROM placed p, (VALUES ('good'), ('partial'), ('bad')) v(run) WHERE NOT (run = 'partial' AND number = 2)),
st AS (SELECT run, s.* FROM stored s, (VALUES ('good'), ('partial'), ('bad')) v(run))
"""


def run_input(spark, sf_dir, run: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """stored rows, seen rows and the gate of a run: one that saw all, one that missed a page, one with ids that are none."""
    stored, seen = snapshots(spark, sf_dir)
    seen = seen.withColumn("number", F.floor((F.col("id") - F.floor(F.col("id") / 9) - 1) / PAGE) + 1)
    got = seen.where("number <> 2") if run == "partial" else seen
    valid = (F.col("id") % 1000 != 1) if run == "bad" else F.lit(True)
    outcome = F.when(F.col("number") == 2, "TRANSPORT_ERROR").otherwise("SUCCESS") if run == "partial" else F.lit("SUCCESS")
    total = seen.agg(F.count(F.lit(1)).alias("total_count"))
    pages = seen.groupBy("number").agg(F.count(F.lit(1)).alias("n_items")).join(F.broadcast(total)).withColumn("asked", F.lit(PAGE)).withColumn("outcome", outcome)
    report = g.blocking_reasons(g.run_report(got.select("id", valid.alias("valid")), pages))
    passed = (F.col("invalid") == 0) & (F.col("duplicates") == 0)
    gate = report.select(passed.alias("passed"), (F.size("reasons") == 0).alias("complete"), "expected", F.lit(PAGE).alias("rows_per_page"), "n_pages", "good_pages", "observed", "unique_ids", F.lit(f"run-{run}").alias("gate_run"))
    return stored, got.drop("number"), gate


def unioned(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(RUNS_SQL + """SELECT run, coalesce(a.id, b.id) AS id, CASE WHEN run = 'bad' OR b.id IS NULL THEN a.cents ELSE b.cents END AS cents, CASE WHEN run = 'bad' OR b.id IS NULL THEN a.fingerprint ELSE b.fingerprint END AS fingerprint,
  CASE WHEN run = 'bad' THEN a.deleted WHEN b.id IS NOT NULL THEN false WHEN run = 'good' THEN true ELSE a.deleted END AS deleted, CASE WHEN run <> 'bad' AND b.id IS NOT NULL THEN 'run-' || run ELSE a.run_id END AS run_id
  FROM st a FULL JOIN got b USING (run, id) WHERE run <> 'bad' OR a.id IS NOT NULL""")
def ingest_run(spark, sf_dir):
    """The table after each run, from report to deletion: a failed run changes nothing, an incomplete one deletes nothing."""
    parts = []
    for run in RUNS:
        stored, seen, gate = run_input(spark, sf_dir, run)
        rows = w.ingested(stored, seen, gate, ["category", "cents"])
        parts.append(rows.select(F.lit(run).alias("run"), "id", "cents", "fingerprint", "deleted", "run_id"))
    return unioned(parts)


@query(RUNS_SQL + f""", j AS (SELECT run, a.id AS old, b.id AS new, a.fingerprint AS f, b.fingerprint AS n, a.deleted FROM st a FULL JOIN got b USING (run, id)),
c AS (SELECT run, count_if(old IS NULL) AS i, count_if(f <> n) AS u, count_if(f = n) AS o, count_if(new IS NOT NULL AND coalesce(deleted, false)) AS re, count_if(new IS NULL AND NOT deleted) AS gone, count(new) AS observed FROM j GROUP BY run),
t AS (SELECT count(*) AS expected, greatest(1, ceil(count(*) / {PAGE}.0))::BIGINT AS planned FROM seen)
SELECT run, CASE WHEN run = 'bad' THEN 'FAIL' ELSE 'PASS' END AS status, (CASE WHEN run = 'bad' THEN 0 ELSE i END)::BIGINT AS inserted, (CASE WHEN run = 'bad' THEN 0 ELSE u END)::BIGINT AS updated, (CASE WHEN run = 'bad' THEN 0 ELSE o END)::BIGINT AS noop,
  (CASE WHEN run = 'bad' THEN 0 ELSE re END)::BIGINT AS reactivated, (CASE WHEN run = 'good' THEN gone ELSE 0 END)::BIGINT AS soft_deleted, planned AS planned_pages, CASE run WHEN 'good' THEN '' WHEN 'partial' THEN 'failed_pages,items' ELSE 'items' END AS broken FROM c, t""")
def ingest_reports(spark, sf_dir):
    parts = []
    for run in RUNS:
        stored, seen, gate = run_input(spark, sf_dir, run)
        gone = stored.where("not deleted").join(seen.select("id"), "id", "left_anti")
        report = w.ingest_report(g.upsert_actions(stored, seen), gone, gate)
        parts.append(report.select(F.lit(run).alias("run"), "status", "inserted", "updated", "noop", "reactivated", "soft_deleted", "planned_pages", F.array_join("broken", ",").alias("broken")))
    return unioned(parts)


INDEX_SQL = WORDS_SQL + """, o AS (SELECT doc_id, any_value(chunk_count) AS chunks, count(DISTINCT sha256(length(t) || ':' || t || ';')) AS embedded FROM j GROUP BY doc_id),
x AS (SELECT *, chunks > 10 AND doc_id % 3 <> 0 AS held, doc_id % 3 = 0 AS old FROM o)
"""


@query(INDEX_SQL + """SELECT doc_id, CASE WHEN held THEN 'SKIPPED_INDEX_POLICY' ELSE 'INDEXED' END AS status, chunks, (CASE WHEN held THEN 0 ELSE embedded END)::BIGINT AS embedded, (CASE WHEN held THEN 0 ELSE chunks END)::BIGINT AS upserted,
  (CASE WHEN old THEN 2 ELSE 0 END)::BIGINT AS stale_deleted, (CASE WHEN held THEN 0 ELSE chunks END)::BIGINT AS source_points, CASE WHEN held THEN 'document_points' END AS reason FROM x""")
def index_run(spark, sf_dir):
    """Admission, distinct embeddings, upsert and stale deletion of every document's chunks; a third of the documents had points before, two of them stale."""
    own = p.chunked(table(spark, sf_dir, "documents"), "doc_id", "text", 100)
    rows = own.select("doc_id", F.concat_ws("/", "doc_id", "chunk_index").alias("chunk_id"), "content_key", "chunk_index", "chunk_count")
    held = rows.where("chunk_index = 0")
    before = held.where("doc_id % 3 = 0").select("doc_id", F.explode(F.sequence(F.lit(0), F.col("chunk_count") + 1)).alias("k")).select("doc_id", F.concat_ws("/", "doc_id", "k").alias("chunk_id"))
    refused = held.where("chunk_count > 10").select("doc_id", F.lit("document_points").alias("reason"))
    return w.index_outcomes(rows, before, refused, "doc_id")


@query("""WITH d AS (SELECT doc_id, source, doc_id % 5 = 0 AS done, doc_id // 60 % 7 = 3 AS unexpected, doc_id // 60 % 7 = 3 OR doc_id % 11 = 0 AS failed FROM documents),
k AS (SELECT *, sum((NOT done AND NOT unexpected)::INT) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS run FROM d),
s AS (SELECT *, sum((NOT done AND unexpected)::INT) OVER (PARTITION BY source, run ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS streak FROM k),
z AS (SELECT *, coalesce(bool_or(streak >= 3) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stopped FROM s)
SELECT doc_id, CASE WHEN stopped THEN 'NOT_STARTED' WHEN done THEN 'SKIPPED' WHEN failed THEN 'FAILED' ELSE 'INDEXED' END AS state FROM z""")
def index_drive(spark, sf_dir):
    """A shard is driven in order, resumes behind what is done, and stops after three unexpected failures in a row."""
    k = F.col("doc_id")
    unexpected = F.floor(k / 60) % 7 == 3
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", (k % 5 == 0).alias("done"), unexpected.alias("unexpected"), (unexpected | (k % 11 == 0)).alias("failed"))
    return w.driven(rows, "source", "doc_id", 3).select("doc_id", "state")


@query(f"""WITH {RELATIONS_SQL}, i AS (SELECT program, content, CASE WHEN content % 9 = 0 THEN 'EXECUTION_FAILED' WHEN content % 5 = 0 THEN 'EMPTY_TEXT' ELSE 'PARSED' END AS status, CASE WHEN content % 9 <> 0 THEN ['INSERTED', 'REUSED', 'UPDATED'][content % 3 + 1] END AS action FROM relations)
SELECT program, count(*) AS executed, count(*) FILTER (action = 'INSERTED') AS inserted, count(*) FILTER (action = 'REUSED') AS reused, count(*) FILTER (action = 'UPDATED') AS updated, count_if(action IS NULL)::BIGINT AS failed, count_if(status <> 'PARSED')::BIGINT AS non_parsed,
  CASE WHEN count(*) > 3 THEN 'parsing_batch_source_limit' WHEN count_if(action IS NULL) = 0 AND count_if(status <> 'PARSED') = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM i GROUP BY program""")
def batch_verdicts(spark, sf_dir):
    c = F.col("content")
    status = F.when(c % 9 == 0, "EXECUTION_FAILED").when(c % 5 == 0, "EMPTY_TEXT").otherwise("PARSED")
    action = F.when(c % 9 != 0, F.element_at(F.array(F.lit("INSERTED"), F.lit("REUSED"), F.lit("UPDATED")), (c % 3 + 1).cast("int")))
    return w.batch_verdict(relations(spark, sf_dir).select("program", c.alias("source"), status.alias("status"), action.alias("action")), "program")


@query(r"""WITH d AS (SELECT doc_id AS id, ['PDF', 'HWP', 'DOCX', 'PNG', 'OTHER'][doc_id % 5 + 1] AS detected, CASE WHEN doc_id % 13 = 0 THEN ' ' ELSE text END AS text FROM documents),
r AS (SELECT id, CASE detected WHEN 'PDF' THEN 'pdf' WHEN 'HWP' THEN 'convert' WHEN 'DOCX' THEN 'office' WHEN 'PNG' THEN 'image' ELSE 'none' END AS route, length(regexp_replace(text, '\s', '', 'g')) AS chars FROM d),
s AS (SELECT id, route, CASE WHEN route = 'none' THEN 'UNSUPPORTED' WHEN chars = 0 AND route = 'pdf' THEN 'OCR_REQUIRED' WHEN chars = 0 THEN 'EMPTY_TEXT' ELSE 'PARSED' END AS status, chars FROM r)
SELECT id, route, status, CASE WHEN status = 'PARSED' THEN chars ELSE 0 END AS chars FROM s""")
def parsed_documents(spark, sf_dir):
    k = F.col("doc_id")
    detected = F.element_at(F.array(*map(F.lit, ("PDF", "HWP", "DOCX", "PNG", "OTHER"))), (k % 5 + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").select(k.alias("id"), detected.alias("detected"), F.when(k % 13 == 0, " ").otherwise(F.col("text")).alias("text"))
    return w.counts_by_route(docs, {"PDF": "pdf", "HWP": "convert", "DOCX": "office", "PNG": "image"})


@query("""WITH q AS (SELECT p_partkey AS source, p_partkey % 7 <> 0 AS known, p_partkey % 4 <> 0 AS stored, p_size % 3 = 0 AS changed, p_size % 10 = 0 AS empty FROM part)
SELECT source, CASE WHEN NOT known THEN 'source_not_found' WHEN stored AND NOT changed THEN 'REUSED' WHEN stored THEN 'UPDATED' ELSE 'INSERTED' END AS action, CASE WHEN NOT known THEN 'EXECUTION_FAILED' WHEN empty THEN 'EMPTY_TEXT' ELSE 'PARSED' END AS status FROM q""")
def orchestrated_sources(spark, sf_dir):
    """Look up, parse, persist: known sources whose stored result has the same key are reused."""
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    parsed = part.select(k.alias("source"), F.concat_ws("/", k, F.when(F.col("p_size") % 3 == 0, "v2").otherwise("v1")).alias("parse_key"), F.when(F.col("p_size") % 10 == 0, "EMPTY_TEXT").otherwise("PARSED").alias("status"))
    known = part.where("p_partkey % 7 <> 0").select(k.alias("source"), F.lit(True).alias("known"))
    stored = part.where("p_partkey % 4 <> 0").select(k.alias("source"), F.concat_ws("/", k, F.lit("v1")).alias("stored_key"))
    rows = parsed.join(known, "source", "left").join(stored, "source", "left")
    action = F.when(F.col("known").isNull(), "source_not_found").when(F.col("stored_key") == F.col("parse_key"), "REUSED").when(F.col("stored_key").isNotNull(), "UPDATED").otherwise("INSERTED")
    return rows.select("source", action.alias("action"), F.when(F.col("known").isNull(), "EXECUTION_FAILED").otherwise(F.col("status")).alias("status"))


SEARCH_SQL = f"""{BASE}, {PROGRAMS_SQL},
prof AS (SELECT qid, c_mktsegment AS target, c_acctbal < -500 AS closed, CASE WHEN qid % 60 = 0 AND c_mktsegment <> 'MACHINERY' THEN 'target' END AS conflict FROM q JOIN customer ON c_custkey = qid),
scope AS (SELECT id, target FROM programs WHERE active AND NOT (end_date IS NOT NULL AND end_date < DATE '{AS_OF}')),
n AS (SELECT target, count(*) AS n FROM scope GROUP BY target),
ok AS (SELECT qid, target FROM prof WHERE NOT closed AND conflict IS NULL),
dp AS (SELECT d.qid, program, max(score) AS score FROM dense d JOIN ok USING (qid) JOIN scope s ON s.id = program AND s.target = ok.target GROUP BY ALL),
sp AS (SELECT d.qid, program, max(score) AS score FROM sparse d JOIN ok USING (qid) JOIN scope s ON s.id = program AND s.target = ok.target GROUP BY ALL),
dr AS (SELECT qid, program, row_number() OVER (PARTITION BY qid ORDER BY score DESC, program) AS rank FROM dp QUALIFY rank <= 50),
sr AS (SELECT qid, program, row_number() OVER (PARTITION BY qid ORDER BY score DESC, program) AS rank FROM sp QUALIFY rank <= 50),
bl AS (SELECT coalesce(d.qid, s.qid) AS qid, coalesce(d.program, s.program) AS program, least(d.rank, s.rank) AS best_rank, round(coalesce(1.0::DOUBLE / (60 + d.rank), 0.0::DOUBLE) + coalesce(0.3::DOUBLE / (60 + s.rank), 0.0::DOUBLE), 12) AS score FROM dr d FULL JOIN sr s ON d.qid = s.qid AND d.program = s.program),
tp AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, best_rank, program) AS place FROM bl QUALIFY place <= 10),
mb AS (SELECT tp.*, p.jurisdiction, max(score) OVER (PARTITION BY qid) AS best FROM tp JOIN programs p ON p.id = program),
fi AS (SELECT qid, program, place, round(score + CASE WHEN jurisdiction IN {REGION} AND score > 0 AND score >= best * 0.9::DOUBLE THEN 0.001::DOUBLE ELSE 0.0::DOUBLE END, 12) AS final FROM mb),
li AS (SELECT qid, program, row_number() OVER (PARTITION BY qid ORDER BY final DESC, place) AS rank FROM fi QUALIFY rank <= 3),
res AS (SELECT prof.qid, CASE WHEN closed THEN 'COMPANY_CLOSED' WHEN conflict IS NOT NULL THEN 'CONDITION_CONFLICT' WHEN coalesce(n.n, 0) = 0 THEN 'NO_CANDIDATES' WHEN li.qid IS NULL THEN 'NO_INDEXED_PROGRAMS' ELSE 'LISTED' END AS status,
  (CASE WHEN closed OR conflict IS NOT NULL THEN 0 ELSE coalesce(n.n, 0) END)::BIGINT AS candidates, li.program, li.rank FROM prof LEFT JOIN n USING (target) LEFT JOIN li ON li.qid = prof.qid)
"""


def searched(spark, sf_dir) -> DataFrame:
    """qid, status, candidates, and up to three ranked programs for each profile; profiles are the customers of the asked chunks' numbers."""
    target = F.col("c_mktsegment")
    asked = chunks(spark, sf_dir).where(F.col("chunk_id") % EVERY == 0).select(F.col("chunk_id").alias("qid"))
    conflict = F.when((F.col("qid") % 60 == 0) & (target != "MACHINERY"), "target")
    profiles = asked.join(table(spark, sf_dir, "customer"), F.col("qid") == F.col("c_custkey")).select("qid", target.alias("scope"), (F.col("c_acctbal") < -500).alias("closed"), conflict.alias("conflict"))
    able = profiles.where("not closed and conflict is null").select("qid", "scope")
    # Stored, as each half of the search and what follows reads it, and to find it joins all orders with their customers.
    allowed = segments.stored(candidates(programs(spark, sf_dir), CandidateFilter(not_closed_on=AS_OF)).select(F.col("id").alias("program"), F.col("target").alias("scope"), "jurisdiction"), "allowed")
    scoped = lambda rows: rows.join(allowed.select("program", "scope"), "program")
    wanted = asked_chunks(spark, sf_dir).join(able, "qid")
    ranks = r.best_rows(index(spark, sf_dir), wanted, BOTH, scoped, by_program=True)
    top = r.fuse(ranks, {"dense": 1.0, "sparse": 0.3}, "program", limit=10).join(allowed.select("program", "jurisdiction"), "program")
    listed = r.regional_bonus(top, F.coalesce(F.col("jurisdiction").isin(*REGION), F.lit(False))).select("qid", "program", "rank")
    found = allowed.groupBy("scope").agg(F.count(F.lit(1)).alias("found"))
    rows = profiles.join(found, "scope", "left").join(listed, "qid", "left")
    refused = F.col("closed") | F.col("conflict").isNotNull()
    status = w.search_status(F.col("closed"), F.col("conflict"), F.coalesce("found", F.lit(0)), F.when(F.col("program").isNull(), 0).otherwise(1))
    return rows.select("qid", status.alias("status"), F.when(refused, 0).otherwise(F.coalesce("found", F.lit(0))).alias("candidates"), "program", "rank")


@query(SEARCH_SQL + "SELECT * FROM res")
def personalised_search(spark, sf_dir):
    return searched(spark, sf_dir)


@query(SEARCH_SQL + "," + CRITERIA_SQL[5:] + """, bad AS (SELECT DISTINCT program FROM fin WHERE problem = 'unknown_evidence')
SELECT qid, rank, res.program, CASE WHEN bad.program IS NOT NULL THEN 'FAILED' ELSE 'COMPLETED' END AS evaluation, CASE WHEN bad.program IS NULL THEN coalesce(st.status, 'INSUFFICIENT_EVIDENCE') END AS eligibility, CASE WHEN bad.program IS NOT NULL THEN 'evidence_invalid' END AS error
FROM res LEFT JOIN bad ON bad.program = res.program LEFT JOIN st ON st.program = res.program WHERE res.program IS NOT NULL""")
def top_evaluations(spark, sf_dir):
    """The listed programs judged in order: one whose criteria cite evidence that is not there fails alone."""
    # Stored, as what follows reads it three times.
    listed = segments.stored(searched(spark, sf_dir).where("program is not null").select("qid", "rank", "program"), "listed")
    judged = checked(spark, sf_dir).join(listed.select("program").distinct(), "program", "left_semi")
    bad = judged.where("problem = 'unknown_evidence'").select("program").distinct().withColumn("error", F.lit("evidence_invalid"))
    rows = listed.join(e.overall(judged.where("problem is null"), "program").select("program", "status"), "program", "left").join(bad, "program", "left")
    failed = F.col("error").isNotNull()
    return rows.select("qid", "rank", "program", F.when(failed, "FAILED").otherwise("COMPLETED").alias("evaluation"), F.when(~failed, F.coalesce("status", F.lit("INSUFFICIENT_EVIDENCE"))).alias("eligibility"), "error")


@query("SELECT count(*) AS sent, count_if(value > 250)::BIGINT AS redacted, max(value) AS most FROM events WHERE event_type <> 'view'")
def traced_step(spark, sf_dir):
    """What a step counts while it runs; one row of counts."""
    step = table(spark, sf_dir, "events").where("event_type <> 'view'")
    seen = w.observed(step, "traced", sent=F.count(F.lit(1)), redacted=F.count_if(F.col("value") > 250), most=F.max("value"))
    return spark.createDataFrame([(seen["sent"], seen["redacted"], seen["most"])], "sent long, redacted long, most double")


@query()
def reserved_quota(spark, sf_dir):
    """Limits of several keys at once, in order, so without SQL; the tests compare it with a plain loop."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").select(dates.local_day(F.col("ts")).alias("day"), at.alias("at"), "event_id", F.col("user_id").alias("user"), (F.col("user_id") % 50).alias("ip"), (F.col("event_id") % 3 == 0).alias("trial"))
    return w.reserved(rows.where("day is not null and user is not null"))


@query("""WITH l AS (SELECT user_id, max(ts) AS seen, arg_max(event_type, (ts, event_id)) AS kind FROM events GROUP BY user_id), m AS (SELECT max(ts) AS now FROM events)
SELECT user_id, kind IN ('click', 'view') AND seen + INTERVAL 5 DAY > now AS busy, kind IN ('click', 'view') AND seen + INTERVAL 5 DAY <= now AS stale FROM l, m""")
def claimed_workflows(spark, sf_dir):
    """A claimed step is busy while its lease runs, and released once it is stale."""
    events = table(spark, sf_dir, "events")
    last = events.groupBy("user_id").agg(F.max("ts").alias("at"), F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"))
    rows = last.join(F.broadcast(events.agg(F.max("ts").alias("now"))))
    held, live = F.col("kind").isin("click", "view"), F.col("at") + F.expr("INTERVAL 5 DAY") > F.col("now")
    return rows.select("user_id", (held & live).alias("busy"), (held & ~live).alias("stale"))


@query("""SELECT conv_id, turn, '#/texts/' || turn AS item_ref, CASE WHEN role = 'user' THEN 'text' ELSE 'table' END AS label, CASE WHEN turn % 2 = 0 THEN turn + 1 END AS page, CASE WHEN turn % 2 = 0 THEN [round(turn * 1.005::DOUBLE, 2), 0.0::DOUBLE] END AS bbox,
  CASE WHEN role <> 'user' THEN 'TABLE_VALID' END AS table_verdict, CASE WHEN conv_id % 3 = 0 THEN 0.9::DOUBLE END AS ocr_confidence FROM conversations""")
def item_provenance(spark, sf_dir):
    """Where an item of a chunk stands, flat: only what the parser gave."""
    turn, own = F.col("turn"), F.col("role") == "user"
    prov = F.when(turn % 2 == 0, F.struct((turn + 1).alias("page"), F.array(turn * 1.005, F.lit(0.0)).alias("box")))
    meta = F.struct(F.when(~own, F.struct(F.lit("TABLE_VALID").alias("verdict"))).alias("table"), F.when(F.col("conv_id") % 3 == 0, F.struct(F.lit(0.9).alias("confidence"))).alias("ocr"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.struct(F.concat(F.lit("#/texts/"), turn.cast("string")).alias("self_ref"), F.when(own, "text").otherwise("table").alias("label"), prov.alias("prov"), meta.alias("meta")).alias("item"))
    return p.provenance(rows, "item", ["conv_id", "turn"])


@query("""WITH k AS (SELECT program, list({'c': criterion, 'r': result, 'e': evidence_id} ORDER BY criterion, evidence_id, result) AS items FROM (SELECT DISTINCT l_orderkey AS program, l_linenumber AS criterion, l_partkey AS evidence_id, l_returnflag AS result FROM lineitem) GROUP BY program)
SELECT program, len(items) AS criteria, array_to_string([x.c || ':' || x.r || ':' || x.e FOR x IN items], ',') AS compact FROM k""")
def compact_results(spark, sf_dir):
    """What of a result is stored: criteria with their citations' names, without places and diagnostics."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("program"), F.col("l_linenumber").alias("criterion"), F.col("l_partkey").alias("evidence_id"), F.col("l_returnflag").alias("result")).distinct()
    item = F.struct("criterion", "result", F.array(F.struct("evidence_id", F.lit("p.1").alias("location"), F.lit(0.5).alias("score"))).alias("citations"))
    full = rows.groupBy("program").agg(F.collect_list(item).alias("criteria"))
    kept = p.compact_criteria(full, "program", "criteria")
    order = F.array_sort(F.transform("criteria", lambda x: F.struct(x["criterion"], x["citations"][0].alias("e"), x["result"])))
    told = F.transform(order, lambda x: F.concat_ws(":", x["criterion"].cast("string"), x["result"], x["e"].cast("string")))
    return kept.select("program", F.size("criteria").cast("long").alias("criteria"), F.array_join(told, ",").alias("compact"))
