"""Queries over runs and snapshots: lifecycle, quality gates, identities, retention."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import identity
from tessera.operators import activity
from tessera.operators import ingest as g
from tessera.plans.base import registrar
from tessera.sources.tables import SCHEMAS, table

QUERIES, ORACLES = {}, {}
query = registrar(QUERIES, ORACLES)
RUN = "run-2"
NAMESPACE = uuid.UUID("6ba7b812-9dad-11d1-80b4-00c04fd430c8")
NULL_SQL = identity.NULL_MARK


def key_sql(*cols: str) -> str:
    parts = [f"length(coalesce(({c})::VARCHAR, '{NULL_SQL}')) || ':' || coalesce(({c})::VARCHAR, '{NULL_SQL}') || ';'" for c in cols]
    return f"sha256({' || '.join(parts)})"


SNAPSHOTS_SQL = f"""WITH o AS (SELECT o_orderkey AS id, o_orderpriority AS category, round(o_totalprice * 100)::BIGINT AS cents, o_orderstatus AS st FROM orders),
stored AS (SELECT id, category, cents, st = 'F' AS deleted, 'run-1' AS run_id, {key_sql('category', 'cents')} AS fingerprint FROM o WHERE id % 10 <> 0),
s0 AS (SELECT id, category, CASE WHEN id % 13 = 0 THEN cents + 1 ELSE cents END AS cents FROM o WHERE id % 9 <> 0),
seen AS (SELECT *, {key_sql('category', 'cents')} AS fingerprint FROM s0)
"""


def snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("category"), cents.alias("cents"), F.col("o_orderstatus").alias("st"))
    print_of = identity.content_key(F.col("category"), F.col("cents"))
    stored = o.where("id % 10 <> 0").select("id", "category", "cents", (F.col("st") == "F").alias("deleted"), F.lit("run-1").alias("run_id"), print_of.alias("fingerprint"))
    seen = o.where("id % 9 <> 0").withColumn("cents", F.when(F.col("id") % 13 == 0, F.col("cents") + 1).otherwise(F.col("cents")))
    return stored, seen.select("id", "category", "cents", print_of.alias("fingerprint"))


@query(SNAPSHOTS_SQL + """SELECT action, reactivated, count(*) AS n, sum(id)::BIGINT AS ids FROM (
  SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'UNSEEN' WHEN a.id IS NULL THEN 'INSERTED' WHEN a.fingerprint <> b.fingerprint THEN 'UPDATED' ELSE 'NOOP' END AS action,
         b.id IS NOT NULL AND coalesce(a.deleted, false) AS reactivated FROM stored a FULL JOIN seen b ON a.id = b.id) GROUP BY ALL""")
def upsert_actions(spark, sf_dir):
    rows = g.upsert_actions(*snapshots(spark, sf_dir))
    return rows.groupBy("action", "reactivated").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query(SNAPSHOTS_SQL + f"""SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN a.cents ELSE b.cents END AS cents, coalesce(b.fingerprint, a.fingerprint) AS fingerprint,
  CASE WHEN b.id IS NULL THEN true ELSE false END AS deleted, CASE WHEN b.id IS NULL THEN a.run_id ELSE '{RUN}' END AS run_id FROM stored a FULL JOIN seen b ON a.id = b.id""")
def soft_delete(spark, sf_dir):
    stored, seen = snapshots(spark, sf_dir)
    after = g.merged(stored, seen, ["category", "cents"], RUN)
    return g.soft_deleted(after, RUN, allowed=True).select("id", "cents", "fingerprint", "deleted", "run_id")


@query(SNAPSHOTS_SQL + """SELECT a.id, b.id IS NULL AS missing,
  CASE WHEN b.id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.category IS DISTINCT FROM b.category THEN 'category' END, CASE WHEN a.cents IS DISTINCT FROM b.cents THEN 'cents' END) END AS differs
  FROM stored a LEFT JOIN seen b ON a.id = b.id WHERE b.id IS NULL OR a.category IS DISTINCT FROM b.category OR a.cents IS DISTINCT FROM b.cents""")
def roundtrip_verify(spark, sf_dir):
    stored, seen = snapshots(spark, sf_dir)
    return g.differing_columns(stored, seen, ["category", "cents"]).select("id", "missing", F.array_join("differs", ",").alias("differs"))


@query("""SELECT vec_id, label::BIGINT AS label FROM embeddings a WHERE NOT EXISTS (SELECT 1 FROM embeddings b WHERE b.vec_id = a.vec_id AND b.vec_id % 4 <> 0)""")
def stale_delete(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    current = rows.where("vec_id % 4 <> 0").select("vec_id")
    return rows.join(current, "vec_id", "left_anti")


PAGES_SQL = """WITH i AS (SELECT o_orderkey // 500 + 1 AS number, CASE WHEN o_orderkey % 997 = 0 THEN 'bad id' WHEN o_orderkey % 1499 = 0 THEN 'P0001' ELSE 'P' || lpad(o_orderkey::VARCHAR, 4, '0') END AS id FROM orders),
t AS (SELECT count(*) AS total FROM orders),
p AS (SELECT number, any_value(total) AS total_count, count(*) AS n_items, 500 AS asked, CASE WHEN number = 4 THEN 'TRANSPORT_ERROR' ELSE 'SUCCESS' END AS outcome FROM i, t GROUP BY number),
a AS (SELECT count(*) AS observed, count_if(regexp_full_match(id, '[A-Za-z0-9_-]{1,80}'))::BIGINT AS valid, count(DISTINCT CASE WHEN regexp_full_match(id, '[A-Za-z0-9_-]{1,80}') THEN id END) AS unique_ids FROM i),
b AS (SELECT count(*) AS n_pages, count_if(outcome = 'SUCCESS')::BIGINT AS good_pages, count_if(outcome = 'TRANSPORT_ERROR')::BIGINT AS transport_errors, count_if(outcome = 'API_ERROR')::BIGINT AS api_errors,
  arg_min(total_count, number) FILTER (outcome = 'SUCCESS') AS expected, max(number) AS last_page, count(DISTINCT number) AS n_numbers,
  count_if(n_items <> least(asked, greatest(0, total_count - (number - 1) * asked)))::BIGINT AS odd_pages, count(DISTINCT total_count) FILTER (outcome = 'SUCCESS') AS n_totals FROM p)
"""


def run_parts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    name = F.when(key % 997 == 0, "bad id").when(key % 1499 == 0, "P0001").otherwise(F.concat(F.lit("P"), F.when(F.length(key.cast("string")) < 4, F.lpad(key.cast("string"), 4, "0")).otherwise(F.substring(key.cast("string"), 1, 4))))
    items = orders.select((F.floor(key / 500) + 1).alias("number"), name.alias("id"))
    items = items.withColumn("valid", F.col("id").rlike(r"^[A-Za-z0-9_-]{1,80}\z"))
    total = orders.agg(F.count(F.lit(1)).alias("total_count"))
    pages = items.groupBy("number").agg(F.count(F.lit(1)).alias("n_items")).join(F.broadcast(total))
    return items, pages.withColumn("asked", F.lit(500)).withColumn("outcome", F.when(F.col("number") == 4, "TRANSPORT_ERROR").otherwise("SUCCESS"))


@query(PAGES_SQL + "SELECT observed, valid, unique_ids, observed - valid AS invalid, valid - unique_ids AS duplicates, n_pages, good_pages, transport_errors, expected, last_page FROM a, b")
def quality_report(spark, sf_dir):
    rows = g.run_report(*run_parts(spark, sf_dir))
    return rows.select("observed", "valid", "unique_ids", "invalid", "duplicates", "n_pages", "good_pages", "transport_errors", "expected", "last_page")


@query(PAGES_SQL + """SELECT concat_ws(',', CASE WHEN good_pages < n_pages THEN 'requests_failed' END, CASE WHEN transport_errors > 0 THEN 'transport_errors' END, CASE WHEN api_errors > 0 THEN 'api_errors' END,
  CASE WHEN valid > unique_ids THEN 'duplicates' END, CASE WHEN n_totals <> 1 THEN 'totals_differ' END, CASE WHEN unique_ids IS DISTINCT FROM expected THEN 'unique_not_total' END,
  CASE WHEN observed > valid THEN 'invalid_ids' END, CASE WHEN n_numbers <> n_pages OR last_page <> n_pages THEN 'page_gap' END, CASE WHEN odd_pages > 0 THEN 'page_item_counts' END,
  CASE WHEN unique_ids = 0 THEN 'empty_universe' END) AS reasons FROM a, b""")
def reconcile_reasons(spark, sf_dir):
    return g.blocking_reasons(g.run_report(*run_parts(spark, sf_dir))).select(F.array_join("reasons", ",").alias("reasons"))


@query("""WITH r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"k": null}' WHEN 1 THEN '{"k": " "}' WHEN 2 THEN '{}' ELSE props END AS raw FROM events),
s AS (SELECT f AS field, CASE WHEN json_extract(raw, '$.' || f) IS NULL THEN 'MISSING' WHEN json_type(raw, '$.' || f) = 'NULL' THEN 'NULL' WHEN trim(json_extract_string(raw, '$.' || f)) = '' THEN 'BLANK' ELSE 'VALID' END AS state
  FROM r, (VALUES ('k'), ('z')) v(f)),
g AS (SELECT f AS field, s AS state FROM (VALUES ('k'), ('z')) a(f), (VALUES ('MISSING'), ('NULL'), ('BLANK'), ('VALID')) b(s)),
c AS (SELECT field, state, count(*) AS n FROM s GROUP BY ALL)
SELECT field, state, coalesce(n, 0)::BIGINT AS n, coalesce(n, 0)::DOUBLE / (SELECT count(*) FROM r) AS share FROM g LEFT JOIN c USING (field, state)""")
def field_profile(spark, sf_dir):
    key = F.col("event_id") % 4
    raw = F.when(key == 0, '{"k": null}').when(key == 1, '{"k": " "}').when(key == 2, "{}").otherwise(F.col("props"))
    return g.field_states(table(spark, sf_dir, "events").select(raw.alias("raw")), "raw", ["k", "z"])


@query("""SELECT l_orderkey AS id, count(*) AS n, array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') AS lines, min(l_partkey) AS first_part FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def duplicate_locations(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id"), "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.min("l_partkey").alias("first_part"))
    return rows.where("n > 1").select("id", "n", F.col("l_linenumber").cast("string").alias("lines"), "first_part")


@query("""WITH s AS (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS before, ts::DATE AS d FROM events),
k AS (SELECT user_id, d, bool_or(value > before) AS up, bool_or(value < before) AS down FROM s WHERE before IS NOT NULL GROUP BY ALL)
SELECT user_id || '/' || d AS user_day, CASE WHEN up AND down THEN 'UNORDERED' WHEN up THEN 'ASCENDING' WHEN down THEN 'DESCENDING' ELSE 'CONSTANT' END AS ordering FROM k""")
def ordering_class(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("user_day", F.concat_ws("/", "user_id", F.col("ts").cast("date")))
    return g.ordering_class(rows, "user_day", "value", ["ts", "event_id"])


@query("""WITH p AS (SELECT event_id // 200 AS page, arg_min(value, event_id) AS first, arg_max(value, event_id) AS last FROM events GROUP BY 1)
SELECT page, last AS value, lead(first) OVER (ORDER BY page) AS next_first, lead(first) OVER (ORDER BY page) > last AS rises FROM p""")
def page_boundaries(spark, sf_dir):
    pages = table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 200).alias("page")).agg(F.min_by("value", "event_id").alias("first"), F.max_by("value", "event_id").alias("value"))
    # The successor is met by an equi-join on the page number, not by a window over all pages.
    following = pages.select((F.col("page") - 1).alias("page"), F.col("first").alias("next_first"))
    rows = pages.join(following, "page", "left")
    return rows.select("page", "value", "next_first", (F.col("next_first") > F.col("value")).alias("rises"))


@query(f"""SELECT o_orderkey AS id, {key_sql('o_orderpriority', 'round(o_totalprice * 100)::BIGINT')} AS row_key, sha256('ORDER:' || o_orderkey) AS typed_key,
  'sha256/' || substr(sha256('ORDER:' || o_orderkey), 1, 2) || '/' || substr(sha256('ORDER:' || o_orderkey), 3, 2) || '/' || sha256('ORDER:' || o_orderkey) AS path, '2.' || o_orderkey AS version FROM orders""")
def fingerprints(spark, sf_dir):
    key = F.col("o_orderkey")
    typed = identity.typed_key("ORDER", key)
    version = identity.public_version(F.concat(F.lit("2."), key.cast("string"), F.lit("+local")))
    row = identity.content_key(F.col("o_orderpriority"), F.round(F.col("o_totalprice") * 100).cast("long"))
    return table(spark, sf_dir, "orders").select(key.alias("id"), row.alias("row_key"), typed.alias("typed_key"), identity.object_path(typed).alias("path"), version.alias("version"))


@query("""SELECT event_id, sha256('{"a":[1,2],"k":' || (event_id % 7) || ',"z":"x"}') AS key FROM events""")
def canonical_json(spark, sf_dir):
    raw = F.concat(F.lit('{ "z": "x", "k": '), (F.col("event_id") % 7).cast("string"), F.lit(', "a": [1, 2] }'))
    return table(spark, sf_dir, "events").select("event_id", identity.canonical_json_key(raw).alias("key"))


@query(f"""WITH h AS (SELECT vec_id, sha1(from_hex('{NAMESPACE.hex}') || encode('chunk:' || vec_id)) AS d FROM embeddings)
SELECT vec_id, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || substr('89ab', (position(substr(d, 17, 1) IN '0123456789abcdef') - 1) % 4 + 1, 1) || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS point_id FROM h""")
def uuid5_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", identity.uuid5(NAMESPACE, F.concat(F.lit("chunk:"), F.col("vec_id").cast("string"))).alias("point_id"))


@query("SELECT c_custkey AS id, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END, c_acctbal - 1) AS kept FROM customer")
def upsert_keep_known(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") - 1).alias("old"))
    new = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal")).alias("new"))
    return old.join(new, "id").select("id", F.coalesce("new", "old").alias("kept"))


@query("""WITH old AS (SELECT p_partkey AS id, p_name AS v, p_size > 25 AS final FROM part WHERE p_partkey % 5 <> 0), new AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN 'new' ELSE p_name END AS v FROM part WHERE p_partkey % 7 <> 0)
SELECT CASE WHEN old.id IS NULL THEN 'INSERTED' WHEN old.v = new.v THEN 'REUSED' WHEN old.final THEN 'CONFLICT' ELSE 'UPDATED' END AS outcome, count(*) AS n FROM new LEFT JOIN old USING (id) GROUP BY 1""")
def immutable_results(spark, sf_dir):
    part, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    old = part.where(key % 5 != 0).select(key.alias("id"), F.col("p_name").alias("old"), (F.col("p_size") > 25).alias("final"))
    new = part.where(key % 7 != 0).select(key.alias("id"), F.when(key % 11 == 0, "new").otherwise(F.col("p_name")).alias("new"))
    outcome = F.when(F.col("old").isNull(), "INSERTED").when(F.col("old").eqNullSafe(F.col("new")), "REUSED").when(F.col("final"), "CONFLICT").otherwise("UPDATED")
    return new.join(old, "id", "left").groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT count_if(event_type = 'signup' AND ts < TIMESTAMP '2024-01-20')::BIGINT AS expired_signups, count_if(event_type = 'error' AND ts < TIMESTAMP '2024-01-10' AND (value < 50 OR ts < TIMESTAMP '2024-01-05'))::BIGINT AS idle_throttles,
  count_if(NOT (event_type = 'signup' AND ts < TIMESTAMP '2024-01-20') AND NOT (event_type = 'error' AND ts < TIMESTAMP '2024-01-10' AND (value < 50 OR ts < TIMESTAMP '2024-01-05')))::BIGINT AS kept FROM events""")
def retention(spark, sf_dir):
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    finished = (F.col("event_type") == "signup") & (F.col("ts") < at("2024-01-20"))
    idle = (F.col("event_type") == "error") & (F.col("ts") < at("2024-01-10")) & ((F.col("value") < 50) | (F.col("ts") < at("2024-01-05")))
    return table(spark, sf_dir, "events").agg(F.count_if(finished).alias("expired_signups"), F.count_if(idle).alias("idle_throttles"), F.count_if(~finished & ~idle).alias("kept"))


@query("""WITH gone AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND value > 100)
SELECT 'activity' AS kind, count(*) AS n, count_if(user_id IN (SELECT user_id FROM gone))::BIGINT AS anonymised FROM events
UNION ALL SELECT 'conversation', count(*), 0 FROM conversations WHERE conv_id NOT IN (SELECT user_id FROM gone)""")
def cascade_purge(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    gone = events.where("event_type = 'signup' and value > 100").select("user_id").distinct()
    marked = events.join(gone.withColumn("gone", F.lit(True)), "user_id", "left")
    activity = marked.withColumn("user_id", F.when(F.col("gone").isNull(), F.col("user_id")))
    a = activity.agg(F.lit("activity").alias("kind"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("user_id").isNull()).alias("anonymised"))
    talks = table(spark, sf_dir, "conversations").join(gone, F.col("conv_id") == F.col("user_id"), "left_anti")
    return a.union(talks.agg(F.lit("conversation").alias("kind"), F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("anonymised")))


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in SCHEMAS))
def table_counts(spark, sf_dir):
    return g.table_counts([(t, table(spark, sf_dir, t)) for t in SCHEMAS])


@query("""WITH f AS (SELECT user_id, event_id, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS run FROM events),
r AS (SELECT user_id, run, count(*) AS n, min(event_id) AS first_event FROM f WHERE bad GROUP BY ALL)
SELECT user_id, max(n) AS longest, count_if(n >= 3)::BIGINT AS trips FROM r GROUP BY user_id""")
def consecutive_failures(spark, sf_dir):
    return activity.failure_runs(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", 3)
