"""Queries over activity: batch twins of the streaming rules, and the streams themselves run to the end of their input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import dates
from tessera.operators import activity as a
from tessera.plans.base import registrar
from tessera.sources.files import shared_folder
from tessera.sources.tables import SCHEMAS, table
from tessera.streaming import stateful

QUERIES, ORACLES = {}, {}
query = registrar(QUERIES, ORACLES)
RULE = a.Lock(max_failures=2, lock_seconds=86_400)


@query("""SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, (ts + INTERVAL 9 HOUR)::DATE ORDER BY ts, event_id) <= 2 AS accepted FROM events WHERE event_type IN ('click', 'purchase')""")
def capped_daily_counter(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type in ('click', 'purchase')").withColumn("day", dates.local_day(F.col("ts")))
    return a.capped(rows, ["user_id", "day"], 2, ["ts", "event_id"]).select("event_id", "user_id", "accepted")


@query("""WITH s AS (SELECT *, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 86400000000)::INT, 0) AS new FROM events),
k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM s) SELECT user_id, session, min(ts) AS first_at, max(ts) AS last_at, count(*) AS n FROM k GROUP BY ALL""")
def inactive_sessions(spark, sf_dir):
    return a.sessions(table(spark, sf_dir, "events"), "user_id", "ts", 86_400, "event_id")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events QUALIFY place <= 20")
def top_n_per_user(spark, sf_dir):
    return a.latest_per_user(table(spark, sf_dir, "events"), "user_id", 20, [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "place")


@query("SELECT conv_id, turn, role, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations")
def conversation_messages(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"), place.alias("place"))


@query("SELECT user_id, ts::DATE::VARCHAR AS day, count(*) AS used, greatest(0, 4 - count(*))::BIGINT AS remaining FROM events GROUP BY ALL")
def daily_usage(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("used"))
    return rows.withColumn("remaining", F.greatest(F.lit(0), 4 - F.col("used")))


@query("SELECT count(*) AS sent, count_if(value > 250)::BIGINT AS redacted, count(DISTINCT user_id) AS users, max(value) AS most FROM events")
def observed_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("sent"), F.count_if(F.col("value") > 250).alias("redacted"), F.count_distinct("user_id").alias("users"), F.max("value").alias("most"))


def attempts(events: DataFrame) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return events.where("event_type in ('error', 'signup')").select(F.col("user_id").alias("key"), "event_id", at.alias("at"), (F.col("event_type") == "error").alias("failed"))


THROTTLE_SQL = f"""WITH RECURSIVE e AS (SELECT user_id AS key, event_id, epoch_us(ts) / 1e6::DOUBLE AS at, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k
  FROM events WHERE event_type IN ('error', 'signup')),
s AS (SELECT key, 0::BIGINT AS k, NULL::BIGINT AS event_id, 0 AS failures, 0.0::DOUBLE AS until, '' AS outcome FROM (SELECT DISTINCT key FROM e)
  UNION ALL SELECT e.key, e.k, e.event_id,
    CASE WHEN e.at < s.until THEN s.failures WHEN NOT e.failed OR s.failures + 1 >= {RULE.max_failures} THEN 0 ELSE s.failures + 1 END,
    CASE WHEN e.at < s.until THEN s.until WHEN e.failed AND s.failures + 1 >= {RULE.max_failures} THEN e.at + {RULE.lock_seconds} ELSE 0.0::DOUBLE END,
    CASE WHEN e.at < s.until THEN 'LOCKED' WHEN NOT e.failed THEN 'SUCCESS' WHEN s.failures + 1 >= {RULE.max_failures} THEN 'LOCKS' ELSE 'FAILURE' END
  FROM s JOIN e ON e.key = s.key AND e.k = s.k + 1)
SELECT key, event_id, outcome FROM s WHERE k > 0"""


@query(THROTTLE_SQL)
def throttle_locks(spark, sf_dir):
    """Attempts in ranges of a task's size: a key of any size is folded range by range, from the state that the ranges before leave."""
    return a.locked(attempts(table(spark, sf_dir, "events")), RULE)


def drained(spark, stream: DataFrame, mode: str = "append") -> DataFrame:
    """The rows of a stream over finished input: written by Spark to the shared folder, read again."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    job = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def event_stream(spark, sf_dir) -> DataFrame:
    return spark.readStream.schema(SCHEMAS["events"]).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)


@query(THROTTLE_SQL)
def throttle_stream(spark, sf_dir):
    return drained(spark, stateful.throttle(attempts(event_stream(spark, sf_dir)), RULE))


QUOTA_SQL = """WITH RECURSIVE e AS (SELECT user_id || '/' || ((ts + INTERVAL 9 HOUR)::DATE)::VARCHAR AS key, event_id, event_type = 'error' AS refund, row_number() OVER (PARTITION BY user_id, (ts + INTERVAL 9 HOUR)::DATE ORDER BY ts, event_id) AS k
  FROM events WHERE event_type IN ('click', 'purchase', 'error')),
s AS (SELECT key, 0::BIGINT AS k, NULL::BIGINT AS event_id, 0 AS used, '' AS outcome FROM (SELECT DISTINCT key FROM e)
  UNION ALL SELECT e.key, e.k, e.event_id, CASE WHEN e.refund THEN greatest(0, used - 1) WHEN used < 2 THEN used + 1 ELSE used END,
    CASE WHEN e.refund AND used > 0 THEN 'REFUNDED' WHEN e.refund THEN 'NOTHING' WHEN used < 2 THEN 'ACCEPTED' ELSE 'REJECTED' END FROM s JOIN e ON e.key = s.key AND e.k = s.k + 1)
SELECT key, event_id, outcome FROM s WHERE k > 0"""


@query(QUOTA_SQL)
def quota_stream(spark, sf_dir):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = event_stream(spark, sf_dir).where("event_type in ('click', 'purchase', 'error')")
    uses = rows.select(F.concat_ws("/", "user_id", dates.local_day(F.col("ts"))).alias("key"), "event_id", at.alias("at"), F.when(F.col("event_type") == "error", "refund").otherwise("use").alias("kind"))
    return drained(spark, stateful.quota(uses, 2))


STEP_SQL = """CASE WHEN s.status = 'NEW' AND c = 'start' THEN 'RUNNING' WHEN s.status = 'RUNNING' AND c = 'step' THEN 'RUNNING' WHEN s.status = 'RUNNING' AND c = 'ask' THEN 'WAITING'
  WHEN s.status = 'WAITING' AND c = 'answer' THEN 'RUNNING' WHEN s.status = 'RUNNING' AND c = 'fail' THEN 'FAILED' END"""
WORKFLOW_SQL = f"""WITH RECURSIVE e AS (SELECT user_id AS key, event_id, CASE event_type WHEN 'signup' THEN 'start' WHEN 'click' THEN 'step' WHEN 'view' THEN 'ask' WHEN 'purchase' THEN 'answer' WHEN 'error' THEN 'fail' END AS c,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
s AS (SELECT key, 0::BIGINT AS k, NULL::BIGINT AS event_id, 'NEW' AS status, 0::BIGINT AS version, '' AS outcome FROM (SELECT DISTINCT key FROM e)
  UNION ALL SELECT e.key, e.k, e.event_id, coalesce({STEP_SQL}, s.status), s.version + ({STEP_SQL} IS NOT NULL)::INT, CASE WHEN {STEP_SQL} IS NOT NULL THEN 'APPLIED' ELSE 'REFUSED' END FROM s JOIN e ON e.key = s.key AND e.k = s.k + 1)
SELECT key, event_id, status, version, outcome FROM s WHERE k > 0"""


@query(WORKFLOW_SQL)
def workflow_stream(spark, sf_dir):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    names = F.create_map(*[F.lit(x) for pair in (("signup", "start"), ("click", "step"), ("view", "ask"), ("purchase", "answer"), ("error", "fail")) for x in pair])
    commands = event_stream(spark, sf_dir).select(F.col("user_id").alias("key"), "event_id", at.alias("at"), F.try_element_at(names, F.col("event_type")).alias("command"))
    return drained(spark, stateful.workflows(commands))


@query("SELECT event_type, count_if(value < 30)::BIGINT AS low, count_if(value >= 30 AND value < 120)::BIGINT AS middle, count_if(value >= 120)::BIGINT AS high FROM events GROUP BY event_type")
def event_pivot(spark, sf_dir):
    band = F.when(F.col("value") < 30, "low").when(F.col("value") < 120, "middle").otherwise("high")
    rows = table(spark, sf_dir, "events").withColumn("band", band).groupBy("event_type").pivot("band", ["low", "middle", "high"]).count()
    return rows.na.fill(0)


@query("""WITH d AS (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, day::VARCHAR AS day, n, sum(n) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING)::BIGINT AS so_far FROM d""")
def running_usage(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days.withColumn("so_far", F.sum("n").over(Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))
