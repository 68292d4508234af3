"""Queries over eligibility evaluations, derived from lineitem (criteria), part (evidence) and customer (profiles)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import dates, text
from tessera.operators import eligibility as e
from tessera.plans.base import registrar
from tessera.sources.tables import AS_OF, table

QUERIES, ORACLES = {}, {}
query = registrar(QUERIES, ORACLES)
FIELDS = ("region", "industry", "employee_count", "annual_revenue", "credit_score")
FACTS = (("region", "ASIA"), ("industry", None), ("employee_count", "12"), ("annual_revenue", None))

BASE = """WITH c0 AS (SELECT DISTINCT l_orderkey AS program, l_linenumber AS criterion, l_partkey AS evidence_id, (l_suppkey % 5)::INT AS f, l_quantity::INT % 3 AS r FROM lineitem),
crit AS (SELECT program, criterion, evidence_id, ['region', 'industry', 'employee_count', 'annual_revenue', 'credit_score'][f + 1] AS field, ['MET', 'NOT_MET', 'UNKNOWN'][r + 1] AS result FROM c0),
facts AS (SELECT * FROM (VALUES ('region', 'ASIA'), ('industry', NULL), ('employee_count', '12'), ('annual_revenue', NULL)) v(field, value)),
ev AS (SELECT p_partkey AS evidence_id, CASE WHEN p_size % 10 = 0 THEN p_partkey + 1 ELSE NULL END AS other FROM part WHERE p_partkey % 9 <> 0),
val AS (SELECT c.*, v.value, CASE WHEN ev.evidence_id IS NULL THEN 'unknown_evidence' WHEN ev.other IS NOT NULL THEN 'foreign_evidence' WHEN v.field IS NULL THEN 'unknown_field' END AS problem
  FROM crit c LEFT JOIN ev USING (evidence_id) LEFT JOIN facts v USING (field)),
fin AS (SELECT program, criterion, evidence_id, field, problem, CASE WHEN problem IS NULL AND result <> 'UNKNOWN' AND value IS NULL THEN 'UNKNOWN' ELSE result END AS result,
  CASE WHEN problem IS NULL AND result <> 'UNKNOWN' AND value IS NULL THEN result END AS adjusted FROM val),
st AS (SELECT program, CASE WHEN bool_or(result = 'NOT_MET') THEN 'INELIGIBLE' WHEN bool_or(result = 'UNKNOWN') THEN 'NEEDS_MORE_INFO' ELSE 'ELIGIBLE' END AS status, count(*) AS criteria,
  list_sort(list(DISTINCT field) FILTER (result = 'UNKNOWN')) AS missing FROM fin WHERE problem IS NULL GROUP BY program)
"""


def criteria(spark, sf_dir) -> DataFrame:
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        F.col("l_orderkey").alias("program"),
        F.col("l_linenumber").alias("criterion"),
        F.col("l_partkey").alias("evidence_id"),
        pick(FIELDS, F.col("l_suppkey") % 5).alias("field"),
        pick(("MET", "NOT_MET", "UNKNOWN"), F.round("l_quantity").cast("int") % 3).alias("result"),
    ).distinct()


def checked(spark, sf_dir) -> DataFrame:
    part = table(spark, sf_dir, "part").where("p_partkey % 9 <> 0")
    # Evidence without an owner of its own serves every program.
    evidence = part.select(F.col("p_partkey").alias("evidence_id"), F.when(F.col("p_size") % 10 == 0, -F.col("p_partkey")).alias("program"))
    facts = spark.createDataFrame(FACTS, "field string, value string")
    return e.validated(criteria(spark, sf_dir), evidence, facts)


def statuses(spark, sf_dir) -> DataFrame:
    return e.overall(checked(spark, sf_dir).where("problem is null"), "program")


@query(BASE + "SELECT coalesce(problem, 'none') AS problem, result, coalesce(adjusted, 'none') AS adjusted, count(*) AS n FROM fin GROUP BY ALL")
def criteria_validation(spark, sf_dir):
    rows = checked(spark, sf_dir)
    return rows.groupBy(F.coalesce("problem", F.lit("none")).alias("problem"), "result", F.coalesce("adjusted", F.lit("none")).alias("adjusted")).agg(F.count(F.lit(1)).alias("n"))


@query(BASE + "SELECT o_orderkey AS program, coalesce(status, 'INSUFFICIENT_EVIDENCE') AS status, criteria, array_to_string(missing, ',') AS missing FROM orders LEFT JOIN st ON program = o_orderkey")
def verdict_precedence(spark, sf_dir):
    all_programs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("program"))
    rows = e.with_status(all_programs, statuses(spark, sf_dir), "program")
    return rows.select("program", "status", "criteria", F.nullif(F.array_join("missing", ","), F.lit("")).alias("missing"))


@query(BASE + """, m AS (SELECT program, unnest(missing) AS source FROM st WHERE status = 'NEEDS_MORE_INFO'),
f AS (SELECT program, source, CASE source WHEN 'annual_revenue' THEN 'revenue' WHEN 'credit_score' THEN 'revenue' ELSE source END AS field FROM m)
SELECT field, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, count(DISTINCT program) AS programs, min(program) AS first_program FROM f WHERE field IN ('industry', 'revenue', 'region') AND field NOT IN ('region') GROUP BY field""")
def missing_information(spark, sf_dir):
    rows = statuses(spark, sf_dir).withColumn("rank", F.col("program"))
    out = e.missing_fields(rows, {"annual_revenue": "revenue", "credit_score": "revenue"}, ["industry", "revenue", "region"], ["region"])
    return out.select("field", F.array_join("sources", ",").alias("sources"), F.size("programs").cast("long").alias("programs"), F.col("first.rank").alias("first_program"))


@query(BASE + """, r AS (SELECT program % 40 AS flow, program AS rank, program, CASE status WHEN 'ELIGIBLE' THEN 'recommended' WHEN 'INELIGIBLE' THEN 'excluded' ELSE 'unresolved' END AS category FROM st)
SELECT flow, category, count(*) AS n, string_agg(program::VARCHAR, ',' ORDER BY rank) AS programs FROM r GROUP BY ALL""")
def final_result(spark, sf_dir):
    rows = statuses(spark, sf_dir).withColumn("flow", F.col("program") % 40).withColumn("rank", F.col("program"))
    out = e.final_result(rows, "flow")
    return out.select("flow", "category", "n", F.array_join(F.transform("items", lambda x: x["program"].cast("string")), ",").alias("programs"))


@query("""WITH cited AS (SELECT DISTINCT l_orderkey % 500 AS answer, l_partkey AS evidence_id, l_orderkey AS program FROM lineitem), got AS (SELECT DISTINCT l_orderkey % 500 AS answer, l_partkey AS evidence_id FROM lineitem WHERE l_partkey % 17 <> 0)
SELECT answer, bool_and(g.evidence_id IS NOT NULL) AS grounded, count(DISTINCT program) <= 1 AS one_program FROM cited LEFT JOIN got g USING (answer, evidence_id) GROUP BY answer""")
def citation_guard(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("answer"), F.col("l_partkey").alias("evidence_id"), F.col("l_orderkey").alias("program")).distinct()
    return e.citations_hold(rows, rows.where("evidence_id % 17 <> 0").select("answer", "evidence_id"), "answer")


@query("SELECT user_id, count_if(event_type IN ('purchase', 'signup'))::BIGINT AS completed, count_if(event_type = 'error')::BIGINT AS failed, count_if(event_type IN ('view', 'click'))::BIGINT AS pending FROM events GROUP BY user_id")
def evaluation_progress(spark, sf_dir):
    state = F.when(F.col("event_type").isin("purchase", "signup"), "COMPLETED").when(F.col("event_type") == "error", "FAILED").otherwise("PENDING")
    return e.progress(table(spark, sf_dir, "events").withColumn("state", state), "user_id")


@query(f"""WITH f AS (SELECT c.*, (SELECT min(o_orderdate)::DATE FROM orders WHERE o_custkey = c_custkey) AS d FROM customer c),
m AS (SELECT *, (year(DATE '{AS_OF}') - year(d)) * 12 + month(DATE '{AS_OF}') - month(d) AS months FROM f),
p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN lower(c_mktsegment) END AS a, CASE WHEN d <= DATE '{AS_OF}' THEN CASE WHEN months < 12 THEN 'start-up' WHEN months < 36 THEN 'young firm' ELSE 'firm' END END AS b,
  CASE WHEN c_acctbal >= 0 THEN CASE WHEN c_acctbal < 1000 THEN 'small revenue' WHEN c_acctbal < 5000 THEN 'medium revenue' ELSE 'large revenue' END END AS c, CASE WHEN c_nationkey % 4 = 0 THEN 'exporter' END AS d FROM m)
SELECT id, nullif(concat_ws(' ', a, b, c, d), '') AS sentence, concat_ws(',', CASE WHEN a IS NOT NULL THEN 'industry' END, CASE WHEN b IS NOT NULL THEN 'age' END, CASE WHEN c IS NOT NULL THEN 'revenue' END, CASE WHEN d IS NOT NULL THEN 'exporter' END) AS fields FROM p""")
def company_query(spark, sf_dir):
    first = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").cast("date").alias("day"))
    rows = table(spark, sf_dir, "customer").join(first, "c_custkey", "left")
    as_of = F.lit(AS_OF).cast("date")
    age = dates.bucket(dates.calendar_months(F.col("day"), as_of), ((12, "start-up"), (36, "young firm"), (None, "firm")))
    revenue = dates.bucket(F.col("c_acctbal"), ((1000, "small revenue"), (5000, "medium revenue"), (None, "large revenue")))
    parts = [
        ("industry", F.when(F.col("c_custkey") % 3 != 0, F.lower("c_mktsegment"))),
        ("age", F.when(F.col("day") <= as_of, age)),
        ("revenue", F.when(F.col("c_acctbal") >= 0, revenue)),
        ("exporter", F.when(F.col("c_nationkey") % 4 == 0, "exporter")),
    ]
    out = rows.select(F.col("c_custkey").alias("id"), e.profile_sentence(parts).alias("p"))
    return out.select("id", "p.sentence", F.array_join("p.fields", ",").alias("fields"))


@query("""SELECT c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 'small,medium' WHEN 'MACHINERY' THEN 'medium' END AS targets,
  concat_ws(',', CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'size:no_mapping' END, CASE WHEN c_custkey % 7 = 0 THEN 'status:differs_by_program' END, CASE WHEN c_nationkey > 20 THEN 'region:not_standard' END) AS unapplied, c_custkey % 11 = 0 AS closed FROM customer""")
def company_conditions(spark, sf_dir):
    size = F.col("c_mktsegment")
    mapping = F.create_map(F.lit("BUILDING"), F.lit("small,medium"), F.lit("MACHINERY"), F.lit("medium"))
    targets = F.try_element_at(mapping, size)
    left = F.filter(F.array(F.when(targets.isNull(), "size:no_mapping"), F.when(F.col("c_custkey") % 7 == 0, "status:differs_by_program"), F.when(F.col("c_nationkey") > 20, "region:not_standard")), lambda x: x.isNotNull())
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), targets.alias("targets"), F.array_join(left, ",").alias("unapplied"), (F.col("c_custkey") % 11 == 0).alias("closed"))


@query("""WITH s AS (SELECT conv_id, turn, text, ['the', 'der', 'que', 'zzz'][conv_id % 4 + 1] AS value FROM conversations WHERE role = 'user'),
g AS (SELECT *, length(value) > 0 AND contains(regexp_replace(text, '\\s+', '', 'g'), value) AS grounded, value IN ('the', 'que') AS known FROM s)
SELECT conv_id, turn, CASE WHEN grounded AND known THEN value END AS applied, CASE WHEN grounded AND NOT known THEN value END AS unapplied, CASE WHEN NOT grounded THEN value END AS discarded FROM g""")
def grounded_conditions(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'user'")
    value = F.element_at(F.array(*map(F.lit, ("the", "der", "que", "zzz"))), (F.col("conv_id") % 4 + 1).cast("int"))
    ok, known = text.grounded(value, F.col("text")), value.isin("the", "que")
    return rows.select("conv_id", "turn", F.when(ok & known, value).alias("applied"), F.when(ok & ~known, value).alias("unapplied"), F.when(~ok, value).alias("discarded"))


@query("""SELECT conv_id, turn, CASE WHEN contains(lower(text), 'list') OR contains(lower(text), 'than ') THEN 'SEARCH_LIST' WHEN contains(lower(text), 'the ') THEN 'DOCUMENT_QA' END AS mode FROM conversations WHERE role = 'user'""")
def request_mode(spark, sf_dir):
    low = F.lower("text")
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: low.contains(w))
    mode = F.when(has(["list", "than "]), "SEARCH_LIST").when(has(["the "]), "DOCUMENT_QA")
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", mode.alias("mode"))


@query("""SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_id % 5 END AS k, event_id % 3 = 0 AS failed FROM events""")
def strict_json(spark, sf_dir):
    """Model output is read strictly: duplicate keys and broken JSON fail the row, not the job."""
    raw = F.when(F.col("event_id") % 3 == 0, '{"k": 1, "k": 2}').otherwise(F.concat(F.lit('{"k": '), (F.col("event_id") % 5).cast("string"), F.lit(', "more": [1, 2]}')))
    rows = table(spark, sf_dir, "events").select("event_id", F.try_parse_json(raw).alias("v"))
    return rows.select("event_id", F.try_variant_get("v", "$.k", "long").alias("k"), F.col("v").isNull().alias("failed"))


@query("""SELECT c_custkey AS id, 'size=' || c_mktsegment || ';extra_1=' || c_nationkey || CASE WHEN c_custkey % 2 = 0 THEN ';extra_2=temporary' ELSE '' END AS facts FROM customer""")
def profile_facts(spark, sf_dir):
    """A stored profile merged with temporary facts; further facts get stable ids by their position."""
    stored = F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string"))
    added = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("note"), F.lit("temporary"))).otherwise(F.create_map().cast("map<string,string>"))
    extra = F.transform(F.map_entries(F.map_concat(stored, added)), lambda x, k: F.concat(F.lit("extra_"), (k + 1).cast("string"), F.lit("="), x["value"]))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array_join(F.concat(F.array(F.concat(F.lit("size="), "c_mktsegment")), extra), ";").alias("facts"))


@query("""SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'FAILED' ELSE 'WAITING' END AS status, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'expired' END AS failure, event_type AS step FROM events""")
def expired_states(spark, sf_dir):
    """Fields of a nested state are rewritten in place."""
    state = F.struct(F.lit("WAITING").alias("status"), F.lit(None).cast("string").alias("failure"), F.col("event_type").alias("step"))
    rows = table(spark, sf_dir, "events").withColumn("state", state)
    old = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    rows = rows.withColumn("state", F.when(old, F.col("state").withField("status", F.lit("FAILED")).withField("failure", F.lit("expired"))).otherwise(F.col("state")))
    return rows.select("event_id", "state.status", "state.failure", "state.step")
