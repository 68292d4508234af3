"""Queries over programs: candidates, states, listings, regions, conditions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import dates
from tessera.operators import candidates as c
from tessera.plans.base import registrar
from tessera.sources.tables import AS_OF, PROGRAMS_SQL, programs, table

P = f"WITH {PROGRAMS_SQL} "
QUERIES, ORACLES = {}, {}


query = registrar(QUERIES, ORACLES)

STATE_SQL = f"""CASE WHEN start_date IS NULL AND end_date IS NULL THEN 'UNDATED' WHEN end_date < DATE '{AS_OF}' THEN 'CLOSED'
  WHEN start_date > DATE '{AS_OF}' THEN 'UPCOMING' ELSE 'OPEN' END"""


@query(P + f"""SELECT id, category, target, jurisdiction FROM programs WHERE active AND category IN ('1-URGENT', '2-HIGH')
  AND target IN ('BUILDING', 'MACHINERY') AND NOT (end_date IS NOT NULL AND end_date < DATE '{AS_OF}')""")
def candidate_filter(spark, sf_dir):
    f = c.CandidateFilter(categories=("1-URGENT", "2-HIGH"), targets=("BUILDING", "MACHINERY"), not_closed_on=AS_OF)
    return c.candidates(programs(spark, sf_dir), f).select("id", "category", "target", "jurisdiction")


@query(P + "SELECT id, jurisdiction FROM programs WHERE active AND jurisdiction NOT IN ('NATION_1', 'NATION_2', 'NATION_3')")
def candidate_not_in_nulls(spark, sf_dir):
    f = c.CandidateFilter(not_jurisdictions=("NATION_1", "NATION_2", "NATION_3"))
    return c.candidates(programs(spark, sf_dir), f).select("id", "jurisdiction")


@query(P + f"""SELECT count(*) AS n, count_if(start_date IS NULL AND end_date IS NULL) AS undated, count_if(end_date IS NULL) AS open_ended FROM programs
  WHERE active AND NOT ((end_date IS NOT NULL AND end_date < DATE '{AS_OF}') OR (start_date IS NOT NULL AND start_date > DATE '{AS_OF}'))""")
def open_interval_filter(spark, sf_dir):
    rows = c.candidates(programs(spark, sf_dir), c.CandidateFilter(open_on=AS_OF))
    undated = F.col("start_date").isNull() & F.col("end_date").isNull()
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(undated).alias("undated"), F.count_if(F.col("end_date").isNull()).alias("open_ended"))


@query(P + f"SELECT {STATE_SQL} AS state, count(*) AS n, sum(round(budget * 100)::BIGINT)::BIGINT AS cents FROM programs WHERE active GROUP BY 1")
def program_state(spark, sf_dir):
    state = dates.program_state(F.col("start_date"), F.col("end_date"), F.lit(AS_OF).cast("date"))
    rows = programs(spark, sf_dir).where("active").groupBy(state.alias("state"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("budget") * 100).cast("long")).alias("cents"))


@query(P + f"""SELECT id, name, {STATE_SQL} AS state, count(*) OVER () AS total FROM programs WHERE active AND category = '3-MEDIUM' AND {STATE_SQL} = 'OPEN'
  ORDER BY id DESC LIMIT 20 OFFSET 20""")
def listing_page(spark, sf_dir):
    return c.listing_page(programs(spark, sf_dir), AS_OF, page=1, size=20, category="3-MEDIUM", state="OPEN")


@query(P + "SELECT id, name FROM programs WHERE active AND (contains(name, 'support 17') OR contains(category, 'support 17'))")
def keyword_search(spark, sf_dir):
    word = "  support 17 ".strip()
    return programs(spark, sf_dir).where(F.col("active") & (F.col("name").contains(word) | F.col("category").contains(word))).select("id", "name")


@query(P + """SELECT DISTINCT 'category' AS field, category AS value FROM programs WHERE active AND category IS NOT NULL
  UNION ALL SELECT DISTINCT 'target', target FROM programs WHERE active AND target IS NOT NULL
  UNION ALL SELECT DISTINCT 'jurisdiction', jurisdiction FROM programs WHERE active AND jurisdiction IS NOT NULL""")
def filter_domain(spark, sf_dir):
    return c.domain_values(programs(spark, sf_dir), "category", "target", "jurisdiction")


@query(P + "SELECT id, category, budget FROM programs WHERE id = 42 AND active")
def active_point_lookup(spark, sf_dir):
    return programs(spark, sf_dir).where((F.col("id") == 42) & F.col("active")).select("id", "category", "budget")


@query(P + f"SELECT id, end_date::VARCHAR AS end_date FROM programs WHERE end_date IS NOT NULL AND end_date < DATE '{AS_OF}'")
def closed_programs(spark, sf_dir):
    return programs(spark, sf_dir).where(dates.surely_closed(F.col("end_date"), F.lit(AS_OF).cast("date"))).select("id", "end_date")


@query(P + """, k AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_quantity > 45)
SELECT id, name, category, start_date::VARCHAR AS start_date FROM programs WHERE active AND id IN (SELECT id FROM k)""")
def metadata_for_keys(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("id"))
    return programs(spark, sf_dir).where("active").join(keys, "id", "left_semi").select("id", "name", "category", "start_date")


@query(P + """, a AS (SELECT 'NATION_' || n_nationkey AS alias, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 <> 3),
o AS (SELECT n_name AS jurisdiction, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 = 0),
t AS (SELECT id, trim(x) AS alias FROM (SELECT id, unnest(string_split(regexp_extract(name, '^\\s*\\[([^\\]]+)\\]', 1), ',')) AS x FROM programs) WHERE trim(x) <> ''),
g AS (SELECT id, list_sort(list(DISTINCT region) FILTER (region IS NOT NULL)) AS tagged, bool_or(region IS NULL) AS unknown FROM t LEFT JOIN a USING (alias) GROUP BY id),
r AS (SELECT p.id, o.region AS own, CASE WHEN coalesce(unknown, true) THEN [] ELSE tagged END AS tagged FROM programs p LEFT JOIN o USING (jurisdiction) LEFT JOIN g ON g.id = p.id)
SELECT id, CASE WHEN len(tagged) > 1 THEN array_to_string(tagged, ',') WHEN own IS NOT NULL THEN own ELSE array_to_string(tagged, ',') END AS regions,
       CASE WHEN len(tagged) > 1 THEN 'TITLE' WHEN own IS NOT NULL THEN 'OWNER' WHEN len(tagged) = 1 THEN 'TITLE' ELSE 'NONE' END AS basis,
       CASE WHEN own IS NOT NULL THEN own = 'ASIA' ELSE len(tagged) = 0 OR tagged[1] = 'ASIA' END AS allowed_in_asia FROM r""")
def region_rules(spark, sf_dir):
    names = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    aliases = names.where("n_nationkey % 4 <> 3").select(F.concat(F.lit("NATION_"), "n_nationkey").alias("alias"), F.col("r_name").alias("region"))
    owners = names.where("n_nationkey % 3 = 0").select(F.col("n_name").alias("jurisdiction"), F.col("r_name").alias("region"))
    rows = c.program_regions(programs(spark, sf_dir), owners, aliases)
    return rows.select("id", F.array_join("regions", ",").alias("regions"), "basis", c.region_allowed(F.col("regions"), "ASIA").alias("allowed_in_asia"))


@query("""WITH a AS (SELECT replace(n_name, '_', ' ') AS alias, r_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 <> 4 UNION ALL SELECT 'NATION 1' || n_name, 'INNER' FROM nation WHERE n_nationkey = 2),
c AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN ' NATION ' || c_nationkey || ' city ' || c_custkey WHEN 1 THEN 'NATION' || c_nationkey || 'NATION_2' ELSE c_mktsegment END AS place FROM customer),
m AS (SELECT DISTINCT place, replace(alias, ' ', '') AS p, value FROM c, a WHERE starts_with(replace(place, ' ', ''), replace(alias, ' ', '')))
SELECT id, c.place, g.region FROM c LEFT JOIN (SELECT place, arg_max(value, length(p)) AS region FROM m GROUP BY place) g ON g.place = c.place""")
def longest_regions(spark, sf_dir):
    """The region of a place by the longest alias that it begins with; aliases nest, and some places have none."""
    names = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    aliases = names.where("n_nationkey % 5 <> 4").select(F.replace("n_name", F.lit("_"), F.lit(" ")).alias("alias"), F.col("r_name").alias("value"))
    aliases = aliases.union(names.where("n_nationkey = 2").select(F.concat(F.lit("NATION 1"), "n_name"), F.lit("INNER")))
    key, nation = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    place = F.when(key % 3 == 0, F.concat(F.lit(" NATION "), nation, F.lit(" city "), key.cast("string"))).when(key % 3 == 1, F.concat(F.lit("NATION"), nation, F.lit("NATION_2"))).otherwise(F.col("c_mktsegment"))
    return c.longest_prefix(table(spark, sf_dir, "customer").select(key.alias("id"), place.alias("place")), "place", aliases, "region")


@query(P + """, a AS (SELECT 'NATION_' || n_nationkey AS alias, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT coalesce(a.region, 'NONE') AS region, count(*) AS n FROM programs p LEFT JOIN a ON p.jurisdiction = a.alias WHERE active GROUP BY 1""")
def region_histogram(spark, sf_dir):
    names = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = programs(spark, sf_dir).where("active").join(names, F.col("jurisdiction") == F.col("n_name"), "left")
    return rows.groupBy(F.coalesce("r_name", F.lit("NONE")).alias("region")).agg(F.count(F.lit(1)).alias("n"))


CONFLICT_SQL = """WITH p AS (
  SELECT c_custkey AS id,
    CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal < 3000 THEN ['BUILDING', 'FURNITURE'] ELSE ['MACHINERY'] END AS ct,
    CASE WHEN c_custkey % 4 = 0 THEN [] WHEN c_custkey % 4 = 1 THEN [c_mktsegment] ELSE [c_mktsegment, 'MACHINERY'] END AS qt,
    CASE WHEN c_custkey % 3 = 0 THEN [] ELSE ['NATION_' || (c_custkey % 25), 'NATION_' || c_nationkey] END AS qj,
    ['NATION_' || c_nationkey, 'NATION_' || ((c_custkey % 25 + c_custkey % 2))] AS ex FROM customer),
r AS (SELECT *, list_filter(list_distinct(qj), lambda x: NOT list_contains(ex, x)) AS js, list_filter(list_distinct(qt), lambda x: list_contains(ct, x)) AS shared FROM p)
SELECT id, array_to_string(list_sort(CASE WHEN ct IS NULL THEN qt WHEN len(qt) = 0 THEN ct ELSE shared END), ',') AS targets,
       array_to_string(list_sort(js), ',') AS jurisdictions,
       CASE WHEN len(qj) > 0 AND len(js) = 0 THEN 'region' WHEN ct IS NOT NULL AND len(qt) > 0 AND len(shared) = 0 THEN 'target' END AS conflict FROM r"""


@query(CONFLICT_SQL)
def condition_conflict(spark, sf_dir):
    key, none = F.col("c_custkey"), F.array().cast("array<string>")
    nation = lambda x: F.concat(F.lit("NATION_"), x.cast("string"))
    profiles = table(spark, sf_dir, "customer").select(
        key.alias("id"),
        F.when(F.col("c_acctbal") < 0, F.lit(None)).when(F.col("c_acctbal") < 3000, F.array(F.lit("BUILDING"), F.lit("FURNITURE"))).otherwise(F.array(F.lit("MACHINERY"))).alias("company_targets"),
        F.when(key % 4 == 0, none).when(key % 4 == 1, F.array("c_mktsegment")).otherwise(F.array("c_mktsegment", F.lit("MACHINERY"))).alias("query_targets"),
        F.when(key % 3 == 0, none).otherwise(F.array(nation(key % 25), nation(F.col("c_nationkey")))).alias("query_jurisdictions"),
        F.array(nation(F.col("c_nationkey")), nation(key % 25 + key % 2)).alias("excluded_jurisdictions"),
    )
    joined = lambda x: F.array_join(F.array_sort(x), ",")
    return c.condition_conflicts(profiles).select("id", joined("targets").alias("targets"), joined("jurisdictions").alias("jurisdictions"), "conflict")


@query("""WITH r AS (SELECT o_orderkey AS id, CASE o_orderkey % 6
    WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') || ' ~ ' || strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d')
    WHEN 1 THEN strftime(o_orderdate, '%Y.%m.%d') || '~' || strftime(o_orderdate - INTERVAL 3 DAY, '%Y.%m.%d')
    WHEN 2 THEN 'until the budget is used' WHEN 3 THEN '   '
    WHEN 4 THEN strftime(o_orderdate, '%Y') || '년 2월 30일 ~ 2030년 1월 1일' END AS raw,
    o_orderdate FROM orders)
SELECT id, CASE WHEN id % 6 = 0 THEN (o_orderdate::DATE)::VARCHAR END AS start_date, CASE WHEN id % 6 = 0 THEN (o_orderdate::DATE + 30)::VARCHAR END AS end_date,
       CASE id % 6 WHEN 0 THEN 'DATE_RANGE' WHEN 2 THEN 'FREE_TEXT' WHEN 3 THEN 'UNAVAILABLE' WHEN 5 THEN 'UNAVAILABLE' ELSE 'INVALID_DATE_RANGE' END AS kind FROM r""")
def period_parse(spark, sf_dir):
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    dash, dot = (lambda d: F.date_format(d, "yyyy-MM-dd")), (lambda d: F.date_format(d, "yyyy.MM.dd"))
    raw = (
        F.when(key % 6 == 0, F.concat(dash(day), F.lit(" ~ "), dash(F.date_add(day, 30))))
        .when(key % 6 == 1, F.concat(dot(day), F.lit("~"), dot(F.date_sub(day, 3))))
        .when(key % 6 == 2, "until the budget is used")
        .when(key % 6 == 3, "   ")
        .when(key % 6 == 4, F.concat(F.date_format(day, "yyyy"), F.lit("년 2월 30일 ~ 2030년 1월 1일")))
    )
    rows = table(spark, sf_dir, "orders").select(key.alias("id"), dates.parsed_period(raw).alias("p"))
    return rows.select("id", F.col("p.start").alias("start_date"), F.col("p.end").alias("end_date"), F.col("p.kind").alias("kind"))


@query(P + f""", m AS (SELECT owner, min(created_at)::DATE AS first_day FROM programs GROUP BY owner),
a AS (SELECT owner, first_day, (year(DATE '{AS_OF}') - year(first_day)) * 12 + month(DATE '{AS_OF}') - month(first_day) AS months FROM m)
SELECT owner, months, months - (day(DATE '{AS_OF}') < day(first_day))::INT AS completed,
       CASE WHEN months < 12 THEN 'under 1 year' WHEN months < 36 THEN 'under 3 years' WHEN months < 84 THEN 'under 7 years' ELSE '7 years or more' END AS age FROM a""")
def age_months(spark, sf_dir):
    day, first = F.lit(AS_OF).cast("date"), F.col("first_day")
    rows = programs(spark, sf_dir).groupBy("owner").agg(F.min("created_at").cast("date").alias("first_day"))
    months = dates.calendar_months(first, day)
    ages = ((12, "under 1 year"), (36, "under 3 years"), (84, "under 7 years"), (None, "7 years or more"))
    return rows.select("owner", months.alias("months"), dates.completed_months(first, day).alias("completed"), dates.bucket(months, ages).alias("age"))


@query("""SELECT event_id, (ts + INTERVAL 9 HOUR)::DATE::VARCHAR AS day, ((ts + INTERVAL 9 HOUR)::DATE + 1)::TIMESTAMP - INTERVAL 9 HOUR AS resets_at FROM events""")
def service_days(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", dates.local_day(F.col("ts")).alias("day"), dates.next_local_midnight(F.col("ts")).alias("resets_at"))


@query("""WITH r AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE '2001-02-30 00:00:00' END AS raw FROM orders)
SELECT id, CASE WHEN id % 3 = 0 THEN strptime(raw, '%Y-%m-%d %H:%M:%S') END AS at FROM r""")
def source_timestamps(spark, sf_dir):
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    raw = F.when(key % 3 == 0, F.date_format(day, "yyyy-MM-dd HH:mm:ss")).when(key % 3 == 1, F.date_format(day, "yyyy/MM/dd")).otherwise("2001-02-30 00:00:00")
    return table(spark, sf_dir, "orders").select(key.alias("id"), dates.source_timestamp(raw).alias("at"))


@query("""WITH q AS (SELECT p_partkey AS qid, p_name AS query FROM part WHERE p_partkey % 20 = 0),
n AS (SELECT p_partkey AS id, p_type || ' ' || p_name AS name, p_size AS size FROM part),
s AS (SELECT qid, id, CASE WHEN contains(query, name) THEN 3 WHEN contains(name, query) THEN 1 END AS score, length(query) AS len, size FROM q, n WHERE contains(query, name) OR contains(name, query)),
r AS (SELECT *, rank() OVER (PARTITION BY qid ORDER BY score DESC, len DESC, size DESC) AS place FROM s)
SELECT qid, id, count(*) OVER (PARTITION BY qid) AS n_tied FROM r WHERE place = 1""")
def best_match_ties(spark, sf_dir):
    """Every twentieth part's name is looked up among all names. Names meet by their rarest characters in a row; rows follow by equi-joins."""
    part = table(spark, sf_dir, "part")
    asked = part.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("qid"), F.col("p_name").alias("query"))
    named = part.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_type", "p_name").alias("name"), F.col("p_size").alias("size"))
    texts, names = asked.select("query").distinct(), named.select("name").distinct()
    hits = c.containing(names, "name", texts, "query").withColumn("score", F.lit(3)).unionByName(c.containing(texts, "query", names, "name").withColumn("score", F.lit(1)))
    hits = hits.groupBy("query", "name").agg(F.max("score").alias("score")).withColumn("len", F.length("query"))
    # Only the largest size of a name can be among the best, so ties are settled by name before rows are met.
    sizes = named.groupBy("name").agg(F.max("size").alias("size"))
    best = c.best_matches(hits.join(sizes, "name"), "query", [F.desc("score"), F.desc("len"), F.desc("size")]).drop("n_tied")
    rows = best.join(named, ["name", "size"])
    rows = rows.join(rows.groupBy("query").agg(F.count(F.lit(1)).alias("n_tied")), "query")
    return asked.join(rows, "query").select("qid", "id", "n_tied")


#: Titles with a year, a round or a notice suffix, which an identity leaves out; the SQL takes the plain name instead.
TITLE_ENDS = (" 2026년 모집공고", " 제2차", " 2025 변경 공고", " 3차 추가모집공고", "")


@query(P + """, k AS (SELECT id, category, target, jurisdiction, regexp_replace(lower(CASE WHEN id % 6 = 5 THEN 'no. ' || id % 9 ELSE name END), '[^a-z0-9]', '', 'g') AS plain,
  row_number() OVER (ORDER BY budget DESC, id) AS place FROM programs WHERE active),
i AS (SELECT *, CASE WHEN length(plain) < 8 THEN id::VARCHAR ELSE concat_ws('|', plain, coalesce(jurisdiction, '-'), category, target) END AS ident FROM k),
f AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY ident ORDER BY place) = 1)
SELECT id, place AS original_rank, row_number() OVER (ORDER BY place) AS rank FROM f""")
def identity_dedup(spark, sf_dir):
    k = F.col("id") % 6
    end = F.element_at(F.array(*map(F.lit, TITLE_ENDS)), (F.col("id") % len(TITLE_ENDS) + 1).cast("int"))
    title = F.when(k == 5, F.concat(F.lit("No. "), (F.col("id") % 9).cast("string"))).otherwise(F.concat("name", end))
    rows = programs(spark, sf_dir).where("active").withColumn("title", title).withColumn("b", -F.col("budget"))
    rows = c.ranked_overall(rows, "b", "id", "original_rank")
    ident = c.business_identity(F.col("title"), F.col("id"), F.col("jurisdiction"), F.col("category"), F.col("target"))
    # The best row of each identity is one aggregate.
    best = rows.groupBy(ident.alias("ident")).agg(F.min(F.struct("b", "id", "original_rank")).alias("best")).select("best.*")
    return c.ranked_overall(best, "b", "id", "rank").select("id", "original_rank", "rank")
