"""Queries for evaluation metrics and text rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import markup
from tessera.functions import text as t
from tessera.operators import documents as d
from tessera.operators import evaluation as v
from tessera.plans.base import registrar
from tessera.sources.tables import table

QUERIES, ORACLES = {}, {}
query = registrar(QUERIES, ORACLES)

TOKENS_SQL = """WITH e AS (SELECT item_id AS id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM benchmark), a AS (SELECT doc_id AS id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)),
ec AS (SELECT id, w, count(*) AS e FROM e WHERE w <> '' GROUP BY ALL), ac AS (SELECT id, w, count(*) AS a FROM a WHERE w <> '' GROUP BY ALL)
"""


def token_rows(spark, sf_dir):
    words = lambda c: F.explode(F.filter(F.split(F.lower(c), "[^a-z]+"), lambda w: w != ""))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").join(items.select("id"), "id", "left_semi")
    return items.select("id", words("text").alias("w")), docs.select("id", words("text").alias("w"))


@query(TOKENS_SQL + "SELECT id, sum(e)::BIGINT AS expected, sum(least(e, coalesce(a, 0)))::BIGINT AS found, round(sum(least(e, coalesce(a, 0))) / sum(e)::DOUBLE, 6) AS recall FROM ec LEFT JOIN ac USING (id, w) GROUP BY id")
def multiset_recall(spark, sf_dir):
    return v.multiset_recall(*token_rows(spark, sf_dir), "id", "w")


@query(TOKENS_SQL + "SELECT id, sum(greatest(0, e - coalesce(a, 0)))::BIGINT AS missing FROM ec LEFT JOIN ac USING (id, w) GROUP BY id HAVING sum(greatest(0, e - coalesce(a, 0))) > 0")
def multiset_difference(spark, sf_dir):
    return v.multiset_difference(*token_rows(spark, sf_dir)).groupBy("id").agg(F.count(F.lit(1)).alias("missing"))


@query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_value, max(value) AS most, round(median(value), 6) AS middle, count_if(value > 100)::BIGINT AS failures, round((sum(value) + 5 * count(*)) / 1e6, 9) AS cost FROM events GROUP BY event_type""")
def latency_summary(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("value"), 6).alias("mean_value"),
        F.max("value").alias("most"),
        F.round(F.median("value"), 6).alias("middle"),
        F.count_if(F.col("value") > 100).alias("failures"),
        F.round((F.sum("value") + 5 * F.count(F.lit(1))) / 1e6, 9).alias("cost"),
    )


@query("""WITH r AS (SELECT l_suppkey % 7 AS engine, l_orderkey, count(*) AS expected, count_if(l_returnflag = 'A') AS found FROM lineitem GROUP BY ALL)
SELECT engine, round(sum(found) / sum(expected)::DOUBLE, 4) AS micro, round(avg(found / expected::DOUBLE), 4) AS macro, count(*) AS n FROM r GROUP BY engine""")
def micro_macro_recall(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 7).alias("engine"), "l_orderkey")
    rows = rows.agg(F.count(F.lit(1)).alias("expected"), F.count_if(F.col("l_returnflag") == "A").alias("found"))
    return v.micro_macro(rows, "engine", "found", "expected")


@query("""WITH c AS (SELECT l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY 1), g AS (SELECT unnest(['A', 'N', 'R', 'X']) AS flag)
SELECT flag, coalesce(n, 0)::BIGINT AS n, coalesce(n, 0) / (SELECT sum(n) FROM c)::DOUBLE AS share FROM g LEFT JOIN c USING (flag)""")
def distribution(spark, sf_dir):
    counted = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("n"))
    return v.zero_filled(counted, ["A", "N", "R", "X"], "flag", "n")


@query("""SELECT doc_id, (contains(text, 'the') OR contains(text, 'der')) AND (contains(text, 'ing') OR contains(text, 'ung')) AS hit FROM documents""")
def fact_groups(spark, sf_dir):
    groups = F.array(F.array(F.lit("the"), F.lit("der")), F.array(F.lit("ing"), F.lit("ung")))
    return table(spark, sf_dir, "documents").select("doc_id", t.groups_hit(F.col("text"), groups).alias("hit"))


#: Each kind is masked before the next; this differs from skipping only where a match overlaps a mask in part.
CRITICAL_SQL = "WITH s0 AS (SELECT doc_id, text || CASE doc_id % 5 WHEN 0 THEN ' 2026년 9월 3일' WHEN 1 THEN ' 5천만원 12개월' WHEN 2 THEN ' 3.5 %' ELSE '' END AS t FROM documents)"
for k, (_, pattern) in enumerate(t.CRITICAL):
    CRITICAL_SQL += f", s{k + 1} AS (SELECT doc_id, regexp_replace(t, '{pattern}', chr(1), 'g') AS t, regexp_extract_all(t, '{pattern}') AS x FROM s{k})"
CRITICAL_SQL += ", a AS (" + " UNION ALL ".join(f"SELECT '{kind}' AS kind, unnest(x) AS token FROM s{k + 1}" for k, (kind, _) in enumerate(t.CRITICAL)) + ")"
CRITICAL_SQL += " SELECT kind, regexp_replace(token, '\\s+', '', 'g') AS token, count(*) AS n FROM a GROUP BY ALL"


@query(CRITICAL_SQL)
def critical_tokens(spark, sf_dir):
    k = F.col("doc_id") % 5
    more = F.when(k == 0, " 2026년 9월 3일").when(k == 1, " 5천만원 12개월").when(k == 2, " 3.5 %").otherwise("")
    rows = table(spark, sf_dir, "documents").select(F.explode(t.critical_tokens(F.concat("text", more))).alias("x"))
    return rows.groupBy("x.kind", "x.token").agg(F.count(F.lit(1)).alias("n"))


#: The references that the pages use; a paragraph without an end tag ends where the next one or its parent does.
PLAIN_SQL = r"""
WITH s AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<title\b.*?</title>|<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g'), '<[a-zA-Z/][^>]*$', '') AS t FROM pages),
p AS (SELECT page_id, list_transform(string_split(regexp_replace(t, '(?i)<p(?:\s[^>]*)?>', chr(1), 'g'), chr(1)), lambda x, i: CASE WHEN i = 1 OR regexp_matches(x, '(?i)</p>') THEN x
  WHEN regexp_matches(x, '(?i)</(?:article|div)>') THEN regexp_replace(x, '(?i)(</(?:article|div)>)', chr(10) || '\1') ELSE x || chr(10) END) AS x FROM s),
b AS (SELECT page_id, regexp_replace(regexp_replace(array_to_string(x, ''), '(?i)<br\s*/?>|</(?:p|div|li|h[1-6]|tr)>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM p),
e AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(t, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&middot;', '·'), '&copy;', '©'), chr(160), ' ') AS t FROM b),
a AS (SELECT page_id, list_transform(string_split(replace(regexp_replace(t, '&amp;?', '&', 'g'), chr(13), chr(10)), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS lines FROM e)
SELECT page_id, trim(regexp_replace(array_to_string(lines, chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), chr(10)) AS text FROM a
"""


@query(PLAIN_SQL)
def html_plain_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", markup.plain_html(F.col("html")).alias("text"))


@query("""SELECT doc_id, length(regexp_replace(text, '\\s', '', 'g')) AS visible, substr(trim(text), 1, 40) AS title, CASE WHEN regexp_full_match(source, '[A-Za-z0-9_.:/ -]{0,80}') THEN source ELSE '[redacted]' END AS source FROM documents""")
def text_facts(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", t.visible_chars(text).alias("visible"), t.title_of(text).alias("title"), t.safe_value(F.col("source")).alias("source"))


@query("""WITH r AS (SELECT page_id, url, 'dir' || page_id % 3 || CASE WHEN page_id % 2 = 0 THEN '/' ELSE '\\' END || 'file' || page_id || CASE page_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.zip' ELSE '' END AS path FROM pages)
SELECT page_id, 'file' || page_id || CASE page_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.zip' ELSE '' END AS base, CASE page_id % 3 WHEN 0 THEN 'PDF' WHEN 1 THEN 'ZIP' ELSE 'UNKNOWN' END AS kind, contains(url, 'page=2') AS leaks FROM r""")
def paths_and_leaks(spark, sf_dir):
    k = F.col("page_id")
    end = F.when(k % 3 == 0, ".pdf").when(k % 3 == 1, ".zip").otherwise("")
    path = F.concat(F.lit("dir"), (k % 3).cast("string"), F.when(k % 2 == 0, "/").otherwise("\\"), F.lit("file"), k.cast("string"), end)
    base = d.basename(path)
    return table(spark, sf_dir, "pages").select("page_id", base.alias("base"), d.extension(base).alias("kind"), t.leaks(F.col("url"), "page=2").alias("leaks"))


@query(f"""WITH r AS (SELECT conv_id, turn, text, CASE WHEN turn % 4 <> 1 THEN role ELSE '' END AS title, CASE WHEN conv_id % 3 = 0 THEN role || ' > ' || turn ELSE '-' END AS heading,
  CASE WHEN turn % 2 = 0 THEN 'p.' || turn || ', ' || (turn + 1) WHEN conv_id % 2 = 0 THEN '{t.IN_SECTIONS}a' || CASE WHEN role = 'a' THEN '' ELSE ', ' || role END ELSE '{t.NOWHERE}' END AS place FROM conversations),
b AS (SELECT conv_id, text, turn, concat_ws(chr(10), '[E' || row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) || ']', '{t.TITLE}' || CASE WHEN coalesce(title, '') = '' THEN '-' ELSE title END, '{t.PLACE}' || place, '{t.HEADING}' || heading, '{t.CONTENT}', text) AS block FROM r)
SELECT conv_id, string_agg(block, chr(10) || chr(10) ORDER BY turn, text) AS context FROM b GROUP BY conv_id""")
def numbered_context(spark, sf_dir):
    """The turns of a conversation as numbered blocks of context, with places from pages or sections."""
    turn, role = F.col("turn"), F.col("role")
    none = F.array().cast("array<string>")
    place = t.location(F.when(turn % 2 == 0, F.array(turn, turn + 1)).otherwise(F.array().cast("array<int>")), F.when(F.col("conv_id") % 2 == 0, F.array(role, F.lit("a"), F.lit(""), role)).otherwise(none))
    headings = F.when(F.col("conv_id") % 3 == 0, F.array(role, turn.cast("string"))).otherwise(none)
    row = F.struct("turn", "text", F.when(turn % 4 != 1, role).otherwise("").alias("title"), place.alias("place"), headings.alias("headings"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("all"))
    return rows.select("conv_id", t.numbered_context(F.col("all")).alias("context"))


@query("SELECT doc_id, nfc_normalize(text) = text AS composed, length(nfc_normalize(text)) AS n FROM documents")
def normal_forms(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("c", t.nfc(F.col("text")))
    return rows.select("doc_id", (F.col("c") == F.col("text")).alias("composed"), F.length("c").alias("n"))


@query("""SELECT page_id, starts_with(lower(ltrim(html)), '<!doctype html') OR starts_with(lower(ltrim(html)), '<html') AS is_html, upper(substr(hex(encode(html)), 1, 8)) AS magic FROM pages""")
def sniffed_formats(spark, sf_dir):
    head = F.lower(F.ltrim("html"))
    return table(spark, sf_dir, "pages").select("page_id", (head.startswith("<!doctype html") | head.startswith("<html")).alias("is_html"), F.hex(F.substring(F.col("html").cast("binary"), 1, 4)).alias("magic"))


@query("""WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'r' || r_regionkey, 'root' FROM region), t AS (SELECT child AS item, parent AS ancestor, 1 AS depth FROM e UNION ALL SELECT t.item, e.parent, t.depth + 1 FROM t JOIN e ON t.ancestor = e.child)
SELECT item, ancestor, depth::BIGINT AS depth FROM t""")
def recursive_tree(spark, sf_dir):
    table(spark, sf_dir, "nation").createOrReplaceTempView("tessera_nation")
    table(spark, sf_dir, "region").createOrReplaceTempView("tessera_region")
    return spark.sql(
        """WITH RECURSIVE e AS (SELECT concat('n', n_nationkey) AS child, concat('r', n_regionkey) AS parent FROM tessera_nation UNION ALL SELECT concat('r', r_regionkey), 'root' FROM tessera_region),
        t AS (SELECT child AS item, parent AS ancestor, 1 AS depth FROM e UNION ALL SELECT t.item, e.parent, t.depth + 1 FROM t JOIN e ON t.ancestor = e.child)
        SELECT item, ancestor, depth FROM t"""
    )
