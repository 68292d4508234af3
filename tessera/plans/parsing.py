"""Queries over parsed documents and judged cases."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import dates
from tessera.operators import candidates as c
from tessera.operators import evaluation as v
from tessera.operators import parsing as p
from tessera.plans.base import registrar
from tessera.plans.layout import BOXES_SQL, boxes
from tessera.sources.tables import AS_OF, PROGRAMS_SQL, RELATIONS_SQL, programs, relations, table

QUERIES, ORACLES = {}, {}
query = registrar(QUERIES, ORACLES)

WORDS_SQL = r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents), c AS (SELECT doc_id, w, ceil(len(w) / 100.0)::BIGINT AS chunk_count FROM w WHERE len(w) > 0),
k AS (SELECT doc_id, chunk_count, chunk_index, w[chunk_index * 100 + 1 : chunk_index * 100 + 100] AS part FROM c, LATERAL (SELECT unnest(range(chunk_count)) AS chunk_index)), j AS (SELECT *, array_to_string(part, ' ') AS t FROM k)
"""


@query(WORDS_SQL + "SELECT doc_id, chunk_index, chunk_count, len(part) AS n_words, sha256(length(t) || ':' || t || ';') AS content_key FROM j")
def chunked_documents(spark, sf_dir):
    return p.chunked(table(spark, sf_dir, "documents"), "doc_id", "text", 100)


@query(WORDS_SQL + ", r AS (SELECT DISTINCT l_orderkey AS program, l_partkey AS doc_id FROM lineitem) SELECT program, count(*) AS chunks, count(DISTINCT sha256(length(t) || ':' || t || ';')) AS contents FROM j JOIN r USING (doc_id) GROUP BY program")
def chunk_relations(spark, sf_dir):
    relations = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("program"), F.col("l_partkey").alias("doc_id")).distinct()
    return p.counted_contents(p.chunked(table(spark, sf_dir, "documents"), "doc_id", "text", 100), relations, "doc_id", "program")


EMBEDDED_SQL = r"""WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS t FROM documents),
h AS (SELECT doc_id, ('0x' || substr(md5(t), 1, 8))::BIGINT AS h FROM w), v AS (SELECT doc_id, h % 16 AS dim, sum(CASE WHEN h // 65536 % 2 = 1 THEN 1 ELSE -1 END) AS x FROM h GROUP BY ALL),
n AS (SELECT doc_id, sqrt(sum(x * x)) AS n FROM v GROUP BY doc_id)
SELECT doc_id, dim, round(x / n, 5) AS value FROM v JOIN n USING (doc_id) WHERE x <> 0"""


@query(EMBEDDED_SQL)
def embedded_documents(spark, sf_dir):
    """A deterministic stand-in for the model: the components that are not zero."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(p.hash_embedding(F.col("text"))).alias("dim", "value"))
    return rows.where("value <> 0").select("doc_id", "dim", F.round("value", 5).alias("value"))


@query(r"""WITH g AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN '' ELSE text END AS text, doc_id % 3 AS images FROM documents),
s AS (SELECT CASE WHEN length(regexp_replace(text, '\s', '', 'g')) = 0 AND images > 0 THEN 'OCR_REQUIRED' WHEN length(regexp_replace(text, '\s', '', 'g')) = 0 THEN 'EMPTY_TEXT' ELSE 'PARSED' END AS status, CASE WHEN contains(text, '%%%') THEN 'replacement_characters' END AS warning FROM g)
SELECT status, coalesce(warning, 'none') AS warning, count(*) AS n FROM s GROUP BY ALL""")
def parse_statuses(spark, sf_dir):
    text = F.when(F.col("doc_id") % 13 == 0, "").otherwise(F.col("text"))
    chars = F.length(F.regexp_replace(text, r"(?U)\s", ""))
    rows = table(spark, sf_dir, "documents").select(p.parse_status(chars, F.col("doc_id") % 3, text.contains("%%%").cast("int")).alias("s"))
    return rows.groupBy("s.status", F.coalesce("s.warning", F.lit("none")).alias("warning")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PROGRAMS_SQL}, x AS (SELECT id FROM programs WHERE end_date < DATE '{AS_OF}'), v AS (SELECT l_orderkey AS id FROM lineitem) SELECT (SELECT count(*) FROM v) AS before, (SELECT count(*) FROM v WHERE id IN (SELECT id FROM x)) AS target, (SELECT count(*) FROM v WHERE id NOT IN (SELECT id FROM x)) AS after, true AS exact")
def guarded_prune(spark, sf_dir):
    closed = programs(spark, sf_dir).where(dates.surely_closed(F.col("end_date"), F.lit(AS_OF).cast("date"))).select("id")
    return p.guarded_delete(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")), closed, "id")


@query(BOXES_SQL + """, n AS (SELECT DISTINCT x.page, x.cell FROM c x JOIN c z ON x.page = z.page AND x.cell <> z.cell WHERE ((z.r - z.l) * (z.bt - z.t) > (x.r - x.l) * (x.bt - x.t) OR ((z.r - z.l) * (z.bt - z.t) = (x.r - x.l) * (x.bt - x.t) AND z.cell < x.cell))
  AND greatest(0, least(x.r, z.r) - greatest(x.l, z.l)) * greatest(0, least(x.bt, z.bt) - greatest(x.t, z.t)) >= 0.9::DOUBLE * (x.r - x.l) * (x.bt - x.t))
SELECT page, cell FROM c WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.page = c.page AND n.cell = c.cell)""")
def nested_boxes(spark, sf_dir):
    return p.without_nested(boxes(spark, sf_dir)[1]).select("page", "cell")


@query(BOXES_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """, e AS (SELECT x.page, x.cell AS a, z.cell AS b FROM c x JOIN c z ON x.page = z.page AND least(x.r, z.r) > greatest(x.l, z.l) AND least(x.bt, z.bt) > greatest(x.t, z.t)),
g AS (SELECT page, cell, cell AS seen FROM c UNION SELECT g.page, g.cell, e.b FROM g JOIN e ON e.page = g.page AND e.a = g.seen)
SELECT page, cell, min(seen) AS "group" FROM g GROUP BY ALL""")
def overlap_groups(spark, sf_dir):
    return p.overlap_groups(boxes(spark, sf_dir)[1])


CELLS_SQL = """WITH c AS (SELECT l_partkey AS tab, l_orderkey % 6 AS row, l_linenumber AS col, min(CASE WHEN l_orderkey % 5 = 0 THEN ' ' ELSE 'v' || (l_orderkey % 40) END) AS text FROM lineitem GROUP BY ALL),
w AS (SELECT tab, text, 'right' AS d, row AS line, col AS pos FROM c UNION ALL SELECT tab, text, 'down', col, row FROM c), i AS (SELECT *, pos - row_number() OVER (PARTITION BY tab, d, line ORDER BY pos) AS isle FROM w),
n AS (SELECT tab, d, text, lead(text) OVER (PARTITION BY tab, d, line, isle ORDER BY pos) AS n FROM i WHERE trim(text) <> '')
"""


def table_cells(spark, sf_dir):
    k = F.col("l_orderkey")
    rows = table(spark, sf_dir, "lineitem").withColumn("t", F.when(k % 5 == 0, " ").otherwise(F.concat(F.lit("v"), (k % 40).cast("string"))))
    return rows.groupBy(F.col("l_partkey").alias("tab"), (k % 6).alias("row"), F.col("l_linenumber").alias("col")).agg(F.min("t").alias("text")).withColumns({"at": F.col("row") * 10 + F.col("col"), "rowspan": F.lit(1), "colspan": F.lit(1)})


@query(CELLS_SQL + "SELECT tab, text, n AS next_text, d AS direction FROM n WHERE n IS NOT NULL")
def cell_neighbours(spark, sf_dir):
    return p.neighbours(table_cells(spark, sf_dir), "tab")


@query(CELLS_SQL + """, a AS (SELECT tab % 2 AS side, tab // 2 AS pair, text, n, d FROM n WHERE n IS NOT NULL),
k AS (SELECT pair, text, n, d, count_if(side = 0) AS x, count_if(side = 1) AS y FROM a GROUP BY ALL),
s AS (SELECT pair, sum(least(x, y)) AS hit, sum(x) AS x, sum(y) AS y FROM k GROUP BY pair) SELECT pair, round(hit / nullif(y, 0)::DOUBLE, 6) AS precision, round(hit / nullif(x, 0)::DOUBLE, 6) AS recall, round(2 * hit / nullif(x + y, 0)::DOUBLE, 6) AS f1 FROM s""")
def adjacency_f1(spark, sf_dir):
    """Neighbours to the right and below of a table against those of its reference."""
    side = F.col("tab") % 2
    counted = p.neighbours(table_cells(spark, sf_dir), "tab").groupBy(F.floor(F.col("tab") / 2).alias("pair"), "text", "next_text", "direction").agg(F.count_if(side == 0).alias("x"), F.count_if(side == 1).alias("y"))
    s = counted.groupBy("pair").agg(F.sum(F.least("x", "y")).alias("hit"), F.sum("x").alias("x"), F.sum("y").alias("y"))
    ratio = lambda a, b: F.round(F.try_divide(a, b), 6)
    return s.select("pair", ratio(F.col("hit"), F.col("y")).alias("precision"), ratio(F.col("hit"), F.col("x")).alias("recall"), ratio(2 * F.col("hit"), F.col("x") + F.col("y")).alias("f1"))


@query("""WITH d AS (SELECT doc_id AS page, text FROM documents), n AS (SELECT page, unnest(string_split(text, '')) AS ch FROM d), f AS (SELECT page, unnest(string_split(replace(text, 'the', ''), '')) AS ch FROM d), b AS (SELECT page, unnest(string_split(replace(text, 'h', ''), '')) AS ch FROM d),
nc AS (SELECT page, ch, count(*) AS n FROM n GROUP BY ALL), fc AS (SELECT page, ch, count(*) AS f FROM f GROUP BY ALL), bc AS (SELECT page, ch, count(*) AS b FROM b GROUP BY ALL),
l AS (SELECT page, greatest(0, greatest(0, n - coalesce(f, 0)) - greatest(0, n - coalesce(b, 0))) AS lost FROM nc LEFT JOIN fc USING (page, ch) LEFT JOIN bc USING (page, ch)) SELECT page, sum(lost)::BIGINT AS lost FROM l GROUP BY page HAVING sum(lost) > 0""")
def lost_characters(spark, sf_dir):
    text = F.col("text")
    lost = p.lost_characters(text, F.replace(text, F.lit("h"), F.lit("")), F.replace(text, F.lit("the"), F.lit("")))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), lost.alias("lost")).where("lost > 0")


@query(f"""WITH {PROGRAMS_SQL} SELECT id, (CASE WHEN id % 4 = 0 AND end_date IS NULL THEN DATE '2000-01-31' WHEN id % 4 = 1 THEN end_date ELSE end_date END)::VARCHAR AS end_date, id % 4 = 0 AND end_date IS NULL AS changed FROM programs""")
def refreshed_dates(spark, sf_dir):
    """Derived dates are filled again from the stated period; a period that does not parse changes nothing."""
    raw = F.when(F.col("id") % 4 == 0, "2000-01-01 ~ 2000-01-31").when(F.col("id") % 4 == 1, "soon")
    rows = programs(spark, sf_dir).withColumn("p", dates.parsed_period(raw))
    new = F.coalesce("end_date", "p.end")
    return rows.select("id", new.alias("end_date"), (~new.eqNullSafe(F.col("end_date"))).alias("changed"))


@query("""WITH c AS (SELECT l_partkey AS page, l_linestatus AS engine, count(*) AS cells, count_if(l_quantity > 25)::BIGINT AS merged, count_if(l_discount > 0.05)::BIGINT AS tokens FROM lineitem GROUP BY ALL),
p AS (SELECT page, max(CASE WHEN engine = 'F' THEN cells END) AS ac, max(CASE WHEN engine = 'O' THEN cells END) AS bc, max(CASE WHEN engine = 'F' THEN merged END) AS am, max(CASE WHEN engine = 'O' THEN merged END) AS bm, max(CASE WHEN engine = 'F' THEN tokens END) AS at_, max(CASE WHEN engine = 'O' THEN tokens END) AS bt FROM c GROUP BY page),
r AS (SELECT *, list_filter([CASE WHEN ac IS NULL OR bc IS NULL THEN 'not_detected' END, CASE WHEN ac <> bc THEN 'shapes' END, CASE WHEN am <> bm THEN 'merged_cells' END, CASE WHEN at_ <> bt THEN 'tokens' END], lambda x: x IS NOT NULL) AS why FROM p)
SELECT page, array_to_string(why, ',') AS reasons, abs(coalesce(at_, 0) - coalesce(bt, 0)) AS gap FROM r WHERE len(why) > 0""")
def review_rows(spark, sf_dir):
    """Every table on which two engines differ, with what they differ in: for people to look at."""
    counts = {"cells": F.count(F.lit(1)), "merged": F.count_if(F.col("l_quantity") > 25), "tokens": F.count_if(F.col("l_discount") > 0.05)}
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("page"), F.col("l_linestatus").alias("engine")).agg(*[c.alias(n) for n, c in counts.items()])
    of = lambda engine, n: F.max(F.when(F.col("engine") == engine, F.col(n)))
    both = rows.groupBy("page").agg(*[of(e, n).alias(f"{e}_{n}") for e in ("F", "O") for n in counts])
    return p.differences(both, "page", "F", "O")


GOLD_SQL = f"""WITH {PROGRAMS_SQL}, x AS (SELECT owner, l_orderkey AS id, l_linenumber, row_number() OVER (PARTITION BY owner ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS place FROM lineitem JOIN programs ON id = l_orderkey),
got AS (SELECT owner, list(id ORDER BY place) AS ids FROM x WHERE place <= 5 GROUP BY owner),
gold AS (SELECT owner, list(id ORDER BY budget DESC, id)[1:2] AS wanted, (owner % 5 + 1)::BIGINT AS most FROM programs GROUP BY owner),
scope AS (SELECT id FROM programs WHERE active AND NOT (end_date IS NOT NULL AND end_date < DATE '{AS_OF}')),
odd AS (SELECT owner, count(*) AS n FROM x WHERE place <= 5 AND id NOT IN (SELECT id FROM scope) GROUP BY owner)
"""


def judged_lists(spark, sf_dir):
    """What a search listed for each owner (its five dearest items, so a program may stand twice), and what the cases expect."""
    owned = programs(spark, sf_dir)
    items = table(spark, sf_dir, "lineitem").join(owned.select(F.col("id").alias("l_orderkey"), "owner"), "l_orderkey")
    place = F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"))
    listed = items.select("owner", F.col("l_orderkey").alias("id"), place.alias("place")).where("place <= 5")
    best = F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("budget"), "id"))
    gold = owned.withColumn("place", best).where("place <= 2").groupBy("owner").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("wanted"))
    return listed, gold.withColumn("most", F.col("owner") % 5 + 1)


@query(GOLD_SQL + """SELECT gold.owner, coalesce(len(ids), 0) > 0 AS answered, list_has_all(coalesce(ids, []), wanted) AS expected_programs, coalesce(ids[1:len(wanted)] = wanted, false) AS in_order, coalesce(len(list_distinct(ids)) = len(ids), true) AS no_duplicates,
  coalesce(odd.n, 0) = 0 AS in_scope, coalesce(len(ids), 0) BETWEEN 1 AND most AS count_allowed FROM gold LEFT JOIN got USING (owner) LEFT JOIN odd USING (owner)""")
def case_checks(spark, sf_dir):
    """Listed programs of each case against its gold list, its limit, and the candidates of its filter."""
    listed, gold = judged_lists(spark, sf_dir)
    allowed = c.candidates(programs(spark, sf_dir), c.CandidateFilter(not_closed_on=AS_OF)).select("id", F.lit(True).alias("allowed"))
    return v.judged_lists(listed.join(allowed, "id", "left"), gold, "owner")


DOCUMENT_SQL = f"""WITH {RELATIONS_SQL}, r AS (SELECT program, list(content ORDER BY content) FILTER (status = 'O' OR content % 3 = 0) AS retrieved, coalesce(list(content ORDER BY content) FILTER (format = 'A'), []) AS cited,
  list(content) FILTER (content % 7 = 0) AS gold, bool_or(container % 11 = 0) AS foreign_one FROM relations GROUP BY program)
"""


@query(DOCUMENT_SQL + """SELECT program, list_has_all(coalesce(retrieved, []), cited) AS citations_known, (len(cited) > 0) = (program % 2 = 0) AS citation_presence, list_has_any(coalesce(retrieved, []), coalesce(gold, [])) AS evidence, NOT foreign_one AS own_program_only FROM r""")
def document_checks(spark, sf_dir):
    """Citations of each answer against what was retrieved for it, and retrieved evidence against the gold evidence."""
    content = F.col("content")
    rows = relations(spark, sf_dir).groupBy("program").agg(
        F.collect_list(F.when((F.col("status") == "O") | (content % 3 == 0), content)).alias("retrieved"),
        F.collect_list(F.when(F.col("format") == "A", content)).alias("cited"),
        F.collect_list(F.when(content % 7 == 0, content)).alias("gold"),
        F.bool_or(F.col("container") % 11 == 0).alias("foreign"),
    )
    return rows.select("program", *v.citation_checks(F.col("retrieved"), F.col("cited"), F.col("gold"), F.col("program") % 2 == 0), (~F.col("foreign")).alias("own_program_only"))


CRITERIA_SQL = """WITH k AS (SELECT o_orderkey AS id, list({'criterion': l_shipmode_like, 'result': r}) AS criteria FROM (SELECT o_orderkey, ['SIZE', 'REGION', 'AGE'][l_linenumber % 3 + 1] AS l_shipmode_like, CASE l_returnflag WHEN 'A' THEN 'MET' WHEN 'N' THEN 'UNMET' ELSE 'UNKNOWN' END AS r FROM orders JOIN lineitem ON o_orderkey = l_orderkey) GROUP BY o_orderkey)
"""


@query(CRITERIA_SQL + """SELECT id, len(criteria) >= id % 4 + 1 AS enough, len(list_filter(criteria, lambda x: x.criterion = 'REGION' AND x.result = 'MET')) > 0 AS criterion_hit, len(list_filter(criteria, lambda x: x.result = 'UNKNOWN')) > 0 AS unknown_found,
  list_sort(list_distinct([x.criterion FOR x IN criteria IF x.result = 'UNKNOWN'])) = ['AGE', 'SIZE'] AS missing_as_expected,
  CASE WHEN len(list_filter(criteria, lambda x: x.result = 'UNMET')) > 0 THEN 'INELIGIBLE' WHEN len(list_filter(criteria, lambda x: x.result = 'UNKNOWN')) > 0 THEN 'NEEDS_INFO' ELSE 'ELIGIBLE' END = ['ELIGIBLE', 'INELIGIBLE', 'NEEDS_INFO'][(id % 3)::INT + 1] AS status FROM k""")
def eligibility_checks(spark, sf_dir):
    """Judged criteria of each program against the case: their number, one that must be met, unknown ones, the missing fields as a set, the status."""
    item = F.struct(
        F.element_at(F.array(*map(F.lit, ("SIZE", "REGION", "AGE"))), F.col("l_linenumber") % 3 + 1).alias("criterion"),
        F.when(F.col("l_returnflag") == "A", "MET").when(F.col("l_returnflag") == "N", "UNMET").otherwise("UNKNOWN").alias("result"),
    )
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(item).alias("criteria"))
    wanted = F.element_at(F.array(*map(F.lit, ("ELIGIBLE", "INELIGIBLE", "NEEDS_INFO"))), (F.col("id") % 3 + 1).cast("int"))
    return rows.select("id", *v.criteria_checks(F.col("criteria"), F.col("id") % 4 + 1, ("REGION", "MET"), ("AGE", "SIZE"), wanted))


@query("""WITH e AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN ['industry', 'revenue'] WHEN c_custkey % 3 = 1 THEN ['region'] ELSE [] END AS missing FROM customer)
SELECT id, list_has_any(missing, ['revenue', 'credit']) AS affected, array_to_string(list_filter(missing, lambda x: x NOT IN ('revenue', 'credit')), ',') AS left_over FROM e""")
def affected_by_answers(spark, sf_dir):
    k = F.col("c_custkey") % 3
    missing = F.when(k == 0, F.array(F.lit("industry"), F.lit("revenue"))).when(k == 1, F.array(F.lit("region"))).otherwise(F.array().cast("array<string>"))
    answered = F.array(F.lit("revenue"), F.lit("credit"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), missing.alias("missing"))
    return rows.select("id", F.arrays_overlap("missing", answered).alias("affected"), F.array_join(F.array_except("missing", answered), ",").alias("left_over"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents),
w AS (SELECT doc_id, line, length(text) AS width, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS k FROM l),
s AS (SELECT *, coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id, line ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM w)
SELECT doc_id, line, k AS word, round(100.0::DOUBLE * start / width, 6) AS x_from, round(100.0::DOUBLE * (start + length(word)) / width, 6) AS x_to FROM s WHERE word <> ''""")
def line_words(spark, sf_dir):
    """Every word of every line gets the share of the line's width that its characters have."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    return p.word_spans(lines, ["doc_id", "line"], "t", 100.0)


@query()
def repeated_criteria(spark, sf_dir):
    """The similarity is the standard library's, so without SQL; the tests compare it with a plain loop."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    # A criterion of every third turn is said again, without its first word.
    again = turns.where("turn % 3 = 0").select("conv_id", (F.col("turn") + 1000).alias("turn"), F.regexp_replace("text", r"^\S*\s*", "").alias("text"))
    turns = turns.union(again)
    return p.similar_to_earlier(turns, "conv_id", "turn", "text", 0.85)


@query("""SELECT page_id, len(regexp_extract_all(html, '<p>')) AS paragraphs, len(regexp_extract_all(html, '<li>')) AS items, CASE WHEN regexp_matches(html, '<li>') THEN len(regexp_extract_all(string_split(html, '</ul>')[1], '<li>')) END AS first_list FROM pages""")
def html_counts(spark, sf_dir):
    html = F.col("html")
    first = F.when(html.contains("<li>"), F.regexp_count(F.split(html, "</ul>")[0], F.lit("<li>")))
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_count(html, F.lit("<p>")).alias("paragraphs"), F.regexp_count(html, F.lit("<li>")).alias("items"), first.alias("first_list"))


@query("""WITH s AS (SELECT substr(sha256(p_partkey::VARCHAR), 1, 3) AS prefix, p_partkey AS id FROM part), q AS (SELECT DISTINCT substr(sha256((p_partkey * 7)::VARCHAR), 1, 3) AS prefix FROM part)
SELECT q.prefix, count(s.id) AS found, CASE WHEN count(s.id) = 1 THEN min(s.id) END AS id FROM q LEFT JOIN s USING (prefix) GROUP BY q.prefix""")
def prefix_lookup(spark, sf_dir):
    """A hash prefix names a source only if exactly one has it."""
    part, head = table(spark, sf_dir, "part"), lambda c: F.substring(F.sha2(c.cast("string"), 256), 1, 3)
    sources = part.select(head(F.col("p_partkey")).alias("prefix"), F.col("p_partkey").alias("id"))
    asked = part.select(head(F.col("p_partkey") * 7).alias("prefix")).distinct()
    rows = asked.join(sources, "prefix", "left").groupBy("prefix").agg(F.count("id").alias("found"), F.min("id").alias("id"))
    return rows.withColumn("id", F.when(F.col("found") == 1, F.col("id")))
