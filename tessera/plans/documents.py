"""Queries over documents and their relations to programs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import documents as d
from tessera.plans.base import registrar
from tessera.sources.tables import AS_OF, PROGRAMS_SQL, RELATIONS_SQL, programs, relations, table

QUERIES, ORACLES = {}, {}
query = registrar(QUERIES, ORACLES)
R = f"WITH {RELATIONS_SQL} "
RP = f"WITH {RELATIONS_SQL}, {PROGRAMS_SQL} "
STATE = f"""CASE WHEN start_date IS NULL AND end_date IS NULL THEN 'UNDATED' WHEN end_date < DATE '{AS_OF}' THEN 'CLOSED' WHEN start_date > DATE '{AS_OF}' THEN 'UPCOMING' ELSE 'OPEN' END"""


LISTS_SQL = """WITH l AS (SELECT program, string_agg(CASE WHEN content % 5 = 0 THEN ' ' ELSE 'http://files/' || content END, '@' ORDER BY content) AS urls,
  string_agg('f' || content || CASE content % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.hwp' WHEN 2 THEN '.doc' ELSE '' END, '@' ORDER BY content) || CASE WHEN program % 3 = 0 THEN '@x' ELSE '' END AS names FROM relations GROUP BY program),
e AS (SELECT program, unnest(string_split(urls, '@')) AS url, unnest(string_split(names, '@')) AS name, generate_subscripts(string_split(names, '@'), 1) - 1 AS place, len(string_split(urls, '@')) = len(string_split(names, '@')) AS same FROM l)
"""


@query(R.rstrip() + ", " + LISTS_SQL[5:] + """SELECT program, place, url, CASE WHEN same THEN name END AS filename, CASE WHEN same THEN 'MATCHED' ELSE 'UNMATCHED' END AS pairing,
  CASE WHEN NOT same THEN 'UNKNOWN' WHEN ends_with(name, '.PDF') THEN 'PDF' WHEN ends_with(name, '.hwp') THEN 'HWP' WHEN ends_with(name, '.doc') THEN 'OTHER' ELSE 'UNKNOWN' END AS extension,
  sha256(length(program::VARCHAR) || ':' || program || ';' || length(place::VARCHAR) || ':' || place || ';' || length(url) || ':' || url || ';') AS key FROM e WHERE trim(url) <> '' AND url IS NOT NULL""")
def relation_explode(spark, sf_dir):
    c = F.col("content")
    url = F.when(c % 5 == 0, " ").otherwise(F.concat(F.lit("http://files/"), c.cast("string")))
    name = F.concat(F.lit("f"), c.cast("string"), F.when(c % 4 == 0, ".PDF").when(c % 4 == 1, ".hwp").when(c % 4 == 2, ".doc").otherwise(""))
    rows = relations(spark, sf_dir).groupBy("program").agg(F.array_sort(F.collect_list(F.struct("content", url.alias("url"), name.alias("name")))).alias("all"))
    listed = rows.select("program", F.array_join("all.url", "@").alias("urls"), F.concat(F.array_join("all.name", "@"), F.when(F.col("program") % 3 == 0, "@x").otherwise("")).alias("names"))
    out = d.listed_pairs(listed, "urls", "names")
    return out.select("program", F.col("at").alias("place"), "url", "filename", "pairing", "extension", d.candidate_key(F.col("program"), F.col("at"), F.col("url")).alias("key"))


@query(R + """, m AS (SELECT p_partkey AS container, p_partkey + 1 AS member FROM part WHERE p_partkey % 10 = 0)
SELECT program, content FROM relations UNION SELECT program, member FROM relations JOIN m ON content = m.container""")
def inherited_relations(spark, sf_dir):
    members = table(spark, sf_dir, "part").where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("container"), (F.col("p_partkey") + 1).alias("member"))
    return d.inherited_relations(relations(spark, sf_dir), members)


@query(R + "SELECT content, count(*) AS relations, count(DISTINCT program) AS programs, count(DISTINCT (format, status)) = 1 AS consistent FROM relations GROUP BY content")
def source_consistency(spark, sf_dir):
    return d.consistency(relations(spark, sf_dir), "content", ["format", "status"])


@query("""WITH c AS (SELECT l_partkey % 50 AS program, l_suppkey AS source, count(*) AS points FROM lineitem GROUP BY ALL), t AS (SELECT *, sum(points) OVER (PARTITION BY program) AS total, source % 4 = 0 AS reference FROM c)
SELECT program, source, points, unnest(list_filter([CASE WHEN points > 20 THEN 'document_points' END, CASE WHEN reference AND points > 14 THEN 'large_reference' END,
  CASE WHEN reference AND points >= 10 AND points / total::DOUBLE > 0.011::DOUBLE THEN 'reference_share' END], lambda x: x IS NOT NULL)) AS reason FROM t""")
def admission_reasons(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("program"), F.col("l_suppkey").alias("source"))
    return d.admission(rows, F.col("source") % 4 == 0, per_program=20, per_reference=14, share_from=10, most_share=0.011)


@query(R + """, n AS (SELECT content, format, CASE program % 4 WHEN 0 THEN p_name || ' form' WHEN 1 THEN p_name || ' LIST' ELSE p_name END AS name FROM relations JOIN part ON p_partkey = content),
r AS (SELECT content, CASE WHEN contains(replace(lower(name), ' ', ''), 'form') OR contains(replace(lower(name), ' ', ''), 'gear') THEN 'FORM' WHEN contains(replace(lower(name), ' ', ''), 'list') THEN 'LIST'
  WHEN contains(replace(lower(name), ' ', ''), 'ring') THEN 'BODY' ELSE CASE WHEN format = 'A' THEN 'BODY' ELSE 'UNKNOWN' END END AS role FROM n)
SELECT content, CASE WHEN min(role) = max(role) THEN min(role) ELSE 'UNKNOWN' END AS role FROM r GROUP BY content""")
def unanimous_role(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("content"), "p_name")
    p = F.col("program") % 4
    name = F.when(p == 0, F.concat("p_name", F.lit(" form"))).when(p == 1, F.concat("p_name", F.lit(" LIST"))).otherwise(F.col("p_name"))
    cues = {"FORM": ("form", "gear"), "LIST": ("list",), "BODY": ("ring",)}
    role = d.filename_role(name, cues, F.when(F.col("format") == "A", "BODY").otherwise("UNKNOWN"))
    return d.unanimous(relations(spark, sf_dir).join(part, "content"), "content", role)


@query(RP + f""", s AS (SELECT id, {STATE} AS state FROM programs WHERE active), k AS (SELECT id FROM s WHERE state <> 'CLOSED'),
f AS (SELECT program, content, format FROM relations WHERE program IN (SELECT id FROM k) AND format IN ('A', 'R')),
m AS (SELECT DISTINCT program, container AS content, 'M' AS format FROM relations WHERE program IN (SELECT id FROM k) AND status = 'O'),
a AS (SELECT * FROM f UNION ALL SELECT * FROM m), g AS (SELECT content, arg_min(format, (format = 'M', format)) AS format FROM a GROUP BY content)
SELECT 'programs ' || state AS measure, count(*) AS n FROM s GROUP BY state UNION ALL SELECT 'with documents', count(DISTINCT program) FROM a UNION ALL SELECT 'documents ' || format, count(*) FROM g GROUP BY format""")
def service_scope(spark, sf_dir):
    from tessera.functions import dates

    state = dates.program_state(F.col("start_date"), F.col("end_date"), F.lit(AS_OF).cast("date"))
    s = programs(spark, sf_dir).where("active").select(F.col("id").alias("program"), state.alias("state"))
    held = relations(spark, sf_dir).join(s.where("state <> 'CLOSED'").select("program"), "program", "left_semi")
    files = held.where(F.col("format").isin("A", "R")).select("program", "content", "format", F.lit(0).alias("later"))
    members = held.where("status = 'O'").select("program", F.col("container").alias("content"), F.lit("M").alias("format"), F.lit(1).alias("later")).distinct()
    both = files.unionByName(members)
    formats = d.first_by_key(both, "content", ["later", "format"], "format")
    named = lambda df, label: df.select(F.concat(F.lit(label), F.col(df.columns[0])).alias("measure"), "n")
    out = named(s.groupBy("state").agg(F.count(F.lit(1)).alias("n")), "programs ")
    out = out.union(both.agg(F.count_distinct("program").alias("n")).select(F.lit("with documents").alias("measure"), "n"))
    return out.union(named(formats.groupBy("format").agg(F.count(F.lit(1)).alias("n")), "documents "))


@query(R + """, t AS (SELECT DISTINCT content FROM relations WHERE format = 'N'), p AS (SELECT p_partkey AS content, p_size AS version, p_size > 20 AS parsed FROM part WHERE p_partkey % 3 <> 0)
SELECT t.content, CASE WHEN p.content IS NULL THEN 'no_result' WHEN NOT parsed THEN 'not_parsed' ELSE 'old_version' END AS reason FROM t LEFT JOIN p USING (content) WHERE p.content IS NULL OR NOT parsed OR version < 40""")
def parse_gate(spark, sf_dir):
    wanted = relations(spark, sf_dir).where("format = 'N'").select("content").distinct()
    parsed = table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("content"), F.col("p_size").alias("version"), (F.col("p_size") > 20).alias("parsed"), F.lit(True).alias("there"))
    rows = wanted.join(parsed, "content", "left")
    reason = F.when(F.col("there").isNull(), "no_result").when(~F.col("parsed"), "not_parsed").when(F.col("version") < 40, "old_version")
    return rows.select("content", reason.alias("reason")).where("reason is not null")


@query("SELECT a.page_id, min(b.page_id) AS earliest FROM pages a JOIN pages b ON sha256(a.url) = sha256(b.url) AND a.url = b.url GROUP BY a.page_id")
def acquired_for_url(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.sha2("url", 256).alias("hash"))
    first = pages.groupBy("hash", "url").agg(F.min("page_id").alias("earliest"))
    return pages.join(first, ["hash", "url"]).select("page_id", "earliest")


@query(R + """SELECT count(*) AS relations, count(DISTINCT content) AS contents, count(*) - count(DISTINCT content) AS duplicates, (SELECT sum(b) FROM (SELECT max(bytes) AS b FROM relations GROUP BY content))::BIGINT AS distinct_bytes,
  count_if(format = 'A')::BIGINT AS format_a, count_if(status = 'O')::BIGINT AS open, count(DISTINCT container) AS containers, round(avg(bytes), 6) AS mean_bytes, min(bytes) AS least_bytes, max(bytes) AS most_bytes, median(bytes) AS median_bytes, count(*) / 100.0::DOUBLE AS rate FROM relations""")
def acquisition_metrics(spark, sf_dir):
    rel = relations(spark, sf_dir)
    own = rel.groupBy("content").agg(F.max("bytes").alias("b")).agg(F.sum("b").alias("distinct_bytes"))
    rows = rel.agg(
        F.count(F.lit(1)).alias("relations"),
        F.count_distinct("content").alias("contents"),
        (F.count(F.lit(1)) - F.count_distinct("content")).alias("duplicates"),
        F.count_if(F.col("format") == "A").alias("format_a"),
        F.count_if(F.col("status") == "O").alias("open"),
        F.count_distinct("container").alias("containers"),
        F.round(F.avg("bytes"), 6).alias("mean_bytes"),
        F.min("bytes").alias("least_bytes"),
        F.max("bytes").alias("most_bytes"),
        F.median("bytes").alias("median_bytes"),
        (F.count(F.lit(1)) / F.lit(100.0)).alias("rate"),
    )
    return rows.join(F.broadcast(own))


@query(R + """, a AS (SELECT container, count(*) AS entries, sum(bytes)::BIGINT AS bytes, sum(bytes // 3)::BIGINT AS packed, count(*) - count(DISTINCT content) AS duplicates, count_if(content % 701 = 0)::BIGINT AS escapes FROM relations GROUP BY container),
r AS (SELECT CASE WHEN entries > 640 THEN 'entries' WHEN bytes > 16000 THEN 'total_size' WHEN duplicates > 40 THEN 'duplicate_paths' WHEN escapes > 0 THEN 'path_escape' WHEN bytes / packed::DOUBLE > 3.07::DOUBLE THEN 'ratio' END AS reason, entries FROM a)
SELECT coalesce(reason, 'none') AS reason, count(*) AS n, sum(entries)::BIGINT AS entries FROM r GROUP BY 1""")
def archive_safety(spark, sf_dir):
    rel = relations(spark, sf_dir)
    rows = rel.groupBy("container").agg(
        F.count(F.lit(1)).alias("entries"),
        F.sum("bytes").alias("bytes"),
        F.sum(F.floor(F.col("bytes") / 3)).alias("packed"),
        F.greatest(F.lit(0), F.count(F.lit(1)) - F.count_distinct("content") - 40).alias("duplicates"),
        F.count_if(F.col("content") % 701 == 0).alias("escapes"),
    )
    out = d.unsafe_reason(rows, most_entries=640, most_bytes=16000, most_ratio=3.07)
    return out.groupBy(F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum("entries").alias("entries"))


@query(R + "SELECT content, arg_min(format, (format, program)) AS format FROM relations WHERE format IN ('A', 'R') GROUP BY content")
def first_format(spark, sf_dir):
    return d.first_by_key(relations(spark, sf_dir).where(F.col("format").isin("A", "R")), "content", ["format", "program"], "format")


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars <= 200 AND (n_chars < 40 OR doc_id % 2 = 0)")
def ocr_pages(spark, sf_dir):
    return table(spark, sf_dir, "documents").where((F.col("n_chars") <= 200) & ((F.col("n_chars") < 40) | (F.col("doc_id") % 2 == 0))).select("doc_id", "n_chars")


@query("SELECT sha256(text) AS key, min(doc_id) AS first_doc, count(*) AS copies, count(DISTINCT lang) > 1 AS conflict FROM documents GROUP BY sha256(text)")
def unique_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("key")).agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"), (F.count_distinct("lang") > 1).alias("conflict"))


@query("""SELECT page_id, regexp_matches(url, '^https://') AND NOT contains(url, '#') AND regexp_matches(url, '^https://(tionsh\\.example\\.net|m\\.thther\\.example\\.org)(/|$)')
  AND coalesce(list_bool_and([x = '' OR string_split(x, '=')[1] IN ('page', 'ref') FOR x IN string_split(regexp_extract(url, '\\?([^#]*)', 1), '&')]), true) AS allowed FROM pages""")
def allowed_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", d.public_url(F.col("url"), ["tionsh.example.net", "m.thther.example.org"], ["page", "ref"]).alias("allowed"))


@query("""WITH u AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 'ftp://x/' WHEN 2 THEN NULL WHEN 3 THEN 'https://u:p@host/a' ELSE 'https://host/a b' END AS url FROM pages)
SELECT page_id, page_id % 5 IN (0, 2) AS valid FROM u""")
def valid_urls(spark, sf_dir):
    k = F.col("page_id") % 5
    url = F.when(k == 0, F.col("url")).when(k == 1, "ftp://x/").when(k == 3, "https://u:p@host/a").when(k == 4, "https://host/a b")
    return table(spark, sf_dir, "pages").select("page_id", d.url_valid(url).alias("valid"))


@query(R + ", e AS (SELECT p_partkey AS content, p_size % 4 AS expected FROM part), c AS (SELECT content, count(*) AS n FROM relations GROUP BY content) SELECT content, coalesce(n, 0)::BIGINT AS n, expected::BIGINT AS expected FROM e LEFT JOIN c USING (content) WHERE coalesce(n, 0) <> expected")
def verify_counts(spark, sf_dir):
    expected = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("content"), (F.col("p_size") % 4).alias("expected"))
    found = relations(spark, sf_dir).groupBy("content").agg(F.count(F.lit(1)).alias("n"))
    return expected.join(found, "content", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n <> expected")


@query(R + """SELECT count(*) AS total, count_if(status = 'F')::BIGINT AS done, count_if(status = 'O')::BIGINT AS remaining, round(coalesce(avg(bytes) FILTER (status = 'F'), 20), 6) AS mean_cost,
  round(count_if(status = 'O') * coalesce(avg(bytes) FILTER (status = 'F'), 20), 4) AS eta, (SELECT round(coalesce(avg(bytes), 20), 6) FROM relations WHERE status = 'X') AS fallback_cost FROM relations""")
def run_progress(spark, sf_dir):
    rel = relations(spark, sf_dir)
    mean = F.coalesce(F.avg(F.when(F.col("status") == "F", F.col("bytes"))), F.lit(20.0))
    left = F.count_if(F.col("status") == "O")
    none = F.coalesce(F.avg(F.when(F.col("status") == "X", F.col("bytes"))), F.lit(20.0))
    return rel.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "F").alias("done"), left.alias("remaining"), F.round(mean, 6).alias("mean_cost"), F.round(left * mean, 4).alias("eta"), F.round(none, 6).alias("fallback_cost"))


@query(R + """, g AS (SELECT program // 100 AS plan, program, count(*) AS n, sha256(string_agg(content::VARCHAR, ',' ORDER BY content)) AS digest FROM relations GROUP BY program)
SELECT plan, sum(n)::BIGINT AS n, sha256(string_agg(program || ':' || digest, ',' ORDER BY program)) AS plan_key FROM g GROUP BY plan""")
def plan_hash(spark, sf_dir):
    """A plan covers a hundred programs in a row. Programs are hashed first, so a plan's row gathers a hundred digests."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("content")), lambda x: x.cast("string")), ",")
    own = relations(spark, sf_dir).groupBy("program").agg(F.count(F.lit(1)).alias("n"), F.sha2(joined, 256).alias("digest"))
    rows = own.groupBy(F.floor(F.col("program") / 100).alias("plan")).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("program", "digest"))).alias("all"))
    text = F.array_join(F.transform("all", lambda x: F.concat_ws(":", x["program"].cast("string"), x["digest"])), ",")
    return rows.select("plan", "n", F.sha2(text, 256).alias("plan_key"))
