"""Queries over the acquisition of documents and over archive members."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tessera.functions.formats import actual_format
from tessera.operators import acquisition as a
from tessera.plans import containers
from tessera.plans.base import registrar
from tessera.sources.tables import RELATIONS_SQL, relations, table

QUERIES, ORACLES = {}, {}
query = registrar(QUERIES, ORACLES)
R = f"WITH {RELATIONS_SQL}, "

ACQUIRED_SQL = R + """cand AS (SELECT program * 100000 + content AS key, program, content % 997 AS u, CASE format WHEN 'A' THEN 'PDF' WHEN 'N' THEN 'HWP' ELSE 'OTHER' END AS declared FROM relations),
ok AS (SELECT u, min(key) AS first FROM cand GROUP BY u HAVING count_if(NOT (key % 10 = 0 OR u % 31 = 0)) > 0),
b AS (SELECT u, first, u % 4 = 0 AS reused, CASE WHEN u % 4 <> 0 AND u % 13 = 0 THEN 'http_error' END AS failure, ['PDF', 'HWP', 'ZIP'][u % 3 + 1] AS detected FROM ok),
acq AS (SELECT key, program, 'http://files/' || u AS url, CASE WHEN failure IS NULL THEN 'ACQUIRED' ELSE 'FAILED' END AS status, failure, detected, declared NOT IN ('UNKNOWN', 'OTHER') AND declared <> detected AS format_mismatch,
  CASE WHEN failure IS NULL THEN u * 10 + 1 END AS bytes, CASE WHEN failure IS NULL THEN sha256(u::VARCHAR) END AS digest,
  CASE WHEN key <> first THEN 'REUSED_URL' WHEN reused THEN 'REUSED_EXISTING' WHEN failure IS NULL THEN 'DOWNLOADED' ELSE 'FAILED' END AS action,
  (CASE WHEN key = first AND NOT reused THEN 1 + u % 2 ELSE 0 END)::BIGINT AS requests FROM cand JOIN b USING (u))
"""


def candidates(spark, sf_dir) -> DataFrame:
    declared = F.when(F.col("format") == "A", "PDF").when(F.col("format") == "N", "HWP").otherwise("OTHER")
    u = F.col("content") % 997
    return relations(spark, sf_dir).select((F.col("program") * 100_000 + F.col("content")).alias("key"), "program", u.alias("u"), F.concat(F.lit("http://files/"), u.cast("string")).alias("url"), declared.alias("declared"))


def acquired(spark, sf_dir) -> DataFrame:
    """A run that was broken off once: a tenth of its rows and whole addresses are stored, a quarter of the addresses are known from before."""
    rows = candidates(spark, sf_dir)
    u = F.col("u")
    bodies = rows.select("u", "url").distinct().select(
        "u", "url", F.element_at(F.array(F.lit("PDF"), F.lit("HWP"), F.lit("ZIP")), (u % 3 + 1).cast("int")).alias("detected"), (u * 10 + 1).alias("bytes"), F.sha2(u.cast("string"), 256).alias("digest"),
        F.when(u % 13 == 0, "http_error").alias("failure"), (1 + u % 2).alias("requests"),
    )
    done = rows.where((F.col("key") % 10 == 0) | (u % 31 == 0)).select("key")
    return a.acquired(rows, done, bodies.where(u % 4 == 0), bodies.where(u % 4 != 0))


@query(ACQUIRED_SQL + "SELECT key, url, status, failure, detected, format_mismatch, bytes, digest, action, requests FROM acq")
def acquired_relations(spark, sf_dir):
    return acquired(spark, sf_dir)


@query(ACQUIRED_SQL + """, r AS (SELECT count(*) AS persisted, count_if(status = 'ACQUIRED')::BIGINT AS success, count_if(status = 'FAILED')::BIGINT AS failed, sum(requests)::BIGINT AS requests, count_if(format_mismatch)::BIGINT AS mismatches,
  count_if(status = 'ACQUIRED')::BIGINT AS formats, sum(CASE WHEN action = 'DOWNLOADED' THEN bytes ELSE 0 END)::BIGINT AS downloaded FROM acq),
t AS (SELECT count(*) AS total, (SELECT count(*) FROM orders) AS programs, count(DISTINCT program) AS with_candidates FROM cand)
SELECT *, 'FAIL' AS status, concat_ws(',', CASE WHEN with_candidates > programs THEN 'programs' END, CASE WHEN success + failed <> persisted THEN 'success_and_failed' END, CASE WHEN persisted > total THEN 'persisted' END, CASE WHEN formats <> success THEN 'formats' END) AS broken FROM r, t""")
def acquisition_verdict(spark, sf_dir):
    c = candidates(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"), F.count_distinct("program").alias("with_candidates"))
    totals = c.join(table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("programs")))
    out = a.with_verdict(a.acquisition_report(acquired(spark, sf_dir), totals))
    return out.withColumn("broken", F.array_join("broken", ","))


EXCLUDED, ON_HOLD = ("XLSX", "PNG"), ("HWPML",)
FORMATS = ("PDF", "HWP", "HWPX", "XLSX", "PNG", "HWPML", "ZIP", "DOCX")


@query(f"""WITH c AS (SELECT n_nationkey AS id, list_filter({list(FORMATS)}, lambda x, i: (n_nationkey + i) % 3 <> 0) AS enabled FROM nation)
SELECT id, array_to_string(list_sort(list_filter(enabled, lambda x: x NOT IN ('XLSX', 'PNG', 'HWPML', 'ZIP'))), ',') AS formats FROM c""")
def processable_formats(spark, sf_dir):
    """Formats with an enabled route, without those that are left out, on hold, or archives themselves."""
    key = F.col("n_nationkey")
    enabled = F.filter(F.array(*map(F.lit, FORMATS)), lambda x, k: (key + k + 1) % 3 != 0)
    return table(spark, sf_dir, "nation").select(key.alias("id"), F.array_join(a.processable(enabled, EXCLUDED, ON_HOLD), ",").alias("formats"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE '공고' || p_partkey || '.hwp' END AS path, ['UTF8_FLAG', 'CP949', 'RAW_BYTES'][p_partkey % 3 + 1] AS decoded_by FROM part""")
def member_names(spark, sf_dir):
    """Names with the UTF-8 flag, names in CP949, and bytes that are neither."""
    k = F.col("p_partkey")
    end = F.encode(F.concat(k.cast("string"), F.lit(".hwp")), "UTF-8")
    head = F.when(k % 3 == 0, F.encode(F.lit("공고"), "UTF-8")).when(k % 3 == 1, F.unhex(F.lit("B0F8B0ED"))).otherwise(F.unhex(F.lit("FFFF")))
    flags = F.when(k % 3 == 0, a.UTF8_FLAG).otherwise(0)
    return table(spark, sf_dir, "part").select(k.alias("id"), a.member_name(F.concat(head, end), flags).alias("x")).select("id", "x.*")


MEMBERS_SQL = """WITH m AS (SELECT p_partkey AS id, p_partkey % 16 AS k, p_size FROM part)
SELECT id, CASE WHEN k IN (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10) THEN 'EXCLUDED' WHEN k = 11 THEN 'DUPLICATE_SOURCE' ELSE 'STORED' END AS status,
  CASE k WHEN 0 THEN 'os_metadata_file' WHEN 1 THEN 'os_metadata_file' WHEN 2 THEN 'empty_or_placeholder_text' WHEN 3 THEN 'empty_or_placeholder_text' WHEN 4 THEN 'empty_member' WHEN 5 THEN 'nested_archive' WHEN 6 THEN 'nested_archive'
    WHEN 7 THEN 'hwpml_on_hold' WHEN 8 THEN 'intentionally_excluded_format' WHEN 9 THEN 'unsupported_format' WHEN 10 THEN 'unsupported_format' WHEN 11 THEN 'same_sha_as_attachment' END AS reason FROM m"""
#: Path, text and detected format of the kinds of members, by number; the rest is a stored PDF.
MEMBERS = {
    0: ("a/Thumbs.db", "x", "UNKNOWN"), 1: ("__macosx\\._a.pdf", "x", "PDF"), 2: ("dir\\note.TXT", "  to be handed in \n", "UNKNOWN"), 3: ("note.txt", "", "UNKNOWN"), 4: ("a.pdf", "", "PDF"), 5: ("b.pdf", "x", "ZIP"),
    6: ("c.7z", "x", "UNKNOWN"), 7: ("d.hwp", "x", "HWPML"), 8: ("e.png", "x", "PNG"), 9: ("long.txt", "one line\nand another", "UNKNOWN"), 10: ("f", "x", "UNKNOWN"), 11: ("same.pdf", "x", "PDF"),
}


@query(MEMBERS_SQL)
def member_classes(spark, sf_dir):
    k = F.col("p_partkey") % 16
    pick = lambda at, default: F.coalesce(*[F.when(k == n, values[at]) for n, values in MEMBERS.items()], F.lit(default))
    formats = F.array(F.lit("PDF"), F.lit("HWP"), F.lit("HWPX"))
    found = a.member_class(pick(0, "dir/file.pdf"), pick(1, "text"), pick(2, "PDF"), formats, k == 11, EXCLUDED, ON_HOLD)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), found.alias("x")).select("id", "x.*")


@query(R + """s AS (SELECT content FROM relations UNION SELECT container * 3 FROM relations), q AS (SELECT p_partkey * 3 AS content FROM part) SELECT content, content IN (SELECT content FROM s) AS known FROM q""")
def required_sources(spark, sf_dir):
    """A source may be parsed only if it is an attachment or a member of one."""
    rel = relations(spark, sf_dir)
    known = rel.select("content").union(rel.select((F.col("container") * 3).alias("content"))).distinct().withColumn("known", F.lit(True))
    asked = table(spark, sf_dir, "part").select((F.col("p_partkey") * 3).alias("content"))
    return asked.join(known, "content", "left").select("content", F.coalesce("known", F.lit(False)).alias("known"))


@query(R + """p AS (SELECT content, max(bytes) AS bytes, count(DISTINCT container) AS n, min(container) AS c, bool_or(status = 'O') AS open FROM relations GROUP BY content)
SELECT count(*) AS sources, count_if(bytes > 0)::BIGINT AS with_bytes, count_if(n > 1)::BIGINT AS shared, count_if(open AND c % 5 = 0)::BIGINT AS unverified, count_if(bytes <= 0 OR c IS NULL)::BIGINT AS broken, count_if(bytes <= 0 OR c IS NULL) = 0 AS consistent FROM p""")
def stored_pointers(spark, sf_dir):
    """Consistency of stored pointers over all sources, in one aggregate over one row for each."""
    rows = relations(spark, sf_dir).groupBy("content").agg(F.max("bytes").alias("bytes"), F.count_distinct("container").alias("n"), F.min("container").alias("c"), F.bool_or(F.col("status") == "O").alias("open"))
    broken = F.count_if((F.col("bytes") <= 0) | F.col("c").isNull())
    return rows.agg(
        F.count(F.lit(1)).alias("sources"), F.count_if(F.col("bytes") > 0).alias("with_bytes"), F.count_if(F.col("n") > 1).alias("shared"),
        F.count_if(F.col("open") & (F.col("c") % 5 == 0)).alias("unverified"), broken.alias("broken"), (broken == 0).alias("consistent"),
    )


BUILD_SQL = R + """e AS (SELECT p_partkey AS id, substr(sha256(p_partkey::VARCHAR), 1, 3) AS prefix, p_size AS pages, p_partkey % 6 = 0 AS dropped, p_partkey % 2 = 0 AS tabled FROM part),
g AS (SELECT *, CASE WHEN dropped THEN 'cell_drop' WHEN tabled AND pages <= 20 THEN 'normal_table' END AS grp FROM e),
n AS (SELECT prefix, count(*) AS n FROM e GROUP BY prefix), r AS (SELECT g.*, n FROM g JOIN n USING (prefix) WHERE grp IS NOT NULL)
"""


@query(BUILD_SQL + """, k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY sha256(id::VARCHAR)) AS place FROM r WHERE n = 1), h AS (SELECT * FROM k WHERE grp = 'cell_drop' OR place <= 30)
SELECT h.grp, h.id, coalesce(string_agg(program || '/' || container, ',' ORDER BY program, container), '') AS relations FROM h LEFT JOIN relations ON content = h.id GROUP BY h.grp, h.id""")
def corpus_build(spark, sf_dir):
    """Two groups of documents by evidence, the second limited; each prefix must name one source, and its relations come in order."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k.alias("id"), F.sha2(k.cast("string"), 256).alias("sha"), F.when(k % 6 == 0, "cell_drop").when((k % 2 == 0) & (F.col("p_size") <= 20), "normal_table").alias("grp"))
    rows = rows.withColumn("prefix", F.substring("sha", 1, 3))
    one = rows.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("prefix")
    held = rows.where("grp is not null").join(one, "prefix", "left_semi")
    picked = held.where("grp = 'cell_drop'").unionByName(held.where("grp = 'normal_table'").orderBy("sha").limit(30))
    rel = relations(spark, sf_dir).select(F.col("content").alias("id"), F.struct("program", "container").alias("x"))
    listed = F.transform(F.array_sort(F.collect_list("x")), lambda x: F.concat_ws("/", x["program"].cast("string"), x["container"].cast("string")))
    return picked.join(rel, "id", "left").groupBy("grp", "id").agg(F.array_join(listed, ",").alias("relations"))


@query(BUILD_SQL + "SELECT grp, count(*) AS documents, count_if(n > 1)::BIGINT AS ambiguous, sum(pages)::BIGINT AS pages FROM r GROUP BY grp")
def corpus_groups(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_size", F.substring(F.sha2(k.cast("string"), 256), 1, 3).alias("prefix"), F.when(k % 6 == 0, "cell_drop").when((k % 2 == 0) & (F.col("p_size") <= 20), "normal_table").alias("grp"))
    n = rows.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))
    held = rows.where("grp is not null").join(n, "prefix")
    return held.groupBy("grp").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("n") > 1).alias("ambiguous"), F.sum("p_size").alias("pages"))


def built(key: int, size: int, name: str) -> bytes:
    """A file whose parts follow from a row: an archive for even keys, else a compound file, cut short for some sizes."""
    if key % 2 == 0:
        parts = {"[Content_Types].xml": size % 2 == 0, "word/document.xml": key % 3 == 0, "xl/workbook.xml": key % 5 == 0, "xl/worksheets/sheet1.xml": key % 5 == 0, "ppt/presentation.xml": key % 7 == 0}
        parts |= {"content.xml": size % 3 == 0, f"{'../' * (key % 11 == 0)}{name}.hwp": True}
        marked = {"mimetype": "application/vnd.oasis.opendocument.text"} if size % 5 == 0 else {}
        return containers.archive_of(marked | {part: name for part, held in parts.items() if held})
    streams = {"FileHeader": key % 3 == 0, "WordDocument": key % 5 == 0, "Workbook": key % 7 == 0, "EncryptedPackage": key % 11 == 0}
    header = (b"HWP Document File" if size % 2 == 0 else b"Another file").ljust(256, b"\0")
    raw = containers.compound_of({part: header if part == "FileHeader" else (name * (size * 9)).encode() for part, held in streams.items() if held} | {name[:30]: b"HWP Document File"})
    return raw[:600] if size % 13 == 0 else raw


@F.pandas_udf(BinaryType())
def built_files(keys: pd.Series, sizes: pd.Series, names: pd.Series) -> pd.Series:
    return pd.Series([built(*row) for row in zip(keys, sizes, names, strict=True)])


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS s FROM part),
a AS (SELECT k, list_filter([CASE WHEN s % 2 = 0 AND k % 3 = 0 THEN 'DOCX' END, CASE WHEN s % 2 = 0 AND k % 5 = 0 THEN 'XLSX' END, CASE WHEN s % 2 = 0 AND k % 7 = 0 THEN 'PPTX' END, CASE WHEN s % 5 = 0 AND s % 3 = 0 THEN 'ODT' END], lambda x: x IS NOT NULL) AS kinds FROM p)
SELECT k AS id, CASE
  WHEN k % 2 = 0 THEN CASE WHEN k % 11 = 0 OR len(kinds) > 1 THEN 'UNKNOWN' WHEN len(kinds) = 1 THEN kinds[1] ELSE 'ZIP' END
  WHEN s % 13 = 0 THEN 'UNKNOWN' WHEN k % 3 = 0 AND s % 2 = 0 THEN 'HWP' WHEN k % 11 = 0 OR (k % 5 = 0 AND k % 7 = 0) THEN 'UNKNOWN' WHEN k % 5 = 0 THEN 'DOC' WHEN k % 7 = 0 THEN 'XLS' ELSE 'UNKNOWN' END AS format
FROM p JOIN a USING (k)""")
def container_formats(spark, sf_dir):
    raw = built_files("p_partkey", "p_size", "p_name")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), actual_format(raw).alias("format"))
