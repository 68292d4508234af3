"""Queries that go through files: paged JSON, archives, snapshots with manifests, JSON lines, content addresses, upserts."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tessera.operators import hashtree
from tessera.plans.base import registrar
from tessera.plans.containers import archive_of
from tessera.sources import files
from tessera.sources.paged import paged_source
from tessera.sources.tables import table

QUERIES, ORACLES = {}, {}
query = registrar(QUERIES, ORACLES)


def place(spark, name: str) -> str:
    return f"{files.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def pages(spark, sf_dir) -> DataFrame:
    """Customers as answers of an API, a hundred to a page; some pages fail in each of the known ways."""
    number = F.floor(F.col("c_custkey") / 100) + 1
    kind = F.col("number") % 7
    item = F.struct(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    rows = table(spark, sf_dir, "customer").groupBy(number.cast("int").alias("number")).agg(F.array_sort(F.collect_list(item)).alias("item"))
    told = F.struct(F.when(kind == 6, F.col("number") + 1).otherwise(F.col("number")).alias("pageNo"), F.lit(1000).alias("totalCount"), F.struct("item").alias("items"))
    body = F.to_json(F.struct(F.struct(F.struct(F.when(kind == 5, "22").otherwise("00").alias("resultCode")).alias("header"), told.alias("body")).alias("response")))
    return rows.select("number", F.lit(100).alias("asked"), F.when(kind == 3, 500).otherwise(200).alias("status"), F.when(kind == 4, F.substring(body, 1, 20)).otherwise(body).alias("body"))


PAGES_SQL = "WITH p AS (SELECT c_custkey // 100 + 1 AS number, c_custkey AS id, c_mktsegment AS segment FROM customer) "


@query(PAGES_SQL + """SELECT number, CASE number % 7 WHEN 3 THEN 'TRANSPORT_ERROR' WHEN 4 THEN 'CONTRACT_ERROR' WHEN 5 THEN 'API_ERROR' WHEN 6 THEN 'CONTRACT_ERROR' ELSE 'SUCCESS' END AS outcome,
  CASE WHEN number % 7 < 3 THEN count(*) END AS n_items FROM p GROUP BY number""")
def page_outcomes(spark, sf_dir):
    return files.paged_items(pages(spark, sf_dir))[0].select("number", "outcome", "n_items")


@query(PAGES_SQL + "SELECT number, row_number() OVER (PARTITION BY number ORDER BY id) - 1 AS place, id, segment FROM p WHERE number % 7 < 3")
def scanned_items(spark, sf_dir):
    items = files.paged_items(pages(spark, sf_dir))[1]
    return items.select("number", F.col("at").alias("place"), F.try_variant_get("item", "$.id", "long").alias("id"), F.try_variant_get("item", "$.segment", "string").alias("segment"))


@query("""WITH p AS (SELECT c_custkey // 50 + 1 AS number, c_custkey AS id FROM customer), n AS (SELECT count(*) AS total FROM customer), k AS (SELECT unnest(range(1, (total + 49) // 50 + 1)) AS number FROM n)
SELECT k.number, CASE WHEN k.number % 5 = 3 THEN 'TRANSPORT_ERROR' WHEN k.number % 5 = 4 THEN 'CONTRACT_ERROR' ELSE 'SUCCESS' END AS outcome, CASE WHEN k.number % 5 NOT IN (3, 4) THEN count(p.id) END AS n_items FROM k LEFT JOIN p USING (number) GROUP BY k.number""")
def paged_scan(spark, sf_dir):
    """A crawl read through the paged source: some pages are gone, some cut short, and the first one's total says how many there are."""
    path = place(spark, "crawl")
    rows = table(spark, sf_dir, "customer").select((F.floor(F.col("c_custkey") / 50) + 1).cast("int").alias("number"), F.struct(F.col("c_custkey").alias("id")).alias("item"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    held = rows.groupBy("number").agg(F.array_sort(F.collect_list("item")).alias("item")).join(F.broadcast(total))
    told = F.struct(F.col("number").alias("pageNo"), F.when(F.col("number") == 1, F.col("total")).otherwise(F.lit(7)).alias("totalCount"), F.struct("item").alias("items"))
    body = F.to_json(F.struct(F.struct(F.struct(F.lit("00").alias("resultCode")).alias("header"), told.alias("body")).alias("response")))
    crawled = held.where("number % 5 <> 3").select("number", F.when(F.col("number") % 5 == 4, F.substring(body, 1, 30)).otherwise(body).alias("value"))
    crawled.repartition("number").write.partitionBy("number").text(path)
    spark.dataSource.register(paged_source())
    scan = spark.read.format("paged").option("path", path).option("pageSize", 50).option("pagesPerTask", 4).load()
    return files.paged_items(scan)[0].select("number", "outcome", "n_items")


@query("SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, s_acctbal FROM supplier")
def lines_roundtrip(spark, sf_dir):
    """A table as JSON lines, and read again."""
    path, rows = place(spark, "lines"), table(spark, sf_dir, "supplier")
    files.written_lines(rows, path)
    return spark.read.schema(rows.schema).json(path).select(*rows.columns)


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def restored_snapshot(spark, sf_dir):
    """A write-once snapshot, restored through a staging folder with its count checked."""
    path, rows = place(spark, "snapshot"), table(spark, sf_dir, "nation")
    files.snapshot(rows, f"{path}/from/nation.parquet")
    files.restored(spark, f"{path}/from", f"{path}/to", {"nation": rows.count()})
    return spark.read.schema(rows.schema).parquet(f"{path}/to/nation.parquet")


def two_snapshots(spark, sf_dir) -> tuple[str, str]:
    """A snapshot of parts, and one with a few rows changed, lost and added."""
    old, new, k = place(spark, "old"), place(spark, "new"), F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    after = parts.where(k % 997 != 5).withColumn("p_size", F.when(k % 499 == 3, F.col("p_size") + 1).otherwise(F.col("p_size")))
    added = parts.where(k % 991 == 7).withColumn("p_partkey", k + 10_000_000)
    hashtree.stored(parts, ["p_partkey"], old)
    hashtree.stored(after.union(added), ["p_partkey"], new)
    return old, new


@query("""SELECT p_partkey, 'lost' AS change FROM part WHERE p_partkey % 997 = 5 UNION ALL SELECT p_partkey, 'changed' FROM part WHERE p_partkey % 997 <> 5 AND p_partkey % 499 = 3
UNION ALL SELECT p_partkey + 10000000, 'added' FROM part WHERE p_partkey % 991 = 7""")
def snapshot_differences(spark, sf_dir):
    """Rows in which two snapshots differ, found from the roots of their hash trees."""
    return hashtree.differences(spark, *two_snapshots(spark, sf_dir), ["p_partkey"])


@query("SELECT * FROM (VALUES ('changed', 1), ('missing', 1), ('new', 1)) v(problem, n)")
def manifest_check(spark, sf_dir):
    """Files of a snapshot against a manifest that names one that is not there, lacks one, and has another content for one."""
    path = place(spark, "manifest")
    table(spark, sf_dir, "region").repartition(1).write.partitionBy("r_regionkey").parquet(path)
    found = files.manifest(spark, path)
    key = F.regexp_extract("path", r"r_regionkey=(\d+)", 1)
    stored = found.where(key != "1").withColumn("sha256", F.when(key == "0", "other").otherwise(F.col("sha256")))
    stored = stored.union(spark.createDataFrame([("gone", 1, "x")], "path string, bytes long, sha256 string"))
    return files.manifest_differences(stored, found).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 3 = 0), n AS (SELECT DISTINCT sha256(text) AS h FROM documents)
SELECT h AS sha256, 'sha256/' || substr(h, 1, 2) || '/' || substr(h, 3, 2) || '/' || h AS address FROM n WHERE h NOT IN (SELECT h FROM s)""")
def stored_objects(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    stored = docs.where("doc_id % 3 = 0").select(F.sha2("text", 256).alias("sha256")).distinct()
    return files.new_objects(docs.select(F.encode("text", "UTF-8").alias("content")), stored).select("sha256", "address")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'new ' || s_name ELSE s_name END AS s_name, CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_suppkey % 5 <> 0 OR s_suppkey % 4 = 0")
def upserted_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    new = rows.where("s_suppkey % 4 = 0").select("s_suppkey", F.concat(F.lit("new "), "s_name").alias("s_name"), F.lit(0.0).alias("s_acctbal"))
    return files.upserted(rows.where("s_suppkey % 5 <> 0"), new, ["s_suppkey"])


@query("SELECT vec_id AS chunk_id, CASE WHEN vec_id % 6 = 0 THEN 'LIST' ELSE 'BODY' END AS role, true AS untouched FROM embeddings")
def replaced_roles(spark, sf_dir):
    """Roles replaced in place, with the digest of all other columns before and after."""
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label", F.lit("BODY").alias("role"))
    after = files.with_roles(points, points.where("chunk_id % 6 = 0").select("chunk_id", F.lit("LIST").alias("role")))
    old, new = files.digest_without(points, "role"), files.digest_without(after.select(points.columns), "role").toDF("n2", "digest2")
    same = old.join(new).select(((F.col("n") == F.col("n2")) & (F.col("digest") == F.col("digest2"))).alias("untouched"))
    return after.select("chunk_id", "role").join(F.broadcast(same))


@query("""WITH d AS (SELECT c_custkey AS k FROM customer),
x AS (SELECT unnest(list_filter([CASE WHEN k % 13 = 0 THEN 'no object' END, CASE WHEN k % 13 > 0 AND k % 5 = 0 THEN 'type id: STRING, not BIGINT' END, CASE WHEN k % 13 > 0 AND k % 7 = 0 THEN 'missing name' END, CASE WHEN k % 13 > 0 AND k % 3 = 0 THEN 'unexpected more' END], lambda x: x IS NOT NULL)) AS difference FROM d)
SELECT difference, count(*) AS n FROM x GROUP BY difference""")
def schema_check(spark, sf_dir):
    """What the stored objects of a collection lack, have besides, or have as another type than its schema says."""
    k = F.col("c_custkey")
    typed = lambda value: F.to_json(F.struct(value.alias("id"), F.when(k % 7 != 0, F.col("c_name")).alias("name"), F.when(k % 3 == 0, F.lit(True)).alias("more")))
    line = F.when(k % 13 == 0, "[1]").when(k % 5 == 0, typed(k.cast("string"))).otherwise(typed(k))
    return files.row_differences(table(spark, sf_dir, "customer").select(line.alias("line")), "line", {"id": "BIGINT", "name": "STRING"})


@F.pandas_udf(BinaryType())
def built_archives(keys: pd.Series, names: pd.Series) -> pd.Series:
    """An archive for each row: as many members as its key says, one of them outside for some keys, cut short for others."""

    def built(key: int, name: str) -> bytes:
        raw = archive_of({f"{'../' if i == 1 and key % 5 == 0 else ''}{i}/{name}.txt": f"{name} {i}" for i in range(key % 8)})
        return raw[: len(raw) // 2] if key % 7 == 0 else raw

    return pd.Series([built(*row) for row in zip(keys, names, strict=True)])


@query("""WITH p AS (SELECT p_partkey AS k, p_name AS name, CASE WHEN p_partkey % 7 = 0 THEN 'not_an_archive' WHEN p_partkey % 8 > 5 THEN 'entries' WHEN p_partkey % 5 = 0 AND p_partkey % 8 > 1 THEN 'path_escape' END AS reason FROM part),
m AS (SELECT *, unnest(range(k % 8)) AS i FROM p WHERE reason IS NULL)
SELECT k::VARCHAR AS container, i AS member_index, i || '/' || name || '.txt' AS path, 'STORED' AS status, reason, sha256(name || ' ' || i) AS sha256 FROM m
UNION ALL SELECT k::VARCHAR, -1, NULL, 'REJECTED', reason, NULL FROM p WHERE reason IS NOT NULL""")
def unpacked_archives(spark, sf_dir):
    """Members of archives; one that breaks a safety rule is one row, refused as a whole."""
    # Rows are short and archives dear: dealt by number, as few bytes would make few tasks.
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    archives = parts.select(F.col("p_partkey").cast("string").alias("path"), built_archives("p_partkey", "p_name").alias("content"))
    return files.archive_members(archives, most_entries=5).select("container", "member_index", "path", "status", "reason", "sha256")
