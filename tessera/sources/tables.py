"""Readers with explicit schemas, and the catalogue's tables as views over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "1998-06-15"

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support programs: one row per order, with unknown jurisdictions, open ends and inactive rows."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    return rows.select(
        key.alias("id"),
        F.col("o_orderpriority").alias("category"),
        F.col("c_mktsegment").alias("target"),
        F.when(key % 11 != 0, F.col("n_name")).alias("jurisdiction"),
        F.when(key % 7 != 0, day).alias("start_date"),
        F.when((key % 7 != 0) & (key % 5 != 0), F.date_add(day, (key % 90).cast("int"))).alias("end_date"),
        (F.col("o_orderstatus") != "F").alias("active"),
        F.concat(F.lit("["), F.col("n_name"), F.lit("] support "), (key % 50).cast("string"), F.lit(" for "), F.lower("c_mktsegment")).alias("name"),
        F.col("o_totalprice").alias("budget"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_custkey").alias("owner"),
    )


PROGRAMS_SQL = """programs AS (
  SELECT o_orderkey AS id, o_orderpriority AS category, c_mktsegment AS target,
         CASE WHEN o_orderkey % 11 <> 0 THEN n_name END AS jurisdiction,
         CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate::DATE END AS start_date,
         CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 THEN o_orderdate::DATE + (o_orderkey % 90)::INT END AS end_date,
         o_orderstatus <> 'F' AS active,
         '[' || n_name || '] support ' || (o_orderkey % 50) || ' for ' || lower(c_mktsegment) AS name,
         o_totalprice AS budget, o_orderdate AS created_at, o_custkey AS owner
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


#: Rows that a task groups. Partitions that Spark joins by their bytes hold more rows the larger the table, as keys are written small.
ROWS_AT_ONCE = 1 << 18


def dealt(rows: DataFrame, n_rows: int, *keys: str) -> DataFrame:
    """rows, of which there are n_rows, dealt by keys over as many tasks as they need, which Spark leaves as they are."""
    return rows.repartition(max(1, -(-n_rows // ROWS_AT_ONCE)), *keys)


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (program, content) pairs: which files belong to which programs, with the file's container and format. Tasks stay of one size."""
    items = table(spark, sf_dir, "lineitem")
    items = dealt(items, items.count(), "l_orderkey", "l_partkey")
    return items.groupBy(F.col("l_orderkey").alias("program"), F.col("l_partkey").alias("content")).agg(
        F.min("l_suppkey").alias("container"),
        F.sum("l_quantity").cast("long").alias("bytes"),
        F.min("l_returnflag").alias("format"),
        F.max("l_linestatus").alias("status"),
    )


RELATIONS_SQL = """relations AS (
  SELECT l_orderkey AS program, l_partkey AS content, min(l_suppkey) AS container, sum(l_quantity)::BIGINT AS bytes,
         min(l_returnflag) AS format, max(l_linestatus) AS status
  FROM lineitem GROUP BY l_orderkey, l_partkey)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with dense vectors: three to a program, with the text of the document of the same number."""
    vectors, docs = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    return vectors.join(docs, F.col("vec_id") == F.col("doc_id")).select(
        F.col("vec_id").alias("chunk_id"),
        F.floor(F.col("vec_id") / 3).alias("program"),
        F.col("embedding").cast("array<double>").alias("vector"),
        "text",
        F.element_at(F.array(*map(F.lit, ("BODY", "FORM", "LIST"))), (F.col("label") % 3 + 1).cast("int")).alias("role"),
        F.col("label"),
    )


CHUNKS_SQL = """chunks AS (
  SELECT vec_id AS chunk_id, floor(vec_id / 3)::BIGINT AS program, embedding::DOUBLE[] AS vector, text,
         ['BODY', 'FORM', 'LIST'][label % 3 + 1] AS role, label
  FROM embeddings JOIN documents ON vec_id = doc_id)"""
