"""What several corpus operators share: table access, written intermediate tables, word rules, components."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words are runs of anything but ASCII space and the controls tab to carriage return.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
WORD_RE = re.compile("[^\x20\x09-\x0d]+")
LOCAL_CHECKPOINT_DIR = "/tmp/checkpoints/tessera"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. Unset, it is a folder of this machine in local mode, and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.match(r"local(\[[^,]*(,\d+)?\])?$", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return LOCAL_CHECKPOINT_DIR


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and a lost executor costs a re-read at most."""
    path = f"{checkpoint_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.parquet(path)
    table._tessera_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._tessera_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def words_column(text: Column) -> Column:
    """array<string> of the words of text; empty for null and for blank texts."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+")
    return F.filter(parts, lambda w: w != "")


def packed(rows: DataFrame, *keep: Column) -> DataFrame:
    """rows as one struct _row, with what keep names beside it, so that no column of rows can clash with those of an operator."""
    return rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"), *keep)


def mapped_with_id(rows: DataFrame, id_col: str, run, others: str) -> DataFrame:
    """rows.mapInPandas(run) to a long id_col and others. The id travels as text: pandas would round long ids of a batch that holds a null one."""
    out = rows.withColumn(id_col, F.col(id_col).cast("string")).mapInPandas(run, f"{id_col} string, {others}")
    return out.withColumn(id_col, F.col(id_col).cast("long"))


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; null ids give null."""
    return F.crc32(doc_id.cast("string")) % F.lit(modulus)


def connected_components(nodes: DataFrame | None, edges: DataFrame, tag: str, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id in edges (a, b), and in nodes (id) if given; component is the smallest id reachable.

    Alternating large-star and small-star steps. Each is one aggregate, combined on the map side, and one join, in which the edges
    of a hub have one key; adaptive execution splits such partitions. Rounds grow with the logarithm of the longest path.
    """
    now = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{tag}-cc"
    )
    seen = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("low"))
        joined = large.join(low2, "a")
        small = (
            joined.select(F.col("b").alias("a"), F.col("low").alias("b"))
            .union(low2.select("a", F.col("low").alias("b")))
            .where("a <> b")
            .distinct()
        )
        before, now = now, written(small, f"{tag}-cc")
        discard(before)
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    else:
        raise RuntimeError("components did not settle")
    labels = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id")
    roots = now.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    known = labels.union(roots)
    if nodes is not None:
        known = known.union(nodes.select("id", F.col("id").alias("component")))
    return known.groupBy("id").agg(F.min("component").alias("component"))


def labelled_sample(docs: DataFrame, labels: DataFrame, learn_from: Column, label_col: str, rows: int, most_bytes: int | None = None) -> DataFrame:
    """(doc_id, text, y) of the labelled documents of lowest hash, rows of them at most, and most_bytes of text.

    learn_from says of a row of labels whether it may teach. Of several labels of an id the lowest counts, of several texts the least.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & learn_from)
    known = known.groupBy("doc_id").agg(F.min(F.col(label_col).cast("int")).alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    if most_bytes is None:
        return found
    found = written(found, "labelled-sample")
    upto = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # over rows numbers at most
    sizes = found.select("doc_id", F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(upto).alias("so_far"))
    return found.join(F.broadcast(sizes.where(F.col("so_far") <= most_bytes).select("doc_id")), "doc_id")
