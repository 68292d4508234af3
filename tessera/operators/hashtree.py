"""Hash trees of snapshots: what two snapshots differ in is found from the root, and only ranges that differ are read.

A key's place is its hash, so ranges of places are even whatever the keys are, and a new key changes one range. A range's digest sums the SHA-256 of its rows in
quarters, which map-side sums combine; a node's is the SHA-256 over its children's in order. A tree is a table of levels, nodes and digests, and a snapshot is stored by
range, so reading a range is reading its files.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import identity

#: Children of a node, and levels below the root.
FANOUT, DEPTH = 16, 2


def bucket(key: Sequence[str]) -> Column:
    """The range of a key, by the first hex digits of its hash."""
    digits = F.substring(F.sha2(identity.content_key(*map(F.col, key)), 256), 1, DEPTH)
    return F.conv(digits, 16, 10).cast("int")


def stored(rows: DataFrame, key: Sequence[str], path: str) -> DataFrame:
    """Writes rows as a snapshot by range, and its tree beside it; the tree. Keys hardly repeat in a snapshot, so ranges are even and a task writes whole ones."""
    spark = rows.sparkSession
    rows.withColumn("_range", bucket(key)).repartition("_range").write.partitionBy("_range").parquet(f"{path}/rows")
    tree(rows, key).coalesce(1).write.parquet(f"{path}/tree")
    return spark.read.parquet(f"{path}/tree")


def tree(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """level, node, digest, n of rows: FANOUT ** DEPTH ranges at most, their parents, and the root as level 0."""
    row = identity.content_key(*[F.col(f"`{c}`") for c in sorted(rows.columns)])
    quarter = lambda k: F.conv(F.substring(row, 16 * k + 1, 15), 16, 10).cast("decimal(20,0)")
    held = rows.select(bucket(key).alias("node"), *[quarter(k).alias(f"q{k}") for k in range(4)])
    sums = held.groupBy("node").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"q{k}").alias(f"q{k}") for k in range(4)])
    level = sums.select(F.lit(DEPTH).alias("level"), "node", F.sha2(F.concat_ws(":", "n", "q0", "q1", "q2", "q3"), 256).alias("digest"), "n")
    levels = [level]
    for k in range(DEPTH - 1, -1, -1):
        child = F.struct("node", "digest")
        level = level.groupBy(F.floor(F.col("node") / FANOUT).cast("int").alias("node")).agg(F.array_sort(F.collect_list(child)).alias("c"), F.sum("n").alias("n"))
        told = F.array_join(F.transform("c", lambda x: F.concat_ws("=", x["node"].cast("string"), x["digest"])), ",")
        level = level.select(F.lit(k).alias("level"), "node", F.sha2(told, 256).alias("digest"), "n")
        levels.append(level)
    return reduce(DataFrame.union, levels)


def differing(a: DataFrame, b: DataFrame) -> list[int]:
    """Ranges in which two trees differ, from the root downwards: a level is asked only below the nodes that differ above it."""
    open_nodes = [0]
    for level in range(DEPTH + 1):
        # A node's children are FANOUT at most, and the ranges FANOUT ** DEPTH.
        asked = [F.col("level") == level, F.col("node").isin(open_nodes)]
        x, y = (t.where(asked[0] & asked[1]).select("node", F.col("digest").alias(n)) for t, n in ((a, "x"), (b, "y")))
        apart = sorted(r.node for r in x.join(y, "node", "full").where(~F.col("x").eqNullSafe(F.col("y"))).select("node").collect())
        if level == DEPTH or not apart:
            return apart
        open_nodes = [n * FANOUT + k for n in apart for k in range(FANOUT)]
    return []


def differences(spark: SparkSession, old: str, new: str, key: Sequence[str]) -> DataFrame:
    """key, change (added, lost, changed) of the rows in which the snapshots at two paths differ. Files of other ranges are not read."""
    ranges = differing(*(spark.read.parquet(f"{p}/tree") for p in (old, new)))
    sides = []
    for path, name in ((old, "a"), (new, "b")):
        rows = spark.read.parquet(f"{path}/rows").where(F.col("_range").isin(ranges))
        columns = sorted(c for c in rows.columns if c != "_range")
        sides.append(rows.select(*key, identity.content_key(*[F.col(f"`{c}`") for c in columns]).alias(name)))
    both = sides[0].join(sides[1], list(key), "full").where(~F.col("a").eqNullSafe(F.col("b")))
    return both.select(*key, F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "lost").otherwise("changed").alias("change"))
