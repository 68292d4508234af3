"""Hash trees of snapshots."""

from pyspark.sql import functions as F

from tessera.operators import hashtree


def test_only_differing_ranges_are_read(spark, tmp_path):
    rows = spark.range(3000).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"))
    after = rows.where("k <> 17").withColumn("v", F.when(F.col("k") == 99, "other").otherwise(F.col("v"))).union(spark.createDataFrame([(9001, "new")], "k long, v string"))
    old, new = f"{tmp_path}/old", f"{tmp_path}/new"
    a, b = hashtree.stored(rows, ["k"], old), hashtree.stored(after, ["k"], new)
    places = {r.k: r.p for r in rows.union(after).select("k", hashtree.bucket(["k"]).alias("p")).distinct().collect()}
    ranges = hashtree.differing(a, b)
    assert ranges == sorted({places[k] for k in (17, 99, 9001)})
    found = hashtree.differences(spark, old, new, ["k"])
    assert sorted(map(tuple, found.collect())) == [(17, "lost"), (99, "changed"), (9001, "added")]
    files = {x for p in (old, new) for x in spark.read.parquet(f"{p}/rows").where(F.col("_range").isin(ranges)).select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert len(files) <= 2 * len(ranges) < len(set(places.values())) / 10


def test_equal_snapshots_have_equal_roots(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (2, None), (None, "b")], "k long, v string")
    one, two = hashtree.tree(rows, ["k"]), hashtree.tree(rows.repartition(3).select("v", "k"), ["k"])
    root = lambda t: t.where("level = 0").select("digest", "n").collect()
    assert root(one) == root(two) and root(one)[0].n == 4
    assert hashtree.differing(one, two) == []
    assert root(hashtree.tree(rows.distinct(), ["k"])) != root(one)
    assert hashtree.differing(hashtree.tree(rows.limit(0), ["k"]), one) == sorted({r.node for r in one.where(f"level = {hashtree.DEPTH}").collect()})
