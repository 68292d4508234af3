"""Sources and sinks on files made here."""

import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.sources import files


def page(number, items, code="00", total=3):
    return json.dumps({"response": {"header": {"resultCode": code}, "body": {"pageNo": number, "totalCount": total, "items": {"item": items}}}})


def test_pages(spark):
    rows = [(1, 2, 200, page(1, [{"id": "a"}, {"id": "b", "x": None}])), (2, 2, 200, page(2, [{"id": "c"}])), (3, 2, 500, None), (4, 2, 200, "{"), (5, 2, 200, page(5, [], code="22")), (6, 2, 200, page(7, [])), (7, 1, 200, page(7, [1, 2]))]
    outcomes, items = files.paged_items(spark.createDataFrame(rows, files.PAGE))
    assert {r.number: r.outcome for r in outcomes.collect()} == {1: "SUCCESS", 2: "SUCCESS", 3: "TRANSPORT_ERROR", 4: "CONTRACT_ERROR", 5: "API_ERROR", 6: "CONTRACT_ERROR", 7: "CONTRACT_ERROR"}
    got = items.select("number", "at", F.try_variant_get("item", "$.id", "string").alias("id")).orderBy("number", "at").collect()
    assert [r.id for r in got] == ["a", "b", "c"]


def archive(names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in names:
            z.writestr(n, f"content of {n}")
    return out.getvalue()


def test_archives(spark):
    rows = [("ok.zip", archive(["a.txt", "d/b.pdf"])), ("bad.zip", b"PKnope"), ("up.zip", archive(["../x"])), ("big.zip", archive([f"{i}" for i in range(6)]))]
    got = files.archive_members(spark.createDataFrame(rows, "path string, content binary"), most_entries=5).collect()
    assert {(r.container, r.path) for r in got if r.status == "STORED"} == {("ok.zip", "a.txt"), ("ok.zip", "d/b.pdf")}
    assert {r.container: r.reason for r in got if r.status == "REJECTED"} == {"bad.zip": "not_an_archive", "up.zip": "path_escape", "big.zip": "entries"}
    assert next(r.sha256 for r in got if r.path == "a.txt") == hashlib.sha256(b"content of a.txt").hexdigest()


def test_snapshots(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string").coalesce(1)
    files.snapshot(rows, str(tmp_path / "s"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        files.snapshot(rows, str(tmp_path / "s"))
    stored = files.manifest(spark, str(tmp_path / "s")).collect()
    kept = spark.createDataFrame(stored)
    assert files.manifest_differences(kept, files.manifest(spark, str(tmp_path / "s"))).count() == 0
    assert {r.problem for r in files.manifest_differences(kept.limit(0).union(kept.withColumn("sha256", F.lit("x")).limit(1)), files.manifest(spark, str(tmp_path / "s"))).collect()} >= {"changed"}
    files.written_lines(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_restore(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "src/t.parquet"))
    with pytest.raises(ValueError):
        files.restored(spark, str(tmp_path / "src"), str(tmp_path / "a"), {"t": 6})
    assert not (tmp_path / "a").exists()
    assert files.restored(spark, str(tmp_path / "src"), str(tmp_path / "b"), {"t": 5}) == {"t": 5}
    assert spark.read.parquet(str(tmp_path / "b/t.parquet")).count() == 5


def test_tables(spark):
    rows = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"a"),), (bytearray(b"b"),)], "content binary")
    stored = spark.createDataFrame([(hashlib.sha256(b"b").hexdigest(),)], "sha256 string")
    got = files.new_objects(rows, stored).collect()
    assert len(got) == 1 and got[0].address.startswith(f"sha256/{got[0].sha256[:2]}/")
    old = spark.createDataFrame([(1, "x", "BODY"), (2, "y", "FORM")], "chunk_id long, v string, role string")
    new = files.with_roles(old, spark.createDataFrame([(2, "LIST")], "chunk_id long, role string"))
    assert {r.chunk_id: r.role for r in new.collect()} == {1: "BODY", 2: "LIST"}
    assert files.digest_without(old, "role").first() == files.digest_without(new.select(old.columns), "role").first()
    assert sorted(map(tuple, files.upserted(old, spark.createDataFrame([(2, "z", "BODY"), (3, "w", "BODY")], old.schema), ["chunk_id"]).collect())) == [(1, "x", "BODY"), (2, "z", "BODY"), (3, "w", "BODY")]
    assert files.schema_differences(old, old.drop("v").withColumn("chunk_id", F.col("chunk_id").cast("int"))) == ["missing v", "type chunk_id: int, not bigint"]


def test_archives_share_batches(spark, sf_dir):
    """All members come from shared batches, and a small table's archives are dealt over tasks."""
    from pyspark.sql import functions as F

    from tessera.plans import registry
    from tessera.plans.containers import archive_of

    rows = [(str(k), archive_of({"a": f"{k}", "b": ""})) for k in range(300)]
    held = files.archive_members(spark.createDataFrame(rows, "path string, content binary"))
    assert held.count() == 600 and held.where("status = 'STORED'").groupBy("container").count().where("count = 2").count() == 300
    spread = registry.QUERIES["unpacked_archives"](spark, sf_dir).groupBy(F.spark_partition_id()).count().count()
    assert spread == int(spark.conf.get("spark.sql.shuffle.partitions"))
