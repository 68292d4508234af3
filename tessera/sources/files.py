"""Files as sources and sinks: paged JSON, archives, verified snapshots, write-once and content-addressed tables."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.identity import object_path

PAGE = "number int, asked int, status int, body string"
MEMBERS_AT_ONCE = 10_000
MEMBERS = "container string, member_index int, path string, byte_size long, sha256 string, status string, reason string"


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; unset, a folder of this machine in local mode, and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.match(r"local(\[[^,]*(,\d+)?\])?$", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "/tmp/checkpoints/tessera"


def paged_items(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcomes, items) of raw API pages (number, asked, status, body).

    Outcomes are SUCCESS, TRANSPORT_ERROR (no or another status), CONTRACT_ERROR (not JSON, duplicate keys, wrong shape, echo of another
    page), API_ERROR (another result code). Bad pages are rows, never failures of the job; items keep their raw form as a variant.
    """
    v = F.try_parse_json(F.col("body"))
    got = lambda path, kind: F.try_variant_get(F.col("v"), path, kind)
    rows = pages.withColumn("v", v).withColumns(
        {"code": got("$.response.header.resultCode", "string"), "page": got("$.response.body.pageNo", "int"), "total_count": got("$.response.body.totalCount", "long"), "list": got("$.response.body.items.item", "array<variant>")}
    )
    outcome = (
        F.when(F.col("status").isNull() | (F.col("status") != 200), "TRANSPORT_ERROR")
        .when(F.col("v").isNull() | F.col("code").isNull(), "CONTRACT_ERROR")
        .when(F.col("code") != "00", "API_ERROR")
        .when(F.col("list").isNull() | ~F.coalesce(F.col("page") == F.col("number"), F.lit(False)) | (F.size("list") > F.col("asked")), "CONTRACT_ERROR")
        .otherwise("SUCCESS")
    )
    rows = rows.withColumn("outcome", outcome)
    outcomes = rows.select("number", "asked", "outcome", "total_count", F.when(F.col("outcome") == "SUCCESS", F.size("list")).alias("n_items"))
    items = rows.where("outcome = 'SUCCESS'").select("number", F.posexplode("list").alias("at", "item"))
    return outcomes, items


def archive_members(archives: DataFrame, most_entries: int = 1000, most_bytes: int = 1 << 30) -> DataFrame:
    """A row for each member of ZIP files (path, content), or one row for an archive that is refused as a whole. Rows of many archives make a batch."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in MEMBERS.split(", ")]
        for batch in batches:
            held: list[tuple] = []
            for path, content in zip(batch.path, batch.content, strict=True):
                held += members_of(path, bytes(content), most_entries, most_bytes)
                if len(held) >= MEMBERS_AT_ONCE:
                    yield pd.DataFrame(held, columns=names)
                    held = []
            yield pd.DataFrame(held, columns=names)

    return archives.select("path", "content").mapInPandas(unpack, MEMBERS)


def members_of(container: str, raw: bytes, most_entries: int, most_bytes: int) -> list[tuple]:
    def refused(reason: str) -> list[tuple]:
        return [(container, -1, None, len(raw), None, "REJECTED", reason)]

    try:
        archive = zipfile.ZipFile(io.BytesIO(raw))
    except zipfile.BadZipFile:
        return refused("not_an_archive")
    infos = [i for i in archive.infolist() if not i.is_dir()]
    if len(infos) > most_entries:
        return refused("entries")
    if sum(i.file_size for i in infos) > most_bytes:
        return refused("total_size")
    if any(i.flag_bits & 1 for i in infos):
        return refused("encrypted")
    if len({i.filename for i in infos}) < len(infos):
        return refused("duplicate_paths")
    if any(i.filename.startswith(("/", "\\")) or ".." in i.filename.replace("\\", "/").split("/") for i in infos):
        return refused("path_escape")
    return [(container, k, i.filename, i.file_size, hashlib.sha256(archive.read(i)).hexdigest(), "STORED", None) for k, i in enumerate(infos)]


def snapshot(rows: DataFrame, path: str) -> None:
    """A write-once table: an existing one is an error, never overwritten."""
    rows.write.mode("errorifexists").parquet(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of the files under path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_differences(stored: DataFrame, found: DataFrame) -> DataFrame:
    """(path, problem): files that are missing, new or changed against a stored manifest."""
    s, f = stored.select("path", F.col("sha256").alias("stored")), found.select("path", F.col("sha256").alias("found"))
    rows = s.join(f, "path", "full_outer")
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("stored").isNull(), "new").when(F.col("stored") != F.col("found"), "changed")
    return rows.select("path", problem.alias("problem")).where("problem is not null")


def new_objects(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Content (content binary) not yet stored, one row for each hash, with its address; what is there already is reused."""
    keyed = rows.withColumn("sha256", F.sha2("content", 256))
    return keyed.join(stored.select("sha256"), "sha256", "left_anti").dropDuplicates(["sha256"]).withColumn("address", object_path(F.col("sha256")))


def upserted(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table with new rows in place of those with their keys."""
    return stored.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def schema_differences(wanted: DataFrame, found: DataFrame) -> list[str]:
    """What must change for found to be read as wanted, by column name."""
    a, b = dict(wanted.dtypes), dict(found.dtypes)
    return sorted([f"missing {c}" for c in a.keys() - b.keys()] + [f"unexpected {c}" for c in b.keys() - a.keys()] + [f"type {c}: {b[c]}, not {a[c]}" for c in a.keys() & b.keys() if a[c] != b[c]])


def row_differences(lines: DataFrame, line: str, wanted: dict[str, str]) -> DataFrame:
    """difference, n: what JSON objects lack, have besides, or have as another type than wanted (name to a type of schema_of_variant, its digits left out)."""
    found = F.try_parse_json(F.col(line))
    kind = lambda name: F.regexp_extract(F.schema_of_variant(F.try_variant_get(found, f"$.{name}", "variant")), "^[A-Z]+", 0)
    keys = F.json_object_keys(line)
    checks = [
        F.when(~F.array_contains(keys, name), f"missing {name}").when(kind(name) != of, F.concat(F.lit(f"type {name}: "), kind(name), F.lit(f", not {of}")))
        for name, of in wanted.items()
    ]
    extra = F.transform(F.array_except(keys, F.array(*map(F.lit, wanted))), lambda k: F.concat(F.lit("unexpected "), k))
    told = F.when(keys.isNull(), F.array(F.lit("no object"))).otherwise(F.concat(F.array_compact(F.array(*checks)), extra))
    return lines.select(F.explode(told).alias("difference")).groupBy("difference").agg(F.count(F.lit(1)).alias("n"))


def written_lines(rows: DataFrame, path: str) -> None:
    """JSON lines with the columns in the order of their names."""
    rows.select(*sorted(rows.columns)).write.mode("errorifexists").json(path)


def restored(spark: SparkSession, source: str, target: str, expected: dict[str, int]) -> dict[str, int]:
    """Copies tables into an empty place and checks their counts before anything is visible there.

    Tables are written to a staging folder first; counts other than expected raise, and the target stays empty.
    """
    staged = {}
    for name in expected:
        spark.read.parquet(f"{source}/{name}.parquet").write.mode("errorifexists").parquet(f"{target}.staging/{name}.parquet")
        staged[name] = spark.read.parquet(f"{target}.staging/{name}.parquet").count()
    if staged != expected:
        raise ValueError(f"restored counts differ: {staged}")
    for name in expected:
        spark.read.parquet(f"{target}.staging/{name}.parquet").write.mode("errorifexists").parquet(f"{target}/{name}.parquet")
    return staged


def with_roles(points: DataFrame, roles: DataFrame) -> DataFrame:
    """points with the role column replaced by roles (chunk_id, role); every other column is unchanged."""
    new = roles.select("chunk_id", F.col("role").alias("_role"))
    return points.join(new, "chunk_id", "left").withColumn("role", F.coalesce("_role", "role")).drop("_role")


def digest_without(rows: DataFrame, *left_out: str) -> DataFrame:
    """One row: count and an order-free digest of all columns but left_out, to prove an update touched nothing else."""
    kept = [c for c in rows.columns if c not in left_out]
    row = F.xxhash64(*kept)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(row.cast("decimal(38,0)")).alias("digest"))
