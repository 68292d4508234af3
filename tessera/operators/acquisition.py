"""Acquisition of documents by address, and what archives hold: one fetch for an address, rules for members, invariants of a report."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

UTF8_FLAG = 0x800


def acquired(candidates: DataFrame, done: DataFrame, cached: DataFrame, fetched: DataFrame) -> DataFrame:
    """The relation row of every candidate (key, url, declared) of an address that the run has not finished.

    done: key of rows that the run has stored; an address whose candidates are all among them is skipped. cached and fetched: url, detected, bytes,
    digest, and for fetched also failure and requests. An address is fetched once, unless a cached body serves it; its first candidate has the
    requests and the action, the others reuse it.
    """
    left = candidates.join(done.withColumn("_done", F.lit(True)), "key", "left").groupBy("url").agg(F.count_if(F.col("_done").isNull()).alias("_open"), F.min("key").alias("_first"))
    open_urls = left.where("_open > 0").select("url", "_first")
    c = cached.select("url", F.struct("detected", "bytes", "digest").alias("_c"))
    f = fetched.select("url", F.struct("detected", "bytes", "digest", "failure", "requests").alias("_f"))
    bodies = open_urls.join(c, "url", "left").join(f, "url", "left")
    rows = candidates.join(bodies, "url")
    first, reused = F.col("key") == F.col("_first"), F.col("_c").isNotNull()
    failure = F.when(~reused, F.col("_f.failure"))
    body = lambda name: F.coalesce(F.col(f"_c.{name}"), F.when(failure.isNull(), F.col(f"_f.{name}")))
    detected = F.coalesce(F.col("_c.detected"), F.col("_f.detected"))
    action = F.when(~first, "REUSED_URL").when(reused, "REUSED_EXISTING").when(failure.isNull(), "DOWNLOADED").otherwise("FAILED")
    return rows.select(
        "key",
        "url",
        F.when(failure.isNull(), "ACQUIRED").otherwise("FAILED").alias("status"),
        failure.alias("failure"),
        detected.alias("detected"),
        (~F.col("declared").isin("UNKNOWN", "OTHER") & (F.col("declared") != detected)).alias("format_mismatch"),
        body("bytes").alias("bytes"),
        body("digest").alias("digest"),
        action.alias("action"),
        F.when(first & ~reused, F.col("_f.requests")).otherwise(0).alias("requests"),
    )


def acquisition_report(rows: DataFrame, n_candidates: DataFrame) -> DataFrame:
    """One row of counts of acquired rows, and of candidates and programs (total, programs, with_candidates)."""
    counts = rows.agg(
        F.count(F.lit(1)).alias("persisted"),
        F.count_if(F.col("status") == "ACQUIRED").alias("success"),
        F.count_if(F.col("status") == "FAILED").alias("failed"),
        F.sum("requests").alias("requests"),
        F.count_if("format_mismatch").alias("mismatches"),
        F.count_if((F.col("status") == "ACQUIRED") & F.col("detected").isNotNull()).alias("formats"),
        F.sum(F.when(F.col("action") == "DOWNLOADED", F.col("bytes")).otherwise(0)).alias("downloaded"),
    )
    return counts.join(F.broadcast(n_candidates))


def with_verdict(report: DataFrame) -> DataFrame:
    """report with broken (the invariants that do not hold) and status: PASS only for a complete run without failures."""
    checks = (
        ("programs", F.col("with_candidates") <= F.col("programs")),
        ("success_and_failed", F.col("success") + F.col("failed") == F.col("persisted")),
        ("persisted", F.col("persisted") <= F.col("total")),
        ("formats", F.col("formats") == F.col("success")),
    )
    broken = F.filter(F.array(*[F.when(~good, name) for name, good in checks]), lambda x: x.isNotNull())
    whole = (F.col("programs") > 0) & (F.col("total") > 0) & (F.col("failed") == 0) & (F.col("success") == F.col("total")) & (F.col("persisted") == F.col("total"))
    return report.withColumn("broken", broken).withColumn("status", F.when(whole & (F.size(broken) == 0), "PASS").otherwise("FAIL"))


def processable(enabled: Column, excluded: Sequence[str], on_hold: Sequence[str]) -> Column:
    return F.array_sort(F.array_except(enabled, F.array(*map(F.lit, [*excluded, *on_hold, "ZIP"]))))


@F.pandas_udf(StructType([StructField("path", StringType()), StructField("decoded_by", StringType())]))
def member_name(raw: pd.Series, flags: pd.Series) -> pd.DataFrame:
    """The readable path of an archive member: UTF-8 where its flag says so, else CP949 if the bytes are, else none."""

    def one(data: bytes | None, flag: int) -> tuple[str | None, str]:
        if flag & UTF8_FLAG:
            return (data or b"").decode("utf-8", "replace"), "UTF8_FLAG"
        try:
            return (data or b"").decode("cp949"), "CP949"
        except UnicodeDecodeError:
            return None, "RAW_BYTES"

    return pd.DataFrame([one(d, int(f)) for d, f in zip(raw, flags, strict=True)], columns=["path", "decoded_by"])


def placeholder(text: Column, most_chars: int) -> Column:
    """Empty, or one short line that only says that something is to be handed in."""
    plain = F.regexp_replace(text, r"^\s+|\s+$", "")
    return (plain == "") | (~plain.contains("\n") & (F.length(plain) <= most_chars))


def member_class(path: Column, text: Column, detected: Column, formats: Column, known: Column, excluded: Sequence[str], on_hold: Sequence[str], most_chars: int = 60) -> Column:
    """struct<status, reason> of an archive member by the first rule that holds. known: the content is an attachment already."""
    base = F.lower(F.element_at(F.split(F.rtrim(F.translate(path, "\\", "/")), "/"), -1))
    system = base.isin("thumbs.db", ".ds_store") | F.translate(path, "\\", "/").rlike(r"(^|/)__macosx/")
    ending = F.regexp_extract(base, r"(\.[^.]*)$", 1)
    odd = detected == "UNKNOWN"
    reason = (
        F.when(system, "os_metadata_file")
        .when(ending.isin(".txt") & odd & placeholder(text, most_chars), "empty_or_placeholder_text")
        .when(F.length(text) == 0, "empty_member")
        .when((detected == "ZIP") | (odd & ending.isin(".zip", ".7z")), "nested_archive")
        .when(detected.isin(*on_hold), "hwpml_on_hold")
        .when(detected.isin(*excluded), "intentionally_excluded_format")
        .when(~F.array_contains(formats, detected), "unsupported_format")
        .when(known, "same_sha_as_attachment")
    )
    status = F.when(reason.isNull(), "STORED").when(reason == "same_sha_as_attachment", "DUPLICATE_SOURCE").otherwise("EXCLUDED")
    return F.struct(status.alias("status"), reason.alias("reason"))
