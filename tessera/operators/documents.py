"""Documents of programs: relations, roles, admission, consistency, archives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.identity import content_key

SEPARATOR = "@"
ROLE_ORDER = ("FORM", "LIST", "BODY")


def extension(filename: Column) -> Column:
    """Declared kind of a file by its extension; UNKNOWN without one."""
    end = F.upper(F.regexp_extract(F.trim(filename), r"\.([A-Za-z0-9]+)$", 1))
    return F.when(F.coalesce(end, F.lit("")) == "", "UNKNOWN").when(end.isin("PDF", "HWP", "HWPX", "ZIP", "XLSX"), end).otherwise("OTHER")


def basename(path: Column) -> Column:
    """Last segment of a path with either slash."""
    return F.element_at(F.split(path, r"[/\\]"), -1)


def listed_pairs(rows: DataFrame, urls: str, names: str) -> DataFrame:
    """rows exploded over the @-separated lists: at, url, filename, pairing. Blank entries are skipped but keep their place."""
    u, n = F.split(F.col(urls), SEPARATOR, -1), F.split(F.coalesce(F.col(names), F.lit("")), SEPARATOR, -1)
    pairing = F.when(F.size(u) == F.size(n), "MATCHED").otherwise("UNMATCHED")
    out = rows.withColumn("pairing", pairing).withColumn("_names", n).select("*", F.posexplode(u).alias("at", "url"))
    out = out.where(F.trim("url") != "")
    filename = F.when(F.col("pairing") == "MATCHED", F.nullif(F.trim(F.get("_names", F.col("at"))), F.lit("")))
    return out.withColumn("filename", filename).withColumn("extension", extension(F.col("filename"))).drop("_names")


def candidate_key(program: Column, at: Column, url: Column) -> Column:
    return content_key(program, at, url)


def inherited_relations(relations: DataFrame, members: DataFrame) -> DataFrame:
    """(program, content) of direct relations, and of the members (container, member) of what a program has."""
    direct = relations.select("program", "content")
    inside = direct.join(members, F.col("content") == F.col("container")).select("program", F.col("member").alias("content"))
    return direct.union(inside).distinct()


def consistency(relations: DataFrame, key: str, identity: Sequence[str]) -> DataFrame:
    """key, number of relations, and whether all rows of the key agree on the identity columns."""
    row = F.struct(*identity)  # two distinct counts would treble the rows
    same = F.min(row).eqNullSafe(F.max(row))
    return relations.groupBy(key).agg(F.count(F.lit(1)).alias("relations"), F.count_distinct("program").alias("programs"), same.alias("consistent"))


def admission(chunks: DataFrame, is_reference: Column, per_program: int, per_reference: int, share_from: int, most_share: float) -> DataFrame:
    """(program, source, reason, points): why a source may not be indexed. chunks: program, source, one row per point."""
    counts = chunks.groupBy("program", "source").agg(F.count(F.lit(1)).alias("points"))
    totals = counts.groupBy("program").agg(F.sum("points").alias("all_points"))
    rows = counts.join(totals, "program").withColumn("reference", is_reference)
    share = F.col("points") / F.col("all_points")
    reasons = F.filter(
        F.array(
            F.when(F.col("points") > per_program, "document_points"),
            F.when(F.col("reference") & (F.col("points") > per_reference), "large_reference"),
            F.when(F.col("reference") & (F.col("points") >= share_from) & (share > most_share), "reference_share"),
        ),
        lambda x: x.isNotNull(),
    )
    return rows.select("program", "source", "points", F.explode(reasons).alias("reason"))


def filename_role(filename: Column, cues: dict[str, Sequence[str]], default: Column) -> Column:
    """The first role of ROLE_ORDER with a cue in the name, else default."""
    text = F.regexp_replace(F.lower(filename), r"(?U)\s", "")
    chain = F.when(F.lit(False), F.lit(""))
    for role in ROLE_ORDER:
        for cue in cues.get(role, ()):
            chain = chain.when(text.contains(cue), role)
    return chain.otherwise(default)


def unanimous(rows: DataFrame, key: str, value: Column, otherwise: str = "UNKNOWN") -> DataFrame:
    """key and the one value that all its rows agree on."""
    found = rows.groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    return found.select(key, F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(otherwise).alias("role"))


def unsafe_reason(archives: DataFrame, most_entries: int, most_bytes: int, most_ratio: float) -> DataFrame:
    """archives with the first safety rule they break, null for none."""
    reason = (
        F.when(F.col("entries") > most_entries, "entries")
        .when(F.col("bytes") > most_bytes, "total_size")
        .when(F.col("duplicates") > 0, "duplicate_paths")
        .when(F.col("escapes") > 0, "path_escape")
        .when(F.try_divide("bytes", "packed") > most_ratio, "ratio")
    )
    return archives.withColumn("reason", reason)


def first_by_key(rows: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """key and its first value in order: one aggregate, no window."""
    return rows.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias(value))


def public_url(url: Column, hosts: Sequence[str], query_keys: Sequence[str]) -> Column:
    """https, an allowed host, the default port, no user, no fragment, only allowed query keys."""
    part = lambda p: F.try_parse_url(url, F.lit(p))
    keys = F.transform(F.split(F.coalesce(part("QUERY"), F.lit("")), "&"), lambda q: F.substring_index(q, "=", 1))
    allowed = F.forall(keys, lambda k: (k == "") | k.isin(*query_keys))
    plain = part("USERINFO").isNull() & part("REF").isNull() & ~F.coalesce(part("AUTHORITY"), F.lit("")).rlike(r":\d+$")
    return F.coalesce((part("PROTOCOL") == "https") & part("HOST").isin(*hosts) & plain & allowed, F.lit(False))


def url_valid(url: Column) -> Column:
    """http or https with a host, no user, no white space; null and blank are valid."""
    host = F.try_parse_url(url, F.lit("HOST"))
    good = url.rlike(r"^https?://") & host.isNotNull() & (host != "") & F.try_parse_url(url, F.lit("USERINFO")).isNull() & ~url.rlike(r"(?U)[\s\x00-\x1f]")
    return (F.trim(F.coalesce(url, F.lit(""))) == "") | F.coalesce(good, F.lit(False))
