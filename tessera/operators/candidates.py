"""Candidate selection and listing of programs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import dates, text


@dataclass(frozen=True)
class CandidateFilter:
    """Values are alternatives within a field; fields are joined by and. Empty fields ask nothing."""

    categories: Sequence[str] = ()
    targets: Sequence[str] = ()
    jurisdictions: Sequence[str] = ()
    not_jurisdictions: Sequence[str] = ()
    region: str | None = None
    open_on: str | None = None
    not_closed_on: str | None = None


def candidate_condition(f: CandidateFilter) -> Column:
    """Unknown jurisdictions fail not_jurisdictions, as SQL's NOT IN has it; unknown dates never close a program."""
    asked = [F.col("active")]
    for column, values in (("category", f.categories), ("target", f.targets), ("jurisdiction", f.jurisdictions)):
        if values:
            asked.append(F.col(column).isin(*values))
    if f.not_jurisdictions and f.region is None:
        asked.append(~F.col("jurisdiction").isin(*f.not_jurisdictions))
    if f.not_closed_on:
        asked.append(~dates.surely_closed(F.col("end_date"), F.lit(f.not_closed_on).cast("date")))
    if f.open_on:
        asked.append(dates.may_be_open(F.col("start_date"), F.col("end_date"), F.lit(f.open_on).cast("date")))
    return reduce(lambda a, b: a & b, asked)


def candidates(programs: DataFrame, f: CandidateFilter) -> DataFrame:
    return programs.where(candidate_condition(f))


def listing_page(programs: DataFrame, day: str, page: int = 0, size: int = 20, keyword: str | None = None, category: str | None = None, state: str | None = None) -> DataFrame:
    """One page of active programs, highest id first, each row with the total of the condition. Page and size are clamped."""
    page, size = max(0, page), min(max(1, size), 50)
    rows = programs.where("active").withColumn("state", dates.program_state(F.col("start_date"), F.col("end_date"), F.lit(day).cast("date")))
    if keyword and keyword.strip():
        rows = rows.where(F.col("name").contains(keyword.strip()) | F.col("category").contains(keyword.strip()))
    if category:
        rows = rows.where(F.col("category") == category)
    if state:
        rows = rows.where(F.col("state") == state)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(F.desc("id")).offset(page * size).limit(size).select("id", "name", "state").join(F.broadcast(total))


def domain_values(programs: DataFrame, *columns: str) -> DataFrame:
    """(field, value): distinct known values of active programs."""
    parts = [programs.where("active").where(F.col(c).isNotNull()).select(F.lit(c).alias("field"), F.col(c).alias("value")).distinct() for c in columns]
    return reduce(DataFrame.unionByName, parts)


def leading_tag(name: Column) -> Column:
    """What stands in square brackets at the very start of a name; empty if nothing does."""
    return F.regexp_extract(name, r"^\s*\[([^\]]+)\]", 1)


def program_regions(programs: DataFrame, owners: DataFrame, aliases: DataFrame) -> DataFrame:
    """programs with regions and basis: several regions in the title, else the owner's, else the title's, else none.

    owners: (jurisdiction, region); aliases: (alias, region), several rows for an area. A title with any unknown name has no regions.
    """
    tokens = programs.select("id", F.explode(F.split(leading_tag(F.col("name")), r"\s*[,·/]\s*")).alias("alias")).where("alias <> ''")
    named = tokens.join(aliases, "alias", "left").groupBy("id").agg(
        F.array_sort(F.collect_set("region")).alias("tagged"), F.bool_or(F.col("region").isNull()).alias("unknown")
    )
    rows = programs.join(owners.withColumnRenamed("region", "owner_region"), "jurisdiction", "left").join(named, "id", "left")
    none = F.array().cast("array<string>")
    tagged = F.when(F.coalesce("unknown", F.lit(True)), none).otherwise(F.col("tagged"))
    rows = rows.withColumn("tagged", tagged)
    regions = F.when(F.size("tagged") > 1, F.col("tagged")).when(F.col("owner_region").isNotNull(), F.array("owner_region")).otherwise(F.col("tagged"))
    basis = F.when(F.size("tagged") > 1, "TITLE").when(F.col("owner_region").isNotNull(), "OWNER").when(F.size("tagged") == 1, "TITLE").otherwise("NONE")
    return rows.withColumn("regions", regions).withColumn("basis", basis).drop("tagged", "unknown", "owner_region")


def region_allowed(regions: Column, region: str) -> Column:
    """Programs without a known region are open to every region."""
    return (F.size(regions) == 0) | F.array_contains(regions, region)


def condition_conflicts(profiles: DataFrame) -> DataFrame:
    """profiles with the targets and jurisdictions left after both sides; an empty rest is a conflict, never relaxed."""
    left = F.when(F.col("company_targets").isNull(), F.col("query_targets")).when(F.size("query_targets") == 0, F.col("company_targets")).otherwise(
        F.array_intersect("query_targets", "company_targets")
    )
    owners = F.array_except("query_jurisdictions", "excluded_jurisdictions")
    lost = (F.size("query_jurisdictions") > 0) & (F.size(owners) == 0)
    clash = F.col("company_targets").isNotNull() & (F.size("query_targets") > 0) & (F.size(F.array_intersect("query_targets", "company_targets")) == 0)
    return profiles.withColumns({"targets": left, "jurisdictions": owners, "conflict": F.when(lost, "region").when(clash, "target")})


def best_matches(scored: DataFrame, group: str, order: Sequence[Column]) -> DataFrame:
    """All rows tied on the best order within group, and how many there are."""
    w = Window.partitionBy(group)
    ranked = scored.withColumn("_place", F.rank().over(w.orderBy(*order))).where("_place = 1").drop("_place")
    return ranked.withColumn("n_tied", F.count(F.lit(1)).over(w))


#: What of a title names an edition or a notice rather than the business.
EDITION = r"(?<![0-9])20[0-9]{2}\s*년?|제?\s*[0-9]+\s*차(?=\s|$|[\]\)])"
NOTICE = r"(?:변경|수정|재|추가)\s*(?:모집)?\s*공고|모집\s*공고|공고"
#: What is no part of a plain name, and the length below which a name stands for its own row only.
NO_NAME = "[^가-힣a-z0-9]"
LEAST_NAME = 8


def business_identity(title: Column, key: Column, *rest: Column) -> Column:
    """The same business under other years, rounds and notices: its plain name with rest; a short name stands for its own row only."""
    plain = F.lower(text.nfkc(F.coalesce(title, F.lit(""))))
    for pattern in (f"(?U){EDITION}", f"(?U){NOTICE}", NO_NAME):
        plain = F.regexp_replace(plain, pattern, "")
    own = F.struct(key.cast("string").alias("name"), *[F.lit(None).cast("string").alias(f"r{k}") for k in range(len(rest))])
    return F.when(F.length(plain) < LEAST_NAME, own).otherwise(F.struct(plain.alias("name"), *[r.cast("string").alias(f"r{k}") for k, r in enumerate(rest)]))


def ranked_overall(rows: DataFrame, by: str, tie: str, name: str, ranges: int = 64) -> DataFrame:
    """rows with their rank from 1 by (by, tie) over the whole table. Rows are ranked within quantile ranges of by, and ranges by their counts."""
    at = [(k + 1) / ranges for k in range(ranges - 1)]
    bounds = rows.agg(F.array_sort(F.array_distinct(F.percentile_approx(by, F.array(*map(F.lit, at)), F.lit(10_000)))).alias("_bounds"))
    held = rows.join(F.broadcast(bounds)).withColumn("_range", F.size(F.filter("_bounds", lambda b: b < F.col(by)))).drop("_bounds")
    counts = held.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_range", before.alias("_start"))  # one row to a range
    within = F.row_number().over(Window.partitionBy("_range").orderBy(by, tie))
    return held.withColumn("_within", within).join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_within")).drop("_range", "_start", "_within")


GRAM = 4


def containing(needles: DataFrame, needle: str, texts: DataFrame, text_col: str) -> DataFrame:
    """(needle, text) of the distinct texts that contain a distinct needle; empty needles are in no text.

    A text that contains a needle holds all its runs of GRAM characters (of all, for a shorter needle); they meet by the rarest of these.
    """

    def grams(value: Column, n: Column | int) -> Column:
        n = F.lit(n) if isinstance(n, int) else n
        return F.when(F.length(value) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(value) - n + 1), lambda k: F.substring(value, k, n))))

    held = texts.select(text_col, F.explode(F.flatten(F.filter(F.array(*[grams(F.col(text_col), n) for n in range(1, GRAM + 1)]), lambda g: g.isNotNull()))).alias("_gram"))
    often = held.groupBy("_gram").agg(F.count(F.lit(1)).alias("_often"))
    asked = needles.where(F.length(needle) > 0).select(needle, F.explode(grams(F.col(needle), F.least(F.lit(GRAM), F.length(needle)))).alias("_gram"))
    # A run that no text has rules the needle out.
    rarest = asked.join(often, "_gram", "left").groupBy(needle).agg(F.min_by("_gram", F.struct(F.coalesce("_often", F.lit(0)), "_gram")).alias("_gram"))
    return rarest.join(held, "_gram").where(F.col(text_col).contains(F.col(needle))).select(needle, text_col)


def longest_prefix(rows: DataFrame, text: str, aliases: DataFrame, name: str) -> DataFrame:
    """rows with name: the value of the longest alias that text begins with, spaces removed from both; null where none does.

    aliases (alias, value). A text meets an alias by equality of a prefix of one of the aliases' lengths, which are few however many aliases there
    are; of one alias with several values the least counts. A text is looked up once, however many rows have it.
    """
    plain = lambda c: F.regexp_replace(c, r"\s", "")
    known = aliases.select(plain(F.col("alias")).alias("_p"), F.col("value").alias("_v")).where("_p <> ''").groupBy("_p").agg(F.min("_v").alias("_v"))
    lengths = known.agg(F.array_sort(F.collect_set(F.length("_p"))).alias("_lengths"))  # one row
    asked = rows.select(F.col(text).alias("_t")).distinct().withColumn("_s", plain(F.col("_t"))).join(F.broadcast(lengths))
    prefixes = F.transform(F.filter("_lengths", lambda n: n <= F.length("_s")), lambda n: F.substring(F.col("_s"), F.lit(1), n))
    found = asked.select("_t", F.explode(prefixes).alias("_p")).join(known, "_p").groupBy("_t").agg(F.max_by("_v", F.length("_p")).alias(name))
    return rows.join(found, F.col(text) == F.col("_t"), "left").drop("_t")
