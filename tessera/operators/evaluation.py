"""Evaluation metrics over multisets, ranks and timings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def multiset_recall(expected: DataFrame, actual: DataFrame, group: str, item: str) -> DataFrame:
    """group, expected items, items found (the smaller count of each), recall; null recall where nothing is expected."""
    e = expected.groupBy(group, item).agg(F.count(F.lit(1)).alias("e"))
    a = actual.groupBy(group, item).agg(F.count(F.lit(1)).alias("a"))
    rows = e.join(a, [group, item], "left").withColumn("found", F.least("e", F.coalesce("a", F.lit(0))))
    out = rows.groupBy(group).agg(F.sum("e").alias("expected"), F.sum("found").alias("found"))
    return out.withColumn("recall", F.round(F.try_divide("found", "expected"), 6))


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left that remain when each row of right has taken one equal row away."""
    return left.exceptAll(right)


def zero_filled(counted: DataFrame, labels: Sequence[str], label: str, n: str) -> DataFrame:
    """label, n, share for every label; null shares where all counts are 0."""
    spark = counted.sparkSession
    grid = spark.createDataFrame([(x,) for x in labels], f"{label} string")
    total = counted.where(F.col(label).isin(*labels)).agg(F.sum(n).alias("_total"))
    rows = F.broadcast(grid).join(counted, label, "left").join(F.broadcast(total))
    return rows.select(label, F.coalesce(n, F.lit(0)).alias(n), F.try_divide(F.coalesce(n, F.lit(0)), F.col("_total")).alias("share"))


def micro_macro(rows: DataFrame, group: str, found: str, expected: str) -> DataFrame:
    """Recall over all items, and the mean of the rows' own recalls; rows without expected items count in neither."""
    own = F.try_divide(found, expected)
    return rows.groupBy(group).agg(F.round(F.try_divide(F.sum(found), F.sum(expected)), 4).alias("micro"), F.round(F.avg(own), 4).alias("macro"), F.count(own).alias("n"))


def judged_lists(listed: DataFrame, gold: DataFrame, case: str) -> DataFrame:
    """Checks of each case of gold (case, wanted in order, most): listed has case, place, id, and allowed where the filter lets the id pass."""
    got = listed.groupBy(case).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("ids"), F.count_if(F.col("allowed").isNull()).alias("odd")
    )
    rows = gold.join(got, case, "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<bigint>")))
    return rows.select(
        case,
        (F.size("ids") > 0).alias("answered"),
        (F.size(F.array_except("wanted", "ids")) == 0).alias("expected_programs"),
        (F.slice("ids", F.lit(1), F.size("wanted")) == F.col("wanted")).alias("in_order"),
        (F.size(F.array_distinct("ids")) == F.size("ids")).alias("no_duplicates"),
        (F.coalesce("odd", F.lit(0)) == 0).alias("in_scope"),
        F.size("ids").between(F.lit(1), F.col("most")).alias("count_allowed"),
    )


def citation_checks(retrieved: Column, cited: Column, gold: Column, required: Column) -> list[Column]:
    """Whether citations were retrieved, stand where they must and only there, and whether gold evidence was retrieved."""
    known = F.size(F.array_except(cited, retrieved)) == 0
    return [known.alias("citations_known"), ((F.size(cited) > 0) == required).alias("citation_presence"), F.arrays_overlap(retrieved, gold).alias("evidence")]


def criteria_checks(criteria: Column, least: Column, hit: tuple[str, str], missing: Sequence[str], status: Column) -> list[Column]:
    """Checks of an array<struct<criterion, result>>; unmet criteria decide before unknown ones."""
    has = lambda result: F.exists(criteria, lambda x: x["result"] == result)
    unknown = F.array_sort(F.array_distinct(F.transform(F.filter(criteria, lambda x: x["result"] == "UNKNOWN"), lambda x: x["criterion"])))
    overall = F.when(has("UNMET"), "INELIGIBLE").when(has("UNKNOWN"), "NEEDS_INFO").otherwise("ELIGIBLE")
    return [
        (F.size(criteria) >= least).alias("enough"),
        F.exists(criteria, lambda x: (x["criterion"] == hit[0]) & (x["result"] == hit[1])).alias("criterion_hit"),
        has("UNKNOWN").alias("unknown_found"),
        (unknown == F.array(*map(F.lit, sorted(missing)))).alias("missing_as_expected"),
        (overall == status).alias("status"),
    ]
