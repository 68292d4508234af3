"""Lifecycle of ingested rows: upsert, soft deletion, verification, run quality."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert_actions(stored: DataFrame, seen: DataFrame, key: str = "id") -> DataFrame:
    """key, action and reactivated for every row: INSERTED, UPDATED or NOOP by fingerprint for seen rows, UNSEEN for the rest."""
    s = stored.select(key, F.col("fingerprint").alias("stored"), "deleted")
    n = seen.select(key, F.col("fingerprint").alias("seen"))
    action = (
        F.when(F.col("seen").isNull(), "UNSEEN")
        .when(F.col("stored").isNull(), "INSERTED")
        .when(F.col("stored") != F.col("seen"), "UPDATED")
        .otherwise("NOOP")
    )
    reactivated = F.col("seen").isNotNull() & F.coalesce("deleted", F.lit(False))
    return s.join(n, key, "full_outer").select(key, action.alias("action"), reactivated.alias("reactivated"))


def merged(stored: DataFrame, seen: DataFrame, columns: Sequence[str], run_id: str, key: str = "id") -> DataFrame:
    """The table after the run: content changes only where the fingerprint does; every seen row is active and marked with the run."""
    n = seen.select(key, F.lit(True).alias("_seen"), F.col("fingerprint").alias("_new"), *[F.col(c).alias(f"_n_{c}") for c in columns])
    rows = stored.join(n, key, "full_outer")
    here = F.coalesce("_seen", F.lit(False))
    changed = here & ~F.coalesce(F.col("fingerprint") == F.col("_new"), F.lit(False))
    pick = [F.when(changed, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in columns]
    return rows.select(
        key,
        *pick,
        F.when(here, F.col("_new")).otherwise(F.col("fingerprint")).alias("fingerprint"),
        F.when(here, False).otherwise(F.col("deleted")).alias("deleted"),
        F.when(here, run_id).otherwise(F.col("run_id")).alias("run_id"),
    )


def soft_deleted(table: DataFrame, run_id: str, allowed: bool) -> DataFrame:
    """Active rows that the run did not see become deleted, if a complete run allows it."""
    unseen = ~F.col("deleted") & ~F.col("run_id").eqNullSafe(F.lit(run_id))
    return table.withColumn("deleted", F.col("deleted") | unseen) if allowed else table


def differing_columns(left: DataFrame, right: DataFrame, columns: Sequence[str], key: str = "id") -> DataFrame:
    """Rows of left that right lacks or holds differently, null being equal to null, with the names of the columns that differ."""
    r = right.select(key, F.lit(True).alias("_there"), *[F.col(c).alias(f"_r_{c}") for c in columns])
    wrong = F.filter(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_r_{c}")), c) for c in columns]), lambda x: x.isNotNull())
    rows = left.join(r, key, "left").withColumn("missing", F.col("_there").isNull()).withColumn("differs", F.when(~F.col("missing"), wrong).otherwise(F.array().cast("array<string>")))
    return rows.where(F.col("missing") | (F.size("differs") > 0)).select(key, "missing", "differs")


def run_report(items: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: totals of items (id, valid) and of pages (number, outcome, total_count, n_items)."""
    i = items.agg(
        F.count(F.lit(1)).alias("observed"),
        F.count_if("valid").alias("valid"),
        F.count_distinct(F.when(F.col("valid"), F.col("id"))).alias("unique_ids"),
        F.count_if(~F.col("valid")).alias("invalid"),
    )
    p = pages.agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.count_if(F.col("outcome") == "SUCCESS").alias("good_pages"),
        F.count_if(F.col("outcome") == "TRANSPORT_ERROR").alias("transport_errors"),
        F.count_if(F.col("outcome") == "API_ERROR").alias("api_errors"),
        F.min_by(F.when(F.col("outcome") == "SUCCESS", F.col("total_count")), F.when(F.col("outcome") == "SUCCESS", F.col("number"))).alias("expected"),
        F.count_distinct(F.when(F.col("outcome") == "SUCCESS", F.col("total_count"))).alias("n_totals"),
        F.max("number").alias("last_page"),
        F.count_distinct("number").alias("n_numbers"),
        F.count_if(F.col("n_items") != F.least(F.col("asked"), F.greatest(F.lit(0), F.col("total_count") - (F.col("number") - 1) * F.col("asked")))).alias("odd_pages"),
    )
    return i.join(F.broadcast(p)).withColumn("duplicates", F.col("valid") - F.col("unique_ids"))


def blocking_reasons(report: DataFrame) -> DataFrame:
    """report with reasons: everything that forbids deleting what the run did not see, in a fixed order."""
    checks = (
        ("requests_failed", F.col("good_pages") < F.col("n_pages")),
        ("transport_errors", F.col("transport_errors") > 0),
        ("api_errors", F.col("api_errors") > 0),
        ("duplicates", F.col("duplicates") > 0),
        ("totals_differ", F.col("n_totals") != 1),
        ("unique_not_total", ~F.col("unique_ids").eqNullSafe(F.col("expected"))),
        ("invalid_ids", F.col("invalid") > 0),
        ("page_gap", (F.col("n_numbers") != F.col("n_pages")) | (F.col("last_page") != F.col("n_pages"))),
        ("page_item_counts", F.col("odd_pages") > 0),
        ("empty_universe", F.col("unique_ids") == 0),
    )
    return report.withColumn("reasons", F.filter(F.array(*[F.when(ok, name) for name, ok in checks]), lambda x: x.isNotNull()))


def field_states(rows: DataFrame, json_col: str, fields: Sequence[str]) -> DataFrame:
    """(field, state, n) with every state of every field: MISSING, NULL, BLANK or VALID, from the raw JSON text."""
    v = F.try_parse_json(F.col(json_col))

    def state(name: str) -> Column:
        got = F.try_variant_get(v, f"$.{name}", "variant")
        text = F.try_variant_get(v, f"$.{name}", "string")
        return F.when(got.isNull(), "MISSING").when(F.is_variant_null(got), "NULL").when(F.trim(text) == "", "BLANK").otherwise("VALID")

    long = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), state(f).alias("state")) for f in fields])).alias("x"))
    counted = long.groupBy("x.field", "x.state").agg(F.count(F.lit(1)).alias("n"))
    spark = rows.sparkSession
    grid = spark.createDataFrame([(f, s) for f in fields for s in ("MISSING", "NULL", "BLANK", "VALID")], "field string, state string")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    full = F.broadcast(grid).join(counted, ["field", "state"], "left").join(F.broadcast(total))
    return full.select("field", "state", F.coalesce("n", F.lit(0)).alias("n"), F.try_divide(F.coalesce("n", F.lit(0)), F.col("total")).alias("share"))


def ordering_class(rows: DataFrame, group: str, at: str, order: Sequence[str]) -> DataFrame:
    """group and the way its values run: CONSTANT, ASCENDING, DESCENDING or UNORDERED."""
    w = Window.partitionBy(group).orderBy(*order)
    steps = rows.withColumn("_before", F.lag(at).over(w)).where(F.col("_before").isNotNull())
    found = steps.groupBy(group).agg(F.bool_or(F.col(at) > F.col("_before")).alias("up"), F.bool_or(F.col(at) < F.col("_before")).alias("down"))
    kind = F.when(F.col("up") & F.col("down"), "UNORDERED").when(F.col("up"), "ASCENDING").when(F.col("down"), "DESCENDING").otherwise("CONSTANT")
    return found.select(group, kind.alias("ordering"))


def table_counts(tables: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    return reduce(DataFrame.unionByName, [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, t in tables])
