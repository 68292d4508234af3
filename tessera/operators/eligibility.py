"""Eligibility: criteria against evidence and facts, verdicts, what is missing, the final result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def validated(criteria: DataFrame, evidence: DataFrame, facts: DataFrame) -> DataFrame:
    """criteria (program, criterion, result, evidence_id, field) with problem and the result that stands.

    Evidence must exist and be the program's own, or of no program; the field must be known; a verdict on a field without a value becomes UNKNOWN.
    """
    e = evidence.select("evidence_id", F.col("program").alias("evidence_program"), F.lit(True).alias("there"))
    f = facts.select("field", "value", F.lit(True).alias("known"))
    rows = criteria.join(e, "evidence_id", "left").join(f, "field", "left")
    problem = F.when(F.col("there").isNull(), "unknown_evidence").when(F.col("evidence_program") != F.col("program"), "foreign_evidence").when(F.col("known").isNull(), "unknown_field")
    guessed = (F.col("result") != "UNKNOWN") & F.col("value").isNull()
    rows = rows.withColumn("problem", problem).withColumn("adjusted", F.when(problem.isNull() & guessed, F.col("result")))
    return rows.withColumn("result", F.when(problem.isNull() & guessed, "UNKNOWN").otherwise(F.col("result")))


def overall(results: DataFrame, key: str) -> DataFrame:
    """key and status: one failed criterion decides, then one unknown, then all met."""
    return results.groupBy(key).agg(
        F.when(F.bool_or(F.col("result") == "NOT_MET"), "INELIGIBLE").when(F.bool_or(F.col("result") == "UNKNOWN"), "NEEDS_MORE_INFO").otherwise("ELIGIBLE").alias("status"),
        F.count(F.lit(1)).alias("criteria"),
        F.array_sort(F.collect_set(F.when(F.col("result") == "UNKNOWN", F.col("field")))).alias("missing"),
    )


def with_status(programs: DataFrame, statuses: DataFrame, key: str) -> DataFrame:
    """Programs without any criterion have insufficient evidence."""
    return programs.join(statuses, key, "left").withColumn("status", F.coalesce("status", F.lit("INSUFFICIENT_EVIDENCE")))


def missing_fields(evaluated: DataFrame, canonical: dict[str, str], answerable: Sequence[str], answered: Sequence[str]) -> DataFrame:
    """(field, sources, programs) still to ask for, in order of first need. evaluated: program, rank, status, missing."""
    rows = evaluated.where("status = 'NEEDS_MORE_INFO'").select("program", "rank", F.posexplode("missing").alias("at", "source"))
    names = F.create_map(*[F.lit(x) for pair in canonical.items() for x in pair]) if canonical else None
    field = F.coalesce(F.try_element_at(names, F.col("source")), F.col("source")) if canonical else F.col("source")
    rows = rows.withColumn("field", field).where(F.col("field").isin(*answerable) & ~F.col("field").isin(*answered))
    return rows.groupBy("field").agg(
        F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_set("program")).alias("programs"), F.min(F.struct("rank", "at")).alias("first")
    )


def final_result(evaluated: DataFrame, key: str) -> DataFrame:
    """key, category, counts and the ranked programs of each category of finished evaluations."""
    category = F.when(F.col("status") == "ELIGIBLE", "recommended").when(F.col("status") == "INELIGIBLE", "excluded").otherwise("unresolved")
    rows = evaluated.withColumn("category", category)
    return rows.groupBy(key, "category").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("rank", "program"))).alias("items"))


def profile_sentence(parts: Sequence[tuple[str, Column]]) -> Column:
    """struct<sentence, fields>: the words of the known parts of a profile and the names of the parts used; null parts are left out."""
    words = F.filter(F.array(*[c for _, c in parts]), lambda x: x.isNotNull())
    fields = F.filter(F.array(*[F.when(c.isNotNull(), n) for n, c in parts]), lambda x: x.isNotNull())
    return F.struct(F.nullif(F.array_join(words, " "), F.lit("")).alias("sentence"), fields.alias("fields"))


def progress(evaluations: DataFrame, key: str) -> DataFrame:
    state = F.col("state")
    return evaluations.groupBy(key).agg(F.count_if(state == "COMPLETED").alias("completed"), F.count_if(state == "FAILED").alias("failed"), F.count_if(state == "PENDING").alias("pending"))


def citations_hold(cited: DataFrame, retrieved: DataFrame, key: str) -> DataFrame:
    """key, whether every citation was retrieved for the same key, and whether all come from one program."""
    hit = retrieved.select(key, F.col("evidence_id"), F.lit(True).alias("there")).distinct()
    rows = cited.join(hit, [key, "evidence_id"], "left")
    return rows.groupBy(key).agg(F.every(F.coalesce("there", F.lit(False))).alias("grounded"), (F.count_distinct("program") <= 1).alias("one_program"))
