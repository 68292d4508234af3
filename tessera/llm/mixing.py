"""Mixing sources to target weights, in DataFrame functions only.

Method: Efraimidis-Spirakis sampling. A document of weight w gets the key -ln(u) / w with u from a hash of its id, and a
source is read in order of the keys until its token budget is used. Budgets of one source size or more first take
complete epochs of every document; the remainder is selected by the prefix sums of the keys. The last document is in if
that brings the source nearer to its target.

A source may hold a third of all rows: keys are cut into ranges, sizes are summed by (source, range) on the
map side, and only rows of one range of one source are ever sorted together. Ranges are even in the logarithm of the key, RANGES_PER_E to a
factor of e: at any weight the densest of them holds 0.37 / RANGES_PER_E of the rows. A source has some 10 * RANGES_PER_E of them, and 40 * RANGES_PER_E
at most, and targets are found in windows over one row per source: this is meant for sources such as crawls and collections, not for hosts.

A null source is a source of its own, ordered last; null texts have size 0; a row without an id has the key of its text. Repeated rows count as
documents of their own; ties are ordered by id and size. Rows of one key, as of a repeated id, are sorted in one task. Weights that are null, not finite or not above 0 count as
MIN_WEIGHT. Sources of size 0 take nothing. Only the named columns are read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import words_column, written

SOURCE_WEIGHTS = (5.0, 2.0, 1.0)
SHARE_OF_ALL = 1.5
MOST_EPOCHS = 2
RANGES_PER_E = 256
LEAST_KEY = 1e-300
MIN_WEIGHT = 0.05


def text_weight(text: Column) -> Column:
    """Quality weight of a document: its share of characters that are not markup symbols, MIN_WEIGHT at least."""
    n = F.length(text)
    return F.when(n > 0, F.greatest(F.lit(MIN_WEIGHT), F.length(F.regexp_replace(text, "[#*$%&|<>]", "")) / n)).otherwise(F.lit(MIN_WEIGHT))


def unit_hash(doc_id: Column, text: Column) -> Column:
    """A number in (0, 1) from the first 48 bits of the MD5 of the id, or without one of the text; the same in every run."""
    head = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), text, F.lit("")).cast("binary")), 1, 12), 16, 10).cast("double")
    return (head + 0.5) / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame, weights: Sequence[float] = SOURCE_WEIGHTS, share: float = SHARE_OF_ALL, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target): weights repeat along the sources in code-point order.

    With caps c = most * size, the level L with sum(min(c, L * w)) = share * sum(size) is found by sorting on c / w:
    capped sources come first, and L is what is left over the weight that is left. The windows run over one row per source.
    """
    every = Window.partitionBy()
    named = sizes.withColumn("_mx_k", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")))
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("_mx_k") - 1) % len(weights) + 1).cast("int"))
    filled = named.withColumn("_mx_w", w).withColumn("_mx_c", F.col("source_size") * float(most))
    order = Window.orderBy(F.col("_mx_c") / F.col("_mx_w"), "_mx_k")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("_mx_c").over(before), F.lit(0.0))) / F.sum("_mx_w").over(after)
    rows = filled.withColumn("_mx_level", level).withColumn("_mx_open", F.col("_mx_c") / F.col("_mx_w") > F.col("_mx_level"))
    first = F.min_by(F.when(F.col("_mx_open"), F.col("_mx_level")), F.when(F.col("_mx_open"), F.col("_mx_c") / F.col("_mx_w"))).over(every)
    return rows.withColumn("target", F.least("_mx_c", F.coalesce(first * F.col("_mx_w"), F.col("_mx_c")))).select("source", "source_size", "target")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None) -> DataFrame:
    """doc_id, source, size, weight, source_size, target, epochs (complete), selected (in the fraction), taken."""
    weight = text_weight(F.col(text_col)) if weight is None else weight
    weight = F.when(~F.isnan(weight) & (weight > 0) & (weight < float("inf")), weight.cast("double")).otherwise(F.lit(MIN_WEIGHT))
    sized = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).alias("source"),
        F.size(words_column(F.col(text_col))).cast("long").alias("size"),
        weight.alias("weight"),
        unit_hash(F.col(id_col), F.col(text_col)).alias("_mx_u"),
    )
    key = F.greatest(-F.log("_mx_u") / F.col("weight"), F.lit(LEAST_KEY))
    sized = written(sized.withColumn("_mx_key", key).withColumn("_mx_range", F.floor(F.log("_mx_key") * RANGES_PER_E)), "mixing")
    by_range = sized.groupBy("source", "_mx_range").agg(F.sum("size").alias("_mx_sum"))
    by_range = written(by_range, "mixing-ranges")
    targets = source_targets(by_range.groupBy("source").agg(F.sum("_mx_sum").alias("source_size")))
    upto = Window.partitionBy("source").orderBy("_mx_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_range.withColumn("_mx_start", F.coalesce(F.sum("_mx_sum").over(upto), F.lit(0))).join(
        targets.withColumnRenamed("source", "_mx_source"), F.col("source").eqNullSafe(F.col("_mx_source"))
    )
    epochs = F.coalesce(F.floor(F.try_divide("target", "source_size") + 1e-12), F.lit(0)).cast("long")
    starts = written(
        starts.select(F.col("source").alias("_mx_source"), F.col("_mx_range").alias("_mx_of"), "_mx_start", "source_size", "target", epochs.alias("epochs")),
        "mixing-starts",
    )
    within = Window.partitionBy("source", "_mx_range").orderBy("_mx_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.join(starts, F.col("source").eqNullSafe(F.col("_mx_source")) & (F.col("_mx_range") == F.col("_mx_of")))
    prefix = F.col("_mx_start") + F.coalesce(F.sum("size").over(within), F.lit(0))
    rows = rows.withColumn("selected", prefix + F.col("size") / 2 <= F.col("target") - F.col("epochs") * F.col("source_size"))
    taken = F.col("size") * (F.col("epochs") + F.col("selected").cast("long"))
    return rows.select("doc_id", "source", "size", "weight", "source_size", "target", "epochs", "selected", taken.alias("taken"))
