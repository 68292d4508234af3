"""Quality rules: learned decision lists over text statistics, in DataFrame functions only.

Method: sequential covering. Rules for low quality are grown one threshold condition at a time by information gain on two
thirds of the labelled rows, pruned from the end on the other third, and kept while they are precise there; the rows a rule covers
leave before the next one is grown. The list becomes one ordered Spark conditional expression. Each growing step is one
aggregation whose result has a row for each (statistic, threshold bin, label, part): a few hundred rows however many are labelled.

Statistics: words are [^\\x20\\x09-\\x0D]+; null and empty texts have none, so all counts are 0 and the base check fails.
Lines count as duplicates if they hold a word and equal an earlier line; words in a three-word window that occurs twice or
more in the text count as repeated. Labels that are null or whose id matches no document teach nothing; of several labels of an
id the lowest counts. Without labelled rows of both kinds the list is empty and keeps all. Repeated rows are judged
alike. Only the named columns are read. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE_CLASS, crc_remainder, let, words_column, written

MIN_WORDS = 50
REPEAT_PERCENT = 50
BINS = 24
MAX_RULES = 6
MAX_CONDITIONS = 3
MIN_PRECISION = 0.8
MIN_COVERED = 5
PRUNE_FOLDS = 3

#: Statistics that rules may test, by name, from the columns of statistics().
MEASURES = {
    "words": "cast(n_words as double)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "upper_per_char": "n_upper / greatest(word_chars, 1)",
    "duplicate_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


def repeated_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more. Windows are sorted only where one repeats."""
    grams = F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))))

    def covered(at: Column) -> Column:
        own = F.transform(at, lambda p, k: F.coalesce(F.least(F.get(at, k + 1) - p, F.lit(3)), F.lit(3)))
        return F.aggregate(own, F.lit(0), lambda a, b: a + b)

    def places(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        again = let(
            pairs,
            lambda s: F.transform(
                F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["w"] == x["w"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["w"] == x["w"], F.lit(False))),
                lambda x: x["i"],
            ),
        )
        return let(F.sort_array(again), covered)

    return F.coalesce(let(grams, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), places(g)).otherwise(0)), F.lit(0)).cast("long")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts that base_failed() and MEASURES use."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = docs.select(
        F.col(id_col).alias("doc_id"),
        text.alias("_qr_text"),
        words_column(F.col(text_col)).alias("_qr_words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(SPACE_CLASS.replace("[", "[^"))).alias("_qr_lines"),
    )
    left_out = lambda pattern: F.length("_qr_text") - F.length(F.regexp_replace("_qr_text", pattern, ""))
    return parts.select(
        "doc_id",
        F.size("_qr_words").cast("long").alias("n_words"),
        F.length(F.array_join("_qr_words", "")).cast("long").alias("word_chars"),
        left_out("[#*$%&|<>]").cast("long").alias("n_symbols"),
        (F.size("_qr_lines") - F.size(F.array_distinct("_qr_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_qr_words")).alias("n_repeat_words"),
        F.size("_qr_lines").cast("long").alias("n_lines"),
        left_out("\\p{Lu}+").cast("long").alias("n_upper"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.measure) > self.threshold if self.above else F.col(self.measure) <= self.threshold

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def rule_column(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, (c.column() for c in rule), F.lit(True))


def first_rule(rules: Sequence[Rule]) -> Column:
    """Number of the first rule that holds, from 1; 0 if none does."""
    if not rules:
        return F.lit(0)
    chain = F.when(rule_column(rules[0]), 1)
    for k, rule in enumerate(rules[1:], 2):
        chain = chain.when(rule_column(rule), k)
    return chain.otherwise(0)


def measures(stats: DataFrame) -> DataFrame:
    return stats.select("*", *[F.expr(e).cast("double").alias(m) for m, e in MEASURES.items()])


def thresholds(labelled: DataFrame) -> dict[str, list[float]]:
    """Cuts of each measure, BINS at most: midway between neighbouring quantiles of either class, so a cut has a margin on both sides."""
    at = [(k + 0.5) / (BINS // 2) for k in range(BINS // 2)]
    found = labelled.groupBy("low").agg(*[F.percentile_approx(m, at, 10_000).alias(m) for m in MEASURES]).collect()
    values = {m: sorted({v for row in found for v in row[m] or [] if v is not None}) for m in MEASURES}
    return {m: [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)] for m, v in values.items()}


def counted(rows: DataFrame, cuts: dict[str, list[float]]) -> list[tuple[Condition, int, int]]:
    """Each condition with the low and the other rows it holds for, from one aggregation over bins."""

    def bin_of(m: str, c: list[float]) -> Column:
        return F.size(F.filter(F.lit(c), lambda t: t < F.col(m)))

    bins = F.array(*[F.struct(F.lit(m).alias("m"), bin_of(m, c).alias("b")) for m, c in cuts.items() if c])
    table = rows.select("low", F.explode(bins).alias("x")).groupBy("x.m", "x.b", "low").count().collect()
    by: dict[tuple[str, int, int], int] = {(r["m"], r["b"], r["low"]): r["count"] for r in table}
    out = []
    for m, c in cuts.items():
        total = [sum(by.get((m, b, k), 0) for b in range(len(c) + 1)) for k in (1, 0)]
        below = [0, 0]
        for b, t in enumerate(c):  # bin b holds values up to cut b
            below = [n + by.get((m, b, k), 0) for n, k in zip(below, (1, 0), strict=True)]
            out += [(Condition(m, False, t), *below), (Condition(m, True, t), total[0] - below[0], total[1] - below[1])]
    return out


def grow(rows: DataFrame, cuts: dict[str, list[float]]) -> Rule:
    rule: Rule = ()
    first = {r["low"]: r["count"] for r in rows.groupBy("low").count().collect()}
    p0, n0 = first.get(1, 0), first.get(0, 0)
    while p0 and n0 and len(rule) < MAX_CONDITIONS:
        before = math.log2(p0 / (p0 + n0))
        options = [(p * (math.log2(p / (p + n)) - before), p, -n, str(c), c) for c, p, n in counted(rows.where(rule_column(rule)), cuts) if p >= MIN_COVERED]
        gain, p, minus_n, _, best = max(options, key=lambda o: o[:4], default=(0, 0, 0, "", None))
        if best is None or gain <= 1e-9:
            break
        rule, p0, n0 = (*rule, best), p, -minus_n
    return rule


def pruned(rule: Rule, rows: DataFrame) -> tuple[Rule, float, int]:
    """The prefix of rule with the best (p - n) / (p + n) on rows, its precision there, and the rows it covers."""
    sums = []
    for k in range(1, len(rule) + 1):
        held = rule_column(rule[:k])
        sums += [F.count_if(held & (F.col("low") == 1)).alias(f"p{k}"), F.count_if(held & (F.col("low") == 0)).alias(f"n{k}")]
    got = rows.agg(*sums).first()
    scored = [((got[f"p{k}"] - got[f"n{k}"]) / max(1, got[f"p{k}"] + got[f"n{k}"]), -k) for k in range(1, len(rule) + 1)]
    k = -max(scored)[1]
    covered = got[f"p{k}"] + got[f"n{k}"]
    return rule[:k], got[f"p{k}"] / max(1, covered), covered


def learn(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> list[Rule]:
    """A decision list for low quality (label 0) from statistics that pass the base check, and their labels."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("_q")).where("doc_id is not null and _q is not null")
    known = known.groupBy("doc_id").agg(F.min("_q").alias("_q"))
    labelled = measures(stats.where(~base_failed()).join(known, "doc_id")).select(
        *MEASURES, (F.col("_q") < 1).cast("int").alias("low"), (crc_remainder(F.col("doc_id"), PRUNE_FOLDS) == 0).alias("prune")
    )
    left = written(labelled, "quality-labelled")
    cuts = thresholds(left)
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        rule = grow(left.where("not prune"), cuts)
        if not rule:
            break
        rule, precision, covered = pruned(rule, left.where("prune"))
        if precision < MIN_PRECISION or covered < MIN_COVERED:
            break
        rules.append(rule)
        left = left.where(~rule_column(rule))
    return rules


def judge(stats: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """stats with base_failed, rule (the number of the first rule that holds, 0: none) and kept."""
    judged = measures(stats).withColumn("base_failed", base_failed()).withColumn("rule", first_rule(rules))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    stats = written(statistics(docs), "quality-statistics")
    return judge(stats, learn(stats, labels))
