"""Line deduplication by site-relative frequency, in DataFrame functions only.

Group by host; the share of a line is the number of the host's pages that contain it over the number of its pages.
Lines whose share exceeds max_share, which at least min_pages pages of the host contain and which have min_words words or more,
are boilerplate and go from every page of that host. Lines are compared without white space at either end; lines without a word are neither
counted nor dropped.

Nulls: a null text stays null and counts as a page without lines; a null host is a host of its own. Repeated rows are
pages of their own. An empty text has one line without a word. Further input columns stay as they are, whatever their names, but for
the one that count_col names, which is replaced. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import packed, words_column, written

#: A menu is on most pages of a host, a notice or an advertisement on some; prose does not repeat at this share.
MAX_SHARE = 0.03
#: One page or two, such as copies of each other, do not make boilerplate however small the host.
MIN_PAGES = 3
#: Shorter lines repeat by chance.
MIN_WORDS = 3
#: Characters that do not make a word.
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return F.trim(line, F.lit(BLANKS))


def boilerplate(pages: DataFrame, host: Column, text: Column, max_share: float = MAX_SHARE, min_pages: int = MIN_PAGES, min_words: int = MIN_WORDS) -> DataFrame:
    """(_ld_host, _ld_line, _ld_pages, _ld_total): a row for each line to drop.

    Lines and host totals are counted on the map side first, so a line that a third of all pages hold, or a host of a third of
    them, is one row from each task.
    """
    lines = pages.select(
        host.alias("_ld_host"),
        F.explode(F.array_distinct(F.filter(F.transform(F.split(text, "\n"), line_key), lambda x: x != ""))).alias("_ld_line"),
    )
    totals = pages.groupBy(host.alias("_ld_host_t")).agg(F.count(F.lit(1)).alias("_ld_total"))
    counts = lines.groupBy("_ld_host", "_ld_line").agg(F.count(F.lit(1)).alias("_ld_pages")).where(F.col("_ld_pages") >= min_pages)
    if min_words > 1:
        counts = counts.where(F.size(words_column(F.col("_ld_line"))) >= min_words)
    return (
        counts.join(totals, F.col("_ld_host").eqNullSafe(F.col("_ld_host_t")))
        .where(F.col("_ld_pages") > F.lit(max_share) * F.col("_ld_total"))
        .select("_ld_host", "_ld_line", "_ld_pages", "_ld_total")
    )


def drop_boilerplate(pages: DataFrame, host: Column, text_col: str = "text", max_share: float = MAX_SHARE, min_pages: int = MIN_PAGES, min_words: int = MIN_WORDS, count_col: str = "_n_dropped") -> DataFrame:
    """pages with boilerplate lines out of text_col, and the number of lines dropped in count_col."""
    columns = [c for c in pages.columns if c != count_col]
    rows = packed(pages, host.alias("_ld_of"), F.col(f"`{text_col}`").alias("_ld_text"))
    drop = boilerplate(rows, F.col("_ld_of"), F.col("_ld_text"), max_share, min_pages, min_words)
    # A line in the list is on more than max_share of the host's pages, so the list has 1 / max_share times the lines of a mean page at most.
    lists = written(drop.groupBy("_ld_host").agg(F.collect_set("_ld_line").alias("_ld_lines")), "line-dedup")
    joined = rows.join(lists, F.col("_ld_of").eqNullSafe(F.col("_ld_host")), "left")
    parts = F.split("_ld_text", "\n")
    held = F.filter(parts, lambda x: ~F.array_contains(F.col("_ld_lines"), line_key(x)))
    has = F.col("_ld_lines").isNotNull() & F.col("_ld_text").isNotNull()
    out = joined.withColumn("_ld_held", F.when(has, held))
    return out.select(
        *[
            (F.when(has, F.array_join("_ld_held", "\n")).otherwise(F.col("_ld_text")) if c == text_col else F.col("_row")[c]).alias(c)
            for c in columns
        ],
        F.when(has, F.size(parts) - F.size("_ld_held")).otherwise(0).cast("long").alias(count_col),
    )
