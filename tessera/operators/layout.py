"""Page layout: words in cells, clusters of lines, grids, greedy matching of tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import geometry as geo

BUCKET = 100.0
#: Rows that page_by_page() gives at once.
AT_ONCE = 10_000


def page_by_page(rows: DataFrame, page: str, f: Callable[[list[tuple]], list[tuple]], out: str, within: Sequence[str] = (), tasks: int | None = None) -> DataFrame:
    """page and the columns out that f gives for the rows (their other columns, as tuples in any order) of each page, or of each part of a page by the numbers within.

    Pages are small and many: a task goes through its pages as they stand in sorted batches, where a group of pandas for each page would cost more than its rows.
    Without tasks, Spark joins small partitions by their bytes.
    """
    others = [c for c in rows.columns if c != page and c not in within]
    names = [page, *[c.split()[0] for c in out.split(", ")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, found = None, [], []

        def told() -> pd.DataFrame:
            frame = pd.DataFrame(found, columns=names)
            return frame.assign(**{page: pd.array([x[0] for x in found], dtype="Int64")})

        def done() -> None:
            if held:
                found.extend((None if at[0] is None else int(at[0]), *x) for x in f(held))

        for batch in batches:
            pages = batch[page].astype(object).where(batch[page].notna(), None).to_numpy()
            marks = [pages, *[batch[c].to_numpy() for c in within]]
            columns = [batch[c].tolist() for c in others]
            changed = np.zeros(max(0, len(pages) - 1), bool)
            for x in marks:
                changed |= x[1:] != x[:-1]
            starts = [0, *(changed.nonzero()[0] + 1).tolist(), len(pages)]
            for low, high in zip(starts, starts[1:], strict=False):
                if low == high:
                    continue
                here = tuple(x[low] for x in marks)
                if here != at:
                    done()
                    at, held = here, []
                held.extend(zip(*[c[low:high] for c in columns], strict=True))
                if len(found) >= AT_ONCE:
                    yield told()
                    found = []
        done()
        yield told()

    # As text, since pandas rounds long numbers beside nulls; rows without a page are a page.
    dealt = rows.repartition(page, *within) if tasks is None else rows.repartition(tasks, page, *within)
    return dealt.sortWithinPartitions(page, *within).withColumn(page, F.col(page).cast("string")).mapInPandas(run, f"{page} long, {out}")


def on_grid(rows: DataFrame, box: str, size: float = BUCKET) -> DataFrame:
    """rows repeated for each grid square that their box touches: the equi-join key of a containment join."""
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(f"{box}.{lo}") / size), F.floor(F.col(f"{box}.{hi}") / size)))
    return rows.withColumn("gx", span("l", "r")).withColumn("gy", span("t", "b"))


def words_in_cells(words: DataFrame, cells: DataFrame) -> DataFrame:
    """page, word, cell: the smallest cell that holds a word's centre; null where none does.

    A word stands in the grid square of its centre, a cell in all that it touches, so the join is an equi-join.
    """
    x, y = (F.col("word_box.l") + F.col("word_box.r")) / 2, (F.col("word_box.t") + F.col("word_box.b")) / 2
    w = words.withColumn("gx", F.floor(x / BUCKET)).withColumn("gy", F.floor(y / BUCKET))
    hits = w.join(on_grid(cells, "cell_box"), ["page", "gx", "gy"]).where(geo.center_in(F.col("cell_box"), F.col("word_box")))
    best = hits.groupBy("page", "word").agg(F.min_by("cell", F.struct(geo.area(F.col("cell_box")), "cell")).alias("cell"))
    return words.select("page", "word").join(best, ["page", "word"], "left")


def gap_clusters(values: DataFrame, group: str, value: str, tolerance: float) -> DataFrame:
    """group, cluster, its mean and size: a cluster ends where the gap to the next value exceeds tolerance."""
    w = Window.partitionBy(group).orderBy(value)
    new = F.coalesce((F.col(value) - F.lag(value).over(w) > tolerance).cast("int"), F.lit(0))
    marked = values.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(group, "cluster").agg(F.round(F.avg(value), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


def band_bounds(tiles: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """tiles with the band that each owns: to the midpoint of the overlap with its neighbours."""
    w = Window.partitionBy(group).orderBy(start)
    low = (F.col(start) + F.lag(end).over(w)) / 2
    high = (F.lead(start).over(w) + F.col(end)) / 2
    return tiles.withColumn("own_from", F.coalesce(low, F.col(start).cast("double"))).withColumn("own_to", F.coalesce(high, F.col(end).cast("double")))


def grid_report(cells: DataFrame, table: str) -> DataFrame:
    """table, rows, columns, slots taken twice, and whether rows differ in width. cells: row, col, rowspan, colspan."""
    slots = cells.select(
        table, F.explode(F.sequence(F.col("row"), F.col("row") + F.col("rowspan") - 1)).alias("r"), "col", "colspan"
    ).select(table, "r", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("colspan") - 1)).alias("c"))
    counted = slots.groupBy(table, "r", "c").agg(F.count(F.lit(1)).alias("n"))
    widths = counted.groupBy(table, "r").agg(F.max("c").alias("last"), F.count_if(F.col("n") > 1).alias("twice"))
    return widths.groupBy(table).agg(
        (F.max("r") + 1).alias("n_rows"), (F.max("last") + 1).alias("n_cols"), F.sum("twice").alias("conflicts"), (F.count_distinct("last") > 1).alias("ragged")
    )


def greedy_matches(pairs: DataFrame, page: str, threshold: float) -> DataFrame:
    """One-to-one matches by falling overlap within a page: page, a, b, iou.

    The order decides, so a page is matched in one place; a page holds its tables only. pairs: page, a, b, iou.
    """

    def match(pairs: list[tuple]) -> list[tuple]:
        taken_a, taken_b, held = set(), set(), []
        for a, b, iou in sorted(pairs, key=lambda x: (-x[2], x[0], x[1])):
            if a not in taken_a and b not in taken_b:
                taken_a.add(a)
                taken_b.add(b)
                held.append((a, b, iou))
        return held

    return page_by_page(pairs.where(F.col("iou") >= threshold).select(page, "a", "b", "iou"), page, match, "a long, b long, iou double")


def reading_lines(words: DataFrame, page: str, ratio: float = 0.5) -> DataFrame:
    """page, line, text: words by the height of their centre; a line ends when a centre is more than ratio heights below its first word."""

    def lines(words: list[tuple]) -> list[tuple]:
        rows, anchor = [], None
        for cy, cx, word, height in sorted(words):
            if anchor is None or cy - anchor > ratio * height:
                rows.append([])
                anchor = cy
            rows[-1].append((cx, word))
        return [(k, " ".join(str(word) for _, word in sorted(r))) for k, r in enumerate(rows)]

    return page_by_page(words.select(page, "cy", "cx", "word", "height"), page, lines, "line long, text string")


def anchors(items: DataFrame, cuts: DataFrame, page: str) -> DataFrame:
    """page, cut, item: the last item at or above a cut, else the page's first: an as-of lookup by one aggregate."""
    rows = cuts.join(items, page)
    above = F.when(F.col("top") <= F.col("cut"), F.struct("top", "item"))
    return rows.groupBy(page, "cut").agg(F.coalesce(F.max(above)["item"], F.min(F.struct("top", "item"))["item"]).alias("item"))
