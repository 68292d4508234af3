"""Tables on pages: grids from boxes, verdicts, comparison with a reference table, words and lines of tiles.

What the order of rows decides within a page (merging characters, tiles, regions) runs by page: a page holds its own boxes only.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import geometry as geo
from tessera.operators.layout import gap_clusters, on_grid, page_by_page


def nearest(lines: Column, value: Column) -> Column:
    """Place of the line nearest to value, the first of equally near ones; distances that agree in nine digits are equal."""
    return F.array_min(F.transform(lines, lambda m, k: F.struct(F.round(F.abs(m - value), 9).alias("d"), k.alias("k"))))["k"]


def snapped(boxes: DataFrame, page: str, box: str, tolerance: float) -> DataFrame:
    """boxes with row, col, rowspan, colspan between the lines that their edges form; spans of 0 or less are degenerate."""
    lines = boxes.select(page).distinct()
    for name, low, high in (("_x", "l", "r"), ("_y", "t", "b")):
        edges = boxes.select(page, F.explode(F.array(F.col(f"{box}.{low}"), F.col(f"{box}.{high}"))).alias("v"))
        means = gap_clusters(edges, page, "v", tolerance).groupBy(page).agg(F.array_sort(F.collect_list("mean")).alias(name))
        lines = lines.join(means, page)
    rows = boxes.join(lines, page)
    at = {n: nearest(F.col(c), F.col(f"{box}.{e}")) for n, c, e in (("col", "_x", "l"), ("_c2", "_x", "r"), ("row", "_y", "t"), ("_r2", "_y", "b"))}
    rows = rows.withColumns({**at, "n_cols": F.size("_x") - 1, "n_rows": F.size("_y") - 1})
    return rows.withColumns({"rowspan": F.col("_r2") - F.col("row"), "colspan": F.col("_c2") - F.col("col")}).drop("_x", "_y", "_c2", "_r2")


def grid_proof(cells: DataFrame, page: str) -> DataFrame:
    """page, cells, degenerate, conflicts (slots taken more than once), ragged (rows of different width), proven."""
    good = F.col("rowspan").between(1, 10_000) & F.col("colspan").between(1, 10_000)
    counted = cells.groupBy(page).agg(F.count(F.lit(1)).alias("cells"), F.count_if(~good).alias("degenerate"))
    rows = cells.where(good).select(page, F.explode(F.sequence(F.col("row"), F.col("row") + F.col("rowspan") - 1)).alias("r"), "col", "colspan")
    slots = rows.select(page, "r", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("colspan") - 1)).alias("c"))
    taken = slots.groupBy(page, "r", "c").agg(F.count(F.lit(1)).alias("n")).groupBy(page, "r").agg(F.sum(F.col("n") - 1).alias("again"), F.max("c").alias("last"))
    widths = taken.groupBy(page).agg(F.sum("again").alias("conflicts"), (F.count_distinct("last") > 1).alias("ragged"))
    out = counted.join(widths, page, "left").withColumns({"conflicts": F.coalesce("conflicts", F.lit(0)), "ragged": F.coalesce("ragged", F.lit(False))})
    return out.withColumn("proven", (F.col("conflicts") == 0) & (F.col("degenerate") == 0))


def table_verdicts(proofs: DataFrame, loose: DataFrame, page: str, most_chars: int) -> DataFrame:
    """page, verdict, reasons: any reason fails the table, and an unproven grid is the only reason given.

    loose: page, lost (critical tokens outside all cells), chars (of all words), td_count.
    """
    rows = proofs.join(loose, page, "left")
    later = F.filter(
        F.array(
            F.when(F.col("ragged"), "impossible_row_col_grid"),
            F.when(F.coalesce("lost", F.lit(0)) > 0, "critical_native_token_unexplained_loss"),
            F.when((F.coalesce("td_count", F.lit(0)) <= 1) & (F.coalesce("chars", F.lit(0)) > most_chars), "empty_structure_with_substantial_text"),
        ),
        lambda x: x.isNotNull(),
    )
    reasons = F.when(~F.col("proven"), F.array(F.lit("grid_unproven"))).otherwise(later)
    return rows.select(page, F.when(F.size(reasons) > 0, "TABLE_QUALITY_FAILED").otherwise("TABLE_VALID").alias("verdict"), reasons.alias("reasons"))


def compared_tables(gold: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """key, cell_recall, merged_accuracy: cells of gold (key, text, rowspan, colspan) that found has too, as multisets.

    Cells with spans count as merged and must agree in them. Tables without such cells have a null accuracy.
    """
    same = ["text", "rowspan", "colspan"]
    count = lambda rows, by, name: rows.where(F.trim("text") != "").groupBy(key, *by).agg(F.count(F.lit(1)).alias(name))
    texts = count(gold, same[:1], "g").join(count(found, same[:1], "f"), [key, "text"], "left")
    recall = texts.groupBy(key).agg(F.round(F.sum(F.least("g", F.coalesce("f", F.lit(0)))) / F.sum("g"), 6).alias("cell_recall"))
    merged = (F.col("rowspan") > 1) | (F.col("colspan") > 1)
    spans = count(gold.where(merged), same, "g").join(count(found, same, "f"), [key, *same], "left")
    accuracy = spans.groupBy(key).agg(F.round(F.sum(F.least("g", F.coalesce("f", F.lit(0)))) / F.sum("g"), 6).alias("merged_accuracy"))
    return recall.join(accuracy, key, "left")


def mismatches(expected: DataFrame, found: DataFrame, page: str) -> DataFrame:
    """page, reason, n: expected boxes (id, x, rowspan, colspan, row) without a found one of IoU 0.5, found ones (id, z) without an expected one, found ones twice."""
    pairs = on_grid(expected, "x").join(on_grid(found, "z").withColumnRenamed("id", "other"), [page, "gx", "gy"]).where(geo.iou(F.col("x"), F.col("z")) >= 0.5)
    missed = expected.join(pairs.select(page, "id").distinct(), [page, "id"], "left_anti")
    why = F.when((F.col("rowspan") > 1) | (F.col("colspan") > 1), "span_cell_split_or_missed").when(F.col("row") == 0, "header_cell_missed").otherwise("body_cell_missed")
    extra = found.join(pairs.select(page, F.col("other").alias("id")).distinct(), [page, "id"], "left_anti")
    a, b = on_grid(found, "z"), on_grid(found, "z").select(page, "gx", "gy", F.col("id").alias("other"), F.col("z").alias("y"))
    twice = a.join(b, [page, "gx", "gy"]).where((F.col("id") < F.col("other")) & (geo.iou(F.col("z"), F.col("y")) > 0.7)).select(page, "id", "other").distinct()
    rows = missed.select(page, why.alias("reason")).union(extra.select(page, F.lit("detection_without_td"))).union(twice.select(page, F.lit("duplicated_detection")))
    return rows.groupBy(page, "reason").agg(F.count(F.lit(1)).alias("n"))


def best_overlaps(regions: DataFrame, tables: DataFrame, page: str, least: float = 0.5) -> DataFrame:
    """regions (id, x) with the table (variant, table, z) of each variant that overlaps most, if by least."""
    pairs = on_grid(regions, "x").join(on_grid(tables, "z"), [page, "gx", "gy"]).withColumn("iou", F.round(geo.iou(F.col("x"), F.col("z")), 9)).where(F.col("iou") >= least)
    best = pairs.groupBy(page, "id", "variant").agg(F.min(F.struct((-F.col("iou")).alias("i"), "table")).alias("b"))
    return best.select(page, "id", "variant", "b.table", (-F.col("b.i")).alias("iou"))


def resolved_overlaps(boxes: DataFrame, page: str) -> DataFrame:
    """page, l, t, r, b, n: boxes (l, t, r, b) of which one's centre lies in another become one, directly or along a chain."""

    def resolve(rows: list[tuple]) -> list[tuple]:
        x = np.array(rows)
        cx, cy = (x[:, 0] + x[:, 2]) / 2, (x[:, 1] + x[:, 3]) / 2
        inside = (cx[:, None] >= x[None, :, 0]) & (cx[:, None] <= x[None, :, 2]) & (cy[:, None] >= x[None, :, 1]) & (cy[:, None] <= x[None, :, 3])
        near, name = inside | inside.T, np.arange(len(x))
        while True:
            low = np.where(near, name[None], len(x)).min(1)
            if np.array_equal(low, name):
                break
            name = low
        groups: dict[int, list] = {}
        for k, (left, top, right, bottom) in zip(name.tolist(), rows, strict=True):
            g = groups.get(k)
            groups[k] = [left, top, right, bottom, 1] if g is None else [min(g[0], left), min(g[1], top), max(g[2], right), max(g[3], bottom), g[4] + 1]
        return [tuple(g) for g in groups.values()]

    return page_by_page(boxes.select(page, "l", "t", "r", "b"), page, resolve, "l double, t double, r double, b double, n long")


def merged_tile_lines(lines: DataFrame, page: str) -> DataFrame:
    """Lines (page, tile, line, l, t, r, b, text, own_from, own_to, last) that their tile owns, without those that an earlier one repeats.

    A line repeats another if their texts agree without white space and they overlap by half of the smaller.
    """

    def merge(rows: list[tuple]) -> list[tuple]:
        kept: dict[str, list[tuple]] = {}
        found = []
        for tile, line, left, top, right, bottom, text, low, high, last in sorted(rows, key=lambda x: x[:2]):
            centre = (top + bottom) / 2
            if not (low <= centre < high or last and centre == high):
                continue
            same, box = kept.setdefault("".join(text.split()), []), (left, top, right, bottom)
            if not any(overlap(box, o) >= 0.5 for o in same):
                same.append(box)
                found.append((tile, line))
        return found

    def overlap(x: tuple, y: tuple) -> float:
        both = max(0.0, min(x[2], y[2]) - max(x[0], y[0])) * max(0.0, min(x[3], y[3]) - max(x[1], y[1]))
        least = min((x[2] - x[0]) * (x[3] - x[1]), (y[2] - y[0]) * (y[3] - y[1]))
        return both / least if least else 0.0

    names = ("tile", "line", "l", "t", "r", "b", "text", "own_from", "own_to", "last")
    return page_by_page(lines.select(page, *names), page, merge, "tile long, line long")


def consensus_regions(tables: DataFrame, page: str) -> DataFrame:
    """page, l, t, r, b, families: regions where engines (variant, family, table, l, t, r, b) of two families or more agree.

    Tables join the first region of the page that they overlap by IoU 0.5, in order of variant and table; a region keeps its first box.
    """

    def iou(x: Sequence[float], y: Sequence[float]) -> float:
        both = max(0.0, min(x[2], y[2]) - max(x[0], y[0])) * max(0.0, min(x[3], y[3]) - max(x[1], y[1]))
        total = (x[2] - x[0]) * (x[3] - x[1]) + (y[2] - y[0]) * (y[3] - y[1]) - both
        return both / total if total else 0.0

    def agree(rows: list[tuple]) -> list[tuple]:
        regions: list[tuple[tuple, set]] = []
        for _, _, family, *box in sorted(rows, key=lambda x: x[:2]):
            held = next((families for other, families in regions if iou(other, box) >= 0.5), None)
            if held is None:
                regions.append((tuple(box), {family}))
            else:
                held.add(family)
        return [(*box, len(f)) for box, f in regions if len(f) >= 2]

    return page_by_page(tables.select(page, "variant", "table", "family", "l", "t", "r", "b"), page, agree, "l double, t double, r double, b double, families long")


def words_outside(words: DataFrame, cells: DataFrame, page: str) -> DataFrame:
    """Words (page, word, text) in order whose characters the texts of the page's cells (page, text) have no longer left."""

    def left(rows: list[tuple]) -> list[tuple]:
        pool = Counter("".join("".join(t.split()) for of_cell, _, t in rows if of_cell))
        out = []
        for word, text in sorted((word, t) for of_cell, word, t in rows if not of_cell):
            need = Counter("".join(text.split()))
            if all(pool[ch] >= n for ch, n in need.items()):
                pool.subtract(need)
            else:
                out.append((word,))
        return out

    both = cells.select(page, F.lit(True).alias("of_cell"), F.lit(0).cast("long").alias("word"), "text").union(words.select(page, F.lit(False), F.col("word").cast("long"), "text"))
    return page_by_page(both, page, left, "word long")


def merged_characters(chars: DataFrame, page: str) -> DataFrame:
    """page, word, text, l, t, r, b: characters (page, at, ch, l, t, r, b) in order, joined while the next one stands on the line and close.

    Close is from 0.6 heights before the word's right edge to 0.5 after it; a blank ends a word. The word's box grows with it.
    """

    def merge(rows: list[tuple]) -> list[tuple]:
        words: list[list] = []
        open_word = False
        for _, ch, left, top, right, bottom in sorted(rows):
            if not ch.strip():
                open_word = False
                continue
            if open_word:
                last = words[-1]
                size = max(last[4] - last[2], 1)
                on_line = top < last[4] + 0.3 * size and bottom > last[2] - 0.3 * size
                if on_line and -0.6 * size <= left - last[3] <= 0.5 * size:
                    words[-1] = [last[0] + ch, min(last[1], left), min(last[2], top), max(last[3], right), max(last[4], bottom)]
                    continue
            words.append([ch, left, top, right, bottom])
            open_word = True
        return [(k, *w) for k, w in enumerate(words)]

    return page_by_page(chars.select(page, "at", "ch", "l", "t", "r", "b"), page, merge, "word long, text string, l double, t double, r double, b double")


# How a list of cells is announced, and what a column is called.
CELLS_SAID, COLUMN = "표 cell 목록 (행·병합 구조는 추정하지 않음):", "열 "
# Fixed value: a "name, column = value" triplet, up to the next one or the end.
TRIPLET = r"([^\n.]+?),\s*(\d+)\s*=\s*(.*?)(?=\.\s*[^\n.]+?,\s*\d+\s*=|$)"


def readable_table(text: Column) -> Column:
    """A text that is wholly triplets, told as a list of cells under a line that says so; other texts as they are."""
    parts = [F.regexp_extract_all(text, F.lit(f"(?s){TRIPLET}"), F.lit(k)) for k in (1, 2, 3)]
    # White space alone may stand before the first triplet.
    starts = text.rlike(rf"(?s)^\s*{TRIPLET}")
    # Zipped, as what a function of cells names from outside is made anew for each cell.
    cells = F.arrays_zip(*[x.alias(n) for x, n in zip(parts, ("name", "column", "value"), strict=True)])
    lines = F.transform(cells, lambda x: F.concat(F.lit("- "), F.trim(x["name"]), F.lit(" / "), F.lit(COLUMN), x["column"], F.lit(": "), F.trim(x["value"])))
    return F.when((F.size(parts[0]) >= 2) & starts, F.concat(F.lit(f"{CELLS_SAID}\n"), F.array_join(lines, "\n"))).otherwise(text)
