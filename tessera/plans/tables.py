"""Queries over tables on pages: grids, verdicts, comparison, regions, words; boxes are those of the layout queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import geometry as geo
from tessera.functions import markup
from tessera.functions import text as t
from tessera.operators import layout as y
from tessera.operators import parsing as p
from tessera.operators import tables as o
from tessera.plans.base import registrar
from tessera.plans.layout import BOXES_SQL, RECURSIVE_SQL, boxes, greedy_sql, iou_sql
from tessera.sources.tables import RELATIONS_SQL, relations, table

QUERIES, ORACLES = {}, {}
query = registrar(QUERIES, ORACLES)
TOLERANCE = 6.0

GRID_SQL = BOXES_SQL + f""", ed AS (SELECT page, 'x' AS axis, l AS v FROM c UNION ALL SELECT page, 'x', r FROM c UNION ALL SELECT page, 'y', t FROM c UNION ALL SELECT page, 'y', bt FROM c),
em AS (SELECT *, coalesce((v - lag(v) OVER (PARTITION BY page, axis ORDER BY v) > {TOLERANCE})::INT, 0) AS new FROM ed),
ek AS (SELECT *, sum(new) OVER (PARTITION BY page, axis ORDER BY v ROWS UNBOUNDED PRECEDING)::BIGINT AS k FROM em),
ln AS (SELECT page, axis, k, round(avg(v), 6) AS m FROM ek GROUP BY ALL),
sn AS (SELECT page, cell, (SELECT arg_min(k, (round(abs(m - c.l), 9), k)) FROM ln WHERE ln.page = c.page AND axis = 'x') AS c1, (SELECT arg_min(k, (round(abs(m - c.r), 9), k)) FROM ln WHERE ln.page = c.page AND axis = 'x') AS c2,
  (SELECT arg_min(k, (round(abs(m - c.t), 9), k)) FROM ln WHERE ln.page = c.page AND axis = 'y') AS r1, (SELECT arg_min(k, (round(abs(m - c.bt), 9), k)) FROM ln WHERE ln.page = c.page AND axis = 'y') AS r2 FROM c),
sl AS (SELECT page, r, cc, count(*) AS n FROM (SELECT page, unnest(range(r1, r2)) AS r, c1, c2 FROM sn WHERE c2 > c1 AND r2 > r1) q, LATERAL (SELECT unnest(range(q.c1, q.c2)) AS cc) GROUP BY ALL),
wd AS (SELECT page, sum(a)::BIGINT AS conflicts, count(DISTINCT last) > 1 AS ragged FROM (SELECT page, r, sum(n - 1) AS a, max(cc) AS last FROM sl GROUP BY ALL) GROUP BY page),
gp AS (SELECT page, count(*) AS cells, count_if(NOT (c2 > c1 AND r2 > r1))::BIGINT AS degenerate, coalesce(any_value(conflicts), 0)::BIGINT AS conflicts, coalesce(any_value(ragged), false) AS ragged FROM sn LEFT JOIN wd USING (page) GROUP BY page)
"""


def proofs(spark, sf_dir) -> DataFrame:
    return o.grid_proof(o.snapped(boxes(spark, sf_dir)[1], "page", "cell_box", TOLERANCE), "page")


@query(GRID_SQL + "SELECT *, conflicts = 0 AND degenerate = 0 AS proven FROM gp")
def grid_proofs(spark, sf_dir):
    return proofs(spark, sf_dir)


@query(GRID_SQL + """, tx AS (SELECT page, word, CASE WHEN word % 9 = 0 THEN (word % 7 + 1) || ',000원' ELSE 'w' || word END AS text FROM w),
lo AS (SELECT w.page, w.word FROM w WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.page = w.page AND (w.l + w.r) / 2 BETWEEN c.l AND c.r AND (w.t + w.bt) / 2 BETWEEN c.t AND c.bt)),
ls AS (SELECT tx.page, count_if(lo.word IS NOT NULL AND tx.word % 9 = 0) AS lost, sum(length(text)) AS chars FROM tx LEFT JOIN lo ON lo.page = tx.page AND lo.word = tx.word GROUP BY tx.page),
rs AS (SELECT gp.page, CASE WHEN conflicts > 0 OR degenerate > 0 THEN 'grid_unproven' ELSE concat_ws(',', CASE WHEN ragged THEN 'impossible_row_col_grid' END, CASE WHEN lost > 0 THEN 'critical_native_token_unexplained_loss' END,
  CASE WHEN cells <= 1 AND chars > 40 THEN 'empty_structure_with_substantial_text' END) END AS reasons FROM gp LEFT JOIN ls USING (page))
SELECT page, CASE WHEN reasons = '' THEN 'TABLE_VALID' ELSE 'TABLE_QUALITY_FAILED' END AS verdict, reasons FROM rs""")
def table_verdicts(spark, sf_dir):
    """Amounts stand among the words; those outside every cell are losses that fail the page's table."""
    words, cells = boxes(spark, sf_dir)
    w = F.col("word")
    told = words.select("page", "word", F.when(w % 9 == 0, F.concat((w % 7 + 1).cast("string"), F.lit(",000원"))).otherwise(F.concat(F.lit("w"), w.cast("string"))).alias("text"))
    placed = y.words_in_cells(words, cells).join(told, ["page", "word"])
    # Words that are more than a name may hold critical tokens; the rest is not sent to Python.
    lost = F.sum(F.when(F.col("cell").isNull() & F.col("text").startswith("w"), 0).when(F.col("cell").isNull(), F.size(t.critical_tokens(F.col("text")))).otherwise(0))
    loose = placed.groupBy("page").agg(lost.alias("lost"), F.sum(F.length("text")).alias("chars"))
    proof = proofs(spark, sf_dir)
    rows = loose.join(proof.select("page", F.col("cells").alias("td_count")), "page")
    out = o.table_verdicts(proof, rows, "page", 40)
    return out.select("page", "verdict", F.array_join("reasons", ",").alias("reasons"))


COMPARE_SQL = """WITH a AS (SELECT l_partkey // 2 AS pair, l_partkey % 2 AS side, CASE WHEN l_orderkey % 5 = 0 THEN ' ' ELSE 'v' || (l_orderkey % 40) END AS text, (1 + (l_orderkey % 11 = 0)::INT)::BIGINT AS rs, (1 + (l_orderkey % 7 = 0)::INT)::BIGINT AS cs FROM lineitem),
k AS (SELECT pair, text, count_if(side = 0) AS g, count_if(side = 1) AS f FROM a WHERE trim(text) <> '' GROUP BY ALL),
r AS (SELECT pair, round(sum(least(g, f)) / sum(g)::DOUBLE, 6) AS cell_recall FROM k WHERE g > 0 GROUP BY pair),
s AS (SELECT pair, text, rs, cs, count_if(side = 0) AS g, count_if(side = 1) AS f FROM a WHERE trim(text) <> '' AND (rs > 1 OR cs > 1) GROUP BY ALL),
m AS (SELECT pair, round(sum(least(g, f)) / sum(g)::DOUBLE, 6) AS merged_accuracy FROM s WHERE g > 0 GROUP BY pair)
SELECT pair, cell_recall, merged_accuracy FROM r LEFT JOIN m USING (pair)"""


@query(COMPARE_SQL)
def table_comparison(spark, sf_dir):
    k = F.col("l_orderkey")
    text = F.when(k % 5 == 0, " ").otherwise(F.concat(F.lit("v"), (k % 40).cast("string")))
    cells = table(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_partkey") / 2).alias("pair"), (F.col("l_partkey") % 2).alias("side"), text.alias("text"),
        F.when(k % 11 == 0, 2).otherwise(1).alias("rowspan"), F.when(k % 7 == 0, 2).otherwise(1).alias("colspan"),
    )
    return o.compared_tables(cells.where("side = 0"), cells.where("side = 1"), "pair")


FOUND_SQL = """, ex AS (SELECT page, cell AS id, l, t, r, bt, cell % 5 AS row, 1 + (cell % 11 = 0)::INT AS rs, 1 + (cell % 7 = 0)::INT AS cs FROM c),
fo AS (SELECT page, cell * 2 AS id, l + cell % 6 * 8 AS l, t + cell % 4 * 3 AS t, r + cell % 6 * 8 AS r, bt + cell % 4 * 3 AS bt FROM c WHERE cell % 10 <> 0 UNION ALL SELECT page, cell * 2 + 1, l + 2, t + 1, r + 2, bt + 1 FROM c WHERE cell % 14 = 0)
"""


def found_boxes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Expected cells, and what an engine found of them: shifted, some missing, some twice."""
    cell, x = F.col("cell"), F.col("cell_box")
    cells = boxes(spark, sf_dir)[1]
    expected = cells.select("page", cell.alias("id"), x.alias("x"), (cell % 5).alias("row"), F.when(cell % 11 == 0, 2).otherwise(1).alias("rowspan"), F.when(cell % 7 == 0, 2).otherwise(1).alias("colspan"))
    moved = lambda dx, dy: geo.box(x["l"] + dx, x["t"] + dy, x["r"] + dx, x["b"] + dy)
    first = cells.where("cell % 10 <> 0").select("page", (cell * 2).alias("id"), moved(cell % 6 * 8, cell % 4 * 3).alias("z"))
    again = cells.where("cell % 14 = 0").select("page", (cell * 2 + 1).alias("id"), moved(F.lit(2), F.lit(1)).alias("z"))
    return expected, first.union(again)


@query(BOXES_SQL + FOUND_SQL + f""", p AS (SELECT ex.page, ex.id, fo.id AS other FROM ex JOIN fo ON ex.page = fo.page AND {iou_sql('ex', 'fo')} >= 0.5::DOUBLE),
u AS (SELECT page, CASE WHEN rs > 1 OR cs > 1 THEN 'span_cell_split_or_missed' WHEN row = 0 THEN 'header_cell_missed' ELSE 'body_cell_missed' END AS reason FROM ex WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.page = ex.page AND p.id = ex.id)
  UNION ALL SELECT page, 'detection_without_td' FROM fo WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.page = fo.page AND p.other = fo.id)
  UNION ALL SELECT a.page, 'duplicated_detection' FROM fo a JOIN fo b ON a.page = b.page AND a.id < b.id AND {iou_sql('a', 'b')} > 0.7::DOUBLE)
SELECT page, reason, count(*) AS n FROM u GROUP BY ALL""")
def mismatch_causes(spark, sf_dir):
    return o.mismatches(*found_boxes(spark, sf_dir), "page")


@query(BOXES_SQL + FOUND_SQL + f""", p AS (SELECT ex.page, ex.id, 'engine' || fo.id % 2 AS variant, fo.id AS "table", round({iou_sql('ex', 'fo')}, 9) AS iou FROM ex JOIN fo ON ex.page = fo.page AND {iou_sql('ex', 'fo')} >= 0.5::DOUBLE),
bb AS (SELECT * FROM p WHERE iou >= 0.5 QUALIFY row_number() OVER (PARTITION BY page, id, variant ORDER BY iou DESC, "table") = 1),
e AS (SELECT page, word, w.l, w.t, w.r, w.bt, word % 12 AS token FROM w),
n AS (SELECT ex.page, ex.id, token, count(*) AS n FROM ex JOIN e ON ex.page = e.page AND (e.l + e.r) / 2 BETWEEN ex.l AND ex.r AND (e.t + e.bt) / 2 BETWEEN ex.t AND ex.bt GROUP BY ALL),
k AS (SELECT fo.page, fo.id, token, count(*) AS n FROM fo JOIN e ON fo.page = e.page AND (e.l + e.r) / 2 BETWEEN fo.l AND fo.r AND (e.t + e.bt) / 2 BETWEEN fo.t AND fo.bt GROUP BY ALL)
SELECT bb.page, bb.id, bb.variant, bb."table", bb.iou, coalesce(sum(n.n), 0)::BIGINT AS expected, coalesce(sum(least(n.n, coalesce(k.n, 0))), 0)::BIGINT AS hits
FROM bb LEFT JOIN n ON n.page = bb.page AND n.id = bb.id LEFT JOIN k ON k.page = bb.page AND k.id = bb."table" AND k.token = n.token GROUP BY ALL""")
def region_rows(spark, sf_dir):
    """The best table of each engine for each region, and how many of the region's tokens are in it."""
    expected, found = found_boxes(spark, sf_dir)
    tables = found.select("page", F.col("id").alias("table"), F.concat(F.lit("engine"), (F.col("id") % 2).cast("string")).alias("variant"), "z")
    best = o.best_overlaps(expected.select("page", "id", "x"), tables, "page")
    words = boxes(spark, sf_dir)[0]
    x, top = (F.col("word_box.l") + F.col("word_box.r")) / 2, (F.col("word_box.t") + F.col("word_box.b")) / 2
    at = words.withColumn("gx", F.floor(x / y.BUCKET)).withColumn("gy", F.floor(top / y.BUCKET)).withColumn("token", F.col("word") % 12)

    def tokens(rows: DataFrame, box: str, name: str) -> DataFrame:
        held = y.on_grid(rows, box).join(at, ["page", "gx", "gy"]).where(geo.center_in(F.col(box), F.col("word_box")))
        return held.groupBy("page", "id", "token").agg(F.count(F.lit(1)).alias(name))

    own, theirs = tokens(expected.select("page", "id", "x"), "x", "n"), tokens(found, "z", "k").withColumnRenamed("id", "table")
    rows = best.join(own, ["page", "id"], "left").join(theirs, ["page", "table", "token"], "left")
    return rows.groupBy("page", "id", "variant", "table", "iou").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("expected"), F.coalesce(F.sum(F.least("n", F.coalesce("k", F.lit(0)))), F.lit(0)).alias("hits"))


@query(RECURSIVE_SQL + FOUND_SQL + f", pr AS (SELECT ex.page, ex.id AS a, fo.id AS b, round({iou_sql('ex', 'fo')}, 9) AS iou FROM ex JOIN fo ON ex.page = fo.page)" + greedy_sql("pr", 0.3) + """,
g AS (SELECT page % 4 AS variant, count(*) AS gold FROM ex GROUP BY 1), f AS (SELECT page % 4 AS variant, count(*) AS found FROM fo GROUP BY 1), k AS (SELECT page % 4 AS variant, count(*) AS matched FROM m GROUP BY 1)
SELECT variant, gold, found, matched, found - matched AS false_positives, round(matched / found::DOUBLE, 4) AS precision FROM g JOIN f USING (variant) JOIN k USING (variant)""")
def gold_matches(spark, sf_dir):
    """Greedy matches of expected and found tables, false positives and precision by variant."""
    expected, found = found_boxes(spark, sf_dir)
    pairs = y.on_grid(expected, "x").join(y.on_grid(found.withColumnRenamed("id", "b"), "z"), ["page", "gx", "gy"]).select("page", F.col("id").alias("a"), "b", F.round(geo.iou(F.col("x"), F.col("z")), 9).alias("iou")).distinct()
    matched = y.greedy_matches(pairs, "page", 0.3).groupBy("page").agg(F.count(F.lit(1)).alias("matched"))
    totals = expected.groupBy("page").agg(F.count(F.lit(1)).alias("gold")).join(found.groupBy("page").agg(F.count(F.lit(1)).alias("found")), "page", "full_outer")
    rows = totals.join(matched, "page", "left").na.fill(0)
    variant = rows.withColumn("variant", F.col("page") % 4).groupBy("variant").agg(F.sum("gold").alias("gold"), F.sum("found").alias("found"), F.sum("matched").alias("matched"))
    return variant.withColumn("false_positives", F.col("found") - F.col("matched")).withColumn("precision", F.round(F.try_divide("matched", "found"), 4))


HTML_SQL = """WITH RECURSIVE c AS (SELECT l_partkey AS tab, (l_orderkey % 4)::INT AS r, l_orderkey AS k, l_linenumber AS n FROM lineitem),
o AS (SELECT *, dense_rank() OVER (PARTITION BY tab ORDER BY r) - 1 AS row, row_number() OVER (PARTITION BY tab ORDER BY r, k, n) AS i, CASE WHEN k % 7 <> 0 AND k % 11 = 0 THEN 3 ELSE 1 END AS rowspan, CASE WHEN k % 7 = 0 THEN 2 ELSE 1 END AS colspan FROM c),
g AS (SELECT tab, 0::BIGINT AS i, -1::BIGINT AS col, []::BIGINT[] AS taken FROM o GROUP BY tab
  UNION ALL SELECT tab, i, col, list_concat(taken, list_transform(range(rowspan * colspan), lambda x: (row + x // colspan) * 1000 + col + x % colspan))
  FROM (SELECT o.*, g.taken, list_filter(range(200), lambda x: NOT list_contains(g.taken, o.row * 1000 + x))[1] AS col FROM g JOIN o ON o.tab = g.tab AND o.i = g.i + 1)),
p AS (SELECT o.*, g.col FROM o JOIN g USING (tab, i))
"""


def html_tables(spark, sf_dir) -> DataFrame:
    """A table of HTML for each part: a row for each remainder of its orders, with spans in both quotes or none, and marks and references in the cells."""
    k = F.col("l_orderkey")
    span = F.when(k % 14 == 0, ' colspan="2"').when(k % 7 == 0, " id=a>b colspan='2'").when(k % 22 == 0, " ROWSPAN = 3").when(k % 11 == 0, " rowspan='3'").otherwise("")
    cell = F.concat(F.lit("<td"), F.replace(span, F.lit("a>b"), F.lit("'a>b'")), F.lit("> <b>"), k.cast("string"), F.when(k % 3 == 0, "&#38;").otherwise(""), F.when(k % 5 == 0, "</b>").otherwise("</b> </td>"))
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("tab"), (k % 4).alias("r"), k.alias("k"), F.col("l_linenumber").alias("n"), cell.alias("cell"))
    rows = cells.groupBy("tab", "r").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "n", "cell"))), lambda x: x["cell"]), "").alias("cells"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "cells"))), lambda x: F.concat(F.lit("<tr>"), x["cells"], F.lit("</tr>"))), "\n")
    return rows.groupBy("tab").agg(F.concat(F.lit("<table><tbody>"), body, F.lit("</tbody></table>")).alias("html"))


@query(HTML_SQL + """SELECT tab, row::BIGINT AS row, col, rowspan::BIGINT AS rowspan, colspan::BIGINT AS colspan, k::VARCHAR || CASE WHEN k % 3 = 0 THEN '&' ELSE '' END AS text FROM p""")
def html_cells(spark, sf_dir):
    """Cells with the columns of the grid that they take, which spans from above move."""
    return html_tables(spark, sf_dir).select("tab", F.explode(markup.cells_of("html")).alias("x")).select("tab", "x.*")


@query(HTML_SQL + """, s AS (SELECT tab, k::VARCHAR || CASE WHEN k % 3 = 0 THEN '&' ELSE '' END AS text, i, row + a AS gr, col + b AS gc FROM p, (VALUES (0), (1), (2)) AS x(a), (VALUES (0), (1)) AS y(b) WHERE a < rowspan AND b < colspan QUALIFY row_number() OVER (PARTITION BY tab, row + a, col + b ORDER BY i DESC) = 1),
w AS (SELECT tab, text, i, 'right' AS d, gr AS line, gc AS pos FROM s UNION ALL SELECT tab, text, i, 'down', gc, gr FROM s),
e AS (SELECT *, pos - row_number() OVER (PARTITION BY tab, d, line ORDER BY pos) AS isle FROM w),
n AS (SELECT *, coalesce(i <> lag(i) OVER (PARTITION BY tab, d, line, isle ORDER BY pos), false)::INT AS new FROM e),
u AS (SELECT *, sum(new) OVER (PARTITION BY tab, d, line, isle ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM n),
t AS (SELECT tab, d, line, isle, run, any_value(text) AS text FROM u GROUP BY ALL)
SELECT u.tab, u.d AS direction, u.text, t.text AS next_text, count(*) AS n FROM u JOIN t ON t.tab = u.tab AND t.d = u.d AND t.line = u.line AND t.isle = u.isle AND t.run = u.run + 1 GROUP BY ALL""")
def html_neighbours(spark, sf_dir):
    """Neighbours in the grid of cells with spans, place by place."""
    cells = html_tables(spark, sf_dir).select("tab", F.posexplode(markup.cells_of("html")).alias("at", "x")).select("tab", "at", "x.*")
    return p.neighbours(cells, "tab").groupBy("tab", "direction", "text", "next_text").agg(F.count(F.lit(1)).alias("n"))


@query(HTML_SQL + ", q AS (SELECT tab, row, count(*) AS n FROM o GROUP BY ALL) SELECT tab, string_agg(n::VARCHAR, ',' ORDER BY row) AS counts FROM q GROUP BY tab")
def html_row_counts(spark, sf_dir):
    parts = F.split("html", "<tr>")
    rows = html_tables(spark, sf_dir).select("tab", F.slice(parts, F.lit(2), F.size(parts)).alias("rows"))
    return rows.select("tab", F.array_join(F.transform("rows", lambda r: F.regexp_count(r, F.lit("<td")).cast("string")), ",").alias("counts"))


RESOLVE_SQL = BOXES_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """, e AS (SELECT x.page, x.cell AS a, z.cell AS b FROM c x JOIN c z ON x.page = z.page AND ((x.l + x.r) / 2 BETWEEN z.l AND z.r AND (x.t + x.bt) / 2 BETWEEN z.t AND z.bt OR (z.l + z.r) / 2 BETWEEN x.l AND x.r AND (z.t + z.bt) / 2 BETWEEN x.t AND x.bt)),
g AS (SELECT page, cell, cell AS seen FROM c UNION SELECT g.page, g.cell, e.b FROM g JOIN e ON e.page = g.page AND e.a = g.seen),
k AS (SELECT page, cell, min(seen) AS grp FROM g GROUP BY ALL)
SELECT k.page, min(l) AS l, min(t) AS t, max(r) AS r, max(bt) AS b, count(*) AS n FROM k JOIN c ON c.page = k.page AND c.cell = k.cell GROUP BY k.page, grp"""


@query(RESOLVE_SQL)
def resolved_overlaps(spark, sf_dir):
    cells = boxes(spark, sf_dir)[1]
    return o.resolved_overlaps(cells.select("page", "cell_box.*"), "page")


def tile_rows(spark, sf_dir) -> DataFrame:
    """Words as lines of overlapping tiles: a line stands in each tile that its box touches, a little lower in the second."""
    words = boxes(spark, sf_dir)[0].select("page", "word", "word_box.*")
    tiles = spark.range(4).select(F.col("id").alias("tile"), (F.col("id") * 200.0).alias("start"), (F.col("id") * 200.0 + 300.0).alias("finish"))
    bounds = y.band_bounds(tiles.withColumn("one", F.lit(0)), "one", "start", "finish").withColumn("last", F.col("tile") == 3)
    held = words.withColumn("tile", F.explode(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda k: (F.col("b") > k * 200) & (F.col("t") < k * 200 + 300)))).join(F.broadcast(bounds), "tile")
    down = (F.col("tile") % 2) * 1.0
    return held.select("page", "tile", F.col("word").alias("line"), "l", (F.col("t") + down).alias("t"), "r", (F.col("b") + down).alias("b"), F.concat(F.lit("line "), (F.col("word") % 3).cast("string")).alias("text"), "own_from", "own_to", "last")


@query()
def merged_tile_lines(spark, sf_dir):
    """Greedy, so without SQL; the tests compare it with a plain loop."""
    return o.merged_tile_lines(tile_rows(spark, sf_dir), "page")


@query()
def consensus_regions(spark, sf_dir):
    """Greedy, so without SQL; the tests compare it with a plain loop."""
    found = found_boxes(spark, sf_dir)[1]
    variant = F.col("id") % 3
    return o.consensus_regions(found.select("page", variant.alias("variant"), F.floor(variant / 2).alias("family"), F.col("id").alias("table"), "z.*"), "page")


@query()
def words_outside(spark, sf_dir):
    """Characters are used up in order, so without SQL; the tests compare it with a plain loop."""
    words, cells = boxes(spark, sf_dir)
    told = cells.select("page", F.concat((F.col("cell") % 100).cast("string"), F.lit(" "), (F.col("cell") % 7).cast("string")).alias("text"))
    return o.words_outside(words.select("page", "word", (F.col("word") % 1000).cast("string").alias("text")), told, "page")


@query()
def native_words(spark, sf_dir):
    """Boxes grow while characters join them, so without SQL; the tests compare it with a plain loop."""
    chars = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("page"), F.posexplode(F.split("text", "")).alias("at", "ch")).where("ch <> ''")
    left = F.col("at") * 6.0 + F.when(F.col("at") % 11 == 0, 4.0).otherwise(0.0)
    top = F.floor(F.col("at") / 60) * 20.0
    return o.merged_characters(chars.select("page", "at", "ch", left.alias("l"), top.alias("t"), (left + 5).alias("r"), (top + 10).alias("b")), "page")


@query(BOXES_SQL + "SELECT page, word, l * 1.5::DOUBLE AS l, (700 - bt) * 1.5::DOUBLE AS t, r * 1.5::DOUBLE AS r, (700 - t) * 1.5::DOUBLE AS b, (l + r) / 2 * 1.5::DOUBLE AS cx, (700 - (t + bt) / 2) * 1.5::DOUBLE AS cy FROM w WHERE word % 8 <> 0")
def scaled_words(spark, sf_dir):
    """Text rectangles in picture coordinates: blank ones go, the vertical axis turns, all is scaled, with centres."""
    words = boxes(spark, sf_dir)[0].withColumn("text", F.when(F.col("word") % 8 == 0, "  ").otherwise(F.col("word").cast("string"))).where("trim(text) <> ''")
    x = F.col("word_box")
    flat = words.select("page", "word", geo.scaled(geo.flipped(x, 700.0), 1.5).alias("z"))
    return flat.select("page", "word", "z.*", ((F.col("z.l") + F.col("z.r")) / 2).alias("cx"), ((F.col("z.t") + F.col("z.b")) / 2).alias("cy"))


@query(BOXES_SQL + """, i AS (SELECT page, word AS item, CASE word % 5 WHEN 0 THEN 'PICTURE' WHEN 1 THEN 'OWN' ELSE 'TEXT' END AS label FROM w)
SELECT page, item, label FROM i WHERE page % 3 <> 0 OR label IN ('PICTURE', 'OWN')
UNION ALL SELECT page, -word, 'OCR' FROM w WHERE page % 3 = 0 AND NOT EXISTS (SELECT 1 FROM c WHERE c.page = w.page AND (w.l + w.r) / 2 BETWEEN c.l AND c.r AND (w.t + w.bt) / 2 BETWEEN c.t AND c.bt)""")
def page_items(spark, sf_dir):
    """On pages read by OCR native items go, but pictures and own output stay; read lines outside tables come in."""
    words, cells = boxes(spark, sf_dir)
    k = F.col("word") % 5
    items = words.select("page", F.col("word").alias("item"), F.when(k == 0, "PICTURE").when(k == 1, "OWN").otherwise("TEXT").alias("label"))
    ocr = items.select("page").where("page % 3 = 0").distinct()
    gone = items.join(ocr, "page", "left_semi").where("label = 'TEXT'")
    lines = y.words_in_cells(words.join(ocr, "page", "left_semi"), cells).where("cell is null").select("page", (-F.col("word")).alias("item"), F.lit("OCR").alias("label"))
    return items.join(gone.select("page", "item"), ["page", "item"], "left_anti").select("page", "item", "label").union(lines)


TRIPLET_SQL = """WITH r AS (SELECT content, list(program ORDER BY program) AS p, content % 4 AS k FROM relations GROUP BY content)
"""


@query(f"WITH {RELATIONS_SQL}, " + TRIPLET_SQL[5:] + f"""SELECT content, CASE WHEN k < 2 AND len(p) >= 2 THEN '{o.CELLS_SAID}' || chr(10) || array_to_string(['- cell ' || x || ' / {o.COLUMN}1: value ' || x FOR x IN p], chr(10))
  WHEN k < 2 THEN 'cell ' || p[1] || ', 1 = value ' || p[1] WHEN k = 2 THEN 'Note. free text' ELSE '' END AS readable FROM r""")
def readable_tables(spark, sf_dir):
    rows = relations(spark, sf_dir).groupBy("content").agg(F.array_sort(F.collect_list("program")).alias("p"))
    k = F.col("content") % 4
    told = F.array_join(F.transform("p", lambda x: F.concat(F.lit("cell "), x.cast("string"), F.lit(", 1 = value "), x.cast("string"))), ". ")
    text = F.when(k < 2, told).when(k == 2, "Note. free text").otherwise("")
    return rows.select("content", o.readable_table(text).alias("readable"))
