"""Queries over page layout: boxes made from lineitem by arithmetic, a page per part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import geometry as geo
from tessera.operators import layout as y
from tessera.plans.base import registrar
from tessera.sources.tables import table

QUERIES, ORACLES = {}, {}
query = registrar(QUERIES, ORACLES)

BOXES_SQL = """WITH b AS (SELECT DISTINCT l_partkey AS page, l_orderkey AS item, (l_orderkey % 37) * 20.0::DOUBLE AS l, (l_orderkey % 23) * 30.0::DOUBLE AS t FROM lineitem),
w AS (SELECT page, item AS word, l, t, l + 18 AS r, t + 10 AS bt FROM b),
c AS (SELECT page, item AS cell, l - 7 AS l, t - 9 AS t, l + 60 + item % 5 * 10 AS r, t + 45 AS bt FROM b WHERE item % 4 = 0)
"""


def boxes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    item = F.col("item")
    b = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("page"), F.col("l_orderkey").alias("item")).distinct()
    b = b.withColumn("l", (item % 37) * 20.0).withColumn("t", (item % 23) * 30.0)
    left, top = F.col("l"), F.col("t")
    words = b.select("page", item.alias("word"), geo.box(left, top, left + 18, top + 10).alias("word_box"))
    cells = b.where("item % 4 = 0").select("page", item.alias("cell"), geo.box(left - 7, top - 9, left + 60 + item % 5 * 10, top + 45).alias("cell_box"))
    return words, cells


@query(BOXES_SQL + """, h AS (SELECT w.page, word, cell, (c.r - c.l) * (c.bt - c.t) AS area FROM w JOIN c ON w.page = c.page AND (w.l + w.r) / 2 BETWEEN c.l AND c.r AND (w.t + w.bt) / 2 BETWEEN c.t AND c.bt),
s AS (SELECT page, word, cell FROM h QUALIFY row_number() OVER (PARTITION BY page, word ORDER BY area, cell) = 1) SELECT page, word, cell FROM w LEFT JOIN s USING (page, word)""")
def point_in_box(spark, sf_dir):
    return y.words_in_cells(*boxes(spark, sf_dir))


@query(BOXES_SQL + """, p AS (SELECT x.page, x.cell AS a, z.cell AS b, greatest(0, least(x.r, z.r) - greatest(x.l, z.l)) * greatest(0, least(x.bt, z.bt) - greatest(x.t, z.t)) AS i, (x.r - x.l) * (x.bt - x.t) AS aa, (z.r - z.l) * (z.bt - z.t) AS ab,
  z.l >= x.l - 20 AND z.t >= x.t - 20 AND z.r <= x.r + 20 AND z.bt <= x.bt + 20 AS inside FROM c x JOIN c z ON x.page = z.page AND x.cell < z.cell)
SELECT page, count(*) AS pairs, count_if(i > 0)::BIGINT AS overlapping, round(max(i / (aa + ab - i)), 6) AS most_iou, round(max(i / least(aa, ab)), 6) AS most_overlap, count_if(inside)::BIGINT AS contained FROM p GROUP BY page""")
def box_overlaps(spark, sf_dir):
    cells = boxes(spark, sf_dir)[1]
    a, b = cells.select("page", F.col("cell").alias("a"), F.col("cell_box").alias("x")), cells.select("page", F.col("cell").alias("b"), F.col("cell_box").alias("z"))
    pairs = a.join(b, "page").where("a < b")
    x, z = F.col("x"), F.col("z")
    return pairs.groupBy("page").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_if(geo.overlaps(x, z)).alias("overlapping"),
        F.round(F.max(geo.iou(x, z)), 6).alias("most_iou"),
        F.round(F.max(geo.overlap_ratio(x, z)), 6).alias("most_overlap"),
        F.count_if(geo.contained(x, z, 20.0)).alias("contained"),
    )


@query("""WITH v AS (SELECT l_suppkey AS page, l_extendedprice AS v FROM lineitem), m AS (SELECT *, coalesce((v - lag(v) OVER (PARTITION BY page ORDER BY v) > 400)::INT, 0) AS new FROM v),
k AS (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY v ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM m) SELECT page, cluster, round(avg(v), 6) AS mean, count(*) AS n FROM k GROUP BY ALL""")
def gap_clusters(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), F.col("l_extendedprice").alias("v"))
    return y.gap_clusters(rows, "page", "v", 400.0)


TILES_SQL = """WITH h AS (SELECT doc_id AS page, n_chars::BIGINT AS height FROM documents),
s AS (SELECT DISTINCT page, height, greatest(0, least(k * 900, height - 1000)) AS start FROM h, LATERAL (SELECT unnest(range(0, greatest(0, ceil((height - 100) / 900.0)::BIGINT - 1) + 1)) AS k)),
e AS (SELECT page, start, start + 1000 AS finish FROM s)
"""


@query(TILES_SQL + """SELECT page, start, coalesce((start + lag(finish) OVER w) / 2.0::DOUBLE, start::DOUBLE) AS own_from, coalesce((lead(start) OVER w + finish) / 2.0::DOUBLE, finish::DOUBLE) AS own_to FROM e WINDOW w AS (PARTITION BY page ORDER BY start)""")
def tile_bands(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.col("n_chars").alias("height"))
    tiles = rows.select("page", F.explode(geo.tile_starts(F.col("height"), 1000, 100)).alias("start")).withColumn("finish", F.col("start") + 1000)
    return y.band_bounds(tiles, "page", "start", "finish").select("page", "start", "own_from", "own_to")


@query("""WITH c AS (SELECT l_partkey AS tab, l_orderkey % 4 AS r, l_linenumber AS col, 1 + (l_orderkey % 11 = 0)::INT AS rs, 1 + (l_orderkey % 7 = 0)::INT AS cs FROM lineitem),
s AS (SELECT tab, r + i AS r, col + j AS c FROM c, LATERAL (SELECT unnest(range(rs)) AS i), LATERAL (SELECT unnest(range(cs)) AS j)),
k AS (SELECT tab, r, c, count(*) AS n FROM s GROUP BY ALL), w AS (SELECT tab, r, max(c) AS last, count_if(n > 1) AS twice FROM k GROUP BY ALL)
SELECT tab, max(r) + 1 AS n_rows, (max(last) + 1)::BIGINT AS n_cols, sum(twice)::BIGINT AS conflicts, count(DISTINCT last) > 1 AS ragged FROM w GROUP BY tab""")
def grid_check(spark, sf_dir):
    k = F.col("l_orderkey")
    cells = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("tab"),
        (k % 4).alias("row"),
        F.col("l_linenumber").cast("long").alias("col"),
        F.when(k % 11 == 0, 2).otherwise(1).alias("rowspan"),
        F.when(k % 7 == 0, 2).otherwise(1).alias("colspan"),
    )
    return y.grid_report(cells, "tab")


def greedy_sql(pairs: str, least: float) -> str:
    """Recursive CTEs for one-to-one matches of pairs(page, a, b, iou) by falling iou: the last one is m(page, a, b, iou)."""
    return f""", o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY iou DESC, a, b) AS k FROM {pairs} WHERE iou >= {least}),
s AS (SELECT page, 0::BIGINT AS k, []::BIGINT[] AS ta, []::BIGINT[] AS tb, NULL::BIGINT AS a, NULL::BIGINT AS b, NULL::DOUBLE AS iou, false AS hit FROM (SELECT DISTINCT page FROM o)
  UNION ALL SELECT o.page, o.k, CASE WHEN list_contains(ta, o.a) OR list_contains(tb, o.b) THEN ta ELSE list_append(ta, o.a) END, CASE WHEN list_contains(ta, o.a) OR list_contains(tb, o.b) THEN tb ELSE list_append(tb, o.b) END,
    o.a, o.b, o.iou, NOT (list_contains(ta, o.a) OR list_contains(tb, o.b)) FROM s JOIN o ON o.page = s.page AND o.k = s.k + 1),
m AS (SELECT page, a, b, iou FROM s WHERE hit)
"""


def iou_sql(a: str, b: str) -> str:
    i = f"(greatest(0.0::DOUBLE, least({a}.r, {b}.r) - greatest({a}.l, {b}.l)) * greatest(0.0::DOUBLE, least({a}.bt, {b}.bt) - greatest({a}.t, {b}.t)))"
    return f"{i} / (({a}.r - {a}.l) * ({a}.bt - {a}.t) + ({b}.r - {b}.l) * ({b}.bt - {b}.t) - {i})"


RECURSIVE_SQL = BOXES_SQL.replace("WITH ", "WITH RECURSIVE ", 1)


@query(RECURSIVE_SQL + f", pr AS (SELECT x.page, x.cell AS a, z.cell AS b, round({iou_sql('x', 'z')}, 9) AS iou FROM c x JOIN c z ON x.page = z.page AND x.cell % 8 = 0 AND z.cell % 8 = 4)" + greedy_sql("pr", 0.05) + "SELECT * FROM m")
def greedy_match(spark, sf_dir):
    """Cells of even number among the page's are matched with the others."""
    cells = boxes(spark, sf_dir)[1]
    a = cells.where("cell % 8 = 0").select("page", F.col("cell").alias("a"), F.col("cell_box").alias("x"))
    b = cells.where("cell % 8 = 4").select("page", F.col("cell").alias("b"), F.col("cell_box").alias("z"))
    pairs = a.join(b, "page").withColumn("iou", F.round(geo.iou(F.col("x"), F.col("z")), 9))
    return y.greedy_matches(pairs, "page", 0.05)


READING_SQL = BOXES_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """, o AS (SELECT page, word, (l + r) / 2 AS cx, (t + bt) / 2 AS cy, bt - t AS h, row_number() OVER (PARTITION BY page ORDER BY (t + bt) / 2, (l + r) / 2, word) AS k FROM w),
s AS (SELECT page, k, word, cx, 0::BIGINT AS line, cy AS anchor FROM o WHERE k = 1
  UNION ALL SELECT o.page, o.k, o.word, o.cx, s.line + (o.cy - s.anchor > 0.5 * o.h)::INT, CASE WHEN o.cy - s.anchor > 0.5 * o.h THEN o.cy ELSE s.anchor END FROM s JOIN o ON o.page = s.page AND o.k = s.k + 1)
SELECT page, line, string_agg(word::VARCHAR, ' ' ORDER BY cx, word) AS text FROM s GROUP BY page, line"""


@query(READING_SQL)
def reading_order(spark, sf_dir):
    """Lines are anchored at their first word."""
    words = boxes(spark, sf_dir)[0]
    box = F.col("word_box")
    rows = words.select("page", "word", ((box["l"] + box["r"]) / 2).alias("cx"), ((box["t"] + box["b"]) / 2).alias("cy"), (box["b"] - box["t"]).alias("height"))
    return y.reading_lines(rows, "page")


@query(BOXES_SQL + """, q AS (SELECT DISTINCT page, (page % 5) * 120.0::DOUBLE AS cut FROM w)
SELECT q.page, cut, coalesce(max((w.t, word)) FILTER (w.t <= cut), min((w.t, word)))[2] AS item FROM q JOIN w USING (page) GROUP BY ALL""")
def anchor_lookup(spark, sf_dir):
    words = boxes(spark, sf_dir)[0].select("page", F.col("word").alias("item"), F.col("word_box.t").alias("top"))
    cuts = words.select("page", ((F.col("page") % 5) * 120.0).alias("cut")).distinct()
    return y.anchors(words, cuts, "page")


@query(BOXES_SQL + """SELECT w.page, word FROM w WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.page = w.page AND (w.l + w.r) / 2 BETWEEN c.l AND c.r AND (w.t + w.bt) / 2 BETWEEN c.t AND c.bt)""")
def spilled_words(spark, sf_dir):
    return y.words_in_cells(*boxes(spark, sf_dir)).where("cell is null").select("page", "word")
