"""Table rules that the order of rows decides, against plain loops."""

import random
from collections import Counter, defaultdict

from tessera.operators import tables as o


def iou(x, y, least=False):
    both = max(0, min(x[2], y[2]) - max(x[0], y[0])) * max(0, min(x[3], y[3]) - max(x[1], y[1]))
    a, b = ((z[2] - z[0]) * (z[3] - z[1]) for z in (x, y))
    return both / (min(a, b) if least else a + b - both)


def random_boxes(rng, n):
    return [(x := rng.randrange(60), y := rng.randrange(60), x + rng.randrange(5, 30), y + rng.randrange(5, 30)) for _ in range(n)]


def test_merged_tile_lines(spark):
    rng, rows = random.Random(1), []
    for page in range(20):
        for tile, (low, high) in enumerate(((0, 30), (30, 60), (60, 90))):
            for line, box in enumerate(random_boxes(rng, 15)):
                rows.append((page, tile, line, *map(float, box), rng.choice(["a b", "ab", "c"]), float(low), float(high), tile == 2))
    frame = spark.createDataFrame(rows, "page long, tile long, line long, l double, t double, r double, b double, text string, own_from double, own_to double, last boolean")
    want, kept = set(), defaultdict(list)
    for page, tile, line, *box, text, low, high, last in rows:
        centre = (box[1] + box[3]) / 2
        if low <= centre < high or last and centre == high:
            key = text.replace(" ", "")
            if all(key != k or iou(box, b, least=True) < 0.5 for k, b in kept[page]):
                kept[page].append((key, box))
                want.add((page, tile, line))
    assert {tuple(r) for r in o.merged_tile_lines(frame, "page").collect()} == want


def test_consensus_regions(spark):
    rng, rows = random.Random(2), []
    for page in range(20):
        for k, box in enumerate(random_boxes(rng, 30)):
            rows.append((page, k % 3, k % 3 // 2, k, *map(float, box)))
    frame = spark.createDataFrame(rows, "page long, variant long, family long, table long, l double, t double, r double, b double")
    regions = defaultdict(list)
    for page, _, family, _, *box in sorted(rows, key=lambda r: (r[0], r[1], r[3])):
        for first, families in regions[page]:
            if iou(first, box) >= 0.5:
                families.add(family)
                break
        else:
            regions[page].append((box, {family}))
    want = Counter((page, *box, len(f)) for page, found in regions.items() for box, f in found if len(f) >= 2)
    assert Counter(map(tuple, o.consensus_regions(frame, "page").collect())) == want and want


def test_words_outside(spark):
    rng, words, cells, want = random.Random(3), [], [], set()
    for page in range(20):
        cells += [(page, " ".join(rng.choice("abc") for _ in range(8)))]
        pool = Counter(cells[-1][1].replace(" ", ""))
        for k in range(12):
            word = "".join(rng.choice("abcd ") for _ in range(2))
            words.append((page, k, word))
            need = Counter(word.replace(" ", ""))
            if need - pool:
                want.add((page, k))
            else:
                pool -= need
    got = o.words_outside(spark.createDataFrame(words, "page long, word long, text string"), spark.createDataFrame(cells, "page long, text string"), "page")
    assert {tuple(r) for r in got.collect()} == want


def test_merged_characters(spark):
    rng, rows, want = random.Random(4), [], []
    for page in range(20):
        x, held = 0.0, []
        for at in range(40):
            x += rng.choice([4, 5, 6, 12])
            y = rng.choice([0.0, 0.0, 0.0, 9.0])
            ch, box = rng.choice("ab, "), (x, y, x + 5, y + 10)
            rows.append((page, at, ch, *box))
            if not ch.strip():
                held.append(None)
                continue
            if held and held[-1]:
                text, last = held[-1]
                size = max(last[3] - last[1], 1)
                if box[1] < last[3] + 0.3 * size and box[3] > last[1] - 0.3 * size and -0.6 * size <= box[0] - last[2] <= 0.5 * size:
                    held[-1] = (text + ch, (min(last[0], box[0]), min(last[1], box[1]), max(last[2], box[2]), max(last[3], box[3])))
                    continue
            held.append((ch, box))
        want += [(page, k, text, *box) for k, (text, box) in enumerate(w for w in held if w)]
    frame = spark.createDataFrame(rows, "page long, at long, ch string, l double, t double, r double, b double")
    assert sorted(map(tuple, o.merged_characters(frame, "page").collect())) == sorted(want)


def test_readable_table(spark):
    texts = ["a, 1 = x. b, 2 = y", "  a, 1 = x. b, 2 = y", "Note. a, 1 = x. b, 2 = y", "a, 1 = x", "", None]
    got = [r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select(o.readable_table(o.F.col("t")).alias("x")).collect()]
    assert got[0] == got[1] == "표 cell 목록 (행·병합 구조는 추정하지 않음):\n- a / 열 1: x\n- b / 열 2: y" and got[3:] == texts[3:]


def test_gold_matches(spark, sf_dir):
    from tessera.plans.tables import QUERIES, found_boxes

    expected, found = (x.collect() for x in found_boxes(spark, sf_dir))
    pairs, totals = [], defaultdict(Counter)
    by = defaultdict(list)
    for r in found:
        by[r.page].append(r)
        totals[r.page % 4]["found"] += 1
    for r in expected:
        totals[r.page % 4]["gold"] += 1
        pairs += [(-round(iou(r.x, f.z), 9), r.page, r.id, f.id) for f in by[r.page]]
    taken = set()
    for score, page, a, b in sorted(pairs):
        if -score >= 0.3 and ("a", page, a) not in taken and ("b", page, b) not in taken:
            taken |= {("a", page, a), ("b", page, b)}
            totals[page % 4]["matched"] += 1
    got = {r.variant: r for r in QUERIES["gold_matches"](spark, sf_dir).collect()}
    for k, t in totals.items():
        assert (got[k].gold, got[k].found, got[k].matched) == (t["gold"], t["found"], t["matched"]) and got[k].false_positives == t["found"] - t["matched"]


def test_lines_equally_near(spark):
    """Distances of 3.333333 differ in binary; the first line counts, as in the queries' SQL."""
    from pyspark.sql import functions as F

    lines = spark.createDataFrame([([-2.333333, 4.333333], 1.0), ([0.0, 1.0], 0.6)], "m array<double>, v double")
    assert sorted(r.k for r in lines.select(o.nearest(F.col("m"), F.col("v")).alias("k")).collect()) == [0, 1]


def test_equal_edges_are_one_cluster(spark):
    """Equal values are in one cluster whichever comes first; a running count of rows over ties in another order would part them."""
    from tessera.operators.layout import gap_clusters

    values = [(1, float(v)) for v in [0] * 50 + [9] * 200 + [20] * 300]
    rows = spark.createDataFrame(values, "page long, v double").repartition(4)
    assert sorted((r["mean"], r.n) for r in gap_clusters(rows, "page", "v", 6.0).collect()) == [(0.0, 50), (9.0, 200), (20.0, 300)]


def test_pages_share_batches(spark):
    """A page may go over batches and many are in one; what stands between is one call of a task, not a group of pandas for each page."""
    from tessera.operators.layout import page_by_page

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(None if k % 10 == 9 else 2**60 + k % 10, k, k * 0.5) for k in range(200)]
        got = page_by_page(spark.createDataFrame(rows, "page long, k long, v double"), "page", lambda held: [(sum(k for k, _ in held), len(held))], "total long, n long")
        assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()
        assert {tuple(r) for r in got.collect()} == {(None if k == 9 else 2**60 + k, sum(range(k, 200, 10)), 20) for k in range(10)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_relations_are_grouped_in_tasks_of_one_size(spark, sf_dir):
    """Dealt by a number of their own, which Spark does not join to a few large ones; a table's distinct counts do not treble its rows."""
    from tessera.operators import documents
    from tessera.sources import tables

    assert tables.dealt(spark.range(10), tables.ROWS_AT_ONCE * 2 + 1, "id").rdd.getNumPartitions() == 3
    assert "REPARTITION_BY_NUM" in tables.relations(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    rows = spark.createDataFrame([(1, 1, "A", None), (1, 2, "A", None), (2, 1, "A", None), (2, 1, "A", "O"), (3, 1, None, None)], "content long, program long, format string, status string")
    found = documents.consistency(rows, "content", ["format", "status"])
    assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.content: (r.relations, r.programs, r.consistent) for r in found.collect()} == {1: (2, 2, True), 2: (2, 1, False), 3: (1, 1, True)}


def test_readable_table_reads_a_text_once_for_all_its_cells(spark):
    plan = spark.createDataFrame([("a, 1 = x. b, 2 = y",)], "t string").select(o.readable_table(o.F.col("t")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "arrays_zip" in plan and "get(regexp_extract_all" not in plan


def test_html_tables_are_read_in_small_batches(spark):
    """An Arrow batch would hold the cells of 10,000 tables at once."""
    from tessera.functions import markup

    rows = spark.createDataFrame([("<table><tr><td colspan=2>a<td>b</table>",), (None,)], "html string").select(o.F.posexplode(markup.cells_of("html")).alias("at", "x"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and plan.count("BatchEvalPython") == 1
    assert [(r.at, *r.x) for r in rows.collect()] == [(0, 0, 0, 1, 2, "a"), (1, 0, 2, 1, 1, "b")]
