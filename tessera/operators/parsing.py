"""Parsed documents: chunks, gates, table comparison, overlap groups, judged cases."""

from __future__ import annotations

import difflib
import hashlib
import re
from collections import Counter
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType
from pyspark.sql.window import Window

from tessera.functions import geometry as geo
from tessera.functions.identity import content_key
from tessera.operators.layout import page_by_page
from tessera.operators.segments import stored

DENSE_DIM = 16


def chunked(docs: DataFrame, key: str, text: str, words_per_chunk: int) -> DataFrame:
    """key, chunk_index, chunk_count, words, content_key of each run of words_per_chunk words."""
    words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    rows = docs.withColumn("_w", words).withColumn("chunk_count", F.ceil(F.size("_w") / words_per_chunk).cast("int")).where("chunk_count > 0")
    rows = rows.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), F.col("chunk_count") - 1)))
    part = F.slice("_w", F.col("chunk_index") * words_per_chunk + 1, F.lit(words_per_chunk))
    return rows.select(key, "chunk_index", "chunk_count", F.size(part).alias("n_words"), content_key(F.array_join(part, " ")).alias("content_key"))


def counted_contents(chunks: DataFrame, relations: DataFrame, key: str, program: str) -> DataFrame:
    """program, chunks and contents (distinct content keys) of the documents that each program has; relations are distinct.

    Documents with the same contents are a class. A content that only one class has is counted there, once; only contents that several classes have go
    out to programs, as the number of a row. So what is shuffled grows with relations, not with the chunks that these repeat.
    """
    held = stored(chunks.groupBy(key).agg(F.count(F.lit(1)).alias("chunks"), F.sort_array(F.collect_set(F.unhex("content_key"))).alias("_keys")), "contents")
    sets = F.sha2(F.to_binary(F.array_join(F.transform("_keys", F.hex), ""), F.lit("hex")), 256)
    classes = stored(held.groupBy(sets.alias("_set")).agg(F.min(key).alias("_class"), F.min_by("_keys", key).alias("_keys")), "classes")
    each = classes.select("_class", F.explode("_keys").alias("_content"))
    number = each.groupBy("_content").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_content", F.monotonically_increasing_id().alias("_number"))
    shared = stored(each.join(number, "_content").select("_number", "_class"), "shared")
    several = shared.groupBy("_class").agg(F.count(F.lit(1)).alias("_shared"))
    held_by = F.coalesce("_shared", F.lit(0))
    own = classes.select("_set", "_class", F.size("_keys").alias("_all")).join(several, "_class", "left").select("_set", "_class", (F.col("_all") - held_by).alias("_own"), held_by.alias("_shared"))
    of_documents = stored(held.select(key, "chunks", sets.alias("_set")).join(own, "_set").drop("_set"), "of_documents")
    # Dealt by program once for both groupings.
    rows = relations.join(of_documents, key).repartition(program).groupBy(program, "_class", "_own", "_shared").agg(F.sum("chunks").alias("chunks"))
    once = rows.groupBy(program).agg(F.sum("chunks").alias("chunks"), F.sum("_own").alias("_own"))
    met = rows.where("_shared > 0").select(program, "_class").join(shared, "_class").select(program, "_number").distinct().groupBy(program).agg(F.count(F.lit(1)).alias("_met"))
    return once.join(met, program, "left").select(program, "chunks", (F.col("_own") + F.coalesce("_met", F.lit(0))).alias("contents"))


@F.pandas_udf(ArrayType(DoubleType()))
def hash_embedding(texts: pd.Series) -> pd.Series:
    """A deterministic stand-in for a dense embedding model: signed hashed words, length one."""

    def one(text: str | None) -> np.ndarray | None:
        if text is None:
            return None
        v = np.zeros(DENSE_DIM)
        for word in filter(None, re.split(r"[ \t\n\x0b\f\r]+", text)):
            h = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
            v[h % DENSE_DIM] += 1.0 if h >> 16 & 1 else -1.0
        return v / max(float(np.linalg.norm(v)), 1e-12)

    return texts.map(one)


def parse_status(chars: Column, images: Column, odd: Column) -> Column:
    """struct<status, warning> of a parsed document from its counts."""
    status = F.when((chars == 0) & (images > 0), "OCR_REQUIRED").when(chars == 0, "EMPTY_TEXT").otherwise("PARSED")
    return F.struct(status.alias("status"), F.when(odd > 0, "replacement_characters").alias("warning"))


def guarded_delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """One row: counts before, of the target and after, and whether they add up."""
    after = table.join(keys, key, "left_anti").agg(F.count(F.lit(1)).alias("after"))
    gone = table.join(keys, key, "left_semi").agg(F.count(F.lit(1)).alias("target"))
    before = table.agg(F.count(F.lit(1)).alias("before"))
    return before.join(gone).join(after).withColumn("exact", F.col("before") == F.col("target") + F.col("after"))


def without_nested(boxes: DataFrame, share: float = 0.9) -> DataFrame:
    """Boxes (page, cell, cell_box) that no larger box of the page holds to the given share; of equal boxes the first stays."""
    other = boxes.select("page", F.col("cell").alias("o"), F.col("cell_box").alias("ob"))
    x, y = F.col("cell_box"), F.col("ob")
    larger = (geo.area(y) > geo.area(x)) | ((geo.area(y) == geo.area(x)) & (F.col("o") < F.col("cell")))
    nested = boxes.join(other, "page").where((F.col("o") != F.col("cell")) & larger & (geo.intersection(x, y) >= share * geo.area(x)))
    return boxes.join(nested.select("page", "cell").distinct(), ["page", "cell"], "left_anti")


def overlap_groups(boxes: DataFrame) -> DataFrame:
    """page, cell, group: connected components of overlapping boxes of a page, named by their smallest cell. A page holds its boxes only."""

    def groups(rows: list[tuple]) -> list[tuple]:
        rows = sorted(rows)
        left, top, right, bottom = np.array([x[1:] for x in rows]).T
        name = np.arange(len(rows))
        hit = (np.minimum(right[:, None], right) > np.maximum(left[:, None], left)) & (np.minimum(bottom[:, None], bottom) > np.maximum(top[:, None], top))
        while True:
            low = np.where(hit, name[None, :], len(rows)).min(1)
            low = np.minimum(low, name)[np.minimum(low, name)]
            if np.array_equal(low, name):
                break
            name = low
        return [(x[0], rows[k][0]) for x, k in zip(rows, name.tolist(), strict=True)]

    flat = boxes.select("page", "cell", *[F.col(f"cell_box.{c}").alias(c) for c in "ltrb"])
    return page_by_page(flat, "page", groups, "cell long, group long")


def common_length(places: dict[str, int], n: int, other: str) -> int:
    """Length of the longest common subsequence of other and a text of n characters, of which places has a bit for each place of a character."""
    whole = (1 << n) - 1
    left = whole
    for ch in other:
        hit = left & places.get(ch, 0)
        left = (left + hit) | (left - hit)
    return n - (left & whole).bit_count()


class Judged:
    """A text, with what is known of it as later texts ask."""

    def __init__(self, text: str):
        self.text, self.n = text, len(text)

    @cached_property
    def counts(self) -> Counter:
        return Counter(self.text)

    @cached_property
    def places(self) -> dict[str, int]:
        bits: dict[str, int] = {}
        for k, ch in enumerate(self.text):
            bits[ch] = bits.get(ch, 0) | 1 << k
        return bits

    @cached_property
    def match(self) -> difflib.SequenceMatcher:
        return difflib.SequenceMatcher(None, "", self.text, autojunk=False)

    def similar(self, earlier: Judged, least: float) -> bool:
        """Whether difflib's ratio from earlier is least or more. It is twice the characters that its blocks match over those of both texts.

        The first block is the longest, so a text within the other is matched whole. All blocks are a common subsequence, so its length bounds them, as do the
        characters that both have.
        """
        both = self.n + earlier.n
        ratio = lambda matched: 2.0 * matched / both if both else 1.0
        short, long = (self, earlier) if self.n <= earlier.n else (earlier, self)
        if ratio(short.n) < least:
            return False
        if short.text in long.text:
            return True
        mine = short.counts
        if ratio(sum(min(n, mine.get(ch, 0)) for ch, n in long.counts.items())) < least or ratio(common_length(self.places, self.n, earlier.text)) < least:
            return False
        self.match.set_seq1(earlier.text)
        return self.match.ratio() >= least


#: Rows of a group that meet at a time, and rows of a task: pairs cost far more than bytes.
MEETING, JUDGED_AT_ONCE = 64, 4096


def similar_to_earlier(rows: DataFrame, group: str, at: str, text: str, least: float, meeting: int = MEETING) -> DataFrame:
    """group, at: rows whose text is at least so similar to an earlier one of the group; rows without at or text are none.

    A group is one evaluation's criteria, tens of rows; of a larger one runs of rows meet each other, so that its pairs are spread over tasks.
    """
    rows = rows.select(group, at, text).dropna(subset=[at, text])
    n_rows = F.count(F.lit(1))
    copies = rows.groupBy(group).agg(n_rows.alias("n")).agg(F.sum(F.col("n") * F.ceil(F.col("n") / meeting))).first()[0] or 0
    own = Window.partitionBy(group)
    placed = rows.withColumn("_k", F.row_number().over(own.orderBy(at, text)).cast("long") - 1).withColumn("_runs", F.ceil(n_rows.over(own) / meeting))
    placed = placed.withColumn("_run", F.floor(F.col("_k") / meeting)).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_runs") - 1)))
    met = placed.select(group, F.least("_run", "_other").alias("_low"), F.greatest("_run", "_other").alias("_high"), "_k", "_run", F.col("_other").alias("_with"), F.col(at).alias("_at"), F.col(text).alias("_text"))

    def repeated(rows: list[tuple]) -> list[tuple]:
        rows.sort(key=lambda x: x[0])
        high = max(max(run, other) for _, run, other, _, _ in rows)
        seen, held = [], []
        for k, run, other, number, value in rows:
            mine = Judged(value)
            if run == high and any(mine.similar(earlier, least) for earlier in reversed(seen)):
                held.append((k, number))
            # Runs that differ meet as earlier and later, a run with itself as both.
            if run < high or run == other:
                seen.append(mine)
        return held

    found = page_by_page(met, group, repeated, "_k long, _at long", ["_low", "_high"], max(1, -(-copies // JUDGED_AT_ONCE)))
    return found.dropDuplicates([group, "_k"]).select(group, F.col("_at").alias(at))


def differences(tables: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """key, reasons, gap in tokens of the tables that engines a and b see differently; cells, merged and tokens of each are given as columns."""
    col = lambda engine, name: F.col(f"{engine}_{name}")
    differ = lambda name: F.coalesce(col(a, name) != col(b, name), F.lit(False))
    told = [F.when(col(a, "cells").isNull() | col(b, "cells").isNull(), "not_detected"), F.when(differ("cells"), "shapes"), F.when(differ("merged"), "merged_cells"), F.when(differ("tokens"), "tokens")]
    gap = F.abs(F.coalesce(col(a, "tokens"), F.lit(0)) - F.coalesce(col(b, "tokens"), F.lit(0)))
    return tables.select(key, F.concat_ws(",", *told).alias("reasons"), gap.alias("gap")).where("reasons <> ''")


def neighbours(cells: DataFrame, table: str) -> DataFrame:
    """table, text, next_text, direction: for each place of the grid that a filled cell takes, the next filled other cell to the right and below.

    cells: at (their order), row, col, rowspan, colspan, text. Places of the same cell and of empty ones are passed over; a place of no cell ends the
    way. Where cells overlap, the later has the place.
    """
    reach = lambda first, n: F.explode(F.sequence(F.col(first), F.col(first) + F.col(n) - 1))
    places = cells.withColumn("_r", reach("row", "rowspan")).withColumn("_c", reach("col", "colspan"))
    places = places.groupBy(table, "_r", "_c").agg(F.max(F.struct("at", "text")).alias("_x"))
    ways = F.array(F.struct(F.lit("right").alias("d"), F.col("_r").alias("line"), F.col("_c").alias("pos")), F.struct(F.lit("down").alias("d"), F.col("_c").alias("line"), F.col("_r").alias("pos")))
    rows = places.select(table, "_x.*", F.explode(ways).alias("_w")).select(table, "at", "text", "_w.*")
    line = [table, "d", "line"]
    rows = rows.withColumn("isle", F.col("pos") - F.row_number().over(Window.partitionBy(*line).orderBy("pos"))).where(F.trim("text") != "")
    along = Window.partitionBy(*line, "isle").orderBy("pos")
    rows = rows.withColumn("_new", F.coalesce((F.col("at") != F.lag("at").over(along)).cast("int"), F.lit(0)))
    rows = rows.withColumn("run", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    after = F.first("text").over(Window.partitionBy(*line, "isle").orderBy("run").rangeBetween(1, 1))
    return rows.withColumn("next_text", after).where("next_text is not null").select(table, "text", "next_text", F.col("d").alias("direction"))


@F.pandas_udf(LongType())
def lost_characters(native: pd.Series, base: pd.Series, final: pd.Series) -> pd.Series:
    """Characters of native that final lacks and base does not, as multisets, counted within the row."""

    def lost(n: str | None, b: str | None, f: str | None) -> int:
        own = Counter(n or "")
        return sum(((own - Counter(f or "")) - (own - Counter(b or ""))).values())

    return pd.Series([lost(*x) for x in zip(native, base, final, strict=True)], dtype="int64")


def word_spans(lines: DataFrame, keys: list[str], text: str, width: float) -> DataFrame:
    """keys, word, x_from, x_to of each word of each line, its place among the characters scaled to width."""
    rows = lines.select(*keys, F.length(text).alias("_all"), F.posexplode(F.split(text, " ")).alias("word", "_w"))
    before = F.sum(F.length("_w") + 1).over(Window.partitionBy(*keys).orderBy("word").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_at", F.coalesce(before, F.lit(0)) * F.lit(width)).where("_w <> ''")
    return rows.select(*keys, "word", F.round(F.col("_at") / F.col("_all"), 6).alias("x_from"), F.round((F.col("_at") + F.length("_w") * F.lit(width)) / F.col("_all"), 6).alias("x_to"))


def provenance(rows: DataFrame, item: str, keys: list[str]) -> DataFrame:
    """keys and the flat provenance of item (self_ref, label, prov<page, box>, meta<table<verdict>, ocr<confidence>>); what is not there is null."""
    x = F.col(item)
    return rows.select(
        *keys,
        x["self_ref"].alias("item_ref"),
        x["label"].alias("label"),
        x["prov"]["page"].alias("page"),
        F.transform(x["prov"]["box"], lambda v: F.round(v, 2)).alias("bbox"),
        x["meta"]["table"]["verdict"].alias("table_verdict"),
        x["meta"]["ocr"]["confidence"].alias("ocr_confidence"),
    )


def compact_criteria(rows: DataFrame, key: str, criteria: str) -> DataFrame:
    """key and criteria with the evidence ids of their citations alone."""
    kept = F.transform(criteria, lambda x: F.struct(x["criterion"].alias("criterion"), x["result"].alias("result"), F.transform(x["citations"], lambda c: c["evidence_id"]).alias("citations")))
    return rows.select(key, kept.alias(criteria))
