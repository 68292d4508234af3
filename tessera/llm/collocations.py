"""Phrase collocations: merged count-min sketches, exact counts of what survives them, scores, subsumption.

Texts are lower-cased in A-Z, cut into pieces at SEPARATORS and these into words at spaces and tabs. A phrase is 2 to MOST_WORDS successive words
of a piece; everything is counted for each language apart, a null language being UNKNOWN.

First pass: each task holds a sketch, SKETCH_ROWS rows of cells, and adds the words and phrases of its texts to it. A cell stops at LEAST, which
is enough to know whether the sum over tasks reaches it, so a task's cells are bytes. Tasks emit them in blocks, sparse or dense; blocks are
merged by number, one after another, to one bit a cell: whether LEAST or more fell into it. A sketch overestimates, so what occurs LEAST times
has its bit in every row. Second pass: the words and phrases whose bits are all set, and whose shorter parts survived likewise, are
counted exactly, by text, with sums on the map side; those below LEAST go then. So nothing frequent is lost, whatever the width.

The width follows the size of the texts, a cell for CELL_BYTES of them in each row, between LEAST_WIDTH and MOST_WIDTH. It decides how much the second
pass shuffles, never what comes out. The bits, SKETCH_ROWS * MOST_WIDTH / 8 bytes at most, are what is broadcast.

score: a candidate is a phrase with a = LEAST occurrences or more; cut after its first k words it has l and r occurrences of its parts and
floor(SCALE * a * a / (l * r)); the lowest cut counts, ties to the smallest k. A candidate goes if a longer one, dropped or not, contains it and
has SUBSUMED hundredths of its occurrences or more. The first TOP of each language stay, by score, occurrences and phrase.

Null and empty texts have no words. Repeated rows count each. A text is never split between tasks; a task holds SLICE_CHARS characters of text at
a time, or one longer text. Only the two named columns are read, whatever else there is. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import discard, written

SEPARATORS = b".,;:!?\n\x0b\x0c\r"
UNKNOWN = "und"
MOST_WORDS = 3
LEAST = 10
SCALE = 1_000_000
SUBSUMED = 50
TOP = 2000
SKETCH_ROWS = 2
CELL_BYTES = 4
LEAST_WIDTH, MOST_WIDTH = 1 << 16, 1 << 27
#: Cells of a block.
BLOCK = 1 << 13
SLICE_CHARS = 2_000_000
#: Parts of a language that are ranked each before the language is.
RANK_PARTS = 64

#: A separator becomes this one, which stands between pieces as a word of its own.
_END = b"."
_AS_WORDS = bytes.maketrans(SEPARATORS + b"\t" + bytes(range(65, 91)), _END * len(SEPARATORS) + b" " + bytes(range(97, 123)))


def words_of(texts: list[str]) -> list[bytes]:
    """Words of texts, with _END between pieces and texts."""
    return b".".join(t.encode("utf-8", "surrogatepass") for t in texts).translate(_AS_WORDS).replace(_END, b" . ").split()


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Grams:
    """Words and phrases of some texts of one language, as positions in their list of words."""

    def __init__(self, lang: str, texts: list[str]):
        self.codes, self.words = pd.factorize(np.array(words_of(texts), dtype=object))
        end = np.flatnonzero(self.words == _END)
        self.is_word = self.codes != (end[0] if len(end) else -1)
        hashed = hash_array(self.words, categorize=False) if len(self.words) else np.empty(0, np.uint64)
        self.hashed = scrambled(hashed ^ hash_array(np.array([lang], dtype=object))[0])

    def n_words(self) -> int:
        return int(self.is_word.sum())

    def sizes(self, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, starts, hashes) of all phrases of 1 to most words."""
        starts = np.flatnonzero(self.is_word)
        hashes = self.hashed[self.codes[starts]]
        for size in range(1, most + 1):
            yield size, starts, hashes
            inside = starts + size < len(self.codes)
            inside[inside] = self.is_word[starts[inside] + size]
            starts = starts[inside]
            hashes = scrambled(hashes[inside] * np.uint64(0x9E3779B97F4A7C15) + self.hashed[self.codes[starts + size]])

    def text(self, start: int, size: int) -> str:
        return b" ".join(self.words[self.codes[start : start + size]]).decode("utf-8", "surrogatepass")


def slices(batch: pd.DataFrame, most: int = SLICE_CHARS) -> Iterator[Grams]:
    for lang, part in batch.groupby("lang", sort=False):
        held, size = [], 0
        for text in part.text:
            held.append(text)
            size += len(text)
            if size >= most:
                yield Grams(lang, held)
                held, size = [], 0
        if held:
            yield Grams(lang, held)


def cells(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    return ((hashes >> np.uint64(32 * row)) & np.uint64(width - 1)).astype(np.int64) + row * width


def blocks_of(held: np.ndarray, block: int) -> Iterator[pd.DataFrame]:
    """(block, cells) of a sketch's blocks that are not empty: all bytes, or places (two bytes) and then bytes where that is shorter."""
    parts = held.reshape(-1, block)
    filled = np.flatnonzero(parts.any(1))
    for at in range(0, len(filled), 1024):
        out = []
        for b in filled[at : at + 1024]:
            places = np.flatnonzero(parts[b])
            out.append(parts[b].tobytes() if 3 * len(places) >= block else places.astype("<u2").tobytes() + parts[b][places].tobytes())
        yield pd.DataFrame({"block": filled[at : at + 1024], "cells": out})


def sketched(texts: DataFrame, width: int, least: int = LEAST, most_words: int = MOST_WORDS) -> np.ndarray:
    """Bits of the merged sketch: whether least or more fell into a cell."""
    block = min(BLOCK, width)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(SKETCH_ROWS * width, np.uint8)
        for batch in batches:
            for grams in slices(batch):
                for _, _, hashes in grams.sizes(most_words):
                    for row in range(SKETCH_ROWS):
                        at, n = np.unique(cells(hashes, row, width), return_counts=True)
                        held[at] = np.minimum(held[at] + n, least)
        yield from blocks_of(held, block)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, total = None, np.zeros(block, np.int64)
        for batch in batches:
            done = []
            for number, data in zip(batch.block, batch.cells, strict=True):
                if number != at:
                    if at is not None:
                        done.append((at, np.packbits(total >= least, bitorder="little").tobytes()))
                    at, total = number, np.zeros(block, np.int64)
                if len(data) == block:
                    total += np.frombuffer(data, np.uint8)
                else:
                    n = len(data) // 3
                    total[np.frombuffer(data, "<u2", n)] += np.frombuffer(data, np.uint8, n, 2 * n)
            yield pd.DataFrame(done, columns=["block", "bits"])
        if at is not None:
            yield pd.DataFrame([(at, np.packbits(total >= least, bitorder="little").tobytes())], columns=["block", "bits"])

    parts = texts.mapInPandas(add, "block long, cells binary").repartition("block").sortWithinPartitions("block")
    bits = np.zeros((SKETCH_ROWS * width // block, block // 8), np.uint8)
    for r in parts.mapInPandas(merge, "block long, bits binary").collect():
        bits[r.block] = np.frombuffer(r.bits, np.uint8)
    return bits.reshape(-1)


def survivors(grams: Grams, bits: np.ndarray, width: int, most_words: int) -> Iterator[tuple[int, int, int]]:
    """(size, start, occurrences) of each different word and phrase that the sketch lets through, in exact groups."""
    known = np.full(len(grams.codes) + 1, -1, np.int64)  # the group of what starts here, of one word less
    for size, starts, hashes in grams.sizes(most_words):
        keep = np.ones(len(starts), dtype=bool) if size == 1 else (known[starts] >= 0) & (known[starts + 1] >= 0)
        starts, hashes = starts[keep], hashes[keep]
        for row in range(SKETCH_ROWS):
            at = cells(hashes, row, width)
            keep = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            starts, hashes = starts[keep], hashes[keep]
        key = grams.codes[starts].astype(np.int64) if size == 1 else known[starts] * len(grams.words) + grams.codes[starts + size - 1]
        _, first, group, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        known.fill(-1)
        known[starts] = group
        yield from zip([size] * len(n), starts[first].tolist(), n.tolist(), strict=True)


def phrase_counts(texts: DataFrame, bits: np.ndarray, width: int, least: int = LEAST, most_words: int = MOST_WORDS) -> DataFrame:
    """(lang, size, phrase, n) of all that occurs least times or more, and all words of a language as size 0."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, part in batch.groupby("lang", sort=False):
                for grams in slices(part):
                    rows = [(lang, 0, "", grams.n_words())]
                    rows += [(lang, size, grams.text(start, size), n) for size, start, n in survivors(grams, shared.value, width, most_words)]
                    yield pd.DataFrame(rows, columns=["lang", "size", "phrase", "n"])

    found = texts.mapInPandas(count, "lang string, size int, phrase string, n long")
    return found.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("size") == 0))


def phrase_of(words: Column, start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, score) of the candidates."""
    words, k = F.split("phrase", " "), F.col("k")
    cut = counts.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.withColumn("left", phrase_of(words, 1, k)).withColumn("right", phrase_of(words, k + 1, F.col("size") - k))
    known = counts.where("size > 0")
    cut = cut.join(known.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cut = cut.join(known.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    exact = f"(cast({SCALE} as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0)))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"
    cut = cut.withColumn("score", F.expr(exact))
    best = cut.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")


def not_subsumed(found: DataFrame, most_words: int = MOST_WORDS, share: int = SUBSUMED) -> DataFrame:
    """found without the phrases that a longer one contains with share hundredths of their occurrences or more."""
    if most_words < 3:
        return found
    words, n = F.split("phrase", " "), F.col("size")
    inside = F.flatten(F.transform(F.sequence(F.lit(2), n - 1), lambda m: F.transform(F.sequence(F.lit(1), n - m + 1), lambda i: phrase_of(words, i, m))))
    longer = found.where("size > 2").select("lang", F.explode(F.array_distinct(inside)).alias("phrase"), F.col("a").alias("longest"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longest").alias("longest"))
    kept = found.join(longer, ["lang", "phrase"], "left")
    return kept.where(100 * F.coalesce("longest", F.lit(0)) < share * F.col("a")).drop("longest")


def top_of_each(found: DataFrame, top: int = TOP) -> DataFrame:
    """found with rank, the first top of each language: first of its parts, so that no task ranks a whole language."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    few = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most_words: int = MOST_WORDS, least: int = LEAST, top: int = TOP, width: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first phrases. least is 255 at most."""
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if width is None:
        held = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        width = min(MOST_WIDTH, max(LEAST_WIDTH, 1 << (held // CELL_BYTES).bit_length()))
    bits = sketched(texts, width, least, most_words)
    counts = written(phrase_counts(texts, bits, width, least, most_words), "phrase-counts")
    found = written(scored(counts), "phrase-scores")
    ranked = top_of_each(not_subsumed(found, most_words), top)
    totals = counts.where("size = 0").select("lang", F.col("n").alias("n"))
    out = written(ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "phrase-top")
    discard(counts, found)
    return out
