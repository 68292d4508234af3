"""A sparse inverted index: postings of each token in blocks of falling weight, and exact searches that skip by bounds.

A token's postings are sorted by weight and cut into blocks of BLOCK, each with its highest weight, so a frequent token is spread over tasks. A query first
reads its rarest tokens, up to FIRST postings, and scores the chunks it finds there whole: the limit-th best is a score that it need not go below. By
MaxScore, tokens whose bounds (the query's count times the token's highest weight) stay below that score even in sum cannot bring a chunk in alone; those of the
most postings for their bound are skipped first. Only the others' blocks are read; a chunk found there is dropped if what it has and what the skipped tokens
could add stay below; for the rest the skipped tokens are looked up. All steps are equi-joins on tokens, blocks and chunks; no matrix of queries and tokens is made.

That shuffles a row for each posting that a query reads, which for MANY queries or more grows with queries times chunks. Then parts of the chunks, each a row with its
tokens, meet tiles of the queries as products in the tasks; what is shuffled is each chunk once a tile, each query once a part, and the best rows of each part.
Blocks are made when a search of fewer queries first asks for them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.segments import RANGE, in_ranges, running

BLOCK = 1024
FIRST = 128
#: Room for scores that were rounded.
SLACK = 2e-9
#: A query whose tokens have so many postings together, or fewer, reads them all: that is less work than finding what to skip.
DIRECT = 100_000
#: Queries from which a search goes by products of parts and tiles, the most chunks and queries of these, and the fewest chunks of a part while there are tasks to spare.
MANY = 32
PART, TILE, LEAST_PART = 16384, 16384, 2048
#: Queries of a product at a time, tokens of one, and rows of what is expanded for the others.
STRIP, DENSE, EXPANDED = 256, 1024, 1 << 21
FOUND = "qid long, program long, chunk_id long, score double"


@dataclass(frozen=True)
class SparseIndex:
    """listed: chunk_id, program, tokens, weights, a row to a chunk. tokens: token, n, highest weight. seed: no two tokens have one hash by it."""

    listed: DataFrame
    tokens: DataFrame
    seed: int
    keep: Callable[[DataFrame], DataFrame]
    block: int

    @cached_property
    def postings(self) -> DataFrame:
        """chunk_id, program, token, weight, block."""
        rows = self.listed.select("chunk_id", "program", F.inline(F.arrays_zip(F.col("tokens").alias("token"), F.col("weights").alias("weight"))))
        order = ["_falls", "chunk_id"]
        placed = in_ranges(rows.withColumn("_falls", -F.col("weight")), ["token"], order)
        rows = running(placed, ["token"], order, sums={"_place": F.lit(1)}).withColumn("block", F.floor((F.col("_place") - 1) / self.block)).drop("_place", "_falls", RANGE)
        return self.keep(rows)

    @cached_property
    def blocks(self) -> DataFrame:
        """token, block, top: a row to a block."""
        return self.keep(self.postings.groupBy("token", "block").agg(F.max("weight").alias("top")))


def build(weights: DataFrame, keep: Callable[[DataFrame], DataFrame], block: int = BLOCK) -> SparseIndex:
    """An index of (chunk_id, program, token, weight), weights positive."""
    rows = weights.groupBy("chunk_id", "program").agg(F.collect_list(F.struct("token", "weight")).alias("x"))
    return of_lists(rows.select("chunk_id", "program", F.col("x.token").alias("tokens"), F.col("x.weight").alias("weights")), keep, block)


def of_lists(rows: DataFrame, keep: Callable[[DataFrame], DataFrame], block: int = BLOCK) -> SparseIndex:
    """An index of (chunk_id, program, tokens, weights), a row to a chunk, weights positive."""
    rows = keep(rows)
    each = rows.select(F.inline(F.arrays_zip(F.col("tokens").alias("token"), F.col("weights").alias("weight"))))
    tokens = keep(each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("most")))
    twice = lambda seed: tokens.groupBy(F.xxhash64("token", F.lit(seed))).count().where("count > 1").isEmpty()
    return SparseIndex(rows, tokens, next(seed for seed in count() if twice(seed)), keep, block)


def best_programs(scored: DataFrame) -> DataFrame:
    top = F.min(F.struct((-F.col("score")).alias("s"), "chunk_id")).alias("b")
    return scored.repartition("qid").groupBy("qid", "program").agg(top).select("qid", "program", "b.chunk_id", (-F.col("b.s")).alias("score"))


def summed(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("qid", "chunk_id", "program").agg(F.sum("part").alias("score"))


def search(index: SparseIndex, queries: DataFrame, limit: int, keep: Callable[[DataFrame], DataFrame], rank: Callable[[DataFrame], DataFrame], only: Callable[[DataFrame], DataFrame] = lambda rows: rows, by_program: bool = False, digits: int = 9) -> DataFrame:
    """The best limit rows of each query (qid, token, count), ranked by rank: chunks that share a token, by the sum of count times weight.

    only filters postings, and may give them a scope; queries with a scope then meet those of theirs. Bounds are those of all chunks, so they hold.
    """
    n_queries = queries.agg(F.count_distinct("qid")).first()[0]
    if n_queries >= MANY:
        return rank(products(index, queries, n_queries, limit, only, by_program, digits))
    scope = ["scope"] * ("scope" in queries.columns)
    each = Window.partitionBy("qid")
    asked = queries.join(index.tokens, "token").withColumn("bound", F.col("count") * F.col("most")).withColumn("_all", F.sum("n").over(each))
    allowed = only(index.postings)
    level = best_programs if by_program else lambda rows: rows
    rounded = lambda rows: rows.withColumn("score", F.round("score", digits))

    # The rarest tokens, each read whole, as long as they have FIRST postings together; one at least.
    rarest = Window.partitionBy("qid").orderBy("n", "token")
    early = asked.where(F.col("_all") > DIRECT).withColumn("_read", F.sum("n").over(rarest.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_k", F.row_number().over(rarest))
    early = early.where((F.col("_read") <= FIRST) | (F.col("_k") == 1)).select("qid", "token", *scope)
    seen = allowed.join(early, ["token", *scope]).select("qid", "chunk_id", "program").distinct()
    whole = seen.join(index.postings.select("chunk_id", "token", "weight"), "chunk_id").join(asked.select("qid", "token", "count"), ["qid", "token"])
    sample = level(rounded(summed(whole.select("qid", "chunk_id", "program", (F.col("count") * F.col("weight")).alias("part")))))
    least = rank(sample).where(F.col("rank") == limit).select("qid", F.col("score").alias("least"))

    # MaxScore: tokens whose bounds stay below in sum, those first that have the most postings for it. Of the others, blocks that stay below even with all else that the query could get.
    rising = each.orderBy(F.col("bound") / F.col("n"), "token").rowsBetween(Window.unboundedPreceding, 0)
    split = asked.join(least, "qid", "left").withColumns({"least": F.coalesce("least", F.lit(0.0)), "upto": F.sum("bound").over(rising), "all": F.sum("bound").over(each)})
    split = keep(split.withColumn("needed", F.col("upto") + SLACK >= F.col("least")))
    rest = split.groupBy("qid").agg(F.max("least").alias("least"), F.coalesce(F.sum(F.when(~F.col("needed"), F.col("bound"))), F.lit(0.0)).alias("more"))
    needed = split.where("needed").join(index.blocks, "token").where(F.col("all") - F.col("bound") + F.col("count") * F.col("top") + SLACK >= F.col("least"))
    pairs = allowed.join(needed.select("qid", "token", "count", "block", *scope), ["token", "block", *scope]).select("qid", "chunk_id", "program", (F.col("count") * F.col("weight")).alias("part"))
    # A chunk of a block that was left out stays below the score whatever else it has, so what it lacks there does not matter.
    alive = summed(pairs).join(rest, "qid").where(F.col("score") + F.col("more") + SLACK >= F.col("least"))
    alive = alive.select("qid", "chunk_id", "program", "score")
    skipped = split.where("not needed").select("qid", "token", "count")
    later = alive.select("qid", "chunk_id", "program").join(skipped, "qid").join(index.postings.select("chunk_id", "token", "weight"), ["chunk_id", "token"])
    later = later.select("qid", "chunk_id", "program", (F.col("count") * F.col("weight")).alias("part"))
    # Dealt anew, as Spark 4.1 does not always keep the order of parts that it takes a union for.
    total = summed(alive.withColumnRenamed("score", "part").unionByName(later).repartition("qid", "chunk_id"))
    return rank(level(rounded(total)))


def products(index: SparseIndex, queries: DataFrame, n_queries: int, limit: int, only: Callable[[DataFrame], DataFrame], by_program: bool, digits: int) -> DataFrame:
    """qid, program, chunk_id, score: the best rows of each part of the chunks, or of all parts by program."""
    scope = ["scope"] * ("scope" in queries.columns)
    # Tokens are told by hashes, of which those of the index's tokens differ; queries keep no others.
    hashed = lambda token: F.xxhash64(token, F.lit(index.seed))
    chunks = only(index.listed).select("chunk_id", "program", *scope, F.transform("tokens", hashed).alias("ids"), F.col("weights").alias("values"))
    known = queries.join(index.tokens.select("token"), "token").groupBy("qid", *scope).agg(F.collect_list(F.struct(hashed(F.col("token")).alias("id"), "count")).alias("x"))
    asked = known.select("qid", *scope, F.col("x.id").alias("ids"), F.col("x.count").alias("values"))
    # A part grows with the chunks while there are tasks to spare, so that queries go to as many parts.
    n_chunks, tasks = chunks.select("chunk_id").count(), 2 * chunks.sparkSession.sparkContext.defaultParallelism
    tiles = -(-n_queries // TILE)
    parts = max(-(-n_chunks // PART), min(-(-tasks // tiles), -(-n_chunks // LEAST_PART)), 1)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    left = chunks.withColumn("i", dealt("chunk_id", parts)).withColumn("j", every(tiles))
    right = asked.withColumn("j", dealt("qid", tiles)).withColumn("i", every(parts))
    key = [*scope, "i", "j"]

    def run(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        return best_of_part(c, q, limit, by_program, digits)

    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(run, FOUND)
    return best_programs(found) if by_program else found


def flat(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, value) of the lists of rows."""
    lengths = rows["ids"].map(len).to_numpy()
    return np.repeat(np.arange(len(rows)), lengths), np.concatenate(rows["ids"].to_numpy()).astype(np.int64), np.concatenate(rows["values"].to_numpy()).astype(np.float64)


def scored_strips(c: pd.DataFrame, q: pd.DataFrame):
    """(first query, scores of STRIP queries and all chunks). Frequent tokens are products of matrices, pairs of the others are expanded and summed."""
    at, cid, weight = flat(c)
    of, qid, times = flat(q)
    names = np.unique(qid)
    place = np.minimum(np.searchsorted(names, cid), len(names) - 1)
    held = names[place] == cid
    order = np.argsort(place[held], kind="stable")
    at, token, weight = at[held][order], place[held][order], weight[held][order]
    begins, asked = np.searchsorted(token, np.arange(len(names) + 1)), np.searchsorted(names, qid)
    n_held = np.diff(begins)
    for first in range(0, len(q), STRIP):
        n = min(STRIP, len(q) - first)
        mine = (of >= first) & (of < first + n)
        row, tok, count = of[mine] - first, asked[mine], times[mine]
        scores = np.zeros((n, len(c)))
        frequent = np.flatnonzero(np.bincount(tok, minlength=len(names)) * n_held > n * len(c) // 200)
        for low in range(0, len(frequent), DENSE):
            some = frequent[low : low + DENSE]
            spot = np.full(len(names), -1)
            spot[some] = np.arange(len(some))
            a, b = np.zeros((n, len(some))), np.zeros((len(some), len(c)))
            hit = spot[tok] >= 0
            a[row[hit], spot[tok[hit]]] = count[hit]
            hit = spot[token] >= 0
            b[spot[token[hit]], at[hit]] = weight[hit]
            scores += a @ b
        rare = np.ones(len(names), bool)
        rare[frequent] = False
        rare = rare[tok] & (n_held[tok] > 0)
        row, tok, count = row[rare], tok[rare], count[rare]
        lengths = n_held[tok]
        ends = np.cumsum(lengths)
        low = 0
        while low < len(tok):
            before = ends[low] - lengths[low]
            high = max(low + 1, int(np.searchsorted(ends, before + EXPANDED, "right")))
            part = slice(low, high)
            k = np.arange(ends[high - 1] - before) + np.repeat(begins[tok[part]] - (ends[part] - lengths[part] - before), lengths[part])
            cell = np.repeat(row[part], lengths[part]) * len(c) + at[k]
            scores += np.bincount(cell, np.repeat(count[part], lengths[part]) * weight[k], n * len(c)).reshape(n, -1)
            low = high
        yield first, scores


def best_of_part(c: pd.DataFrame, q: pd.DataFrame, limit: int, by_program: bool, digits: int) -> pd.DataFrame:
    """The best limit rows for each query: chunks that share a token, or the best chunk of each program. Ties go to the lower id."""
    out: list[tuple] = []
    if len(c) and len(q):
        c = c.sort_values(["program", "chunk_id"])
        ids, programs, asked = c["chunk_id"].to_numpy(), c["program"].to_numpy(), q["qid"].to_numpy()
        begins = np.flatnonzero(np.r_[True, programs[1:] != programs[:-1]])
        for first, scores in scored_strips(c, q):
            scores = np.round(scores, digits)
            for k, row in enumerate(scores):
                tops = np.maximum.reduceat(row, begins) if by_program else row
                least = np.partition(tops, -limit)[-limit] if len(tops) > limit else 0.0
                near = np.flatnonzero((row >= least) & (row > 0))
                near = near[np.lexsort((ids[near], -row[near]))]
                if by_program:
                    near = near[np.sort(np.unique(programs[near], return_index=True)[1])]
                    near = near[np.lexsort((programs[near], -row[near]))]
                near = near[:limit]
                out.append((np.full(len(near), asked[first + k]), programs[near], ids[near], row[near]))
    names = [x.split()[0] for x in FOUND.split(", ")]
    return pd.DataFrame({n: np.concatenate(x) if out else [] for n, x in zip(names, zip(*out, strict=True) if out else [[]] * 4, strict=True)})
