"""An index of unit vectors by coarse cells, with searches that are exact or stop after some cells.

Cells are fitted on SAMPLE vectors of lowest hash. Every chunk is stored with its cell, the nearest centroid, and a cell with its radius, the largest
distance of its vectors from the centroid; vectors of other lengths than most are in one cell to each length. For a query a cell can hold no
cosine above what centroid and radius allow. A search takes the nearest cells first; an exact one then takes all other cells whose bound is not below
the query's limit-th best score so far, so what it leaves out cannot be among the best.

Neighbouring cells make groups, which grow with the chunks while there are tasks to spare, up to PART numbers of vectors. A query goes once to each group in which
it asks a cell, with a bit for each cell, and gets the best rows of the group back: what is shuffled grows with queries times groups, not cells. A chunk goes
out once for each QUERY_TILE numbers of queries that ask its group, and not at all if none does. A cell beyond a group is dealt in parts, so a task holds a part
and a tile. Filters are put on the chunks before, and with a column scope queries meet chunks of theirs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructField, StructType

SAMPLE, ROUNDS = 8192, 6
#: Cells at most; they and their radii are what is broadcast and held by the driver.
MOST_CELLS = 4096
#: Numbers (vectors times their length) of the chunks of a group or part and of a tile of queries at most, and chunks of a group at least.
PART, QUERY_TILE, LEAST_PART = 1 << 22, 1 << 21, 4096
#: Scores held at a time.
STRIP = 1 << 22
#: Nearest cells: of the first round of an exact search, and of one that is not exact. A first round takes cells of FIRST_CHUNKS chunks
#: at least, as one of fewer costs no less.
FIRST_CELLS, PROBES = 8, 32
FIRST_CHUNKS = 1 << 14
SLACK = 1e-7


def unit(vectors: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def away(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Distances of unit vectors (rows) from centroids (columns)."""
    squares = (vectors**2).sum(1)[:, None] + (centroids**2).sum(1)[None] - 2 * vectors @ centroids.T
    return np.sqrt(np.maximum(squares, 0))


def fitted(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Means of unit vectors that are nearest to each other, from the first as they come."""
    centroids = sample[:cells].copy()
    for _ in range(rounds):
        nearest = away(sample, centroids).argmin(1)
        n = np.bincount(nearest, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


@dataclass(frozen=True)
class VectorIndex:
    """chunks: the rows given, with cell and away. cells: (cell, n), a row to a cell, and sizes the same. radii: by cell number."""

    chunks: DataFrame
    cells: DataFrame
    sizes: dict[int, int]
    centroids: np.ndarray
    radii: np.ndarray
    n: int


def bounds(vectors: np.ndarray, centroids: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """The highest cosine that each cell allows each query (row)."""
    gap = np.maximum(0.0, away(unit(vectors), centroids) - radii[None])
    return 1 - gap**2 / 2


def by_length(vectors: pd.Series) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, vectors) of the vectors that can be compared: neither missing nor zero."""
    lengths = vectors.map(lambda v: -1 if v is None else len(v)).to_numpy()
    out = []
    for dim in sorted(set(lengths) - {-1, 0}):
        at = np.flatnonzero(lengths == dim)
        held = np.stack(vectors.to_numpy()[at]).astype(np.float64)
        norms = np.linalg.norm(held, axis=1)
        good = np.isfinite(norms) & (norms > 0)
        out.append((dim, at[good], held[good]))
    return out


def build(chunks: DataFrame, n_chunks: int, keep: Callable[[DataFrame], DataFrame], vector_col: str = "vector") -> VectorIndex:
    """An index of chunks (chunk_id, vector, others); n_chunks sets the number of cells. keep makes a table stand, so that it is not computed anew."""
    sample = [r[0] for r in chunks.select("chunk_id", vector_col).where(F.size(vector_col) > 0).orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE).select(vector_col).collect()]
    lengths = [len(v) for v in sample]
    dim = max(set(lengths), key=lengths.count, default=1)
    held = by_length(pd.Series([v for v in sample if len(v) == dim], dtype=object))
    train = unit(held[0][2]) if held else np.zeros((0, dim))
    n_cells = int(min(MOST_CELLS, max(1, n_chunks**0.5), max(1, len(train))))
    centroids = fitted(train, n_cells) if len(train) else np.zeros((1, dim))

    @F.pandas_udf(StructType([StructField("cell", IntegerType()), StructField("away", DoubleType())]))
    def place(vectors: pd.Series) -> pd.DataFrame:
        cell, gap = np.full(len(vectors), np.nan), np.full(len(vectors), np.nan)
        for length, at, v in by_length(vectors):
            if length == dim:
                d = away(unit(v), centroids)
                cell[at] = d.argmin(1)
                gap[at] = d.min(1)
            else:
                cell[at] = -length
        return pd.DataFrame({"cell": pd.array(cell, dtype="Int32"), "away": gap})

    # Cells hold no vector that is missing or zero, which is like nothing.
    placed = keep(chunks.withColumn("_at", place(F.col(vector_col))).select(*chunks.columns, "_at.cell", "_at.away").where("cell is not null"))
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"))
    radii = np.zeros(len(centroids))
    stats = cells.collect()  # a row to a cell
    for r in stats:
        if r.cell >= 0:
            radii[r.cell] = r.radius + SLACK
    known = placed.sparkSession.createDataFrame([(r.cell, r.n) for r in stats], "cell int, n long")
    return VectorIndex(placed, known, {r.cell: r.n for r in stats}, centroids, radii, sum(r.n for r in stats))


def groups(index: VectorIndex, tasks: int) -> list[tuple[list[int], int]]:
    """(cells, parts): cells that are near each other along the widest direction, together of a group's size; or one cell in parts of that size."""
    wide = index.centroids - index.centroids.mean(0)
    along = wide @ np.linalg.svd(wide, full_matrices=False)[2][0]
    most = max(1, PART // index.centroids.shape[1])
    room = min(most, max(LEAST_PART, -(-index.n // tasks)))
    out: list[tuple[list[int], int]] = []
    held = room
    for cell in sorted(index.sizes, key=lambda c: (c < 0, along[c] if c >= 0 else -c)):
        n = index.sizes[cell]
        if held + n > room:
            out.append(([], max(1, -(-n // most))))
            held = 0
        out[-1][0].append(cell)
        held += n
    return out


def asked_cells(index: VectorIndex, of_groups: Sequence[tuple[list[int], int]], first: int, rest: bool):
    """A function of query vectors and least scores: their nearest cells, or with rest the others whose bound is not below the score; by group, as bits."""
    centroids, radii, dim = index.centroids, index.radii, index.centroids.shape[1]
    members = [np.array(cells) for cells, _ in of_groups]
    kind = ArrayType(StructType([StructField("group", IntegerType()), StructField("cells", BinaryType())]))

    def told(cells: np.ndarray) -> list[dict]:
        wanted = np.zeros(len(centroids), bool)
        wanted[cells[cells >= 0]] = True
        out = []
        for g, own in enumerate(members):
            bits = np.where(own >= 0, wanted[own], np.isin(own, cells))
            if bits.any():
                out.append({"group": g, "cells": np.packbits(bits).tobytes()})
        return out

    @F.pandas_udf(kind)
    def cells(vectors: pd.Series, least: pd.Series) -> pd.Series:
        out: list[list[dict] | None] = [None] * len(vectors)
        for length, at, v in by_length(vectors):
            if length != dim:
                for i in at:
                    out[i] = [] if rest else told(np.array([-length]))
                continue
            allowed = bounds(v, centroids, radii)
            order = np.argsort(away(unit(v), centroids), axis=1, kind="stable")
            for i, row, places in zip(at, allowed, order, strict=True):
                later = places[first:]
                out[i] = told(later[row[later] + SLACK >= least.iloc[i]] if rest else places[:first])
        return pd.Series(out, dtype=object)

    return cells


def best_of_tile(chunks: pd.DataFrame, queries: pd.DataFrame, limit: int, by_program: bool, digits: int) -> pd.DataFrame:
    """The best limit rows for each query (qid, vector, cells, least): chunks (chunk_id, program, vector, place of the cell), or the best chunk of each program.

    Only chunks of the cells that a query asks, and no scores below its least. Ties go to the lower id.
    """
    chunks = chunks.sort_values(["program", "chunk_id"] if by_program else "chunk_id")
    ids, programs, places = (chunks[c].to_numpy() for c in ("chunk_id", "program", "place"))
    n_cells = places.max() + 1
    wants = np.stack([np.unpackbits(np.frombuffer(x, np.uint8))[:n_cells] for x in queries["cells"]]).astype(bool)
    ours = {length: (at, v, np.linalg.norm(v, axis=1)) for length, at, v in by_length(chunks["vector"])}
    theirs = by_length(queries["vector"])
    asked, floor = queries["qid"].to_numpy(), queries["least"].to_numpy() - SLACK
    out: list[tuple] = []
    for length, at, q in theirs:
        if length not in ours:
            continue
        to, c, norms = ours[length]
        near = np.lexsort((asked[at], wants[at].argmax(1)))  # queries of a strip ask much the same cells
        strip = max(1, STRIP // len(to))
        for low in range(0, len(at), strip):
            mine = near[low : low + strip]
            wanted = wants[at[mine]]
            some = np.flatnonzero(wanted.any(0)[places[to]])
            if not len(some):
                continue
            cols, whole = to[some], len(some) == len(to)
            scores = q[mine] @ (c if whole else c[some]).T
            scores /= np.linalg.norm(q[mine], axis=1)[:, None] * (norms if whole else norms[some])
            scores = np.round(scores, digits)
            if not wanted[:, np.unique(places[cols])].all():
                scores[~wanted[:, places[cols]]] = -np.inf
            tops = np.maximum.reduceat(scores, np.flatnonzero(np.r_[True, programs[cols][1:] != programs[cols][:-1]]), axis=1) if by_program else scores
            least = np.maximum(floor[at[mine]], np.partition(tops, -limit, axis=1)[:, -limit] if tops.shape[1] > limit else -np.inf)
            row, k = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
            score, k = scores[row, k], cols[k]
            order = np.lexsort((ids[k], -score, row))
            row, k, score = row[order], k[order], score[order]
            if by_program:
                one = np.lexsort((np.arange(len(row)), programs[k], row))
                one = one[np.r_[True, (row[one][1:] != row[one][:-1]) | (programs[k[one]][1:] != programs[k[one]][:-1])][: len(one)]]
                one = one[np.lexsort((programs[k[one]], -score[one], row[one]))]
                row, k, score = row[one], k[one], score[one]
            best = np.arange(len(row)) - np.searchsorted(row, row) < limit
            out.append((asked[at[mine[row[best]]]], programs[k[best]], ids[k[best]], score[best]))
    names = [x.split()[0] for x in FOUND.split(", ")]
    return pd.DataFrame({n: np.concatenate(x) if out else [] for n, x in zip(names, zip(*out, strict=True) if out else [[]] * 4, strict=True)})


FOUND = "qid long, program long, chunk_id long, score double"


def met(index: VectorIndex, of_groups: Sequence[tuple[list[int], int]], chunks: DataFrame, queries: DataFrame, limit: int, by_program: bool, digits: int) -> DataFrame:
    """qid, program, chunk_id, score of queries (qid, vector, asked, least): the best rows of each part of each group in which they ask cells."""
    scope = ["scope"] * ("scope" in queries.columns)
    asked = queries.select("qid", "vector", "least", *scope, F.inline("asked"))
    tile = max(1, QUERY_TILE // index.centroids.shape[1])
    known = [(cell, g, place, parts) for g, (cells, parts) in enumerate(of_groups) for place, cell in enumerate(cells)]
    known = chunks.sparkSession.createDataFrame(known, "cell int, group int, place int, parts long")
    tiles = asked.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / tile).alias("tiles"))
    sizes = F.broadcast(known.join(tiles, "group"))  # a row to a cell, MOST_CELLS and some
    key = [*scope, "group", "i", "j"]
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    left = chunks.select("chunk_id", "program", "vector", "cell", *scope).join(sizes, "cell").drop("cell")
    left = left.withColumn("i", F.pmod(F.xxhash64("chunk_id"), "parts")).withColumn("j", every(F.col("tiles")))
    right = asked.join(F.broadcast(known.select("group", "parts").distinct().join(tiles, "group")), "group")
    right = right.withColumn("j", F.pmod(F.xxhash64("qid"), "tiles")).withColumn("i", every(F.col("parts")))

    def run(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if len(c) and len(q):
            return best_of_tile(c, q, limit, by_program, digits)
        return pd.DataFrame({"qid": [], "program": [], "chunk_id": [], "score": []})

    return left.drop("tiles", "parts").groupBy(*key).cogroup(right.drop("tiles", "parts").groupBy(*key)).applyInPandas(run, FOUND)


def best_programs(found: DataFrame) -> DataFrame:
    """The best chunk of each program for each query; dealt by query, as they are ranked afterwards."""
    top = F.min(F.struct((-F.col("score")).alias("s"), "chunk_id")).alias("b")
    return found.repartition("qid").groupBy("qid", "program").agg(top).select("qid", "program", "b.chunk_id", (-F.col("b.s")).alias("score"))


def search(index: VectorIndex, queries: DataFrame, limit: int, keep: Callable[[DataFrame], DataFrame], rank: Callable[[DataFrame], DataFrame], only: Callable[[DataFrame], DataFrame] = lambda rows: rows, by_program: bool = False, exact: bool = True, probes: int | None = None, digits: int = 9) -> DataFrame:
    """The best limit rows of each query (qid, vector), ranked by rank. Exact, or within its probes nearest cells.

    only filters chunks within their cells, and may give them a scope.
    """
    chunks, probes = only(index.chunks), probes or (max(FIRST_CELLS, -(-FIRST_CHUNKS * len(index.centroids) // max(1, index.n))) if exact else PROBES)
    of_groups = groups(index, 2 * chunks.sparkSession.sparkContext.defaultParallelism)
    level = best_programs if by_program else lambda rows: rows
    none = F.lit(-2.0)
    first = queries.withColumns({"asked": asked_cells(index, of_groups, probes, False)("vector", none), "least": none})
    first = rank(level(met(index, of_groups, chunks, first, limit, by_program, digits)))
    if not exact or probes >= len(index.centroids):
        return first
    first = keep(first)
    reached = first.where(F.col("rank") == limit).select("qid", F.col("score").alias("least"))
    left = queries.join(reached, "qid", "left").withColumn("least", F.coalesce("least", none))
    left = left.withColumn("asked", asked_cells(index, of_groups, probes, True)("vector", "least"))
    return rank(level(met(index, of_groups, chunks, left, limit, by_program, digits).unionByName(first.drop("rank"))))


def recall(found: DataFrame, exact: DataFrame, on: Sequence[str] = ("qid", "chunk_id")) -> float:
    """Share of the rows of an exact search that another one found."""
    held = exact.select(*on).join(found.select(*on).withColumn("_hit", F.lit(1)), list(on), "left")
    return held.agg(F.avg(F.coalesce("_hit", F.lit(0)))).first()[0]
