"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors of cosine c or more are within squared distance 2 - 2c. Rotated vectors are split into blocks; a pair within that
distance is, in one block at least, within the block's proportional share of it. Each block is range-joined under its share, and the union
of candidates is verified exactly, by the cosine of the vectors as given, in double precision.

Vectors of a label are cut into tiles of about TILE: in the order of cells, which are intervals of each block's first coordinate, so that a
tile is narrow in these. Two tiles meet once, if the gaps between their intervals leave a pair within the distance; in the task that
they meet in, all blocks are joined as matrix products in strips. A task holds two tiles whatever the label, and returns for each of
their vectors the number of links and one link towards its smallest relative: rows in proportion to the tiles, never their pairs. The rotation
is that of the principal axes of SAMPLE vectors, dealt to the blocks in turn; it only decides how many tiles meet, never which pairs are found.

Equal vectors of a label are one vector with a multiplicity from the start. Vectors that are null, empty, zero or that hold null or
non-finite components link with nothing, nor do rows without a label, nor vectors of different lengths. Repeated rows are vectors of their
own and link with each other, as are rows of one id with different vectors. Rows with a null id are vectors like others: they count as
links, and may join others into a component; its id is the smallest there is, null if there is none, and then the row is kept. Only the named
columns are read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tessera.llm.common import connected_components, discard, mapped_with_id, written

COSINE = 0.93
BLOCKS = 4
TILE = 1024
STRIP = 256
#: Added to budgets against rounding in single precision; the exact check follows.
SLACK = 1e-5
SAMPLE = 4096
ROTATION_SEED = 7
Turns = Mapping[int, np.ndarray]


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(ROTATION_SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def block_edges(dim: int, blocks: int = BLOCKS) -> list[tuple[int, int]]:
    cuts = np.linspace(0, dim, min(blocks, dim) + 1).astype(int).tolist()
    return list(zip(cuts, cuts[1:], strict=False))


def budgets(dim: int, cosine: float, blocks: int = BLOCKS) -> list[float]:
    """Squared distance that each block may use: its share of 2 - 2 cosine by its dimensions."""
    return [(2 - 2 * cosine) * (b - a) / dim for a, b in block_edges(dim, blocks)]


def principal_turns(sample: list[np.ndarray]) -> dict[int, np.ndarray]:
    """A rotation for each length of the sample's vectors: principal axes, widest first, dealt to the blocks in turn."""
    turns = {}
    for dim in {len(v) for v in sample}:
        x = np.stack([v / np.linalg.norm(v) for v in sample if len(v) == dim])
        axes = np.linalg.eigh(np.cov(x.T, bias=True).reshape(dim, dim))[1][:, ::-1].T
        edges = block_edges(dim)
        places = sorted(range(dim), key=lambda p: next((p - a, a) for a, b in edges if a <= p < b))
        turns[dim] = np.empty((dim, dim))
        turns[dim][places] = axes
    return turns


def keyed(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) with a digest of label and vector; null where the vector can link with nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            digests = []
            for label, vector in zip(batch.label, batch.embedding, strict=True):
                digest = None
                if label is not None and vector is not None and len(vector):
                    v = np.array([np.nan if x is None else x for x in vector] if getattr(vector, "dtype", object) == object else vector, dtype=np.float64)
                    if np.isfinite(v).all() and v.any() and np.isfinite(v @ v) and v @ v > 0:
                        digest = hashlib.blake2b((v + 0.0).tobytes() + label.encode(), digest_size=16).digest()
                digests.append(digest)
            yield pd.DataFrame({"vec_id": batch.vec_id, "label": batch.label, "digest": digests, "embedding": batch.embedding.where(pd.Series(digests, index=batch.index).notna(), None)})

    as_text = vectors.withColumn("label", F.col("label").cast("string"))
    found = mapped_with_id(as_text, "vec_id", run, f"label string, digest binary, embedding {vectors.schema['embedding'].dataType.simpleString()}")
    return found.withColumn("label", F.col("label").cast("long"))


def placed(vectors: DataFrame, turns: Turns, cosine: float) -> DataFrame:
    """vectors with dim, z (the first coordinate of each block) and cell (the intervals of z, as wide as the distance)."""
    width = np.sqrt(2 - 2 * cosine + SLACK)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby(batch.embedding.map(len)):
                x = np.stack(part.embedding.to_numpy()).astype(np.float64)
                turn = turns.get(dim, rotation(dim))[[a for a, _ in block_edges(dim)]]
                z = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ turn.T
                yield part.assign(dim=dim, z=list(z), cell=list(np.floor(z / width).astype(np.int32)))

    more = StructType.fromDDL("dim int, z array<double>, cell array<int>")
    return vectors.mapInPandas(run, StructType([*vectors.schema, *more]))


def settle(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes by the links (a, b)."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if np.array_equal(new, low):
            return low
        low = new


def tile_links(pair: pd.DataFrame, turns: Turns, cosine: float) -> pd.DataFrame:
    """(digest, links, peer) of the vectors of two tiles (side 0 and 1), or of one tile with itself (side 0), that have links there."""
    pair = pair.sort_values("digest", kind="stable")
    dim, side = int(pair.dim.iloc[0]), pair.side.to_numpy()
    x = np.stack(pair.embedding.to_numpy()).astype(np.float64)
    norms = np.linalg.norm(x, axis=1)
    turned = ((x / norms[:, None]) @ turns.get(dim, rotation(dim)).T).astype(np.float32)
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if side.any() else left
    edges, allowed = block_edges(dim), budgets(dim, cosine)
    squares = [(turned[:, s:e] ** 2).sum(1) for s, e in edges]
    found_i, found_j = [left[:0]], [left[:0]]
    for at in range(0, len(left), STRIP):
        rows = left[at : at + STRIP]
        near = np.zeros((len(rows), len(right)), dtype=bool)
        for (s, e), square, most in zip(edges, squares, allowed, strict=True):
            near |= square[rows][:, None] + square[right][None] - 2 * turned[rows, s:e] @ turned[right, s:e].T <= most + SLACK
        if right is left:
            near &= rows[:, None] < left[None]
        i, j = np.nonzero(near)
        i, j = rows[i], right[j]
        held = np.einsum("ij,ij->i", x[i], x[j]) / (norms[i] * norms[j]) >= cosine
        found_i.append(i[held])
        found_j.append(j[held])
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    copies, links = pair.copies.to_numpy(), np.zeros(len(x), dtype=np.int64)
    np.add.at(links, i, copies[j])
    np.add.at(links, j, copies[i])
    digests = pair.digest.to_numpy()
    linked = links > 0
    return pd.DataFrame({"digest": digests[linked], "links": links[linked], "peer": digests[settle(len(x), i, j)[linked]]})


def tiled(vectors: DataFrame, tile: int) -> DataFrame:
    """placed() vectors with the number of their tile in label and dim."""
    key = ["label", "dim"]
    cells = vectors.groupBy(*key, "cell").agg(F.count(F.lit(1)).alias("held"))
    before = F.sum("held").over(Window.partitionBy(*key).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    starts = cells.withColumn("start", F.coalesce(before, F.lit(0)))
    at = F.col("start") + F.pmod(F.xxhash64("digest"), F.col("held"))
    return vectors.join(starts, [*key, "cell"]).withColumn("tile", F.floor(at / tile).cast("long")).drop("held", "start", "cell")


def meeting(tiles: DataFrame, cosine: float) -> DataFrame:
    """(label, dim, i, j, side, tile): the pairs i <= j of tiles that can hold a link, a row for each side."""
    span = [f(F.get("z", F.lit(b))).alias(f"{n}{b}") for b in range(BLOCKS) for f, n in ((F.min, "lo"), (F.max, "hi"))]
    spans = written(tiles.groupBy("label", "dim", "tile").agg(*span), "vector-spans")
    left, right = spans.withColumnRenamed("tile", "i").alias("l"), spans.withColumnRenamed("tile", "j").alias("r")
    gaps = [F.greatest(F.lit(0.0), F.col(f"l.lo{b}") - F.col(f"r.hi{b}"), F.col(f"r.lo{b}") - F.col(f"l.hi{b}")) for b in range(BLOCKS)]
    apart = sum((F.coalesce(g * g, F.lit(0.0)) for g in gaps), F.lit(0.0))
    pairs = left.join(right, (F.col("l.label") == F.col("r.label")) & (F.col("l.dim") == F.col("r.dim")) & (F.col("i") <= F.col("j")) & (apart <= 2 - 2 * cosine + SLACK))
    sides = F.posexplode(F.when(F.col("i") == F.col("j"), F.array("i")).otherwise(F.array("i", "j"))).alias("side", "tile")
    return pairs.select("l.label", "l.dim", "i", "j", sides)


def link_vectors(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("embedding"))
    drawn = written(keyed(rows), "vectors")
    distinct = drawn.where("digest is not null").groupBy("digest").agg(
        F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding")
    )
    distinct = written(distinct, "vector-classes")
    sample = distinct.select("digest", "embedding").orderBy("digest").limit(SAMPLE).collect()
    turns = principal_turns([np.asarray(r.embedding, np.float64) for r in sample])
    tiles = written(tiled(placed(distinct.drop("id"), turns, cosine), tile), "vector-tiles")
    met = tiles.drop("z").join(meeting(tiles, cosine), ["label", "dim", "tile"])
    parts = met.groupBy("label", "dim", "i", "j").applyInPandas(lambda pdf: tile_links(pdf, turns, cosine), "digest binary, links long, peer binary")
    parts = written(parts, "vector-links")
    discard(tiles)
    counts = parts.groupBy("digest").agg(F.sum("links").alias("links"))
    comps = written(connected_components(None, parts.select(F.col("digest").alias("a"), F.col("peer").alias("b")), "vector"), "vector-components")
    known = distinct.join(counts, "digest", "left").join(comps.withColumnRenamed("id", "digest"), "digest", "left")
    known = known.select("digest", "id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "digest").alias("component"))
    smallest = written(known.groupBy("component").agg(F.min("id").alias("component_id")), "vector-ids")
    known = known.join(smallest, "component").select("digest", "n_links", "component_id")
    out = drawn.select("vec_id", "digest").join(known, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
