"""Centroid clustering of integer vectors, exact, with Hamerly's bounds.

Components become integers floor(SCALE * x). The first centroids are the K vectors whose hash is smallest. A round assigns every vector to
the nearest centroid (squared Euclidean distance, ties to the smaller number), then replaces every centroid by the floor of its vectors' means;
an empty one stays. After ROUNDS rounds vectors are assigned once more.

Each vector carries one upper bound of the distance to its centroid and one lower bound of the distance to every other, in a Parquet table that each
round reads and writes anew. A round loosens the bounds by what the centroids moved: the upper by its own centroid's, the lower by the widest
move among the others. While the upper bound stays below the lower one, or below half the way from the centroid to its nearest neighbour, the
vector stays without a scan. Otherwise the upper bound is made exact, and a vector that is still ambiguous is scanned against all
centroids in integers. Bounds are doubles with SLACK to spare, so they only ever decide that a scan is not needed.

No vector is shuffled. Sums follow from the vectors that moved, a row of partial sums for each task and centroid. The driver and the tasks
hold K centroids, whatever the table.

Vectors that are null, have another number of components, or hold null or non-finite components are left out, and give no row. Rows without an id
are vectors like others, and last among the first centroids; repeated rows and rows of one id are vectors of their own. Where hashes tie, the smaller
vector comes first. Fewer vectors than K make as many centroids. Components beyond MOST are held to it, so that distances fit a long. Only the
named columns are read, whatever else there is. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, written

K = 40
ROUNDS = 5
DIMENSIONS = 64
SCALE = 256
SEED = 2
#: Largest size of an integer component.
MOST = 1 << 27
#: Relative and absolute room of the bounds against rounding.
SLACK = 1e-9
#: Below this size of components, sums of products are exact in doubles.
EXACT = 1 << 22
#: Vectors scanned at once.
STRIP = 1 << 14


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v) of the vectors that take part, v in integers."""
    v, most = F.col(vector_col), F.lit(float(MOST))
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    whole = F.transform(v, lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, -most), most)).cast("int"))
    return vectors.where(F.coalesce((F.size(v) == dimensions) & finite, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def first_centroids(rows: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return np.array([r.v for r in rows.orderBy(name.asc_nulls_last(), "v").limit(k).collect()], dtype=np.int64)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of v to rows of c."""
    if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) < EXACT:
        x, y = v.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T)).astype(np.int64)
    x = v.astype(np.int64)
    return (x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * (x @ c.T)


def own_squared(v: np.ndarray, c: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    away = v.astype(np.int64) - c[cluster]
    return (away * away).sum(1)


def half_gaps(c: np.ndarray) -> np.ndarray:
    """Half the distance from each centroid to its nearest neighbour."""
    apart = np.sqrt(squared(c, c).astype(np.float64))
    np.fill_diagonal(apart, np.inf)
    return apart.min(1, initial=np.inf) / 2


def drifts(before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each centroid moved, and the widest move among the others."""
    moved = np.sqrt(own_squared(before, after, np.arange(len(after))).astype(np.float64))
    order = np.argsort(-moved, kind="stable")
    widest = np.full(len(moved), moved[order[0]])
    widest[order[0]] = moved[order[1]] if len(moved) > 1 else 0.0
    return moved, widest


def reassigned(v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: np.ndarray, drift: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster, upper, lower) after the centroids moved by drift, and how many vectors were scanned. Without drift all are."""
    cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
    unsure = np.arange(len(v))
    if drift is not None:
        upper += drift[0][cluster]
        lower -= drift[1][cluster]
        least = np.maximum(lower, half_gaps(c)[cluster])
        holds = lambda at: upper[at] * (1 + SLACK) + SLACK < least[at] * (1 - SLACK)
        unsure = unsure[~holds(unsure)]
        upper[unsure] = np.sqrt(own_squared(v[unsure], c, cluster[unsure]).astype(np.float64))
        unsure = unsure[~holds(unsure)]
    for at in range(0, len(unsure), STRIP):
        rows = unsure[at : at + STRIP]
        away = squared(v[rows], c)
        cluster[rows] = away.argmin(1)
        two = np.partition(away, 1, axis=1)[:, :2] if len(c) > 1 else np.concatenate([away, away], 1)
        near = np.sqrt(two.astype(np.float64))
        upper[rows], lower[rows] = near[:, 0], near[:, 1] if len(c) > 1 else np.inf
    return cluster, upper, lower, len(unsure)


def components(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


STATE = "vec_id long, v array<int>, cluster int, before int, upper double, lower double"


def assigned(state: DataFrame, c: np.ndarray, drift: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """state with each vector at its nearest centroid; before: the centroid it came from, -1 at first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                old = batch.column("cluster").to_numpy()
                bounds = [batch.column(name).to_numpy() for name in ("upper", "lower")]
                cluster, upper, lower, _ = reassigned(components(batch), old, *bounds, c, drift)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("v"), *map(pa.array, (cluster.astype(np.int32), old, upper, lower))], names=[x.split()[0] for x in STATE.split(", ")]
                )

    return state.select("vec_id", "v", "cluster", "upper", "lower").mapInArrow(run, STATE)


def moved_sums(state: DataFrame, k: int, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts, sums) that the vectors which changed their centroid bring to each centroid, less what they take away."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dimensions + 1), np.int64)
        for batch in batches:
            v = components(batch) if batch.num_rows else np.empty((0, dimensions))
            for name, sign in (("cluster", 1), ("before", -1)):
                at = batch.column(name).to_numpy()
                chosen = np.zeros((k, len(at)))
                here = np.flatnonzero(at >= 0)
                chosen[at[here], here] = sign
                total[:, 0] += chosen.sum(1).astype(np.int64)
                total[:, 1:] += (chosen @ v).astype(np.int64)  # components up to 2^27 and a batch's rows: exact in doubles
        rows = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(list(total[rows]), pa.list_(pa.int64()))], names=["cluster", "total"])

    found = state.where("cluster <> before").select("v", "cluster", "before").mapInArrow(run, "cluster int, total array<long>")
    sums = np.zeros((k, dimensions + 1), np.int64)
    for r in found.select("cluster", F.posexplode("total")).groupBy("cluster", "pos").agg(F.sum("col").alias("sum")).collect():
        sums[r.cluster, r.pos] = r.sum
    return sums[:, 0], sums[:, 1:]


def digest_of(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster_vectors(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of each vector that takes part, and the last centroids."""
    rows = written(quantised(vectors, id_col, vector_col, dimensions, scale), "centroid-vectors")
    c = first_centroids(rows, k, seed)
    if not len(c):
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), c
    state = rows.select("vec_id", "v", F.lit(-1).alias("cluster"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"))
    counts, sums = np.zeros(len(c), np.int64), np.zeros((len(c), dimensions), np.int64)
    drift, held = None, rows
    for _ in range(rounds):
        state = written(assigned(state, c, drift), "centroid-bounds")
        discard(held)
        held = state
        more = moved_sums(state, len(c), dimensions)
        counts, sums = counts + more[0], sums + more[1]
        new = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], c)
        drift, c = drifts(c, new), new
    last = assigned(state, c, drift)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                away = own_squared(components(batch), c, batch.column("cluster").to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array(away)], names=["vec_id", "cluster", "distance"])

    found = written(last.select("vec_id", "v", "cluster").mapInArrow(measure, "vec_id long, cluster int, distance long"), "centroid-clusters")
    discard(held)
    return found, c


def clustered(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector that takes part."""
    found, c = cluster_vectors(vectors, **options)
    total = F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")
    by_cluster = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(total).collect()}  # a row for each centroid
    fit = [(j, min(by_cluster.get(j, 0), 2**63 - 1), min(sum(by_cluster.values()), 2**63 - 1), digest_of(x)) for j, x in enumerate(c)]
    named = found.sparkSession.createDataFrame(fit, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
