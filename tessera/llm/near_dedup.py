"""Near-duplicate classes by Order MinHash and banded alignment.

Shingles are five successive words (all words of a shorter text), labelled with how often they occurred before in the text, so
that each is unique in it. A sketch under one permutation is the few smallest labelled shingles in the order of the text. Two
texts that share a sketch are candidates; two are linked if the longest common subsequence of their labelled shingles, inside a
band, makes up THRESHOLD or more of all their shingles. A class is what links reach; its id is its smallest doc_id.

A sketch holds DEPTH shingles. With PERMUTATIONS of them a pair of similarity 0.8 shares none with probability (1 - 0.8^5)^24 = 7e-5, at
0.85 about 3e-6, at 0.9 less than 1e-9. Shingles are drawn without putting back, so pairs of short texts would share fewer, and one of
four and one of five shingles none: texts of SHORT shingles or fewer, and those that can be like them, are also sketched at SHORT_DEPTH
shingles, where a pair of 0.8 shares none with probability 3e-10.

Each text is a row in the bucket of each of its sketches that another text shares, with the codes of its shingles; of buckets of the same
texts, such as those of two copies, one is kept. A bucket is cut into parts of PART texts. First the texts of a part are compared with each other and with the bucket's pivot, the text that shares the most
sketches, so groups of copies become classes at a cost in proportion to their size. Buckets of several parts that then still
hold several classes are compared part by part, all pairs of texts that can be similar by size and are not in one class; parts of one
class alone do not meet. So every pair that shares a sketch is compared or in one class already: there is no cap on partners.
A pair is compared in the first bucket that it shares; the shared shingles of all pairs of two parts are one matrix product, only
pairs that share enough are aligned, and of those only what is not linked yet. A part returns links that span its classes, never its pairs.

Null, empty and blank texts link with nothing. Repeated rows and rows with one id are rows of one class, whatever their texts. Rows with a
null id keep a null class unless their text has rows with an id. Texts are read whole, of any length. Input columns other than the two named
are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WORD_RE, connected_components, discard, mapped_with_id, written

SHINGLE_WORDS = 5
THRESHOLD = 0.8
PERMUTATIONS = 24
DEPTH, SHORT_DEPTH = 5, 2
#: Texts of so many shingles and fewer are sketched at SHORT_DEPTH.
SHORT = 64
#: Texts of a part of a bucket, and their shingles.
PART = 128
PART_SHINGLES = 1 << 19
#: Shingles that one matrix product takes.
COLUMNS = 1 << 14
#: Shingles hashed under all permutations at once.
BLOCK = 1 << 15

_MIX = np.random.default_rng(20240229).integers(1, 2**63, size=(2, 64), dtype=np.uint64) | np.uint64(1)

_PLACE = np.random.default_rng(20240301).integers(1, 2**63, size=DEPTH, dtype=np.uint64)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """Codes of the occurrence-labelled shingles of text, in text order; unique within it."""
    words = WORD_RE.findall(text or "")
    if not words:
        return np.empty(0, dtype=np.uint64)
    codes = hash_array(np.array(words, dtype=object), categorize=False)
    k = min(SHINGLE_WORDS, len(codes))
    n = len(codes) - k + 1
    mixed = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        mixed = _scramble(mixed + codes[j : j + n] + np.uint64(j + 1))
    order = np.argsort(mixed, kind="stable")
    ordered = mixed[order]
    new = np.ones(n, dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    if new.all():
        return mixed
    starts = np.flatnonzero(new)
    label = np.empty(n, dtype=np.uint64)
    label[order] = (np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))).astype(np.uint64)
    return np.where(label > 0, _scramble(mixed ^ _scramble(label)), mixed)


def smallest(values: np.ndarray, depth: int) -> np.ndarray:
    """Positions of the depth smallest values of each row, smallest first; all where there are no more."""
    if values.shape[1] <= depth:
        return np.argsort(values, axis=1, kind="stable")
    low = np.argpartition(values, depth - 1, axis=1)[:, :depth]
    return np.take_along_axis(low, np.argsort(np.take_along_axis(values, low, 1), axis=1, kind="stable"), 1)


def order_sketches(codes: np.ndarray, threshold: float = THRESHOLD, permutations: int = PERMUTATIONS) -> np.ndarray:
    """int64 array of the sketches at DEPTH, then those at SHORT_DEPTH: hashes of the smallest codes under each permutation, in text order.

    0 where the text has no sketch at a depth for its size. Codes are well mixed already, so a permutation is one exclusive or and one odd factor.
    """
    factor, mask = _MIX[0, :permutations, None], _MIX[1, :permutations, None]
    held = np.empty((permutations, 0), np.int64)
    for at in range(0, len(codes), BLOCK):
        part = np.arange(at, min(len(codes), at + BLOCK))
        near = np.concatenate([held, part[smallest((codes[None, part] ^ mask) * factor, DEPTH)]], 1)
        held = np.take_along_axis(near, smallest((codes[near] ^ mask) * factor, DEPTH), 1)
    out = np.zeros((2, permutations), np.int64)
    for d, (depth, wanted) in enumerate(((DEPTH, len(codes) > SHORT), (SHORT_DEPTH, len(codes) * threshold <= SHORT))):
        if wanted:
            places = np.sort(held[:, :depth], axis=1)
            # The place in the sketch goes into each code's part of the sum, so the sum depends on the order; so does the permutation's number.
            mixed = _scramble(codes[places] + _PLACE[: places.shape[1]]).sum(1, dtype=np.uint64)
            out[d] = _scramble(mixed + np.arange(d * permutations, (d + 1) * permutations, dtype=np.uint64)).view(np.int64)
    return out.reshape(-1)


def aligned_similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Longest common subsequence over the union of shingles, aligned inside the band that threshold allows; 0 below what can reach it.

    Codes are unique in either text, so matches are points and their longest increasing chain is the subsequence. With similarity
    of threshold or more at most (1 - t) / (1 + t) of all shingles are off the chain, which bounds how far it leaves the diagonal.
    """
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < threshold * max(n, m):
        return 0.0
    need = threshold * (n + m) / (1 + threshold) - 1e-9
    if n == m and np.array_equal(a, b):
        return 1.0
    _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    band = (n + m) * (1 - threshold) / (1 + threshold) + 1
    inside = np.abs(at_a - at_b) <= band
    at_a, at_b = at_a[inside], at_b[inside]
    if len(at_a) < need:
        return 0.0
    chain = at_b[np.argsort(at_a)]
    if np.all(chain[1:] > chain[:-1]):
        length = len(chain)
    else:
        ends: list[int] = []
        for x in chain.tolist():
            k = bisect_left(ends, x)
            if k == len(ends):
                ends.append(x)
            else:
                ends[k] = x
        length = len(ends)
    return length / (n + m - length)


def digest_of(codes: np.ndarray) -> bytes | None:
    return hashlib.blake2b(codes.tobytes(), digest_size=16).digest() if len(codes) else None


def sketched(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text) to doc_id, digest of the words, number of shingles, and sketches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes = [shingles(text) for text in batch.text]
            keys = [order_sketches(c, threshold).tobytes() if len(c) else None for c in codes]
            yield pd.DataFrame({"doc_id": batch.doc_id, "digest": [digest_of(c) for c in codes], "n": [len(c) for c in codes], "keys": keys})

    return mapped_with_id(docs, "doc_id", run, "digest binary, n long, keys binary")


def bucket_rows(texts: DataFrame) -> DataFrame:
    """(digest, id, n, keys) to digest, id, n and key, a row for each sketch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = [np.frombuffer(k, np.int64) for k in batch["keys"]]
            keys = [k[k != 0] for k in keys]
            rows = batch[["digest", "id", "n"]].loc[batch.index.repeat([len(k) for k in keys])]
            yield rows.assign(key=np.concatenate(keys) if keys else np.empty(0, np.int64))

    return texts.mapInPandas(run, "digest binary, id long, n long, key long")


def different_buckets(active: DataFrame) -> DataFrame:
    """active (digest, key, ...) without buckets that hold the same texts as one of a smaller key. Sets are told apart by 128 bits of hash and their size."""
    sets = active.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("digest")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "digest")).alias("h2")
    )
    return active.join(sets.groupBy("size", "h1", "h2").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")


def with_codes(active: DataFrame, docs: DataFrame) -> DataFrame:
    """active (digest, id, keys) with the codes of its texts, which docs has by doc_id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes = [shingles(text) for text in batch.text]
            yield pd.DataFrame({"digest": [digest_of(c) for c in codes], "codes": [c.tobytes() for c in codes]})

    # The ids grow with the corpus, so they are never broadcast, however few they are here.
    held = docs.join(active.select(F.col("id").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")
    coded = held.mapInPandas(run, "digest binary, codes binary").where("digest is not null").groupBy("digest").agg(F.min("codes").alias("codes"))
    return active.select("digest", "keys").join(coded, "digest")


def part_links(part: pd.DataFrame, threshold: float) -> list[tuple[int, int]]:
    """Links (a, b) of ids that span the classes which the similar texts of a part, or of two parts (side 0 and 1), form.

    part: key, side, id, label, n, keys, codes. Pairs of two parts are those of a text of either; side 2 is the pivot, which meets every text. Texts
    of one label are in one class from the start. Other pairs count in the first of the buckets (keys) that they share.
    """
    part = part.sort_values("side", kind="stable")
    key, side, n = part.key.iloc[0], part.side.to_numpy(), part.n.to_numpy()
    ids, labels = part.id.to_numpy(), part.label.to_numpy()
    if len(ids) < 2:
        return []
    codes = [np.frombuffer(c, np.uint64) for c in part.codes]
    keys = [set(k) for k in part["keys"]]
    root = {x: x for x in labels.tolist()}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    need = threshold * (n[:, None] + n[None]) / (1 + threshold) - 1e-9
    able = (np.minimum(n[:, None], n[None]) >= need) & (labels[:, None] != labels[None])
    able &= side[:, None] != side[None] if 1 in side else np.arange(len(n))[:, None] < np.arange(len(n))[None]
    able &= (side[:, None] <= side[None]) & (side[:, None] < 2)
    if len(n) > 2 and able.any():
        values, at, held = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
        owner, often = np.repeat(np.arange(len(n)), n), held[at] > 1
        column = np.cumsum(held > 1)[at[often]] - 1
        owner, order = owner[often], np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        shared = np.zeros((len(n), len(n)), np.float32)
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            lo, hi = np.searchsorted(column, (first, first + COLUMNS))
            holds = np.zeros((len(n), COLUMNS if hi < len(column) else int(column[hi - 1]) - first + 1), np.float32)
            holds[owner[lo:hi], column[lo:hi] - first] = 1
            shared += holds @ holds.T
        able &= shared >= need
    links = []
    for i, j in zip(*map(np.ndarray.tolist, np.nonzero(able)), strict=True):
        x, y = find(labels[i]), find(labels[j])
        if x == y:
            continue
        if side[j] < 2 and min(keys[i] & keys[j]) != key:
            continue
        if aligned_similarity(codes[i], codes[j], threshold) >= threshold:
            root[max(x, y)] = min(x, y)
            links.append((int(ids[i]), int(ids[j])))
    return links


def linked_in_parts(rows: DataFrame, codes: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) from rows (key, i, j, side, digest, id, label, n): those of one (key, i, j) meet."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        at = None

        def flush() -> Iterator[pd.DataFrame]:
            if held and (links := part_links(pd.concat(held) if len(held) > 1 else held[0], threshold)):
                yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")
            held.clear()

        for batch in batches:
            for name, part in batch.groupby(["key", "i", "j"], sort=False):
                if name != at:
                    yield from flush()
                    at = name
                held.append(part)
        yield from flush()

    dealt = rows.join(codes, "digest").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.select("key", "i", "j", "side", "id", "label", "n", "keys", "codes").mapInPandas(run, "a long, b long")


def parts(texts: Column, shingle_sum: Column) -> Column:
    return F.greatest(F.ceil(texts / PART), F.ceil(shingle_sum / PART_SHINGLES)).cast("int")


def dealt_to(digest: Column, of: Column) -> Column:
    return F.pmod(F.xxhash64(digest), of).cast("int")


def first_links(active: DataFrame, codes: DataFrame, threshold: float) -> DataFrame:
    """Links within parts of buckets, and with each bucket's pivot. active: digest, id, n, key, texts and total of the bucket."""
    sized = active.withColumn("of", parts(F.col("texts"), F.col("total")))
    own = sized.select("key", dealt_to(F.col("digest"), F.col("of")).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "digest", "id", F.col("id").alias("label"), "n")
    large = sized.where("of > 1")
    liked = large.groupBy("digest").agg(F.sum("texts").alias("met"))
    pivots = large.join(liked, "digest").groupBy("key").agg(F.max(F.struct("met", "digest", "id", "n", "of")).alias("p"))
    spread = pivots.select("key", F.explode(F.sequence(F.lit(0), F.col("p.of") - 1)).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("side"), "p.digest", "p.id", F.col("p.id").alias("label"), "p.n")
    return linked_in_parts(own.union(spread), codes, threshold)


def later_links(active: DataFrame, labels: DataFrame, codes: DataFrame, threshold: float) -> DataFrame:
    """Links between the parts of buckets that hold several classes; labels: id, component. Parts hold texts of like size, of the bucket's largest class or not."""
    large = active.where(parts(F.col("texts"), F.col("total")) > 1)
    named = large.join(labels, "id", "left").withColumn("label", F.coalesce("component", "id")).select("key", "digest", "id", "label", "n")
    by_class = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("texts"))
    # Written, so that the planner knows how small it is before it would shuffle the texts of large buckets by key.
    split = written(by_class.groupBy("key").agg(F.max_by("label", "texts").alias("main"), F.count(F.lit(1)).alias("classes")).where("classes > 1").select("key", "main"), "near-split")
    step = -float(np.log(threshold))
    placed = named.join(split, "key").withColumn("main", F.col("label") == F.col("main")).withColumn("band", F.floor(F.log("n") / step + 1e-9).cast("int"))
    sizes = placed.groupBy("key", "main", "band").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("total"))
    sizes = written(sizes.select("key", "main", "band", parts(F.col("texts"), F.col("total")).alias("of")), "near-sizes")
    placed = placed.join(sizes, ["key", "main", "band"])
    placed = written(placed.withColumn("part", dealt_to(F.col("digest"), F.col("of"))), "near-parts")
    found = placed.groupBy("key", "main", "band", "part").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    name = F.struct("main", "band", "part").alias("name")
    left = found.select("key", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("at"), name, "lo", "hi")
    right = found.select("key", F.col("band").alias("at"), name.alias("other"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    # Of two parts of one band either could be first; of neighbouring bands the lower is.
    meet = left.join(right, ["key", "at"]).where((F.col("name.band") < F.col("other.band")) | (F.col("name") <= F.col("other")))
    meet = meet.where(F.least("lo", "lo2") < F.greatest("hi", "hi2"))
    meet = meet.select("key", F.xxhash64("name").alias("i"), F.xxhash64("other").alias("j"), F.posexplode(F.when(F.col("name") == F.col("other"), F.array("name")).otherwise(F.array("name", "other"))).alias("side", "name"))
    meet = meet.select("key", "i", "j", "side", "name.main", "name.band", "name.part")
    rows = placed.select("key", "main", "band", "part", "digest", "id", "label", "n").join(meet, ["key", "main", "band", "part"])
    return linked_in_parts(rows, codes, threshold)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, kept) for each row of docs; kept: the doc_id is its class's id."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    drawn = written(sketched(rows, threshold), "near-sketches")
    good = drawn.where("digest is not null and doc_id is not null")
    reps = good.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    reps = written(reps, "near-reps")
    keyed = bucket_rows(reps)
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("total")).where("texts > 1")
    every = written(keyed.join(shared, "key"), "near-buckets")
    active = written(different_buckets(every), "near-buckets")
    discard(every)
    codes = written(with_codes(active.groupBy("digest", "id").agg(F.collect_list("key").alias("keys")), rows), "near-codes")

    # Texts of one id are one class.
    several = good.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("doc_id")
    same = good.join(several, "doc_id", "left_semi").select("doc_id", "digest").distinct().join(reps.select("digest", "id"), "digest").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    links = written(first_links(active, codes, threshold).union(same), "near-links")
    labels = written(connected_components(None, links, "near"), "near-classes")
    more = written(later_links(active, labels, codes, threshold), "near-links")
    if not more.isEmpty():
        labels = written(connected_components(None, links.union(more), "near"), "near-classes")
    discard(active, codes)
    classes = reps.join(labels, "id", "left").select("digest", F.coalesce("component", "id").alias("class_id"))
    out = drawn.select("doc_id", "digest").join(classes, "digest", "left")
    out = out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))
