"""Indexes of vectors and postings against brute force."""

import random
from collections import defaultdict
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import postings, vector_index
from tessera.operators import retrieval as r
from tessera.operators.segments import stored

KEEP = partial(stored, tag="test")


@pytest.fixture(scope="module")
def rows():
    """Clustered vectors, some alike, some of another length, missing or zero; words of uneven frequency."""
    rng = np.random.default_rng(3)
    centres, out, py = rng.normal(size=(12, 6)) * 3, [], random.Random(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(120)]
    for i in range(900):
        vector = (centres[i % 12] + rng.normal(size=6)).round(3).tolist()
        vector = {5: None, 6: [0.0] * 6, 7: [1.0, 2.0], 8: [], 9: [0.5, -1.0]}.get(i % 100, vector)
        if i % 37 == 0 and i:
            vector = out[-1][2]
        text = " ".join(words[min(119, int(py.expovariate(0.05)))] for _ in range(py.randint(0, 25)))
        out.append((i, i // 3, vector, text, i % 2))
    return out


@pytest.fixture(scope="module")
def index(spark, rows):
    return r.indexed(spark.createDataFrame(rows, "chunk_id long, program long, vector array<double>, text string, scope long").drop("scope"))


def cosine(a, b):
    if not a or not b or len(a) != len(b) or not any(a) or not any(b):
        return None
    return round(float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))), 9)


def weights(text):
    counts = defaultdict(int)
    for w in text.split():
        counts[w] += 1
    return counts


def shared(query, chunk):
    q, c = weights(query), weights(chunk)
    both = q.keys() & c.keys()
    return round(sum(q[w] * c[w] / max(c.values()) for w in both), 9) if both else None


def brute(rows, queries, mode, limit, by_program, scoped):
    out = {}
    for q in queries:
        found = [(-s, c[0], c[1]) for c in rows if (not scoped or c[4] == q[4]) and (s := (cosine(q[2], c[2]) if mode == "dense" else shared(q[3], c[3]))) is not None]
        if by_program:
            best = {}
            for s, chunk, program in sorted(found):
                best.setdefault(program, (s, program, chunk))
            found = [(s, chunk, program) for s, program, chunk in sorted(best.values())]
        out[q[0]] = [(chunk, program, round(-s, 6)) for s, chunk, program in (found if by_program else sorted(found))[:limit]]
    return {k: v for k, v in out.items() if v}


def answers(found):
    out = defaultdict(list)
    for x in found.orderBy("qid", "rank").collect():
        assert x["rank"] == len(out[x.qid]) + 1
        out[x.qid].append((x.chunk_id, x.program, round(x.score, 6)))
    return dict(out)


@pytest.mark.parametrize(("by_program", "scoped", "limit"), [(False, False, 5), (True, False, 7), (False, True, 400), (True, True, 3)])
def test_searches_are_exact(spark, rows, index, monkeypatch, by_program, scoped, limit):
    monkeypatch.setattr(postings, "FIRST", 60)
    monkeypatch.setattr(postings, "DIRECT", 0 if limit < 100 else 50_000)
    queries = rows[::45] + rows[5:900:300] + rows[7:900:300]
    names = "qid long, program long, vector array<double>, text string, scope long"
    asked = spark.createDataFrame(queries, names).drop("program", *([] if scoped else ["scope"]))
    scopes = spark.createDataFrame([(c[0], c[4]) for c in rows], "chunk_id long, scope long")
    only = (lambda held: held.join(scopes, "chunk_id")) if scoped else (lambda held: held)
    found = r.best_rows(index, asked, ("dense", "sparse"), only, limit, by_program, probes=2)
    for mode in ("dense", "sparse"):
        assert answers(found.where(F.col("mode") == mode)) == brute(rows, queries, mode, limit, by_program, scoped)


def test_modes_are_dealt_anew(spark, rows, index):
    """Nothing relies on how the modes' parts were dealt: Spark loses that where a plan reads their exchanges again."""
    asked = spark.createDataFrame(rows[::45], "qid long, program long, vector array<double>, text string, scope long").drop("program", "scope")
    found = r.best_rows(index, asked, ("dense", "sparse"), limit=5, by_program=True)
    plan = r.fuse(found, {"dense": 1.0, "sparse": 1.0}, "program", limit=5)._jdf.queryExecution().executedPlan().toString().split("\n")
    union = next(k for k, line in enumerate(plan) if line.strip(" :+-*()0123456789") == "Union")
    assert "Exchange hashpartitioning(qid" in plan[union - 1]


def test_tokens_and_blocks_are_skipped(spark, rows, monkeypatch):
    """A rare token found early makes frequent ones needless; their blocks of low weights are left."""
    monkeypatch.setattr(postings, "DIRECT", 0)
    texts = [(i, i, "common " * (1 + i % 5) + ("rare " * 9 if i < 3 else "other " * 5), None) for i in range(300)]
    held = spark.createDataFrame([(i, p, t) for i, p, t, _ in texts], "chunk_id long, program long, text string")
    index = postings.build(r.token_weights(r.terms(held)), KEEP, block=20)
    assert index.blocks.where("token = 'common'").count() == 15
    queries = spark.createDataFrame([(1, "rare", 10), (1, "common", 1)], "qid long, token string, count long")
    tables = []

    def keep(frame):
        tables.append(stored(frame, "test"))
        return tables[-1]

    found = postings.search(index, queries, 3, keep, partial(r.ranked, tie="chunk_id", limit=3)).collect()
    assert {x.chunk_id for x in found} == {0, 1, 2}
    assert {(x.token, x.needed) for x in tables[0].collect()} == {("rare", True), ("common", False)}


def test_few_cells_find_most(spark, rows):
    held = spark.createDataFrame([x for x in rows if x[2] and len(x[2]) == 6 and any(x[2])], "chunk_id long, program long, vector array<double>, text string, scope long")
    index = vector_index.build(held.drop("text", "scope"), 900, KEEP)
    queries = held.where("chunk_id % 10 = 0").select(F.col("chunk_id").alias("qid"), "vector")
    rank = partial(r.ranked, tie="chunk_id", limit=20)
    exact, near = (vector_index.search(index, queries, 20, KEEP, rank, exact=e, probes=8) for e in (True, False))
    assert vector_index.recall(near, exact) >= 0.9
    assert index.cells.count() == len(index.centroids) == 30


def test_bounds_hold():
    rng = np.random.default_rng(9)
    v = vector_index.unit(rng.normal(size=(500, 8)))
    c = vector_index.fitted(v, 20)
    away = vector_index.away(v, c)
    cell = away.argmin(1)
    radii = np.array([away[cell == k, k].max(initial=0) for k in range(20)])
    q = rng.normal(size=(40, 8)) * 5
    allowed = vector_index.bounds(q, c, radii)
    assert np.all(vector_index.unit(q) @ v.T <= allowed[:, cell] + 1e-9)


def test_sparse_vector(spark):
    frame = spark.createDataFrame([([5, 2, 5, 0, 7, None, 9], [0.5, 1.0, 0.75, 9.0, -1.0, 3.0, None]), ([], []), (None, None), ([1], [float("nan")])], "ids array<int>, w array<double>")
    got = [x.v and [tuple(y) for y in x.v] for x in frame.select(r.sparse_vector(F.col("ids"), F.col("w"), (0, 1)).alias("v")).collect()]
    assert got == [[(2, 1.0), (5, 0.75)], [], None, []]


@pytest.mark.parametrize(("by_program", "scoped", "limit", "most"), [(False, False, 5, 100), (True, False, 7, 4096), (False, True, 400, 300), (True, True, 3, 100)])
def test_products_are_exact(spark, rows, index, monkeypatch, by_program, scoped, limit, most):
    """Many queries meet parts of the chunks: the best of each part are shuffled, not a row for each posting read."""
    for name, value in (("PART", most), ("TILE", 16), ("LEAST_PART", most), ("STRIP", 5), ("DENSE", 7), ("EXPANDED", 50)):
        monkeypatch.setattr(postings, name, value)
    queries = rows[::20] + rows[5:900:300]
    names = "qid long, program long, vector array<double>, text string, scope long"
    asked = spark.createDataFrame(queries, names).drop("program", *([] if scoped else ["scope"]))
    scopes = spark.createDataFrame([(c[0], c[4]) for c in rows], "chunk_id long, scope long")
    only = (lambda held: held.join(scopes, "chunk_id")) if scoped else (lambda held: held)
    assert answers(r.best_rows(index, asked, ("sparse",), only, limit, by_program)) == brute(rows, queries, "sparse", limit, by_program, scoped)


def test_shuffled_rows_are_bounded():
    """A part gives a query its best rows only, of however many chunks that share its tokens."""
    import pandas as pd

    c = pd.DataFrame({"chunk_id": range(500), "program": [i // 3 for i in range(500)], "ids": [np.array([1, 2])] * 500, "values": [np.array([1.0, (i % 50) / 50]) for i in range(500)]})
    q = pd.DataFrame({"qid": [7, 8], "ids": [np.array([1, 2]), np.array([9])], "values": [np.array([1, 1])] + [np.array([1])]})
    got = postings.best_of_part(c, q, 4, False, 9)
    assert got.qid.tolist() == [7] * 4 and got.chunk_id.tolist() == [49, 99, 149, 199]


def test_queries_go_to_groups_of_cells(spark, rows, index, monkeypatch):
    """A query goes once to each group in which it asks cells, and a group of eight cells loses none of its bits; cells beyond a group are dealt in parts."""
    dense = index.dense
    monkeypatch.setattr(vector_index, "LEAST_PART", 300)
    some = vector_index.groups(dense, 8)
    assert sorted(c for cells, _ in some for c in cells) == sorted(dense.sizes) and len(some) <= 4 and {parts for _, parts in some} == {1}
    held = dense.chunks.withColumn("least", F.lit(-2.0)).withColumnRenamed("chunk_id", "qid")
    asked = held.where("size(vector) = 6").select(F.size(vector_index.asked_cells(dense, some, 30, False)("vector", "least")).alias("n"))
    assert asked.agg(F.max("n")).first()[0] <= len(some)
    monkeypatch.setattr(vector_index, "PART", 60)
    assert {c for cells, _ in vector_index.groups(dense, 8) for c in cells} == set(dense.sizes) and max(parts for _, parts in vector_index.groups(dense, 8)) > 1
    queries = rows[::45] + rows[7:900:300]
    asked = spark.createDataFrame(queries, "qid long, program long, vector array<double>, text string, scope long").drop("program", "scope")
    assert answers(r.best_rows(index, asked, ("dense",), limit=7, by_program=True, probes=3)) == brute(rows, queries, "dense", 7, True, False)
    bits = np.packbits(np.r_[np.zeros(7, bool), True]).tobytes()
    import pandas as pd

    c = pd.DataFrame({"chunk_id": range(16), "program": range(16), "vector": [np.array([1.0, i]) for i in range(16)], "place": np.arange(16) % 8})
    q = pd.DataFrame({"qid": [5], "vector": [np.array([1.0, 0.0])], "cells": [bits], "least": [-2.0]})
    assert vector_index.best_of_tile(c, q, 5, False, 9).chunk_id.tolist() == [7, 15]


def test_token_lists_take_no_shuffle(spark, rows):
    """Tokens are counted in a chunk's row; a dense search alone builds no postings."""
    held = spark.createDataFrame(rows, "chunk_id long, program long, vector array<double>, text string, scope long")
    lists = r.token_lists(held)
    assert "Exchange" not in lists._jdf.queryExecution().executedPlan().toString()
    got = {x.chunk_id: dict(zip(x.tokens, x.weights, strict=True)) for x in lists.collect()}
    want = {c[0]: {w: n / max(weights(c[3]).values()) for w, n in weights(c[3]).items()} for c in rows}
    assert got == want
    index = r.indexed(held.drop("scope"))
    r.best_rows(index, held.where("chunk_id < 3").select(F.col("chunk_id").alias("qid"), "vector", "text"), ("dense",)).collect()
    assert "dense" in index.__dict__ and "sparse" not in index.__dict__
