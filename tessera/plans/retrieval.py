"""Queries over chunks: top-k, fusion, personalised ranking, scope. Every chunk whose id is divisible by 20 is asked, against all chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import retrieval as r
from tessera.operators.candidates import CandidateFilter, candidates
from tessera.plans.base import registrar
from tessera.sources.tables import AS_OF, CHUNKS_SQL, PROGRAMS_SQL, chunks, programs

QUERIES, ORACLES = {}, {}
query = registrar(QUERIES, ORACLES)

EVERY = 20
REGION = ("NATION_1", "NATION_6", "NATION_11", "NATION_16", "NATION_21")
BASE = f"""WITH {CHUNKS_SQL},
q AS (SELECT chunk_id AS qid, vector AS qv, text AS qt FROM chunks WHERE chunk_id % {EVERY} = 0),
dense AS (SELECT qid, chunk_id, program, role, round(list_dot_product(vector, qv) / (sqrt(list_dot_product(vector, vector)) * sqrt(list_dot_product(qv, qv))), 9) AS score FROM chunks, q),
tok AS (SELECT chunk_id, program, t, count(*) AS n FROM (SELECT chunk_id, program, unnest(string_split_regex(lower(text), '[^a-z]+')) AS t FROM chunks) WHERE length(t) >= 3 GROUP BY ALL),
post AS (SELECT chunk_id, program, t, n::DOUBLE / max(n) OVER (PARTITION BY chunk_id) AS w FROM tok),
qt AS (SELECT chunk_id AS qid, t, n::DOUBLE AS w FROM tok WHERE chunk_id % {EVERY} = 0),
sparse AS (SELECT qid, chunk_id, program, round(sum(post.w * qt.w), 9) AS score FROM post JOIN qt USING (t) GROUP BY ALL)
"""
PROGRAM_RANKS = f"""{BASE}, {PROGRAMS_SQL},
scope AS (SELECT id FROM programs WHERE active AND NOT (end_date IS NOT NULL AND end_date < DATE '{AS_OF}')),
dp AS (SELECT qid, program, arg_min(chunk_id, (-score, chunk_id)) AS chunk_id, max(score) AS score FROM dense WHERE program IN (SELECT id FROM scope) GROUP BY ALL),
sp AS (SELECT qid, program, arg_min(chunk_id, (-score, chunk_id)) AS chunk_id, max(score) AS score FROM sparse WHERE program IN (SELECT id FROM scope) GROUP BY ALL),
dr AS (SELECT qid, program, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, program) AS rank FROM dp QUALIFY rank <= 50),
sr AS (SELECT qid, program, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, program) AS rank FROM sp QUALIFY rank <= 50),
fused AS (SELECT coalesce(d.qid, s.qid) AS qid, coalesce(d.program, s.program) AS program,
  round(coalesce(1.0::DOUBLE / (60 + d.rank), 0.0::DOUBLE) + coalesce(1.0::DOUBLE / (60 + s.rank), 0.0::DOUBLE), 12) AS score, least(d.rank, s.rank) AS best_rank,
  CASE WHEN s.rank IS NULL OR d.rank <= s.rank THEN d.chunk_id ELSE s.chunk_id END AS chunk_id, d.rank AS dense_rank, s.rank AS sparse_rank
  FROM dr d FULL JOIN sr s ON d.qid = s.qid AND d.program = s.program)
"""


BOTH = ("dense", "sparse")


def asked(spark, sf_dir) -> DataFrame:
    return chunks(spark, sf_dir).where(F.col("chunk_id") % EVERY == 0).select(F.col("chunk_id").alias("qid"), "vector", "text")


_INDEXES: dict[tuple[str, str], r.Index] = {}


def index(spark, sf_dir) -> r.Index:
    """The index of all chunks of a folder, built by the first query of an application that asks for it; the folder's tables do not change under one."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        _INDEXES[key] = r.indexed(chunks(spark, sf_dir))
    return _INDEXES[key]


def best(spark, sf_dir, modes: tuple[str, ...], **options) -> DataFrame:
    """Best rows of each asked chunk by the modes, over all chunks or those that only leaves."""
    return r.best_rows(index(spark, sf_dir), asked(spark, sf_dir), modes, **options)


def program_rankings(spark, sf_dir) -> DataFrame:
    scope = candidates(programs(spark, sf_dir), CandidateFilter(not_closed_on=AS_OF)).select(F.col("id").alias("program"))
    return best(spark, sf_dir, BOTH, only=lambda rows: rows.join(scope, "program", "left_semi"), by_program=True)


def fused(spark, sf_dir, limit: int) -> DataFrame:
    return r.fuse(program_rankings(spark, sf_dir), {"dense": 1.0, "sparse": 1.0}, "program", limit=limit)


@query(BASE + "SELECT qid, chunk_id, program, score FROM dense WHERE role IS NULL OR role NOT IN ('FORM') QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) <= 50")
def dense_topk(spark, sf_dir):
    return best(spark, sf_dir, ("dense",), only=lambda rows: rows.where(r.role_condition(["FORM"]))).select("qid", "chunk_id", "program", "score")


@query(BASE + "SELECT qid, chunk_id, program, score FROM sparse QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) <= 50")
def sparse_topk(spark, sf_dir):
    return best(spark, sf_dir, ("sparse",)).select("qid", "chunk_id", "program", "score")


@query(BASE + ", b AS (SELECT qid, program, arg_min(chunk_id, (-score, chunk_id)) AS chunk_id, max(score) AS score FROM dense GROUP BY ALL) SELECT qid, program, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, program) AS rank FROM b QUALIFY rank <= 50")
def grouped_top1(spark, sf_dir):
    return best(spark, sf_dir, ("dense",), by_program=True).select("qid", "program", "chunk_id", "score", "rank")


SPECIAL = (0, 1, 2)


@query(f"""WITH {CHUNKS_SQL}, w AS (SELECT chunk_id, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda t: length(t) >= 3) AS words FROM chunks),
t AS (SELECT chunk_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM w), v AS (SELECT chunk_id, ord(word) * 31 % 64 + length(word) - 3 AS id, ((i * 7 + length(word)) % 11 - 3) / 8.0::DOUBLE AS weight FROM t),
m AS (SELECT chunk_id, id, max(weight) AS weight FROM v WHERE id NOT IN {SPECIAL} GROUP BY ALL HAVING max(weight) > 0)
SELECT chunk_id, count(*) AS n_ids, max(weight) AS top, sum(weight) AS total, string_agg(id, ',' ORDER BY id) AS ids FROM m GROUP BY chunk_id""")
def sparse_vectors(spark, sf_dir):
    """What is stored of a text's token weights: the largest positive one of each id, without special ids."""
    rows = chunks(spark, sf_dir).select("chunk_id", r.text_tokens(F.col("text")).alias("words"))
    ids = F.transform("words", lambda w: F.ascii(w) * 31 % 64 + F.length(w) - 3)
    weights = F.transform("words", lambda w, i: ((i * 7 + F.length(w)) % 11 - 3) / 8.0)
    rows = rows.select("chunk_id", r.sparse_vector(ids, weights, SPECIAL).alias("v")).where(F.size("v") > 0)
    of = lambda name: F.col("v")[name]
    total = F.aggregate(of("weight"), F.lit(0.0), lambda s, x: s + x)
    return rows.select("chunk_id", F.size("v").cast("long").alias("n_ids"), F.array_max(of("weight")).alias("top"), total.alias("total"), F.array_join(of("id").cast("array<string>"), ",").alias("ids"))


@query(PROGRAM_RANKS + """, t AS (SELECT * FROM fused QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, best_rank, program) <= 5)
SELECT f.qid, f.program, f.score, f.dense_rank, f.sparse_rank, f.chunk_id, p.name, p.category FROM t f JOIN programs p ON p.id = f.program WHERE p.active""")
def hybrid_rrf(spark, sf_dir):
    rows = programs(spark, sf_dir).where("active").join(fused(spark, sf_dir, r.TOP_K), F.col("id") == F.col("program"))
    return rows.select("qid", "program", "score", "dense_rank", "sparse_rank", "chunk_id", "name", "category")


@query(PROGRAM_RANKS + """, w AS (SELECT coalesce(d.qid, s.qid) AS qid, coalesce(d.program, s.program) AS program, d.rank AS question_rank, s.rank AS company_rank, least(d.rank, s.rank) AS best_rank,
  round(coalesce(1.0::DOUBLE / (60 + d.rank), 0.0::DOUBLE) + coalesce(0.3::DOUBLE / (60 + s.rank), 0.0::DOUBLE), 12) AS score FROM dr d FULL JOIN sr s ON d.qid = s.qid AND d.program = s.program)
SELECT qid, program, question_rank, company_rank, score FROM w QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, best_rank, program) <= 10""")
def weighted_blend(spark, sf_dir):
    rows = r.fuse(program_rankings(spark, sf_dir), {"dense": 1.0, "sparse": 0.3}, "program", limit=10)
    return rows.select("qid", "program", F.col("dense_rank").alias("question_rank"), F.col("sparse_rank").alias("company_rank"), "score")


@query(PROGRAM_RANKS + f""", t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, best_rank, program) AS rank FROM fused QUALIFY rank <= 10),
m AS (SELECT t.*, p.jurisdiction, max(score) OVER (PARTITION BY qid) AS best FROM t JOIN programs p ON p.id = t.program),
b AS (SELECT *, CASE WHEN jurisdiction IN {REGION} AND score > 0 AND score >= best * 0.9::DOUBLE THEN 0.001::DOUBLE ELSE 0.0::DOUBLE END AS bonus FROM m),
f AS (SELECT qid, program, rank AS original_rank, bonus, round(score + bonus, 12) AS final FROM b)
SELECT *, row_number() OVER (PARTITION BY qid ORDER BY final DESC, original_rank) AS rank FROM f QUALIFY rank <= 3""")
def regional_bonus(spark, sf_dir):
    names = programs(spark, sf_dir).select(F.col("id").alias("program"), "jurisdiction")
    rows = names.join(fused(spark, sf_dir, 10), "program")
    match = F.coalesce(F.col("jurisdiction").isin(*REGION), F.lit(False))
    return r.regional_bonus(rows, match).select("qid", "program", "original_rank", "bonus", "final", "rank")


@query(PROGRAM_RANKS + """, t AS (SELECT qid, program FROM fused QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, best_rank, program) <= 50)
SELECT t.qid, t.program, p.name, p.category, p.target, p.jurisdiction FROM t JOIN programs p ON p.id = t.program WHERE p.active""")
def metadata_lookup(spark, sf_dir):
    rows = programs(spark, sf_dir).where("active").join(fused(spark, sf_dir, 50), F.col("id") == F.col("program"))
    return rows.select("qid", "program", "name", "category", "target", "jurisdiction")


@query(BASE + """, g AS (SELECT a.chunk_id AS qid, b.chunk_id FROM chunks a JOIN chunks b ON a.label = b.label AND a.chunk_id <> b.chunk_id WHERE a.chunk_id % 20 = 0),
top AS (SELECT qid, 'dense' AS mode, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM dense QUALIFY rank <= 50
  UNION ALL SELECT qid, 'sparse', chunk_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM sparse QUALIFY rank <= 50),
j AS (SELECT qid, mode, rank, EXISTS (SELECT 1 FROM g WHERE g.qid = top.qid AND g.chunk_id = top.chunk_id) AS hit FROM top)
SELECT qid, mode, min(rank) FILTER (hit) AS first_hit, count_if(hit AND rank <= 1)::BIGINT AS hits_at_1, count_if(hit AND rank <= 5)::BIGINT AS hits_at_5, count_if(hit)::BIGINT AS hits FROM j GROUP BY ALL""")
def hit_at_k(spark, sf_dir):
    """A hit is another chunk with the label of the asked one."""
    label = chunks(spark, sf_dir).select("chunk_id", "label")
    asked = label.where(F.col("chunk_id") % EVERY == 0).select(F.col("chunk_id").alias("qid"), F.col("label").alias("wanted"))
    rows = best(spark, sf_dir, BOTH).join(label, "chunk_id").join(asked, "qid").withColumn("hit", F.coalesce((F.col("label") == F.col("wanted")) & (F.col("chunk_id") != F.col("qid")), F.lit(False)))
    return rows.groupBy("qid", "mode").agg(
        F.min(F.when(F.col("hit"), F.col("rank"))).alias("first_hit"),
        F.count_if(F.col("hit") & (F.col("rank") <= 1)).alias("hits_at_1"),
        F.count_if(F.col("hit") & (F.col("rank") <= 5)).alias("hits_at_5"),
        F.count_if("hit").alias("hits"),
    )


@query(f"WITH {CHUNKS_SQL} SELECT chunk_id, round(sqrt(list_dot_product(vector, vector)), 6) AS length, round(list_sum(vector), 6) AS total FROM chunks")
def unit_vectors(spark, sf_dir):
    from tessera.functions import vectors

    rows = chunks(spark, sf_dir)
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)
    return rows.select("chunk_id", F.round(vectors.norm(F.col("vector")), 6).alias("length"), F.round(total, 6).alias("total"))
