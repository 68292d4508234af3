"""The registered queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import byte_cnn, centroids, chat, collocations, embed_dedup, html_extract, line_dedup, mixing, near_dedup, packing, quality_rules, token_counts, toxicity
from tessera.llm.common import crc_remainder, labelled_sample, table, written

#: html of pages as lines: scripts, styles and comments go, block tags end a line, other tags go.
UNSEEN = "(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
BLOCKS = "(?i)</?(?:p|div|br|li|ul|ol|nav|footer|header|article|section|h[1-6]|tr|table|title|head|body|html)(?:[ />][^>]*)?>"
TAGS = "<[^>]*>"
HOST = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    sample = labelled_sample(docs, labels, crc_remainder(F.col("doc_id"), 5) != 0, "toxic", toxicity.LABELLED_ROWS)
    scored = toxicity.classify(docs, sample, 0.5)
    held_out = F.coalesce(crc_remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "n_clauses")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.link_vectors(table(spark, sf_dir, "embeddings"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    sample = labelled_sample(docs, labels, crc_remainder(F.col("doc_id"), 4) != 2, "quality", byte_cnn.LABELLED_ROWS, byte_cnn.LABELLED_BYTES)
    scored = byte_cnn.classify(docs, sample, 0.7)
    held_out = F.coalesce(crc_remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    )


def op8_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "epochs", "selected")


OP8_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         CASE WHEN length(text) > 0 THEN greatest(0.05::DOUBLE, length(regexp_replace(text, '[#*$%&|<>]', '', 'g'))::DOUBLE / length(text)::DOUBLE) ELSE 0.05::DOUBLE END AS w,
         ((('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 12))::BIGINT)::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") AS k FROM s),
c AS (SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS sw, source_size * 2.0::DOUBLE AS cap FROM n),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / sw, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / sum(sw) OVER (ORDER BY cap / sw, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM c),
f AS (SELECT arg_min(level, cap / sw) FILTER (cap / sw > level) AS level FROM l),
t AS (SELECT source, source_size, least(cap, coalesce(f.level * sw, cap)) AS target FROM l, f),
e AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)::DOUBLE + 1e-12), 0)::BIGINT AS epochs FROM t),
o AS (
  SELECT d.*, e.source_size, e.target, e.epochs,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY -ln(u) / w, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
p AS (SELECT *, before + size / 2.0 <= target - epochs * source_size AS selected FROM o)
SELECT doc_id, size, source_size, target, (size * (epochs + selected::BIGINT))::BIGINT AS taken, source, epochs, selected FROM p
"""


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text")
    )
    return chat.read_back(chat.format_chats(rows.unionByName(extra)))


OP9_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n AS (SELECT *, length(regexp_replace(text, '(\\*(?:### |</turn>))', '\\\1', 'g')) AS body FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(4 + length(role) + 2 + body + 9)::BIGINT AS formatted_chars
FROM n GROUP BY conv_id
"""


def page_lines(html):
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(html, UNSEEN, ""), BLOCKS, "\n"), TAGS, "")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(
        "page_id", F.lower(F.regexp_extract("url", HOST, 1)).alias("host"), page_lines(F.col("html")).alias("text")
    )
    return line_dedup.drop_boilerplate(written(pages, "page-lines"), F.col("host")).withColumnRenamed("_n_dropped", "n_dropped")


OP10_SQL = rf"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, lower(regexp_extract(url, '{HOST}', 1)) AS host,
         regexp_replace(regexp_replace(regexp_replace(html, '{UNSEEN}', '', 'g'), '{BLOCKS}', chr(10), 'g'), '{TAGS}', '', 'g') AS text
  FROM pages),
q AS (SELECT r, host, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM p),
l AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM q),
h AS (SELECT host, count(*) AS total FROM p GROUP BY host),
b AS (SELECT l.host, key FROM l JOIN h ON l.host IS NOT DISTINCT FROM h.host WHERE key <> '' AND len(regexp_extract_all(key, '[^\x20\x09-\x0D]+')) >= 3 GROUP BY l.host, key HAVING count(DISTINCT r) >= 3 AND count(DISTINCT r) > 0.03::DOUBLE * any_value(total)),
k AS (SELECT l.*, b.key IS NOT NULL AS gone FROM l LEFT JOIN b ON l.host IS NOT DISTINCT FROM b.host AND l.key = b.key),
g AS (SELECT r, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text, count(*) FILTER (gone) AS n FROM k GROUP BY r)
SELECT page_id, host, CASE WHEN p.text IS NULL THEN NULL ELSE g.text END AS text, coalesce(g.n, 0)::BIGINT AS n_dropped FROM p LEFT JOIN g USING (r)
"""

def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


def _lloyd_sql(k: int, rounds: int) -> str:
    """The rounds written out one after another, every vector against every centroid."""
    parts = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v AS w FROM v QUALIFY c < {k})"""
    ]
    for n in range(rounds + 1):
        parts.append(
            f"""a{n} AS MATERIALIZED (
  SELECT r, arg_min(c, d * 64 + c) AS c, min(d) AS d
  FROM (SELECT r, c, (list_inner_product(v, v) + list_inner_product(w, w) - 2 * list_inner_product(v, w))::BIGINT AS d FROM v, c{n}) GROUP BY r)"""
        )
        if n < rounds:
            parts.append(
                f"""s{n} AS (SELECT c, i, floor(sum(x) / count(*)) AS m FROM (SELECT a{n}.c, unnest(v) AS x, unnest(range(64)) AS i FROM v JOIN a{n} USING (r)) GROUP BY c, i),
c{n + 1} AS MATERIALIZED (SELECT c{n}.c, coalesce(any_value(s.w), any_value(c{n}.w)) AS w FROM c{n} LEFT JOIN (SELECT c, list(m ORDER BY i) AS w FROM s{n} GROUP BY c) AS s USING (c) GROUP BY c{n}.c)"""
            )
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(list_transform(w, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM v JOIN a{rounds} USING (r) JOIN c{rounds} USING (c)"""
    )


OP11_SQL = _lloyd_sql(centroids.K, centroids.ROUNDS)


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT r, lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
q AS (SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
w AS (SELECT p, lang, unnest(words) AS w, unnest(range(len(words))) AS i FROM q),
g AS (SELECT lang, w AS w1, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY p ORDER BY i)),
c AS (
  SELECT lang, w1 AS phrase, 1 AS size, count(*) AS n FROM g GROUP BY ALL
  UNION ALL SELECT lang, w1 || ' ' || w2, 2, count(*) FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, 3, count(*) FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
t AS (SELECT lang, sum(n)::BIGINT AS n FROM c WHERE size = 1 GROUP BY lang),
e AS MATERIALIZED (SELECT lang || chr(10) || phrase AS key, n FROM c WHERE n >= 10),
k AS MATERIALIZED (
  SELECT lang, phrase, size, n AS a, k, lang || chr(10) || array_to_string(string_split(phrase, ' ')[1:k], ' ') AS lp, lang || chr(10) || array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rp
  FROM c, (VALUES (1), (2)) AS v(k) WHERE size > 1 AND k < size),
h AS MATERIALIZED (SELECT k.*, e.n AS l FROM k JOIN e ON e.key = lp),
s AS (SELECT lang, phrase, size, a, l, e.n AS r, ((1000000::HUGEINT * a * a) // (l::HUGEINT * e.n))::BIGINT AS score, k FROM h JOIN e ON e.key = rp),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS MATERIALIZED (
  SELECT lang || chr(10) || sub AS sub, max(a) AS longest FROM (
    SELECT lang, a, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS sub FROM b WHERE size = 3)
  GROUP BY ALL),
f AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
  FROM b LEFT JOIN i ON i.sub = b.lang || chr(10) || b.phrase WHERE 100 * coalesce(longest, 0) < 50 * a)
SELECT f.lang, rank, phrase, a, l, r, t.n, score FROM f JOIN t USING (lang) WHERE rank <= 2000
"""

def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_toxicity": op2_toxicity,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_mixing_sources": op8_mixing_sources,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_line_dedup": op10_line_dedup,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_html_extraction": op13_html_extraction,
}
ORACLES = {"op8_mixing_sources": OP8_SQL, "op9_chat_formatting": OP9_SQL, "op10_line_dedup": OP10_SQL, "op11_centroid_clustering": OP11_SQL, "op12_phrase_collocations": OP12_SQL}
