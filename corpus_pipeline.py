"""Corpus pipeline: five stages, each one of the corpus operators over all that the stage before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes every result as Parquet in the shared folder and gives
it to the next as docs. All but the last return the columns of documents. Further columns of docs pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import line_dedup, mixing, near_dedup, packing, toxicity
from tessera.llm.common import crc_remainder, labelled_sample, packed, table, written

TOXIC_FROM = 0.5
#: A source is far larger than a site, so a line of it repeats at shares that no site's menu has. Prose repeats short lines by chance.
SOURCE_SHARE = 0.01
SOURCE_MIN_DOCS = 5
SOURCE_MIN_WORDS = 3


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the toxicity grammar scores at TOXIC_FROM or more.

    Null and empty texts hold nothing toxic and stay. Rows without an id are judged by their text too; repeated rows alike. An empty table stays empty.
    """
    sample = labelled_sample(docs, table(spark, sf_dir, "labels"), crc_remainder(F.col("doc_id"), 5) != 0, "toxic", toxicity.LABELLED_ROWS)
    entries, beta = toxicity.learn(sample)
    return toxicity.with_matches(packed(docs, F.col("text")), entries, beta).where(F.col("_tx.score") < TOXIC_FROM).select("_row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the lines that more than SOURCE_SHARE of their source's documents hold. Every document stays; n_chars follows a changed text.

    Null texts stay null and empty ones empty; a null source is a source. Lines without a word are neither counted nor dropped.
    """
    held = packed(docs, F.col("text"), F.col("source"))
    held = line_dedup.drop_boilerplate(held, F.col("source"), max_share=SOURCE_SHARE, min_pages=SOURCE_MIN_DOCS, min_words=SOURCE_MIN_WORDS)
    row, changed = F.col("_row"), F.col("_n_dropped") > 0
    new = {"text": F.col("text"), "n_chars": F.when(changed, F.length("text").cast("long")).otherwise(row["n_chars"]) if "n_chars" in docs.columns else None}
    return held.select(*[(new[c] if c in new else row[c]).alias(c) for c in docs.columns])


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each near-duplicate class; of repeated rows of that id the one of the least text, then hash.

    Rows without an id stay. Null and empty texts are in no class but their id's, so they stay too.
    """
    classes = near_dedup.near_duplicates(docs).where("kept and doc_id is not null").select(F.col("doc_id").alias("_of")).distinct()
    rows = packed(docs, F.col("doc_id").cast("long").alias("_id"), F.struct("text", F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])).alias("_at"))
    held = rows.join(classes, F.col("_id") == F.col("_of"), "left_semi").groupBy("_id").agg(F.min_by("_row", "_at").alias("_row"))
    return held.select("_row").union(rows.where("_id is null").select("_row")).select("_row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs as often as the mix takes them: rows of complete epochs, and once more where selected.

    Documents without words (null, empty, blank) stay once, outside the mix, as do rows without an id. Rows of one id are taken together, as often as
    the one that is taken most.
    """
    mixed = mixing.mix(docs).where("doc_id is not null").groupBy(F.col("doc_id").alias("_of")).agg(F.max(F.col("epochs") + F.col("selected").cast("long")).alias("_times"), F.max("size").alias("_size"))
    rows = packed(docs, F.col("doc_id").cast("long").alias("_id")).join(mixed, F.col("_id") == F.col("_of"), "left")
    times = F.when(F.coalesce("_size", F.lit(0)) == 0, F.lit(1).cast("long")).otherwise(F.col("_times"))
    return rows.where(times > 0).select("_row", F.explode(F.sequence(F.lit(1).cast("long"), times))).select("_row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of docs packed into sequences of packing.SEQUENCE_TOKENS tokens. Null texts are empty ones, which still are an end token; repeated rows are packed each."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", dedup_lines),
    ("near dedup", one_of_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No SQL: learned grammars, sketches and tokenizers are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
