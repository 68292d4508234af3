"""The pipeline's stages on a small fixture, and as a whole on the smallest tables."""

import zlib

import corpus_pipeline as p
import public_tokenizers
from pyspark.sql import functions as F

from tessera.llm import near_dedup, packing
from tessera.llm.common import table


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("more", F.lit(1))
    columns = docs.columns
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == columns, name
        docs = spark.createDataFrame(after.collect(), after.schema)
        if name == "near dedup":
            ids = [r.doc_id for r in docs.collect()]
            assert len(ids) == len(set(ids))
            classes = near_dedup.near_duplicates(docs)
            assert classes.where("kept").count() == len(ids)
    pieces = p.STAGES[-1][1](spark, docs, sf_dir).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    enc = packing.encoder(*[public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("json", "tiktoken")])
    for r in pieces:
        ids = enc.slow(texts[r.doc_id] or "") + (2).to_bytes(4, "little")
        assert zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32


def test_edges(spark, sf_dir):
    rows = [(1, None, "en", "a", None), (2, "", "en", None, 0), (3, "you are a stupid idiot and pathetic scum", "en", "a", 40), (None, "some text of its own here", "en", "a", 25), (4, "plain words", "en", "a", 11), (4, "plain words", "en", "a", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = p.reject_toxic(spark, docs, sf_dir)
    assert {r.doc_id for r in kept.collect()} == {1, 2, None, 4}
    once = p.one_of_near_copies(spark, kept, sf_dir)
    assert sorted(str(r.doc_id) for r in once.collect()) == ["1", "2", "4", "None"]
    for _, stage in p.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert p.ORACLE_SQL is None


def test_stages_keep_columns_of_any_name(spark, sf_dir):
    """Names that operators use themselves, very long texts, repeated rows with other columns, ties."""
    long = "a long text without an end and " * 40_000
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    rows = [(1, long, "en", "a", None, 0), (2, text(2), "en", "a", 5, 1), (2, text(2), "en", "a", 5, 2), (3, text(2), "en", None, 5, 3), (None, text(4), None, "b", 5, 4), (5, None, "en", "b", None, 5), (6, "", "en", "b", 0, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, more long")
    names = ["_tx", "_row", "_n_dropped", "_ld_of", "_ld_lines", "_mx_times", "_times", "_of", "_id", "kept", "class_id", "size", "dotted.name"]
    docs = docs.withColumns({n: F.col("more") + k for k, n in enumerate(names)})
    want = {"toxicity": range(7), "line dedup": range(7), "near dedup": None, "mixing": None}
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        got = out.collect()
        assert all(r[n] == r["more"] + k for r in got for k, n in enumerate(names))
        if want[name]:
            assert sorted(r.more for r in got) == list(want[name])
        if name == "near dedup":
            assert [r.doc_id for r in sorted(got, key=lambda r: r.more)] in ([1, 2, None, 5, 6],) and sorted(map(tuple, stage(spark, docs.repartition(3), sf_dir).collect()), key=str) == sorted(map(tuple, got), key=str)
        if name == "mixing":
            assert {r.more for r in got} >= {4, 5, 6}
    assert p.STAGES[-1][1](spark, docs, sf_dir).select("doc_id").distinct().count() == 6


def test_repeated_lines_of_a_source(spark, sf_dir):
    planted, short, rare = "Subscribe to our weekly letter today", "Read more", "A line that three documents share"
    rows = []
    for i in range(400):
        more = [planted, short] if i % 25 == 0 else [rare] if i in (1, 2, 3) else []
        rows.append((i, "\n".join([f"clean line {i} of its own", *more, f"last line {i} of its own"]), "en", "a", None))
    rows += [(1000 + i, f"{planted}\nother {i}", "en", "b", None) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    texts = {r.doc_id: r.text for r in p.dedup_lines(spark, docs, sf_dir).collect()}
    for i, text, *_ in rows:
        assert texts[i] == (text.replace(f"{planted}\n", "") if i < 1000 else text)


def test_run(spark, sf_dir):
    assert p.run(spark, sf_dir).count() > 0


def test_long_ids_beside_null_ids_stay(spark, sf_dir):
    rows = [(2**53 + 1, "some text of its own here", "en", "a", 25), (None, "another text of its own here", "en", "a", 28)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    assert {r.doc_id for r in p.one_of_near_copies(spark, docs, sf_dir).collect()} == {2**53 + 1, None}
