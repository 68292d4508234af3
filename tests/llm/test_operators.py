"""Each corpus operator against brute force, and at its edges: nulls, empty and long texts, ties, repeated rows, empty tables, further columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import byte_cnn, centroids, chat, collocations, embed_dedup, html_extract, labelled_pages, line_dedup, mixing, near_dedup, packing, quality_rules, queries, token_counts, toxicity
from tessera.llm.common import WORD_RE, connected_components, crc_remainder, table
from tests.rows import bag

DOCS = "doc_id long, text string, source string, extra string"
BPE, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def docs_of(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


EDGES = [
    (1, None, "a", "x"),
    (2, "", "a", "x"),
    (3, " \t\n", None, None),
    (4, "one two three four five six seven", "a", "x"),
    (4, "one two three four five six seven", "a", "x"),
    (None, "one two three four five six seven", None, "y"),
    (5, "word " * 30_000, "b", "x"),
    (6, "x" * 50_000, "b", "x"),
    (7, "naïve 日本 \U0001f600 <|endoftext|> a  b", "c", "x"),
]


@pytest.fixture(scope="module")
def edges(spark):
    return docs_of(spark, EDGES)


@pytest.fixture(scope="module")
def nothing(spark):
    return docs_of(spark, [])


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    assert bag(queries.QUERIES[name](spark, sf_dir).toPandas()) == bag(duck.sql(queries.ORACLES[name]).df())


# 1: quality rules


def counted(text):
    text = text or ""
    words = WORD_RE.findall(text)
    grams = list(zip(words, words[1:], words[2:], strict=False))
    often = Counter(grams)
    covered = {p for i, g in enumerate(grams) if often[g] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD_RE.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark, sf_dir, edges, nothing):
    for docs in (table(spark, sf_dir, "documents"), edges):
        want = Counter((r.doc_id, *counted(r.text)) for r in docs.collect())
        assert Counter(tuple(r)[:6] for r in quality_rules.statistics(docs).collect()) == want
    assert quality_rules.statistics(nothing).count() == 0


def test_rules_learned(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        rows.append((i, " ".join(f"w{rng.randrange(10**6)}{'##' if bad else ''}" for _ in range(60)), "s", None))
        labels.append((i, 0 if bad else 1))
    docs = docs_of(spark, rows)
    known = spark.createDataFrame([*labels, (7, None), (None, 0), (10**9, 0)], "doc_id long, quality int")
    stats = quality_rules.statistics(docs)
    rules = quality_rules.learn(stats, known)
    assert rules and all(len(r) <= quality_rules.MAX_CONDITIONS for r in rules)
    assert {r.doc_id for r in quality_rules.judge(stats, rules).where("kept").collect()} == {i for i, q in labels if q}
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.learn(stats, none) == []
    assert quality_rules.judge(stats, []).where("kept").count() == 600


def covering(rows, cuts):
    """The decision list by plain loops over rows: (measures, low, prune)."""
    q, rules = quality_rules, []

    def holds(rule, m):
        return all(m[name] > t if above else m[name] <= t for name, above, t in rule)

    while len(rules) < q.MAX_RULES:
        rule, left = (), [r for r in rows if not r[2]]
        while len(rule) < q.MAX_CONDITIONS:
            low, high = (sum(r[1] == k for r in left) for k in (1, 0))
            if not low or not high:
                break
            best = (1e-9, 0, 0, "")
            for name, ts in cuts.items():
                for t in ts:
                    for above in (False, True):
                        p, n = (sum(r[1] == k and holds([(name, above, t)], r[0]) for r in left) for k in (1, 0))
                        if p >= q.MIN_COVERED:
                            gain = p * (math.log2(p / (p + n)) - math.log2(low / (low + high)))
                            best = max(best, (gain, p, -n, str(q.Condition(name, above, t)), (name, above, t)), key=lambda x: x[:4])
            if len(best) < 5:
                break
            rule = (*rule, best[4])
            left = [r for r in left if holds(rule, r[0])]
        tried = []
        for k in range(1, len(rule) + 1):
            p, n = (sum(r[2] and r[1] == y and holds(rule[:k], r[0]) for r in rows) for y in (1, 0))
            tried.append(((p - n) / max(1, p + n), -k, p, n))
        if not tried:
            break
        _, k, p, n = max(tried)
        if p + n < q.MIN_COVERED or p / (p + n) < q.MIN_PRECISION:
            break
        rules.append(rule[:-k])
        rows = [r for r in rows if not holds(rule[:-k], r[0])]
    return rules


def test_rules_are_those_of_plain_covering(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        words, lines = rng.randrange(60, 400), rng.randrange(2, 40)
        chars, symbols = words * rng.randrange(3, 9), int(words * rng.random())
        twice, again = rng.randrange(lines), int(words * 0.5 * rng.random())
        upper = int(chars * rng.random())
        bad = (symbols > 0.6 * words and chars < 5 * words) or (twice > 0.6 * lines and words > 200) or (upper > 0.7 * chars and again > 0.25 * words)
        rows.append((i, words, chars, symbols, twice, again, lines, upper))
        labels.append((i, int(not bad) if rng.random() < 0.97 else int(bad)))
    stats = spark.createDataFrame(rows, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    labelled = quality_rules.measures(stats.join(known, "doc_id")).withColumn("low", (F.col("quality") < 1).cast("int"))
    cuts = quality_rules.thresholds(labelled)
    plain = [({m: r[m] for m in quality_rules.MEASURES}, r.low, zlib.crc32(str(r.doc_id).encode()) % quality_rules.PRUNE_FOLDS == 0) for r in labelled.collect()]
    want = covering(plain, cuts)
    rules = quality_rules.learn(stats, known)
    assert [tuple((c.measure, c.above, c.threshold) for c in rule) for rule in rules] == want
    assert len(want) >= 3 and sum(len(rule) >= 2 for rule in want) >= 3
    verdict = {r.doc_id: r.rule for r in quality_rules.judge(stats, rules).collect()}
    for r, (m, *_) in zip(labelled.collect(), plain, strict=True):
        first = next((k for k, rule in enumerate(want, 1) if all(m[n] > t if above else m[n] <= t for n, above, t in rule)), 0)
        assert verdict[r.doc_id] == first


def test_quality_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(1, 0), (4, 1), (None, 0), (99, 1), (5, None)], "doc_id long, quality int")
    got = quality_rules.quality_rules(edges, labels).collect()
    assert len(got) == len(EDGES)
    for r in got:
        words, repeated = r.n_words, r.n_repeat_words
        assert r.base_failed == (words < 50 or 100 * repeated > 50 * words) and (not r.kept if r.base_failed else r.kept == (r.rule == 0))
    assert quality_rules.quality_rules(nothing, labels).count() == 0


# 2: toxicity


def test_composed_table_is_the_chain_of_its_steps():
    rng = random.Random(7)
    for _ in range(3000):
        read = [rng.choice(toxicity.SYMBOLS) for _ in range(rng.randrange(1, 16))]
        chained = read
        for step in (toxicity.reported, toxicity.negation, toxicity.aimed):
            state, out = (), []
            for symbol in chained:
                state, symbol = step(state, symbol)
                out.append(symbol)
            chained = out
        at, composed = 0, []
        for symbol in read:
            at, symbol = toxicity.GRAMMAR[at, symbol]
            composed.append(symbol)
        assert composed == chained


def test_near_copies_teach_once(spark):
    words = [f"{a}{b}lengthy" for a in "abcdefgh" for b in "mnopqrst"]
    rows = [(i, " ".join([*words, "copied", "x" * (i % 3 + 1)]), 1) for i in range(30)]
    rows += [(100 + i, " ".join([words[i], words[i + 1], f"{'qwrtz'[i % 5] * 7}more", "plainly"]), 1) for i in range(40)]
    rows += [(200 + i, f"nothing of interest in {'abcdefghij'[i % 10] * 6} here {'klmnopqrst'[i // 10] * 7} today", 0) for i in range(100)]
    found, toxic, other = toxicity.candidates(spark.createDataFrame(rows, "doc_id long, text string, y int"))
    assert toxic <= 41 and other == 100
    assert not any(e.startswith("copied") for e, *_ in found) and any(e.startswith("plain") for e, *_ in found)


def test_grammar():
    lex = toxicity.Lexicon({"idiot$": 2.0, "lowei": 3.0})
    plain, aimed = lex.clause_score("what an idiot"), lex.clause_score("you are an idiot")
    assert aimed > plain > lex.clause_score("he is not an idiot") > 0
    assert lex.clause_score("she said he was an idiot") < plain
    assert lex.clause_score("idiotic weather") == 0 and lex.clause_score("loweichen da") == 3.0
    assert lex.clause_score("i will kill you") == toxicity.THREAT_WEIGHT and lex.clause_score("kill the lights") == 0
    assert lex.features("Fine. You IDIOT! Fine")[2] == 1
    assert lex.features(None) == lex.features("") == (0.0, 0.0, 0)


def test_toxicity_learned(spark, edges):
    rng = random.Random(5)
    rows, sample = [], []
    for i in range(400):
        words = [f"w{rng.randrange(500)}x{'abc'[rng.randrange(3)]}" for _ in range(40)]
        words = [re.sub(r"\d", lambda m: "qrstuvxyzk"[int(m[0])], w) for w in words]
        if i % 4 == 0:
            words[5:7] = ["grommel" + "abc"[rng.randrange(3)], "grommel" + "abc"[rng.randrange(3)]]
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    sample = spark.createDataFrame(rows, "doc_id long, text string, y int")
    entries, beta = toxicity.learn(sample)
    assert any(e.startswith("grommel") for e, _ in entries)
    scored = toxicity.with_matches(sample, entries, beta).select("y", F.col("_tx.score").alias("s")).collect()
    assert np.mean([(r.s >= 0.5) == bool(r.y) for r in scored]) > 0.97
    out = toxicity.classify(edges, sample).collect()
    assert len(out) == len(EDGES) and all(0 <= r.score <= 1 for r in out)
    assert toxicity.classify(edges.limit(0), sample).count() == 0
    assert toxicity.classify(edges, sample.limit(0)).count() == len(EDGES)


# 3: near duplicates


def labelled(text):
    words, seen, out = WORD_RE.findall(text or ""), Counter(), set()
    k = min(5, len(words))
    for i in range(len(words) - k + 1 if words else 0):
        g = tuple(words[i : i + k])
        out.add((g, seen[g]))
        seen[g] += 1
    return out


def brute_classes(rows, threshold=0.8):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, labelled(t))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both / (len(sets[a]) + len(sets[b]) - both) >= threshold:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in sets}


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "PART", 8)
    rng = random.Random(11)
    base = [[f"t{rng.randrange(3000)}" for _ in range(n)] for n in (4, 30, 120, 400, 120)]
    passage = [f"p{rng.randrange(3000)}" for _ in range(60)]
    rows = []
    for b in base:
        for copy in range(40):
            words = list(b)
            for _ in range(copy % 4):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(1000 + i, " ".join([*passage, *(f"o{rng.randrange(10**6)}" for _ in range(60))])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == brute_classes(rows)


def test_near_duplicates_of_short_texts(spark):
    rng = random.Random(12)
    rows = []
    for n in (5, 6, 8, 9, 12, 13, 17, 28):
        for _ in range(40):
            words = [f"s{rng.randrange(10**6)}" for _ in range(n)]
            end = rng.choice([[*words, "more"], ["more", *words], words[1:], [*words, "and", "more"]])
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(end))]
    rows += [(5000 + i, " ".join([*"the same eight words in every one here".split(), *[f"e{rng.randrange(60)}"] * (i % 3)])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == brute_classes(rows)


def test_near_duplicates_in_large_buckets(spark, monkeypatch):
    """Copies that are like their original but not like each other, and pairs of about 0.8 among texts that share a passage."""
    monkeypatch.setattr(near_dedup, "PART", 8)
    rng = random.Random(13)
    original = [f"h{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for _ in range(150):
        words = list(original)
        for at in rng.sample(range(10, 110, 10), 2):
            words[at] = f"n{rng.randrange(10**6)}"
        rows.append((len(rows), " ".join(words)))
    rows.append((900, " ".join(original)))
    passage = [f"p{rng.randrange(10**6)}" for _ in range(70)]
    for i in range(60):
        words = [*passage, *(f"o{rng.randrange(10**6)}" for _ in range(50))]
        rows += [(1000 + i, " ".join(words)), (2000 + i, " ".join([*words, *(f"m{rng.randrange(10**6)}" for _ in range(27))]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == brute_classes(rows)


def test_near_duplicates_recall(spark):
    """100 pairs of about 0.82 among texts that share a passage and are otherwise unlike, 2,000 words long."""
    rng = random.Random(14)
    passage, rows = [f"p{k}" for k in range(1400)], []
    for i in range(100):
        own = [f"o{rng.randrange(10**7)}" for _ in range(600)]
        other = list(own)
        for at in rng.sample(range(0, 600, 6), 38):
            other[at] = f"n{rng.randrange(10**7)}"
        rows += [(i, " ".join([*passage, *own])), (1000 + i, " ".join([*passage, *other]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == brute_classes(rows) and len(set(got.values())) == 100


def test_near_duplicates_of_repeated_ids(spark):
    rng = random.Random(15)
    a, b, c = ([f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(3))
    rows = [(5, " ".join(a)), (5, " ".join(b)), (9, " ".join([*b, "more"])), (3, " ".join(["more", *a])), (7, " ".join(c)), (8, " ".join(c)), (8, " ".join(c))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.class_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {(5, 3, False), (9, 3, False), (3, 3, True), (7, 7, True), (8, 7, False)}


def test_near_duplicate_edges(spark, edges, nothing):
    got = near_dedup.near_duplicates(edges).collect()
    assert len(got) == len(EDGES)
    assert {(r.doc_id, r.class_id) for r in got} == {(1, 1), (2, 2), (3, 3), (4, 4), (None, 4), (5, 5), (6, 6), (7, 7)}
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_alignment():
    rng = np.random.default_rng(0)
    a = rng.permutation(1000).astype(np.uint64)
    assert near_dedup.aligned_similarity(a, a.copy()) == 1.0
    assert near_dedup.aligned_similarity(a, a[50:]) == pytest.approx(0.95)
    assert near_dedup.aligned_similarity(a, a[::-1].copy()) < 0.8  # the same shingles in another order
    assert near_dedup.aligned_similarity(a, a[:10]) == 0.0


# 4: token counts


def plain_count(trie, token):
    """Tokens of the best segmentation, by dynamic programming over one token."""
    best = [(0.0, 0)]
    for end in range(1, len(token) + 1):
        ways = [(best[at][0] + trie.scores[token[at:end]], best[at][1] - 1) for at in range(max(0, end - trie.longest), end) if token[at:end] in trie.scores]
        if token[end - 1] not in trie.scores:
            ways.append((best[end - 1][0] + trie.unknown, best[end - 1][1] - len(token[end - 1].encode("utf-8", "surrogatepass"))))
        best.append(max(ways))
    return -best[-1][1]


def test_token_counts(spark, edges, nothing):
    from tokenizers import Tokenizer, models

    path = public_tokenizers.path("piece_bpe_32k.model")
    scores = token_counts.piece_scores(path)
    trie = token_counts.UnigramTrie(scores)
    rng = random.Random(1)
    words = {"".join(rng.choice("abcdeéß日x.,1") for _ in range(rng.randrange(1, 14))) for _ in range(2000)} | {"z" * 200, "z" * 300 + "a", "z" * 300 + "b日", "z" * 60 + "q" * 9}
    tokens = ["▁" + w for w in sorted(words)]
    assert trie.counts(tokens) == [plain_count(trie, t) for t in tokens]
    library = Tokenizer(models.Unigram([("<unk>", -99.0), *scores.items()], unk_id=0))
    for token, n in zip(tokens, trie.counts(tokens), strict=True):
        found = library.encode(token, add_special_tokens=False)
        if 0 not in found.ids:
            assert len(found.ids) == n
    got = Counter(map(tuple, token_counts.token_counts(edges, path).collect()))
    assert got == Counter((i, len(WORD_RE.findall(t or "")), sum(plain_count(trie, "▁" + w) for w in WORD_RE.findall(t or ""))) for i, t, *_ in EDGES)
    assert token_counts.token_counts(nothing, path).count() == 0


# 5: embeddings


def test_vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(300):
        v = centres[i % 12] + rng.normal(size=16) * (0.05 if i % 3 else 0.4)
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(i % 2)))
    rows += [(1000 + k, rows[k % 3][1], rows[k % 3][2]) for k in range(30)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, rows[0][1], None), (2004, [1.0], 1), (2004, [1.0], 1), (2005, [], 1), (2006, [None, 1.0], 0)]
    # Repeated ids with other vectors, null ids (one that alone joins two others), a cosine of exactly 0.93 and one just below.
    rows += [(3005, [1.0, 0.0], 1), (3005, [0.0, 1.0], 1), (3006, [1.0, 0.001], 1), (3007, [0.001, 1.0], 1), (None, rows[5][1], 1), (None, [1.0, 1.0, 1.0], 1), (None, None, 1)]
    rows += [(3010, [1.0, 0.0, 0.0], 0), (None, [1.0, 0.35, 0.0], 0), (3011, [1.0, 0.7, 0.0], 0), (3020, [0.0] * 4 + [1.0], 0), (3021, [3.6755951898978215, 0.0, 0.0, 0.0, 9.3], 0), (3022, [3.6756, 0.0, 0.0, 0.0, 9.29], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("digest", F.lit(1)).withColumn("cell", F.lit("x"))
    seen = frame.collect()
    good = [n for n, r in enumerate(seen) if r.label is not None and r.embedding and None not in r.embedding and np.isfinite(r.embedding).all() and np.any(r.embedding)]
    links, root = Counter(), list(range(len(seen)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, n in enumerate(good):
        for m in good[k + 1 :]:
            a, b = seen[n], seen[m]
            if a.label == b.label and len(a.embedding) == len(b.embedding):
                x, y = np.array(a.embedding, float), np.array(b.embedding, float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
                    links[n] += 1
                    links[m] += 1
                    root[find(n)] = find(m)
    least = {}
    for n, r in enumerate(seen):
        if r.vec_id is not None:
            least[find(n)] = min(r.vec_id, least.get(find(n), r.vec_id))
    want = Counter((r.vec_id, links[n], least.get(find(n)), least.get(find(n)) in (r.vec_id, None)) for n, r in enumerate(seen))
    for tile in (1024, 16):
        assert Counter(map(tuple, embed_dedup.link_vectors(frame, tile=tile).collect())) == want
    assert embed_dedup.link_vectors(frame.limit(0)).count() == 0


def test_tiles_that_cannot_link_do_not_meet(spark):
    rng = np.random.default_rng(6)
    sides = [(i, [float(x) for x in rng.normal(size=8) * 0.1 + (9 if i % 2 else -9) * np.eye(8)[0]], 1) for i in range(200)]
    vectors = spark.createDataFrame(sides, "vec_id long, embedding array<double>, label long").select(F.sha2(F.col("vec_id").cast("string"), 256).cast("binary").alias("digest"), F.lit(1).cast("long").alias("copies"), "label", "embedding")
    turns = embed_dedup.principal_turns([np.array(r[1]) for r in sides])
    turn = turns[8]
    assert turn @ turn.T == pytest.approx(np.eye(8), abs=1e-9)
    tiles = embed_dedup.tiled(embed_dedup.placed(vectors, turns, 0.93), 25)
    met = embed_dedup.meeting(tiles, 0.93).where("side = 0").count()
    n = tiles.select("tile").distinct().count()
    assert n == 8 and met < n * (n + 1) / 2


# 6: classifier


def test_gradients():
    rng = np.random.default_rng(2)
    w = {k: v.astype(np.float64) for k, v in byte_cnn.start(rng).items()}
    docs, y = [byte_cnn.chunked(t) for t in ("abc###" * 40, "", "hello world " * 200)], np.array([0.0, 1.0, 1.0])

    def loss(w):
        total = 0.0
        for d, t in zip(docs, y, strict=True):
            top, _ = byte_cnn.pooled(d, w)
            p = byte_cnn.head(top.mean(0)[None], top.max(0)[None], w)[2][0]
            total -= t * np.log(p) + (1 - t) * np.log(1 - p)
        return total / len(y)

    g = byte_cnn.gradients(docs, y, w)
    for name in ("out", "hidden", "conv", "conv_b"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        up, down = ({**w, name: w[name].copy()} for _ in range(2))
        up[name][at] += 1e-5
        down[name][at] -= 1e-5
        assert g[name][at] == pytest.approx((loss(up) - loss(down)) / 2e-5, rel=2e-2, abs=1e-5)


def test_forward_pass():
    """The score by loops over bytes, chunks and filters."""
    w = {k: v.astype(np.float64) for k, v in byte_cnn.start(np.random.default_rng(3)).items()}
    for text in (None, "é", "some plain text " * 140):
        raw = [*(text or "").encode()]
        step = byte_cnn.CHUNK - byte_cnn.OVERLAP
        rows = []
        for at in range(0, max(1, len(raw) - byte_cnn.OVERLAP), step):
            part = raw[at : at + byte_cnn.CHUNK]
            part += [byte_cnn.PAD] * (byte_cnn.CHUNK - len(part))
            top = []
            for f in range(byte_cnn.FILTERS):
                values = [sum(w["embed"][part[p + k]] @ w["conv"][k * byte_cnn.EMBED : (k + 1) * byte_cnn.EMBED, f] for k in range(byte_cnn.WIDTH)) for p in range(0, byte_cnn.CHUNK - byte_cnn.WIDTH + 1, byte_cnn.STRIDE)]
                top.append(max(0.0, max(values) + w["conv_b"][f]))
            rows.append(top)
        both = np.concatenate([np.mean(rows, 0), np.max(rows, 0)])
        hidden = np.maximum(both @ w["hidden"] + w["hidden_b"], 0)
        want = 1 / (1 + np.exp(-(hidden @ w["out"] + w["out_b"][0])))
        assert byte_cnn.score(text, w) == pytest.approx(want, abs=1e-6)


def test_classifier(spark, edges):
    rng = random.Random(9)
    text = lambda bad: " ".join("".join(rng.choice("etaoin") for _ in range(5)) + ("***" if bad and rng.random() < 0.5 else "") for _ in range(60))
    rows = [(i, text(i % 3 == 0), int(i % 3 != 0)) for i in range(240)]
    sample = spark.createDataFrame(rows[:160], "doc_id long, text string, y int")
    held = spark.createDataFrame(rows[160:], "doc_id long, text string, y int")
    got = {r.doc_id: r for r in byte_cnn.classify(held, sample, 0.7).collect()}
    assert np.mean([got[i].predicted == y for i, _, y in rows[160:]]) > 0.95
    assert len(byte_cnn.classify(edges, sample, 0.7).collect()) == len(EDGES)
    assert {r.score for r in byte_cnn.classify(edges, sample.limit(0), 0.7).collect()} == {0.5}
    w = byte_cnn.train([r[1] for r in rows[:60]], np.array([r[2] for r in rows[:60]], dtype=np.float32))
    texts = [None, "", "a" * 200_000, "b" * 961, "short"]
    assert byte_cnn.scores(texts, w) == pytest.approx([byte_cnn.score(t, w) for t in texts], abs=1e-5)


# 7: packing


def test_packing(spark, edges, nothing):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    want = {}
    for i, t, *_ in EDGES:
        want[i] = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
    rows = packing.pack(edges, BPE, RANKS).collect()
    bins = defaultdict(list)
    for r in rows:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length and zlib.crc32(ids.tobytes()) == r.ids_crc32
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = Counter()
    for r in rows:
        total[r.doc_id] += r.length
        assert r.length == 1024 or r.piece == 0
    assert all(total[i] == len(ids) * sum(e[0] == i for e in EDGES) for i, ids in want.items())
    assert packing.pack(nothing, BPE, RANKS).count() == 0


def test_chunked_encoding_is_whole_encoding():
    enc, rng = packing.ChunkEncoder(BPE, RANKS), random.Random(8)
    parts = ["a", "B", " ", "  ", "\n", "\t", "1", "'s", "!", "é", "\u3000", ".", "日", "\xa0", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert enc.encode(text) == enc.slow(text), repr(text)


def test_open_bins():
    """Each piece goes where a scan of all open bins finds least room that suffices; one bin more than the limit closes the fullest."""
    rng, bins = random.Random(2), packing.OpenBins(100, 4)
    free, closed = {}, 0
    for _ in range(2000):
        n = rng.randrange(1, 101)
        fitting = [f for f in free.values() if f >= n]
        number, offset = bins.place(n)
        if fitting:
            assert free[number] == min(fitting)
        else:
            if len(free) == 4:
                least = min(free.values())
                gone = [k for k, f in free.items() if f == least and k not in [b for x in bins.by_free.values() for b in x]]
                assert len(gone) == 1
                del free[gone[0]]
                closed += 1
            assert number not in free and offset == 0
            free[number] = 100
        assert offset == 100 - free[number]
        free[number] -= n
        if not free[number]:
            del free[number]
        assert sorted(free) == sorted(b for x in bins.by_free.values() for b in x) and bins.n_open == len(free)
    assert closed > 50


def test_few_sequences(spark):
    rows = packing.pack(table(spark, "/root/testdata/sf0.01", "documents"), BPE, RANKS).select("sequence_id", "length").collect()
    assert len({r.sequence_id for r in rows}) <= 1.03 * -(-sum(r.length for r in rows) // packing.SEQUENCE_TOKENS)


def test_packing_does_not_depend_on_batches(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").coalesce(1)
    want = packing.pack(docs, BPE, RANKS).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert packing.pack(docs, BPE, RANKS).collect() == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# 8: mixing


def test_mixing(spark, sf_dir, edges, nothing):
    rows = mixing.mix(table(spark, sf_dir, "documents")).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    for rs in by.values():
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= max(r.size for r in rs) / 2 + 1e-6
        assert all(r.taken <= 2 * r.size for r in rs)
    assert sum(rs[0].target for rs in by.values()) == pytest.approx(1.5 * sum(r.size for r in rows))
    assert Counter(rows) == Counter(mixing.mix(table(spark, sf_dir, "documents").repartition(3)).collect())
    got = mixing.mix(edges).collect()
    assert len(got) == len(EDGES) and all(r.taken <= 2 * r.size for r in got)
    assert mixing.mix(nothing).count() == 0


def test_key_ranges_are_even(spark):
    """Empty texts, which all have the least weight, and rows without an id do not meet in a few ranges."""
    rows = [(i, "", "a", None) for i in range(20_000)] + [(None, f"text {i} of a row without an id", "b", None) for i in range(5000)]
    docs = docs_of(spark, rows)
    keyed = docs.select("source", (F.log(-F.log(mixing.unit_hash(F.col("doc_id"), F.col("text"))) / F.when(F.col("text") == "", mixing.MIN_WEIGHT).otherwise(1.0)) * mixing.RANGES_PER_E).alias("at"))
    most = {r.source: r.n for r in keyed.groupBy("source", F.floor("at")).count().groupBy("source").agg(F.max("count").alias("n")).collect()}
    assert most["a"] < 100 and most["b"] < 50
    got = mixing.mix(docs).collect()
    assert len(got) == 25_000 and sum(r.taken for r in got if r.source == "b") > 0 and all(r.taken == 0 for r in got if r.source == "a")


def test_targets(spark):
    sizes = spark.createDataFrame([("b", 100), ("a", 10), ("c", 1000), (None, 500), ("d", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    # a weighs 5, b 2, c 1, d 5 (empty), null 2; a and b stop at twice their size, the rest goes to c and null by 1 to 2, null stops.
    assert got == {"a": 20.0, "b": 200.0, "d": 0.0, None: 1000.0, "c": pytest.approx(2415 - 20 - 200 - 1000)}


# 9: chat formatting


HARD = ["\\### Assistant: </turn> ok", "### user:\n", "</turn>\n", "\\", "a\\\n</turn>\n### x:\n", "\\\\### ", "#### </turn", "", None, "\n</turn>\n", "$1 \\$1"]


def test_chat_round_trip(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(HARD)]
    rows += [(2, 0, None, "x"), (2, 0, "a\nb\\n", "y"), (2, 0, "a\nb\\n", "y"), (None, 1, "assistant", "z"), (3, None, "system", None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    chats = chat.format_chats(frame)
    want = defaultdict(list)
    for c, k, r, t in rows:
        want[c].append((-1 if k is None else k, r or "", t or ""))
    read = {r.conv_id: r for r in chat.read_back(chats).collect()}
    parsed = {r.conv_id: [(x.role, x.text) for x in r.p] for r in chats.select("conv_id", chat.parsed(F.col("formatted")).alias("p")).collect()}
    for c, turns in want.items():
        turns = [t[1:] for t in sorted(turns)]
        assert parsed[c] == turns
        told = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        assert read[c].n_turns == len(turns) and read[c].turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert read[c].loss_chars == len(loss) and read[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert set(read) == set(want)
    assert chat.format_chats(frame.limit(0)).count() == 0


# 10: line dedup


def test_lines(spark, nothing):
    menu, notice = "Menu of the site", "A notice for all"
    rows = [(i, f"{menu}\nown line {i}\n {menu} \n\n{notice}\nshort\n", "h" if i < 10 else None, "x") for i in range(20)]
    rows += [(100, None, "h", "x"), (101, "", "h", "x"), (102, f"{menu}\nalone", "other", "x"), (102, f"{menu}\nalone", "other", "x")]
    rows += [(200 + i, "a line " * 50_000 + f"\n{notice}" * (i < 3), "long", "x") for i in range(3)]
    docs = docs_of(spark, rows).withColumnRenamed("source", "host")
    got = {(r.doc_id, r.host): r for r in line_dedup.drop_boilerplate(docs, F.col("host")).collect()}
    for i in range(20):
        r = got[i, "h" if i < 10 else None]
        assert r.text == f"own line {i}\n\nshort\n" and r["_n_dropped"] == 3 and r.extra == "x"
    assert got[100, "h"].text is None and got[101, "h"].text == "" and got[102, "other"].text == f"{menu}\nalone"
    assert all(got[200 + i, "long"].text == "" for i in range(3))
    assert line_dedup.drop_boilerplate(nothing, F.col("source")).count() == 0


# shared parts, and what the queries promise


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (200, 200)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame([(7,), (300,)], "id long"), spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert all(got[i] == 0 for i in range(61)) and got[102] == 100 and got[300] == 300
    assert connected_components(None, spark.createDataFrame([], "a long, b long"), "t").count() == 0


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r for r in table(spark, sf, "labels").collect()}
    quality = [(r.score, labels[r.doc_id].quality) for r in queries.op6_quality_classifier(spark, sf).where("held_out").collect() if r.doc_id in labels]
    assert auc(quality) > 0.9
    toxic = [(r.score, labels[r.doc_id].toxic) for r in queries.op2_toxicity(spark, sf).where("held_out").collect() if r.doc_id in labels]
    assert auc(toxic) > 0.7
    folds = {r.doc_id: r.x for r in spark.range(50).select(F.col("id").alias("doc_id"), crc_remainder(F.col("id"), 5).alias("x")).collect()}
    assert folds == {i: zlib.crc32(str(i).encode()) % 5 for i in range(50)}


# Ids that doubles cannot hold, in one batch with a null id

BIG = 2**53 + 1


def test_long_ids_beside_null_ids(spark):
    docs = spark.createDataFrame([(BIG, "one two three four five six"), (None, "seven eight nine ten")], "doc_id long, text string").coalesce(1)
    sample = spark.createDataFrame([(1, "good text", 1), (2, "bad text", 0)], "doc_id long, text string, y int")
    for out in (
        near_dedup.near_duplicates(docs),
        token_counts.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")),
        byte_cnn.classify(docs, sample, 0.7),
        packing.pack(docs, BPE, RANKS),
    ):
        assert {r.doc_id for r in out.collect()} == {BIG, None}
    vectors = spark.createDataFrame([(BIG, [1.0, 0.0], BIG), (BIG + 1, [1.0, 0.0], BIG + 1), (None, [0.0, 1.0], None)], "vec_id long, embedding array<double>, label long").coalesce(1)
    got = {r.vec_id: r.n_links for r in embed_dedup.link_vectors(vectors).collect()}
    assert got == {BIG: 0, BIG + 1: 0, None: 0}


# 11: centroid clustering


def plain_lloyd(vectors, k, rounds, seed):
    """(vec_id, cluster, distance) by plain loops over integers."""
    rows = [(i, [max(-(2**27), min(2**27, math.floor(256 * x))) for x in v]) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: "~" if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    c = [v for _, v in sorted(rows, key=lambda r: (name(r[0]), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), j) for j, w in enumerate(c))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in rows]
        for j in range(len(c)):
            if own := [v for (_, v), a in zip(rows, at, strict=True) if a == j]:
                c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return Counter((i, *reversed(nearest(v))) for i, v in rows)


def test_clusters_are_those_of_plain_lloyd(spark):
    rng = random.Random(11)
    rows = [(i, [rng.choice([rng.random(), round(rng.random(), 1), -rng.random()]) for _ in range(3)]) for i in range(400)]
    # Repeated rows and ids, null ids, ties, huge components; the last five are left out.
    rows += [(7, rows[7][1]), (7, [0.5, 0.5, 0.5]), (None, [0.1, 0.2, 0.3]), (None, [0.1, 0.2, 0.3]), (900, [0.0, -0.0, 0.0]), (901, [1e30, -1e300, 5.0])]
    rows += [(902, None), (903, []), (904, [1.0]), (905, [1.0, None, 0.0]), (906, [float("nan"), 0.0, float("inf")])]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, cluster string, v int").repartition(5)
    found, c = centroids.cluster_vectors(frame, k=8, rounds=4, dimensions=3)
    want = plain_lloyd([r for r in rows if r[1] and len(r[1]) == 3], 8, 4, centroids.SEED)
    assert Counter(map(tuple, found.collect())) == want
    out = centroids.clustered(frame, k=8, rounds=4, dimensions=3).collect()
    assert {r.centroid_sha256 for r in out} <= {centroids.digest_of(x) for x in c}
    few = centroids.clustered(frame.where("vec_id < 5"), k=8, rounds=4, dimensions=3).collect()
    assert len(few) == 5 and {r.distance for r in few} == {0}
    for none in (frame.limit(0), frame.where("vec_id > 901")):
        assert centroids.clustered(none, k=8, rounds=4, dimensions=3).count() == 0


def test_bounds_spare_scans_and_hold():
    rng = np.random.default_rng(5)
    centres = rng.integers(-200, 200, (12, 8))
    v = (centres[rng.integers(0, 12, 3000)] + rng.integers(-15, 16, (3000, 8))).astype(np.int32)
    c, drift = v[:12].astype(np.int64), None
    state = (np.full(3000, -1), np.zeros(3000), np.zeros(3000))
    scans = []
    for _ in range(6):
        *state, scanned = centroids.reassigned(v, *state, c, drift)
        scans.append(scanned)
        away = centroids.squared(v, c)
        assert np.array_equal(state[0], away.argmin(1))
        own = np.sqrt(away[np.arange(3000), state[0]])
        away[np.arange(3000), state[0]] = 1 << 40
        assert np.all(state[1] >= own - 1e-6) and np.all(state[2] <= np.sqrt(away.min(1)) + 1e-6)
        new = np.array([v[state[0] == j].sum(0) // max(1, (state[0] == j).sum()) if (state[0] == j).any() else c[j] for j in range(12)])
        drift, c = centroids.drifts(c, new), new
    assert scans[0] == 3000 and scans[-1] < 1000
    big = np.array([[2**27, -(2**27)], [-(2**27), 2**27]])
    assert centroids.squared(big, big).tolist() == [[0, 2**57], [2**57, 0]]


# 12: phrase collocations


def plain_collocations(rows, most, least, top):
    """{lang: [(phrase, a, l, r, n, score)]} by plain loops."""
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang, text = lang or "und", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts[lang].update(tuple(words[i : i + m]) for m in range(1, most + 1) for i in range(len(words) - m + 1))
    out = {}
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((" ".join(p), a, f[p[:k]], f[p[k:]], totals[lang], score))
        out[lang] = sorted(kept, key=lambda x: (-x[5], -x[1], x[0].encode()))[:top]
    return out


@pytest.mark.parametrize(("most", "least", "width"), [(3, 3, None), (4, 2, 1 << 16), (3, 3, 64)])
def test_phrases_are_those_of_plain_counting(spark, most, least, width):
    """A sketch of 64 cells lets everything through, and the rows stay the same."""
    rng = random.Random(12)
    vocabulary = ["new", "York", "CITY", "é", "Éa", "日本", "x<1>", "a\x00b", " ", "Hall"]
    rows = [("".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\r\n", "\x0b", "?! "]) for _ in range(rng.randrange(40))), rng.choice(["en", "de", None, "und"])) for _ in range(150)]
    rows += [(None, "en"), ("", None), (" ..\n", "de"), ("New York City Hall " * 3000, "en"), ("w" * 30_000, "fr"), *[("same row again", "fr")] * 5]
    frame = spark.createDataFrame([(*r, 1, "y") for r in rows], "text string, lang string, phrase int, n string").repartition(4)
    got = defaultdict(list)
    for r in collocations.collocations(frame, most_words=most, least=least, top=20, width=width).orderBy("lang", "rank").collect():
        assert r.rank == len(got[r.lang]) + 1
        got[r.lang].append((r.phrase, r.a, r.l, r.r, r.n, r.score))
    assert dict(got) == {k: v for k, v in plain_collocations(rows, most, least, 20).items() if v}
    assert collocations.collocations(frame.limit(0)).count() == 0


def test_sketch_lets_through_what_is_frequent(spark):
    rows = [("common pair " * 7 + f"rare{i} word{i}", "en") for i in range(2000)]
    frame = spark.createDataFrame(rows, "text string, lang string").repartition(6)
    bits = collocations.sketched(frame, 1 << 16, 10, 3)
    grams = collocations.Grams("en", [r[0] for r in rows])
    held = [grams.text(s, m) for m, s, _ in collocations.survivors(grams, bits, 1 << 16, 3)]
    assert {"common", "pair", "common pair", "pair common", "common pair common", "pair common pair"} <= set(held) and len(held) < 300


def test_exact_scores_beyond_64_bits(spark):
    a, l, r = 3_000_000_017, 4_000_000_007, 5_000_000_029
    counts = spark.createDataFrame([("en", 1, "x", l), ("en", 1, "y", r), ("en", 2, "x y", a)], "lang string, size int, phrase string, n long")
    assert collocations.scored(counts).first().score == 10**6 * a * a // (l * r)


# 13: main text of pages


def plain_marginals(parent, unary, pair):
    """P(state 1) of each node and P(states) of each edge, by all assignments."""
    n = len(parent)
    node, edge, total = np.zeros(n), np.zeros((n, 2, 2)), 0.0
    for states in itertools.product((0, 1), repeat=n):
        weight = math.exp(sum(unary[i] * x for i, x in enumerate(states)) + sum(pair[i][states[p], states[i]] for i, p in enumerate(parent) if p >= 0))
        total += weight
        node += weight * np.array(states)
        for i, p in enumerate(parent):
            if p >= 0:
                edge[i, states[p], states[i]] += weight
    return node / total, edge / total


def test_messages_give_exact_marginals():
    sources = ["<div class=a>x<p>y<b>z</b></p><ul><li>q<li>r</ul></div>", "", "<p>one<p>two", "<nav><a href=/>home</a></nav>t"]
    pages = [html_extract.Page(s) for s in sources]
    names = sorted({f for p in pages for fs in html_extract.features(p) for f in fs})
    known, kinds = {f: k for k, f in enumerate(names)}, {t: k for k, t in enumerate(["", "p", "#text", "div"])}
    rng = np.random.default_rng(2)
    w, edges = rng.normal(size=len(known)), rng.normal(size=(4, 2, 2)) * 2
    forest = html_extract.Forest(pages, known, kinds)
    node, edge = forest.marginals(w, edges)
    at = 0
    for page in pages:
        unary = [sum(w[known[f]] for f in fs) for fs in html_extract.features(page)]
        want, want_edges = plain_marginals(page.parent, unary, [edges[kinds.get(t, 0)] for t in page.tag])
        n = len(page.parent)
        assert np.allclose(node[at : at + n, 1], want) and np.allclose(edge[at : at + n], want_edges)
        at += n


def test_trees():
    page = html_extract.Page("<title>no</title><body>a &amp; <b>b</b>\n c<p class='leadText x' id=one>d<p>e<script>f</script><ul><li>g<a href=/>h</a><li>i</ul><button>j</button><br>k<td hidden>l<p data-main=1>m<div>n")
    assert [(t, page.tag[page.parent[i]]) for i, t in enumerate(page.text) if t] == [("a & b c", "body"), ("d", "p"), ("e", "p"), ("gh", "li"), ("i", "li"), ("k", "body"), ("l", "td"), ("m", "p"), ("n", "div")]
    assert page.names[page.tag.index("p")] == ("lead", "one", "text", "x")
    deep = html_extract.Page("<div>" * 20_000 + "text" + "</div>" * 20_000)
    assert len(deep.parent) == 20_002


@pytest.fixture(scope="module")
def page_sample(spark, sf_dir):
    return sorted(r.html for r in table(spark, sf_dir, "pages").select("html").collect())


@pytest.fixture(scope="module")
def page_model(page_sample):
    return html_extract.learned(page_sample, drawn=500)


def test_main_text_held_out(page_model, page_sample):
    """Layouts and texts that the model has not seen; characters."""
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(500)]
    prose = [" ".join(" ".join(rng.choices(words, k=rng.randint(4, 18))) + rng.choice(".!?") for _ in range(rng.randint(1, 8))) for _ in range(200)]
    pages = [html_extract.Page(s) for s in labelled_pages.labelled_pages(prose, ["Home", "About us", "More"], 200, seed=77)]
    hit = false = missed = 0
    for page, held in zip(pages, page_model.marginals(pages), strict=True):
        for text, p, main in zip(page.text, held, page.main, strict=True):
            n = len(text or "")
            hit, false, missed = hit + n * (p >= 0.5 and main), false + n * (p >= 0.5 and not main), missed + n * (p < 0.5 and main)
    assert hit / (hit + false) > 0.97 and hit / (hit + missed) > 0.97
    for source, text in zip(page_sample, page_model.texts(page_sample), strict=True):
        article = re.split("</?article>", source)[1]
        assert text == "\n\n".join(t for t in html_extract.Page(article).text if t)


HAND_MADE = [
    (
        "<header><h1>Site</h1><nav><a href=/>Home</a> <a href=/b>Blog</a></nav></header><div class=cookie-banner>We use cookies to improve things. <a href=#>Accept</a></div>"
        "<main><h1>Title of it</h1><p>First paragraph with a number of words, &quot;and&quot; a sentence. Another&nbsp;one\n here for the reader.</p><aside class=related><h3>Related</h3><ul><li><a href=/1>One</a><li><a href=/2>Two</a></ul></aside>"
        "<p>Second paragraph has more words in it, as prose does, and ends.</p></main><section id=comments><h2>2 Comments</h2><div class=comment><b>Bob</b><p>Great post, I really enjoyed reading it very much. Thanks!</p></div></section>"
        "<form><label>Mail</label><input><button>Send</button></form><footer>&copy; 2024 Site</footer>",
        'Title of it\n\nFirst paragraph with a number of words, "and" a sentence. Another one here for the reader.\n\nSecond paragraph has more words in it, as prose does, and ends.',
    ),
    (
        "<div id=wrap><div class=menu><ul><li>Home</li><li>Contact</li></ul></div><div class=post><p>Main text begins here and has a few sentences in it. This is one.</p><div class=ad>Buy this now, it is cheap and good for you.</div>"
        "<p>It goes on here with another paragraph of text for all.</p><ul><li>an item of a list in the text</li><li>another item of the same list</li></ul></div><div class=comments><p>I do not agree with any of this at all. It is wrong.</p></div></div>",
        "Main text begins here and has a few sentences in it. This is one.\n\nIt goes on here with another paragraph of text for all.\n\nan item of a list in the text\n\nanother item of the same list",
    ),
    ("<nav><a href=/>a</a> <a href=/b>b</a></nav>", ""),
    ("", ""),
    (None, ""),
    (" \n", ""),
]


def test_hand_made_pages(page_model):
    assert list(page_model.texts([s for s, _ in HAND_MADE])) == [t for _, t in HAND_MADE]


def test_extraction_edges(spark, sf_dir, page_model):
    long = "<article>" + "<p>A paragraph of some words, and a sentence.</p>" * 20_000 + "</article>"
    rows = [(BIG, "u", long, "x", 1), (None, None, None, None, 2), (None, "u", HAND_MADE[0][0], "x", 3), (5, "u", "<p>", "x", 4), (5, "u", "<p>", "x", 4)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long").coalesce(1)
    got = sorted(map(tuple, html_extract.extracted(frame, model=page_model).collect()), key=str)
    want = [(BIG, "u", "\n\n".join(["A paragraph of some words, and a sentence."] * 20_000)), (None, None, ""), (None, "u", HAND_MADE[0][1]), (5, "u", ""), (5, "u", "")]
    assert got == sorted([(*r, len(r[2])) for r in want], key=str)
    assert html_extract.extracted(frame.limit(0)).count() == 0
    out = queries.op13_html_extraction(spark, sf_dir)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert {r.page_id for r in out.where("n_chars > 0").collect()} == {r.page_id for r in table(spark, sf_dir, "pages").collect()}
