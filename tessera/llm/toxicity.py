"""Toxicity by a weighted finite-state pattern grammar.

A lexicon transducer turns the words of a clause into classes: insults (whole words, or stems that any ending may follow, with
weights learned from labels), threat verbs, targets, negations, verbs of saying, quotation marks. Three transducers rewrite the
classes: reported speech and negation take force from insults and threats in their scope, a target gives it to those beside it. They
are composed into one table. A clause scores the sum of the weights of what comes out; a text's clauses give it
two features, their sum and their maximum, and a logistic function of these, fitted on the same labelled rows, is the score.

Stems and weights come from LABELLED_ROWS labelled rows at most, those of lowest hash that may be learned from; the entries are as many as
have MIN_SUPPORT toxic texts among these, and MIN_PRECISION. Near copies, which share the DRAWN words of lowest hash among their longer words, count
once, so that the words of one copied text do not pass for insults. Scoring is one pass of a map over the documents, without a
shuffle; texts are read whole, and only clauses that hold an insult or a threat are run through the grammar.

Null and empty texts have no clauses and get the score of a text without matches. Labels that are null, or whose id matches no
document, teach nothing. Without labelled rows of both kinds the lexicon is SEED_INSULTS alone. Repeated rows are scored alike. Only
the named columns are read. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

LABELLED_ROWS = 12_000
MIN_SUPPORT = 6
DRAWN = 4
MIN_PRECISION = 0.85
STEM_CHARS = (4, 12)
#: A stem gives way to a longer one that keeps this share of its texts.
SAME_SUPPORT = 0.95
TOP_WEIGHT = 6.0

# Fixed word lists.
SEED_INSULTS = "idiot idiots moron morons imbecile stupid dumb scum scumbag trash filth vermin loser losers pathetic worthless disgusting clown jerk bastard".split()
THREATS = "kill murder hurt beat destroy shoot stab hang burn attack strangle".split()
TARGETS = "you your yours yourself u ya he she they them him her those these du dich dir ihr euch tu te toi vous ustedes usted".split()
NEGATIONS = "not no never neither nor without isn't aren't wasn't weren't don't doesn't didn't won't cannot can't nicht kein keine nie ne pas jamais nunca".split()
REPORTS = "said says say told tells called calls wrote writes claimed claims reported reports quoted quotes alleged according sagte dit dijo".split()
SEED_WEIGHT = 2.0
THREAT_WEIGHT = 4.0
#: What an insult's weight is multiplied by, by class.
FORCE = {"I": 1.5, "i": 1.0, "d": 0.25, "s": 0.3}

CLAUSE = re.compile(r"[^.!?;\n]+")
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[\"“”„«»]")
SYMBOLS = "oihynrq"
Step = Callable[[tuple, str], tuple[tuple, str]]


def negation(state: tuple, symbol: str) -> tuple[tuple, str]:
    """Insults (i) and threats (h) in the three words after a negation (n) come out denied (d) or void (D)."""
    left = state[0] if state else 0
    if symbol == "n":
        return (3,), symbol
    out = {"i": "d", "h": "D"}.get(symbol, symbol) if left else symbol
    return (max(0, left - 1),), out


def reported(state: tuple, symbol: str) -> tuple[tuple, str]:
    """After a verb of saying (r) insults come out as said (s), threats as void, to the clause's end or its closing quotation mark (q)."""
    mode = state[0] if state else 0  # 0 none, 1 after the verb, 2 inside its quotation
    if symbol == "r":
        return (max(1, mode),), symbol
    if symbol == "q":
        return ({0: 0, 1: 2, 2: 0}[mode],), symbol
    return (mode,), {"i": "s", "h": "D"}.get(symbol, symbol) if mode else symbol


def aimed(state: tuple, symbol: str) -> tuple[tuple, str]:
    """A target (y) up to four words before an insult, or two after, makes it aimed (I, a); a threat up to three words before one (H)."""
    before, pending, hot = state or (0, 0, 0)
    out = symbol
    if symbol == "y":
        out = "H" if pending else "a" if hot else "y"
        return (4, 0, 0), out
    if symbol == "i":
        out = "I" if before else "i"
        return (max(0, before - 1), max(0, pending - 1), 2 if out == "i" else 0), out
    pending = 3 if symbol == "h" else max(0, pending - 1)
    return (max(0, before - 1), pending, max(0, hot - 1)), out


def compose(*steps: Step) -> dict[tuple[int, str], tuple[int, str]]:
    """One transducer that feeds each step's output to the next: (state, symbol) to (state, output), state 0 first."""
    numbers: dict[tuple, int] = {((),) * len(steps): 0}
    table: dict[tuple[int, str], tuple[int, str]] = {}
    waiting = list(numbers)
    while waiting:
        states = waiting.pop()
        for symbol in SYMBOLS:
            out, after = symbol, []
            for step, state in zip(steps, states, strict=True):
                state, out = step(state, out)
                after.append(state)
            if tuple(after) not in numbers:
                numbers[tuple(after)] = len(numbers)
                waiting.append(tuple(after))
            table[numbers[states], symbol] = (numbers[tuple(after)], out)
    return table


GRAMMAR = compose(reported, negation, aimed)
#: Weights of what comes out: of the weight of the word that is read, of the insult before it, and a constant.
OUT_WEIGHTS = {
    **{out: (force, 0.0, 0.0) for out, force in FORCE.items()},
    "a": (0.0, FORCE["I"] - FORCE["i"], 0.0),
    "H": (0.0, 0.0, THREAT_WEIGHT),
}
#: The weighted transducer: (state, symbol) to the next state, the three weights, and whether an insult has come out.
WEIGHTED = {at: (state, *OUT_WEIGHTS.get(out, (0.0, 0.0, 0.0)), out in FORCE) for at, (state, out) in GRAMMAR.items()}


class Lexicon:
    """The first transducer: words to classes. Entries ending in $ are whole words, others stems."""

    def __init__(self, entries: dict[str, float]):
        import ahocorasick

        self.words = {e[:-1]: w for e, w in entries.items() if e.endswith("$")}
        self.stems = {e: w for e, w in entries.items() if not e.endswith("$")}
        self.lengths = sorted({len(s) for s in self.stems})
        self.classes = {w: c for c, ws in (("h", THREATS), ("y", TARGETS), ("n", NEGATIONS), ("r", REPORTS)) for w in ws}
        self.found = ahocorasick.Automaton()
        for e in {*self.words, *self.stems, *THREATS}:
            self.found.add_word(e, len(e))
        self.found.make_automaton()

    def read(self, token: str) -> tuple[str, float]:
        weight = self.words.get(token, 0.0)
        for n in self.lengths:
            if n > len(token):
                break
            weight = max(weight, self.stems.get(token[:n], 0.0))
        if weight:
            return "i", weight
        if token in self.classes:
            return self.classes[token], 0.0
        return ("q" if not token[0].isalpha() else "o"), 0.0

    def clause_score(self, clause: str) -> float:
        state, total, last = 0, 0.0, 0.0
        for token in TOKEN.findall(clause):
            symbol, weight = self.read(token.replace("’", "'"))
            state, of_word, of_last, constant, insult = WEIGHTED[state, symbol]
            total += of_word * weight + of_last * last + constant
            if insult:
                last = weight
        return total

    def features(self, text: str | None) -> tuple[float, float, int]:
        """Sum and maximum of the clause scores of text, and the number of clauses that score."""
        low = (text or "").lower()
        hits = [end - n + 1 for end, n in self.found.iter(low)]
        hits = [h for h in hits if h == 0 or not low[h - 1].isalpha()]
        total, top, n, done = 0.0, 0.0, 0, -1
        for h in sorted(hits):
            if h < done:
                continue
            begin = max(low.rfind(c, 0, h) for c in ".!?;\n") + 1
            clause = CLAUSE.match(low, begin)
            done = clause.end()
            value = self.clause_score(clause[0])
            if value > 0:
                total, top, n = total + value, max(top, value), n + 1
        return total, top, n


def candidates(sample: DataFrame) -> tuple[list[tuple[str, int, int]], int, int]:
    """(stem or word$, toxic texts, other texts) of every entry that is common and precise enough, and the numbers of texts."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^\\p{L}]+"), lambda w: F.length(w) >= 3))
    texts = sample.select("y", words.alias("words")).where(F.size("words") > 0)
    hashes = F.array_sort(F.transform(F.filter("words", lambda w: F.length(w) >= 6), lambda w: F.xxhash64(w)))
    drawn = F.when(F.size(hashes) >= DRAWN, F.slice(hashes, 1, DRAWN)).otherwise(F.array(F.xxhash64("words")))
    texts = texts.groupBy("y", drawn.alias("draw")).agg(F.min("words").alias("words"))
    texts = written(texts.select("y", "words"), "toxicity-words")
    shortest, longest = STEM_CHARS

    def stems(w):
        cut = F.transform(F.sequence(F.lit(shortest), F.greatest(F.lit(shortest), F.least(F.lit(longest), F.length(w)))), lambda k: F.substring(w, F.lit(1), k))
        return F.concat(F.when(F.length(w) >= shortest, cut).otherwise(F.array().cast("array<string>")), F.array(F.concat(w, F.lit("$"))))

    counts = texts.select("y", F.explode(F.array_distinct(F.flatten(F.transform("words", stems)))).alias("entry"))
    counts = counts.groupBy("entry").agg(F.sum("y").alias("t"), F.count(F.lit(1)).alias("n"))
    counts = counts.where((F.col("t") >= MIN_SUPPORT) & ((F.col("t") + 0.5) / (F.col("n") + 1) >= MIN_PRECISION))
    rows = counts.orderBy(F.desc("t"), "entry").collect()
    totals = texts.agg(F.sum("y").alias("t"), F.count(F.lit(1)).alias("n")).first()
    return [(r.entry, r.t, r.n - r.t) for r in rows], totals.t or 0, (totals.n or 0) - (totals.t or 0)


def chosen(found: Iterable[tuple[str, int, int]], n_toxic: int, n_other: int) -> dict[str, float]:
    """Weights of the entries to use: of each family of stems the longest that keeps nearly all texts of the shortest."""
    by = {e: (t, n) for e, t, n in found}
    entries: dict[str, float] = {}
    for entry in sorted(by, key=lambda e: (len(e), e)):
        if any(entry[:k] in by for k in range(1, len(entry))):
            continue  # reached from its shortest stem
        at = entry
        while True:
            longer = [e for e in by if len(e) == len(at) + 1 and e.startswith(at) and by[e][0] >= SAME_SUPPORT * by[entry][0]]
            if not longer:
                break
            at = max(longer, key=lambda e: (by[e][0], e))
        t, n = by[at]
        entries[at] = min(TOP_WEIGHT, math.log((t + 0.5) / (n + 0.5)) + math.log((n_other + 1) / (n_toxic + 1)))
    return entries


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps; the last coefficient is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    penalty = ridge * np.diag([*[1.0] * (x.shape[1] - 1), 1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


_lexicons: dict[tuple, Lexicon] = {}


def lexicon(entries: tuple[tuple[str, float], ...]) -> Lexicon:
    if entries not in _lexicons:
        _lexicons.clear()
        _lexicons[entries] = Lexicon(dict(entries))
    return _lexicons[entries]


def logistic(total: np.ndarray, top: np.ndarray, beta: tuple[float, ...]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.log1p(total) * beta[0] + np.log1p(top) * beta[1] + beta[2], -30, 30)))


def with_matches(docs: DataFrame, entries: tuple[tuple[str, float], ...], beta: tuple[float, ...] = (1.0, 0.0, -1.0), text_col: str = "text") -> DataFrame:
    """docs with a struct _tx: total, top, n_clauses and score of the text."""

    @F.pandas_udf("total double, top double, n_clauses long, score double")
    def match(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = lexicon(entries)
        for texts in parts:
            f = np.array([words.features(t) for t in texts], dtype=float).reshape(-1, 3)
            yield pd.DataFrame({"total": f[:, 0], "top": f[:, 1], "n_clauses": f[:, 2].astype("int64"), "score": logistic(f[:, 0], f[:, 1], beta)})

    return docs.withColumn("_tx", match(F.col(text_col)))


def learn(sample: DataFrame) -> tuple[tuple[tuple[str, float], ...], tuple[float, ...]]:
    """Entries and coefficients from sample (doc_id, text, y) of a bounded size."""
    sample = written(sample, "toxicity-sample")
    found, n_toxic, n_other = candidates(sample)
    entries = {f"{w}$": SEED_WEIGHT for w in SEED_INSULTS} | (chosen(found, n_toxic, n_other) if n_toxic and n_other else {})
    fixed = tuple(sorted(entries.items()))
    if not (n_toxic and n_other):
        return fixed, (1.0, 0.0, -1.0)
    rows = with_matches(sample, fixed).select("_tx.total", "_tx.top", "y", "doc_id").collect()
    rows.sort(key=lambda r: r.doc_id)
    beta = fit(np.log1p(np.array([[r.total, r.top] for r in rows])), np.array([r.y for r in rows], dtype=float))
    if beta[0] < 0 or beta[1] < 0:  # more matches never lower a score
        beta = fit(np.log1p(np.array([[r.total] for r in rows])), np.array([r.y for r in rows], dtype=float))
        beta = np.array([max(0.0, beta[0]), 0.0, beta[1]])
    return fixed, tuple(beta.tolist())


def classify(docs: DataFrame, sample: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, predicted and n_clauses of each row of docs (doc_id, text)."""
    entries, beta = learn(sample)
    scored = with_matches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), entries, beta)
    return scored.select("doc_id", "_tx.score", (F.col("_tx.score") >= threshold).cast("int").alias("predicted"), "_tx.n_clauses")
