"""Token counts under a unigram vocabulary by dynamic programming over a trie of pre-tokens.

A text's pre-tokens are its words, each after the mark for a space. The distinct pre-tokens of a batch are inserted in a trie; the best
score and token count of each prefix are computed once, at its node, level by level, from the nodes above it and the vocabulary
pieces that end there. A pre-token's count stands at its terminal node, and a text's count is the sum over its words. Where two
segmentations have one score, the shorter counts.

The vocabulary is a public sentencepiece model. Its pieces carry merge ranks, no probabilities, so a piece of rank r scores
-ln(r + 1): the frequency that Zipf's law gives that rank. Characters of no piece count as their UTF-8 bytes, at UNKNOWN_BELOW under the
lowest score.

Nothing is shuffled. A task holds one slice of SLICE_CHARS characters (or one text, if longer) with its trie, and KEPT_WORDS counts of words
seen before. Null, empty and blank texts have no tokens. Repeated rows are counted each. Only the named columns are read. An
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WORD_RE, mapped_with_id

SPACE_MARK = "▁"
UNKNOWN_BELOW = 10.0
SLICE_CHARS = 4_000_000
KEPT_WORDS = 500_000
#: Words of so many characters and fewer stand in a trie built by levels; the trie of longer ones is walked in depth.
LEVELS = 48


def piece_scores(model_path: str) -> dict[str, float]:
    """Scores of the ordinary pieces of a sentencepiece model, by rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    ids.sort(key=lambda i: (-model.get_score(i), i))
    return {model.id_to_piece(i): -math.log(rank + 1) for rank, i in enumerate(ids, 1)}


class UnigramTrie:
    """Counts for lists of distinct pre-tokens."""

    def __init__(self, scores: Mapping[str, float]):
        self.scores = dict(scores)
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_BELOW
        # Pieces read backwards as a trie: state 0 is its root, arcs are sorted by (state, character).
        arcs: dict[tuple[int, int], int] = {}
        ends = [-np.inf]
        for piece, score in self.scores.items():
            at = 0
            for ch in reversed(piece):
                nxt = arcs.get((at, ord(ch)))
                if nxt is None:
                    nxt = arcs[at, ord(ch)] = len(ends)
                    ends.append(-np.inf)
                at = nxt
            ends[at] = score
        keys = np.array([(s << 21) | c for s, c in arcs], dtype=np.int64)
        order = np.argsort(keys)
        self.arc_keys, self.arc_to, self.ends = keys[order], np.array(list(arcs.values()), dtype=np.int64)[order], np.array(ends)

    def step(self, states: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """States after one more character to the left; -1 where no piece goes on."""
        keys = (states << 21) | chars
        at = np.minimum(np.searchsorted(self.arc_keys, keys), len(self.arc_keys) - 1)
        return np.where(self.arc_keys[at] == keys, self.arc_to[at], -1)

    def walked(self, tokens: list[str]) -> list[int]:
        """Counts for sorted tokens: the trie in depth. The scores of a path stand until the next token leaves it, so each node is scored once."""
        best, last, out = [(0.0, 0)], "", []
        for token in tokens:
            shared = next((k for k, (a, b) in enumerate(zip(token, last, strict=False)) if a != b), min(len(token), len(last)))
            del best[shared + 1 :]
            self._down(token, best)
            out.append(-best[-1][1])
            last = token
        return out

    def _down(self, token: str, best: list[tuple[float, int]]) -> None:
        for end in range(len(best), len(token) + 1):
            options = []
            for k in range(1, min(end, self.longest) + 1):
                score = self.scores.get(token[end - k : end])
                if score is not None:
                    options.append((best[end - k][0] + score, best[end - k][1] - 1))
            if token[end - 1] not in self.scores:
                options.append((best[end - 1][0] + self.unknown, best[end - 1][1] - len(token[end - 1].encode("utf-8", "surrogatepass"))))
            best.append(max(options))

    def counts(self, tokens: list[str]) -> list[int]:
        short, long = (sorted(t for t in tokens if (len(t) <= LEVELS) == few and t) for few in (True, False))
        found = {"": 0, **dict(zip(long, self.walked(long), strict=True))}
        if short:
            found |= zip(short, self._trie(short), strict=True)
        return [found[t] for t in tokens]

    def _trie(self, tokens: list[str]) -> list[int]:
        width = max(map(len, tokens))
        chars = np.array(tokens, dtype=f"U{width}").view(np.uint32).reshape(len(tokens), width).astype(np.int64)
        lengths = np.array(list(map(len, tokens)))
        differs = np.ones((len(tokens), width), dtype=bool)
        differs[1:] = np.maximum.accumulate(chars[1:] != chars[:-1], axis=1)
        # Level l of the trie: its nodes' characters, parents, best scores and counts. Level 0 is the root.
        level_chars, parents = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        best, count = [np.zeros(1)], [np.zeros(1, np.int64)]
        node = np.zeros(len(tokens), np.int64)
        out = np.zeros(len(tokens), np.int64)
        for level in range(1, width + 1):
            here = lengths >= level
            new = here & differs[:, level - 1]
            first = np.flatnonzero(new)
            level_chars.append(chars[first, level - 1])
            parents.append(node[first])
            node = np.cumsum(new) - 1
            n = len(first)
            top, fewest = np.full(n, -np.inf), np.zeros(n, np.int64)
            live, state, ancestor = np.arange(n), np.zeros(n, np.int64), np.arange(n)
            for k in range(1, min(level, self.longest) + 1):
                ch = level_chars[level - k + 1][ancestor]
                state = self.step(state, ch)
                ancestor = parents[level - k + 1][ancestor]
                if k == 1:
                    lone = self.ends[np.maximum(state, 0)] == -np.inf
                    lone |= state < 0
                    at = np.flatnonzero(lone)
                    top[at] = best[level - 1][ancestor[at]] + self.unknown
                    c = ch[at]
                    fewest[at] = count[level - 1][ancestor[at]] + 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
                on = state >= 0
                live, state, ancestor = live[on], state[on], ancestor[on]
                if not len(live):
                    break
                score = best[level - k][ancestor] + self.ends[state]
                tokens_so_far = count[level - k][ancestor] + 1
                better = (score > top[live]) | ((score == top[live]) & (tokens_so_far < fewest[live]))
                top[live[better]], fewest[live[better]] = score[better], tokens_so_far[better]
            best.append(top)
            count.append(fewest)
            ending = np.flatnonzero(lengths == level)
            out[ending] = fewest[node[ending]]
        return out.tolist()


_tries: dict[str, tuple[UnigramTrie, dict[str, int]]] = {}


def loaded(model_path: str) -> tuple[UnigramTrie, dict[str, int]]:
    if model_path not in _tries:
        _tries[model_path] = (UnigramTrie(piece_scores(model_path)), {})
    return _tries[model_path]


def sliced(texts: list[str | None], most: int = SLICE_CHARS) -> Iterator[list[str]]:
    part, held = [], 0
    for text in texts:
        part.append(text or "")
        held += len(part[-1])
        if held >= most:
            yield part
            part, held = [], 0
    if part:
        yield part


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie, kept = loaded(model_path)
        for batch in batches:
            n_words, n_tokens = [], []
            for part in sliced(batch.text.tolist()):
                words = [WORD_RE.findall(t) for t in part]
                new = set().union(*words).difference(kept)
                known = kept
                if new:
                    fresh = dict(zip(new, trie.counts([SPACE_MARK + w for w in new]), strict=True))
                    if len(kept) + len(fresh) <= KEPT_WORDS:
                        kept.update(fresh)
                    else:
                        known = {**{w: kept[w] for w in set().union(*words).intersection(kept)}, **fresh}
                n_words += map(len, words)
                n_tokens += [sum(map(known.__getitem__, w)) for w in words]
            yield pd.DataFrame({"doc_id": batch.doc_id, "n_words": n_words, "n_tokens": n_tokens})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return mapped_with_id(rows, "doc_id", run, "n_words long, n_tokens long")
