"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Learned filters over embedded bytes run along each chunk; the
largest response of each filter in a chunk is kept. Over the chunks, mean and maximum of these go through one hidden layer to one
probability. All weights are trained here by Adam, in one task, from LABELLED_ROWS labelled rows and LABELLED_BYTES of text at most: those of
the lowest hash among the rows that may be learned from, with their whole texts.

Scoring is one pass of a map over the documents. A task holds one group of chunks of GROUP_CHUNKS at a time, however long a text is.

Null and empty texts are one chunk of padding and are scored like any other. Labels that are null, or whose id matches no document,
teach nothing; of several labels of an id the lowest counts. Without labelled rows of both kinds every score is the share of
label 1, or 0.5. Repeated rows are scored alike. Only the named columns are read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import mapped_with_id

LABELLED_ROWS = 2400
#: Of text, UTF-8, that the task trains on at most.
LABELLED_BYTES = 64_000_000
CHUNK, OVERLAP = 1024, 64
WIDTH, STRIDE, EMBED, FILTERS, HIDDEN = 8, 4, 6, 24, 16  # WIDTH is two strides
EPOCHS, BATCH_DOCS, RATE, DECAY = 8, 32, 6e-3, 1e-4
GROUP_CHUNKS = 64
PAD = 256
Weights = dict[str, np.ndarray]


def chunked(text: str | None) -> np.ndarray:
    """Overlapping chunks of the bytes of text, the last one padded; int array (chunks, CHUNK)."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    step = CHUNK - OVERLAP
    n = max(1, -(-max(0, len(raw) - OVERLAP) // step))
    padded = np.full(n * step + OVERLAP, PAD, dtype=np.int16)
    padded[: len(raw)] = raw
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]


def start(rng: np.random.Generator) -> Weights:
    return {
        "embed": rng.normal(0, 0.5, (PAD + 1, EMBED)).astype(np.float32),
        "conv": rng.normal(0, (2 / (WIDTH * EMBED)) ** 0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32),
        "conv_b": np.zeros(FILTERS, np.float32),
        "hidden": rng.normal(0, (2 / (2 * FILTERS)) ** 0.5, (2 * FILTERS, HIDDEN)).astype(np.float32),
        "hidden_b": np.zeros(HIDDEN, np.float32),
        "out": rng.normal(0, HIDDEN**-0.5, HIDDEN).astype(np.float32),
        "out_b": np.zeros(1, np.float32),
    }


def pooled(chunks: np.ndarray, w: Weights) -> tuple[np.ndarray, np.ndarray]:
    """Largest response of each filter in each chunk, and the position where it is."""
    # Windows are two strides wide, so each is a pair of neighbouring blocks of one stride.
    block, half = STRIDE * EMBED, WIDTH * EMBED // 2
    blocks = w["embed"].take(chunks, axis=0).reshape(-1, block)
    both = (blocks @ np.concatenate([w["conv"][:half], w["conv"][half:]], 1)).reshape(len(chunks), CHUNK // STRIDE, 2 * FILTERS)
    response = both[:, :-1, :FILTERS] + both[:, 1:, FILTERS:]
    at = response.argmax(1)
    top = np.take_along_axis(response, at[:, None], 1)[:, 0] + w["conv_b"]
    return np.maximum(top, 0), at


def head(mean: np.ndarray, most: np.ndarray, w: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    both = np.concatenate([mean, most], 1)
    hidden = np.maximum(both @ w["hidden"] + w["hidden_b"], 0)
    return both, hidden, 1 / (1 + np.exp(-np.clip(hidden @ w["out"] + w["out_b"], -30, 30)))


def gradients(docs: list[np.ndarray], y: np.ndarray, w: Weights) -> Weights:
    """Of the mean log loss. Only the windows that won the pooling carry any."""
    sizes = np.array([len(d) for d in docs])
    owner = np.repeat(np.arange(len(docs)), sizes)
    chunks = np.concatenate(docs)
    parts = [pooled(chunks[k : k + GROUP_CHUNKS], w) for k in range(0, len(chunks), GROUP_CHUNKS)]
    top, at = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    mean = np.add.reduceat(top, starts) / sizes[:, None]
    most = np.maximum.reduceat(top, starts)
    both, hidden, p = head(mean, most, w)
    d_logit = ((p - y) / len(y)).astype(np.float32)
    g = {"out": hidden.T @ d_logit, "out_b": d_logit.sum(keepdims=True)}
    d_hidden = d_logit[:, None] * w["out"] * (hidden > 0)
    g |= {"hidden": both.T @ d_hidden, "hidden_b": d_hidden.sum(0)}
    d_both = d_hidden @ w["hidden"].T
    d_top = (d_both[:, :FILTERS] / sizes[:, None])[owner]
    is_most = top == most[owner]
    d_top = (d_top + d_both[:, FILTERS:][owner] * is_most / np.maximum(1, np.add.reduceat(is_most.astype(np.float32), starts))[owner]) * (top > 0)
    g["conv_b"] = d_top.sum(0)
    letters = np.take_along_axis(chunks[:, None], at[:, :, None] * STRIDE + np.arange(WIDTH), 2)
    conv = (d_top[:, :, None] * w["embed"].take(letters, axis=0).reshape(*at.shape, -1)).sum(0)
    per_letter = (d_top[:, :, None] * w["conv"].T).reshape(-1, EMBED)
    embed = np.stack([np.bincount(letters.ravel(), column, PAD + 1) for column in per_letter.T], 1)
    return g | {"conv": conv.T, "embed": embed}


def train(texts: list[str], y: np.ndarray, seed: int = 5) -> Weights:
    """Adam with a falling rate; the order of documents is drawn from seed, so reruns agree."""
    rng = np.random.default_rng(seed)
    w = start(rng)
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    w["out_b"][:] = np.log(rate / (1 - rate))
    if len(set(y.tolist())) < 2:
        w["out"][:] = 0
        return w
    docs = [chunked(t) for t in texts]
    first, second, t = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    steps = EPOCHS * -(-len(docs) // BATCH_DOCS)
    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for k in range(0, len(order), BATCH_DOCS):
            batch = order[k : k + BATCH_DOCS]
            t += 1
            step = RATE * (1 - t / (steps + 1))
            for name, g in gradients([docs[i] for i in batch], y[batch], w).items():
                g = g + DECAY * w[name]
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                w[name] = (w[name] - step * (first[name] / (1 - 0.9**t)) / (np.sqrt(second[name] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return w


def score(text: str | None, w: Weights) -> float:
    chunks = chunked(text)
    total, most = np.zeros(FILTERS), np.full(FILTERS, -np.inf)
    for k in range(0, len(chunks), GROUP_CHUNKS):
        top, _ = pooled(chunks[k : k + GROUP_CHUNKS], w)
        total, most = total + top.sum(0), np.maximum(most, top.max(0))
    return float(head((total / len(chunks))[None], most[None], w)[2][0])


def scores(texts: list[str | None], w: Weights) -> list[float]:
    """score() of each text; short texts share groups of chunks."""
    out: list[float] = []
    group: list[np.ndarray] = []

    def flush() -> None:
        if not group:
            return
        sizes = np.array([len(g) for g in group])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        top, _ = pooled(np.concatenate(group), w)
        out.extend(head(np.add.reduceat(top, starts) / sizes[:, None], np.maximum.reduceat(top, starts), w)[2].astype(float).tolist())
        group.clear()

    for text in texts:
        chunks = chunked(text)
        if group and sum(map(len, group)) + len(chunks) > GROUP_CHUNKS:
            flush()
        if len(chunks) > GROUP_CHUNKS:
            out.append(score(text, w))
        else:
            group.append(chunks)
    flush()
    return out


def fitted(sample: DataFrame) -> Weights:
    """train() on sample (doc_id, text, y), in one task: the sample is bounded, and workers calculate on one core, as these small products need."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted((r for batch in batches for r in batch.itertuples(index=False)), key=lambda r: r.doc_id)
        w = train([r.text or "" for r in rows], np.array([r.y for r in rows], dtype=np.float32))
        yield pd.DataFrame({"name": list(w), "shape": [list(v.shape) for v in w.values()], "data": [v.astype(np.float32).tobytes() for v in w.values()]})

    found = sample.select("doc_id", "text", "y").repartition(1).mapInPandas(run, "name string, shape array<int>, data binary").collect()
    # Without rows there may be no task.
    return {r.name: np.frombuffer(r.data, np.float32).reshape(r.shape) for r in found} or train([], np.empty(0, np.float32))


def classify(docs: DataFrame, sample: DataFrame, threshold: float) -> DataFrame:
    """doc_id, score and predicted of each row of docs (doc_id, text), learned from sample (doc_id, text, y) of a bounded size."""
    w = fitted(sample)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            s = np.array(scores(batch.text.tolist(), w))
            yield pd.DataFrame({"doc_id": batch.doc_id, "score": s, "predicted": (s >= threshold).astype("int32")})

    return mapped_with_id(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", run, "score double, predicted int")
