"""Best-fit packing of token sequences.

Method: bounded-space online best-fit. Each task reads its rows once, tokenises them and places every piece, as it arrives, in the
open bin that it fills best; free bins are found in a bitset keyed by free space. OPEN_BINS bins are open at most;
when one more is needed, the fullest closes. Nothing is shuffled and a task holds the open bins only, so the result does not depend on the size of
Arrow batches. Sequence ids are the task's number and the bin's number in it.

Texts: null counts as empty; an empty text still is its end token. Repeated rows are packed once each. Input columns
other than the two named are not read, so their names may clash with anything. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import mapped_with_id

SEQUENCE_TOKENS = 1024
OPEN_BINS = 1024
END_ID = 2
#: Chunks whose ids a worker keeps; later ones are encoded again each time, so memory is bounded.
CACHED_CHUNKS = 300_000
PROBE = "It's 12 o'clock,\n\n  he said: naïve 日本 \U0001f600!\t(ok) "
SCHEMA = "piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class ChunkEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    The byte-level pre-tokeniser never lets a token cross from a character into a single space, so a text may be cut
    before each such space and the ids of each chunk be kept. Texts with a space beside other white space, and those
    naming a special token, are encoded whole by the tokenizers library, which is also what the chunks are tried
    against when a worker starts.
    """

    def __init__(self, path: str, ranks_path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.chunk = tiktoken.Encoding("chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.kept: dict[str, bytes | None] = {}
        if self.chunk(PROBE) != self.whole.encode(PROBE, add_special_tokens=False).ids:
            raise ValueError("the two vocabulary files disagree")

    def slow(self, text: str) -> bytes:
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def of_chunk(self, part: str) -> bytes | None:
        """Ids of a space and part; None if part does not start with a visible character."""
        if part == "" or part[0].isspace():
            return None
        return np.array(self.chunk(" " + part), dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.slow(text)
        first, *rest = text.split(" ")
        if first == "" and rest or first[-1:].isspace():
            return self.slow(text)
        kept = self.kept
        ids = [np.array(self.chunk(first), dtype="<u4").tobytes()]
        try:
            ids.extend(map(kept.__getitem__, rest))
        except KeyError:
            ids = ids[:1]
            for part in rest:
                got = kept.get(part)
                if got is None and part not in kept:
                    got = self.of_chunk(part)
                    if len(kept) < CACHED_CHUNKS:
                        kept[part] = got
                ids.append(got)
        try:
            return b"".join(ids)
        except TypeError:  # a chunk that only the whole text decides
            return self.slow(text)


_encoders: dict[tuple[str, str], ChunkEncoder] = {}


def encoder(path: str, ranks_path: str) -> ChunkEncoder:
    if (path, ranks_path) not in _encoders:
        _encoders[path, ranks_path] = ChunkEncoder(path, ranks_path)
    return _encoders[path, ranks_path]


class OpenBins:
    """Bounded-space best fit. free_mask has bit f set while some open bin has f tokens free."""

    def __init__(self, capacity: int = SEQUENCE_TOKENS, limit: int = OPEN_BINS):
        self.capacity, self.limit = capacity, limit
        self.free_mask, self.by_free, self.n_open, self.made = 0, {}, 0, 0

    def _push(self, number: int, free: int) -> None:
        if free:
            self.by_free.setdefault(free, []).append(number)
            self.free_mask |= 1 << free
            self.n_open += 1

    def _pop(self, free: int) -> int:
        stack = self.by_free[free]
        number = stack.pop()
        if not stack:
            self.free_mask &= ~(1 << free)
        self.n_open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece of 1 to capacity tokens."""
        fits = self.free_mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._pop(free)
        else:
            if self.n_open >= self.limit:  # the fullest closes
                self._pop((self.free_mask & -self.free_mask).bit_length() - 1)
            free, number, self.made = self.capacity, self.made, self.made + 1
        self._push(number, free - length)
        return number, self.capacity - free


def pieces_of(n_tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) pieces; only documents over capacity are cut, and then the first piece takes the remainder."""
    head = n_tokens % capacity or min(n_tokens, capacity)
    return [(0, head), *((s, capacity) for s in range(head, n_tokens, capacity))]


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = SEQUENCE_TOKENS, open_bins: int = OPEN_BINS, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, bins = encoder(tokenizer_path, ranks_path), OpenBins(capacity, open_bins)
        first = TaskContext.get().partitionId() << 36
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.doc_id, batch.text, strict=True):
                ids = enc.encode(text) + end
                for k, (start, length) in enumerate(pieces_of(len(ids) // 4, capacity)):
                    number, offset = bins.place(length)
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), first + number, offset))
            out = pd.DataFrame(rows, columns=["doc_id", *(c.split()[0] for c in SCHEMA.split(", "))])
            yield out.astype({"piece": "int32"})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return mapped_with_id(rows, "doc_id", run, SCHEMA)
