"""Reading of OLE compound files: a file system of sectors in one file, whose allocation tables say which sector follows which."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Fixed values of the format: the mark, the end of a chain and a free place, kinds of directory entries, the size below which a stream is small.
MARK = bytes.fromhex("d0cf11e0a1b11ae1")
END, FREE = 0xFFFFFFFE, 0xFFFFFFFF
STREAM, ROOT = 2, 5
SMALL = 4096
#: Sectors of 512 or 4096 bytes, small ones of 64.
SHIFTS, SMALL_SHIFT = (9, 12), 6
#: Entries of 128 bytes that a directory may have; catalogued files have some dozens.
MOST_ENTRIES = 4096

_HEADER = struct.Struct("<8s16xHHHHH6x9I")
_ENTRY = np.dtype([("name", "S64"), ("name_bytes", "<u2"), ("kind", "u1"), ("rest", "V49"), ("first", "<u4"), ("size", "<u8")])


class Broken(ValueError):
    """The file breaks a rule of its format, or a limit."""


@dataclass(frozen=True)
class Entry:
    name: str
    kind: int
    first: int
    size: int


def require(held: object, rule: str) -> None:
    if not held:
        raise Broken(rule)


class CompoundFile:
    """Entries of a compound file, and the bytes of its streams. Chains that leave the file, meet themselves or pass a limit raise Broken."""

    def __init__(self, raw: bytes):
        require(len(raw) >= 512, "header")
        mark, _, _, order, shift, small_shift, _, n_tables, directory, _, _, small_first, n_small, more, n_more = _HEADER.unpack_from(raw)
        require(mark == MARK and order == 0xFFFE and shift in SHIFTS and small_shift == SMALL_SHIFT, "header")
        size = 1 << shift
        n = max(0, len(raw) // size - 1)
        self.sectors = np.frombuffer(raw, np.uint8, n * size, size if n else 0).reshape(n, size)
        listed = np.concatenate([np.frombuffer(raw, "<u4", 109, 76), *self._listed(more, n_more)])
        listed = listed[listed != FREE]
        require(0 < n_tables == len(listed) == len(np.unique(listed)) and listed.max() < n, "allocation table")
        self.table = self.sectors[listed].reshape(-1).view("<u4")
        self.entries = list(self._entries(self._bytes(directory, 128 * MOST_ENTRIES)))
        self._small = (small_first, n_small * size)

    def _listed(self, at: int, n: int) -> Iterator[np.ndarray]:
        """Sectors of the allocation table that the header has no room for: each sector of the list names the next at its end."""
        require(n <= len(self.sectors), "list of tables")
        for _ in range(n):
            require(at < len(self.sectors), "list of tables")
            held = self.sectors[at].view("<u4")
            yield held[:-1]
            at = int(held[-1])

    @staticmethod
    def chain(first: int, table: np.ndarray, most: int) -> list[int]:
        """Places that follow first in table, in order; at most most of them, so a chain that meets itself ends in Broken."""
        places, most = [], min(most, len(table))
        while first != END:
            require(first < len(table) and len(places) < most, "chain")
            places.append(first)
            first = int(table[first])
        return places

    def _bytes(self, first: int, most: int) -> bytes:
        size = self.sectors.shape[1]
        places = self.chain(first, self.table, -(-most // size))
        require(max(places, default=0) < len(self.sectors), "chain")
        return self.sectors[places].tobytes()

    @staticmethod
    def _entries(directory: bytes) -> Iterator[Entry]:
        for e in np.frombuffer(directory, _ENTRY, len(directory) // _ENTRY.itemsize):
            length = int(e["name_bytes"])
            if e["kind"] in (STREAM, ROOT) and 2 <= length <= 64 and length % 2 == 0:
                name = e["name"].ljust(64, b"\0")[: length - 2]
                yield Entry(name.decode("utf-16-le", "replace"), int(e["kind"]), int(e["first"]), int(e["size"]))

    def streams(self, name: str | None = None) -> list[Entry]:
        return [e for e in self.entries if e.kind == STREAM and name in (None, e.name)]

    def read(self, entry: Entry, most: int) -> bytes:
        """Bytes of a stream of most bytes or fewer."""
        require(entry.size <= most, "size of a stream")
        if entry.size >= SMALL:
            return self._bytes(entry.first, entry.size)[: entry.size]
        roots = [e for e in self.entries if e.kind == ROOT]
        require(len(roots) == 1, "root")
        held = np.frombuffer(self._bytes(roots[0].first, self.sectors.size), np.uint8)[: roots[0].size]
        held = held[: len(held) >> SMALL_SHIFT << SMALL_SHIFT].reshape(-1, 1 << SMALL_SHIFT)
        table = np.frombuffer(self._bytes(*self._small), "<u4")
        places = self.chain(entry.first, table, -(-entry.size >> SMALL_SHIFT) + 1)
        require(max(places, default=0) < len(held), "chain")
        return held[places].tobytes()[: entry.size]
