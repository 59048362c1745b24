"""Vectorised words of text columns: spans and 64-bit hashes straight from Arrow buffers.

All functions work on one bounded slice of a record batch (``slices``), so a task's memory follows the
slice size or the longest single text, never the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that end a word: [\x20\x09-\x0D].
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of a word when punctuation ends words too: ASCII letters and digits, and every byte of a longer code point.
ALNUM = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that are hashed at a time.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def slices(batch: pa.RecordBatch, text: str = "text", max_bytes: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about ``max_bytes`` at most (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes) - sizes) // max_bytes if len(sizes) else sizes
    for rows in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(part)) + 1):
        if len(rows):
            yield batch.slice(int(rows[0]), len(rows))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """hashes: one per word; first: n + 1 bounds of the rows in it; start, end: the words' bytes; prefixes: of their first ``prefix`` bytes."""

    def __init__(self, column: pa.Array, is_word: np.ndarray, fold: bool = True, prefix: int = 0):
        self.raw, self.offsets = buffers(column)
        inside = is_word[self.raw]
        edge = np.zeros(len(self.raw) + 1, bool)
        edge[self.offsets] = True
        head = inside & edge[:-1]
        head[1:] |= inside[1:] & ~inside[:-1]
        self.start = np.flatnonzero(head)
        tail = inside & edge[1:]
        tail[:-1] |= inside[:-1] & ~inside[1:]
        self.end = np.flatnonzero(tail) + 1
        del head, tail, edge
        self.first = np.searchsorted(self.start, self.offsets)
        sums = np.zeros((2 if prefix else 1, len(self.start)), np.uint64)
        for low in range(0, len(self.raw), CHUNK):  # what is made for each byte is bounded, however long a word is
            self._add(sums, inside, low, min(low + CHUNK, len(self.raw)), fold, prefix)
        self.hashes = mix(sums[0] + (self.end - self.start).astype(np.uint64))
        if prefix:
            self.prefixes = mix(sums[1])

    def _add(self, sums: np.ndarray, inside: np.ndarray, low: int, high: int, fold: bool, prefix: int) -> None:
        """Add to each word's sums what its bytes from ``low`` to ``high`` give: byte values times powers by place."""
        a, b = np.searchsorted(self.end, low, "right"), np.searchsorted(self.start, high)
        if a >= b:
            return
        heads = np.maximum(self.start[a:b] - low, 0)
        raw = self.raw[low + heads[0] : high]
        values = _BYTE[FOLD[raw] if fold else raw]
        values[~inside[low + heads[0] : high]] = 0
        heads = heads - heads[0]
        place = np.arange(len(raw)) - np.repeat(heads, np.diff(np.append(heads, len(raw))))
        values *= powers(_P, int(place.max()) + 1)[place]
        before = max(0, low - int(self.start[a]))  # bytes of the first word that earlier chunks took
        shift = np.uint64(pow(int(_P), before, 1 << 64))
        with np.errstate(over="ignore"):
            for k in range(len(sums)):
                some = values
                if k:
                    some = np.where(place < prefix, values, np.uint64(0))
                    if before:
                        cut = int(heads[1]) if len(heads) > 1 else len(raw)
                        some[:cut][place[:cut] + before >= prefix] = 0
                own = np.add.reduceat(some, heads)
                own[0] = own[0] * shift
                sums[k, a:b] += own

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))


_STEP = _rng.integers(1, 2**64, 64, dtype=np.uint64) | np.uint64(1)


def windows(hashes: np.ndarray, width: int, places: tuple[int, ...] | None = None) -> np.ndarray:
    """A hash of each window of ``width`` words, over the words at ``places`` of it (all, if None)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width) if places is None else places:
        out += hashes[j : j + n] * _STEP[j]
    return mix(out + np.uint64(width))
