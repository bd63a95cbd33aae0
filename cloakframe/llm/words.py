"""Vectorised word splitting and hashing for Arrow batches of texts.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]``.  Everything here works on the UTF-8 bytes of a
whole Arrow batch at once, so per-word Python work is avoided; a batch is cut into chunks of bounded
size first, which bounds the memory of a task whatever the batch size or text length.

Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a single longer text is still handled whole.
CHUNK_BYTES = 1 << 21

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (the public splitmix64 steps)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def lane(seed: int, n: int = 256) -> np.ndarray:
    """``n`` pseudo-random uint64 values fixed by ``seed``."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * _MULTIPLIER + mix(np.array([seed + 1], dtype=np.uint64)))


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the multiplier and of its inverse modulo 2**64."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES)
        for name, base in (("up", _MULTIPLIER), ("down", _INVERSE)):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[name] = np.multiply.accumulate(a)
    return _POWERS["up"][:n], _POWERS["down"][:n]


@dataclass
class Words:
    """Words of a chunk of texts: byte ranges in ``data`` and the row offsets of the words."""

    data: np.ndarray  # uint8
    start: np.ndarray  # int64, by word
    end: np.ndarray  # int64, by word
    rows: np.ndarray  # int64, n_rows + 1 offsets into the words

    def counts(self) -> np.ndarray:
        return np.diff(self.rows)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1, dtype=np.int64), self.counts())

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        n = len(self.data)
        if not len(self.start):
            return np.empty(0, dtype=np.uint64)
        up, down = powers(n + 1)
        with np.errstate(over="ignore"):
            total = np.empty(n + 1, dtype=np.uint64)
            total[0] = 0
            np.cumsum(lane(seed)[self.data] * up[:n], out=total[1:])
            h = (total[self.end] - total[self.start]) * down[self.start]
            return mix(h + (self.end - self.start).astype(np.uint64))


class Ranges:
    """Hashes of arbitrary runs of consecutive word hashes (rows are not looked at)."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        up, self.down = powers(n + 1)
        self.total = np.empty(n + 1, dtype=np.uint64)
        self.total[0] = 0
        with np.errstate(over="ignore"):
            np.cumsum(hashes * up[:n], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each run [start, end); its length is not part of the hash."""
        with np.errstate(over="ignore"):
            return mix((self.total[end] - self.total[start]) * self.down[start])


def spans(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words; one value for each start, ``len(hashes) - width + 1`` in all."""
    n = len(hashes)
    if n < width:
        return np.empty(0, dtype=np.uint64)
    r = Ranges(hashes)
    with np.errstate(over="ignore"):
        return mix((r.total[width:] - r.total[:-width]) * r.down[: n - width + 1])


def inside(rows: np.ndarray, width: int) -> np.ndarray:
    """Starts (positions among all words) of the runs of ``width`` words that stay within a row."""
    counts = np.diff(rows)
    n = int(rows[-1])
    ok = np.zeros(max(0, n), dtype=bool)
    if n:
        left = np.repeat(rows[1:], counts) - np.arange(n)
        ok = left >= width
    return np.flatnonzero(ok)


def text_column(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one large_string array without nulls (null becomes an empty text)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    return column


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from 0) of a large_string array without nulls."""
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    if data is None or off[-1] == off[0]:
        return np.empty(0, dtype=np.uint8), off - off[0]
    return np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]], off - off[0]


def plain(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes (ASCII and the Latin-1 letters of UTF-8), and which of them belong to words when
    everything but ASCII letters, digits and non-ASCII bytes separates."""
    upper = (data >= 65) & (data <= 90)
    if len(data):
        upper[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    low = data + (upper * np.uint8(32))
    return low, (low >= 0x80) | ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57))


def split(texts: pa.Array, normal: bool = False) -> Words:
    """Words of each text of a large_string array without nulls; with ``normal`` those of ``plain``."""
    data, off = raw(texts)
    n = len(data)
    if not n:
        empty = np.empty(0, dtype=np.int64)
        return Words(data, empty, empty, np.zeros(len(texts) + 1, dtype=np.int64))
    if normal:
        data, solid = plain(data)
    else:
        solid = (data != 32) & ((data < 9) | (data > 13))
    first = np.empty(n, dtype=bool)
    first[0] = solid[0]
    np.logical_and(solid[1:], ~solid[:-1], out=first[1:])
    last = np.empty(n, dtype=bool)
    last[-1] = solid[-1]
    np.logical_and(solid[:-1], ~solid[1:], out=last[:-1])
    cuts = off[(off > 0) & (off < n)]
    first[cuts] = solid[cuts]
    last[cuts - 1] = solid[cuts - 1]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return Words(data, start, end, np.searchsorted(start, off).astype(np.int64))


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batch with about ``limit`` bytes of text each, with their texts."""
    if not batch.num_rows:
        return
    texts = text_column(batch.column(batch.schema.get_field_index(text)))
    _, off = raw(texts)
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield batch.slice(i, j - i), texts.slice(i, j - i)
        i = j
