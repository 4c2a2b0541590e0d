"""Vectorised word and shingle hashing over the byte buffers of Arrow strings.

A batch is cut into chunks of whole rows of about ``CHUNK_BYTES`` (one longer
row is a chunk of its own), so memory depends on the longest row only.  All
hashes are fixed functions of the bytes: every executor and every attempt of a
task gets the same values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

CHUNK_BYTES = 1 << 20
#: Most rows, and bytes, that a batch may bring to a Python worker: texts of any length come in batches of bounded size.
BATCH_ROWS, BATCH_BYTES = 2_000, 16 << 20
U64 = np.uint64


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS and BATCH_BYTES where they are larger."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        held = int(spark.conf.get(key).removesuffix("b"))
        if held <= 0 or held > most:
            spark.conf.set(key, str(most))


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**63, n, dtype=U64) * U64(2) + U64(1)


BYTE = _odd(11, 256)
PLACE = _odd(12, 64)
BASE = int(_odd(13, 1)[0])
INVERSE = pow(BASE, -1, 2**64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words without white space: every byte but \x20 and \x09-\x0D.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False
#: Words of letters and digits: ASCII ones and every byte of a longer character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        m = max(n, CHUNK_BYTES + 1)
        for k, x in enumerate((BASE, INVERSE)):
            f = np.full(m, x, dtype=U64)
            f[0] = 1
            _powers[k] = np.cumprod(f, dtype=U64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


class Chunk:
    """Words of some rows: row r has the words ``off[r]:off[r + 1]``; ``start`` and ``end`` are byte places in ``data``."""

    def __init__(self, first: int, data: np.ndarray, rows: np.ndarray, word: np.ndarray, cut=None):
        self.first, self.data, self.rows = first, LOWER[data], rows
        n = len(data)
        is_word = word[self.data]
        before = np.empty(n, dtype=bool)
        after = np.empty(n, dtype=bool)
        if n:
            before[0], after[-1] = False, False
            before[1:], after[:-1] = is_word[:-1], is_word[1:]
            if cut is not None:
                apart = cut(self.data)
                before[1:] &= ~apart
                after[:-1] &= ~apart
            inner = rows[1:-1]
            before[inner[inner < n]] = False
            after[inner[inner > 0] - 1] = False
        self.start = np.flatnonzero(is_word & ~before)
        self.end = np.flatnonzero(is_word & ~after) + 1
        self.off = np.searchsorted(self.start, rows)
        up, down = powers(n + 1)
        total = np.zeros(n + 1, dtype=U64)
        np.cumsum(BYTE[self.data] * up[:n], dtype=U64, out=total[1:])
        self.word = mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(U64) * PLACE[63])

    def __len__(self) -> int:
        return len(self.rows) - 1

    def windows(self, k: int) -> np.ndarray:
        """The hash of the k words from each word on; only those that end within their row mean something."""
        n = len(self.word)
        if n < k:
            return np.empty(0, dtype=U64)
        out = np.zeros(n - k + 1, dtype=U64)
        for i in range(k):
            out += self.word[i : n - k + 1 + i] * PLACE[i]
        return mix(out + U64(k))

    def sequence(self, r: int) -> int:
        """A hash of all words of row r, in order."""
        w = self.word[self.off[r] : self.off[r + 1]]
        up, _ = powers(len(w) + 1)
        total = np.sum(w * up[: len(w)], dtype=U64, keepdims=True)
        return int(mix(total + np.full(1, len(w), dtype=U64) * PLACE[62])[0])

    def shingles(self, r: int, k: int, windows: np.ndarray) -> np.ndarray:
        """Sorted distinct k-word shingles of row r; fewer words are one shingle, none none."""
        a, b = int(self.off[r]), int(self.off[r + 1])
        if a == b:
            return np.empty(0, dtype=U64)
        if b - a < k:
            return np.array([self.sequence(r)], dtype=U64)
        return np.unique(windows[a : b - k + 1])


def chunks(column: pa.Array, word: np.ndarray, size: int = CHUNK_BYTES, cut=None) -> Iterator[Chunk]:
    """Chunks over a string column; null is an empty text. cut: of a chunk's bytes, where words end besides (before each byte but the first)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    r = 0
    while r < len(column):
        e = max(r + 1, int(np.searchsorted(offsets, offsets[r] + size, side="right")) - 1)
        e = min(e, len(column))
        yield Chunk(r, data[offsets[r] : offsets[e]], offsets[r : e + 1] - offsets[r], word, cut)
        r = e
