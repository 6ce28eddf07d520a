"""Whole-batch word and window hashing over Arrow string columns.

A *word* is a maximal run of bytes other than ASCII white space
(``[^\\x20\\x09-\\x0D]+``); as UTF-8 never uses those byte values inside a
longer character, working on bytes equals working on characters.

Hashes are polynomial prefix sums modulo 2**64 with a random 64-bit value
per byte: the hash of any slice is a difference of two prefix sums times an
inverse power, so all words (and all windows of k words) of a batch are
hashed without a Python loop.  Every slice hash passes a finaliser, so equal
word sequences have equal hashes in any document, chunk or executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19

_MASK = (1 << 64) - 1


def _splitmix(seed: int) -> Iterator[int]:
    x = seed
    while True:
        x = (x + 0x9E3779B97F4A7C15) & _MASK
        z = x
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        yield z ^ (z >> 31)


_gen = _splitmix(20240229)
BYTE_VALUE = np.array([next(_gen) | 1 for _ in range(256)], np.uint64)
_BASE = {"byte": next(_gen) | 5, "word": next(_gen) | 5}

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_powers: dict[tuple[str, bool], np.ndarray] = {}


def powers(kind: str, n: int, inverse: bool = False) -> np.ndarray:
    """First ``n`` powers of the base (or of its inverse) modulo 2**64; kept
    for the largest chunk seen by this worker."""
    have = _powers.get((kind, inverse))
    if have is None or len(have) < n:
        base = _BASE[kind]
        if inverse:
            base = pow(base, -1, 1 << 64)
        steps = np.full(max(n, 1024), base, np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(steps, dtype=np.uint64)
        if n <= 4 * CHUNK_BYTES:
            _powers[kind, inverse] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        width = np.int64
    else:
        column, width = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, width, len(column) + 1, column.offset * np.dtype(width).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Split a string column into runs of whole texts of about ``limit``
    bytes: (first row, end row, bytes, offsets).  A longer text is a run of
    its own, so memory is bounded by the limit or the longest text."""
    data, offs = string_bytes(column)
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j, data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        i = j


class Words:
    """Words of a run of texts: byte spans ``start``/``end``, ``first`` (index
    of each text's first word, with the total at the end) and hashes."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        n = len(data)
        solid = ~SEPARATOR[data]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        after = np.empty(n + 1, bool)   # after[i]: byte i-1 belongs to a word
        after[0] = False
        after[1:] = solid
        self.start = np.flatnonzero(solid & (~after[:-1] | edge[:-1]))
        follows = np.empty(n, bool)     # follows[i]: byte i+1 belongs to a word
        follows[:-1] = solid[1:]
        follows[-1:] = False
        self.end = np.flatnonzero(solid & (~follows | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offs)
        self.data, self.offs = data, offs

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(BYTE_VALUE[self.data] * powers("byte", n), out=sums[1:])
            h = (sums[self.end] - sums[self.start]) * powers("byte", n, True)[self.start]
        return mix(h + (self.end - self.start).astype(np.uint64))


class Windows:
    """Hashes of any number of consecutive words."""

    def __init__(self, word_hashes: np.ndarray):
        n = len(word_hashes)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum(word_hashes * powers("word", n), out=self.sums[1:])
        self.n = n

    def at(self, start: np.ndarray, length) -> np.ndarray:
        """Hash of ``length`` words from each ``start`` (both in range)."""
        with np.errstate(over="ignore"):
            h = (self.sums[start + length] - self.sums[start]) * powers("word", max(self.n, 1), True)[start]
        return mix(h)

    def all(self, length: int) -> np.ndarray:
        """Hash of every window of ``length`` words, text edges ignored."""
        if self.n < length:
            return np.zeros(0, np.uint64)
        return self.at(np.arange(self.n - length + 1), length)


def window_starts(first: np.ndarray, length: int) -> np.ndarray:
    """Indices of windows of ``length`` words that stay inside one text."""
    n = int(first[-1])
    ok = np.ones(max(0, n - length + 1), bool)
    for e in first[1:-1]:
        ok[max(0, e - length + 1):e] = False
    return np.flatnonzero(ok)


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    if len(h) < width:
        return h[:0]
    m, w = h, 1
    while 2 * w <= width:
        m = np.minimum(m[:len(m) - w], m[w:])
        w *= 2
    return m if w == width else np.minimum(m[:len(h) - width + 1], m[width - w:width - w + len(h) - width + 1])


def signed(h: np.ndarray) -> np.ndarray:
    """uint64 hashes as Spark longs."""
    return h.view(np.int64)
