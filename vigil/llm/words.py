"""Words of whole Arrow string columns as numpy arrays: bounds, rows and 64-bit hashes.

Texts are cut at the bytes of white space (or at all ASCII characters that are neither letter
nor digit) without making a Python string per word. A batch is worked through in chunks of
about `CHUNK` bytes, so memory does not grow with the batch; a longer text is a chunk by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64
_BYTE_VALUE = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
PUNCTUATION = np.ones(256, dtype=bool)
PUNCTUATION[0x80:] = False
for _first, _last in ((48, 57), (65, 90), (97, 122)):
    PUNCTUATION[_first : _last + 1] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... n - 1 modulo 2 ** 64; the longest so far is kept per process."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, CHUNK + 1), base, dtype=np.uint64)
        steps[0] = 1
        known = np.cumprod(steps, dtype=np.uint64)
        if n <= 4 * CHUNK:
            _powers[base] = known
    return known[:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = x ^ _U((salt * _BASE) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@dataclass
class Words:
    """The words of consecutive rows of a batch.

    `first` has, per row and one past the last, the index of its first word; `start` and `end`
    are byte positions in `data`; `offsets` has the rows' bytes.
    """

    row: int
    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    @property
    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, the same in every process."""
        n = len(self.data)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUE[self.data] * _power(_BASE, n), dtype=np.uint64, out=total[1:])
        return mix((total[self.end] - total[self.start]) * _power(_INVERSE, n + 1)[self.start])


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and each row's bounds; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, bounds, data = texts.buffers()
    offsets = np.frombuffer(bounds, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets


def byte_chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row bounds from 0) of runs of rows with about `limit` bytes."""
    if not len(texts):
        return
    data, offsets = text_bytes(texts)
    row = 0
    while row < len(offsets) - 1:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        bounds = offsets[row : last + 1]
        yield row, data[bounds[0] : bounds[-1]], bounds - bounds[0]
        row = last


def split_words(texts: pa.Array, gaps: np.ndarray = WHITE, fold: bool = False, limit: int = CHUNK) -> Iterator[Words]:
    """The words of a string column; `fold` lower-cases A-Z, `gaps` says which bytes part words."""
    for row, data, offsets in byte_chunks(texts, limit):
        if fold:
            data = LOWER[data]
        inside = np.zeros(len(data) + 1, dtype=bool)
        inside[:-1] = ~gaps[data]
        begins = inside[:-1].copy()
        begins[1:] &= ~inside[:-2]
        ends = inside[:-1] & ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        begins[cuts] = inside[cuts]
        ends[cuts - 1] = inside[cuts - 1]
        start = np.flatnonzero(begins)
        yield Words(row, data, offsets, start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets))


def windows(words: Words, hashes: np.ndarray, size: int, salt: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of all runs of `size` words inside one row."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    value = np.zeros(n, dtype=np.uint64)
    factor = _U(((2 * salt + 1) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF)
    for k in range(size):
        value = value * factor + hashes[k : k + n]
    row = words.row_of
    at = np.flatnonzero(row[:n] == row[size - 1 :])
    return at, mix(value[at], salt)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.astype(np.uint64, copy=False).view(np.int64)
