"""Vectorised tokenising and hashing of Arrow text columns.

Texts are handled as UTF-8 bytes in chunks of about one MB, so memory stays bounded whatever the
length of a batch.  A text that is longer than a chunk forms a chunk of its own.  Words are hashed
with a position-independent polynomial computed from one cumulative sum over the chunk, so that no
Python code runs per word.  Words over ``LONG_WORD`` bytes are hashed one by one with xxHash,
because a polynomial modulo 2**64 is weak on very long inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

CHUNK = 1 << 20
LONG_WORD = 256
U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_STEP = 0xD6E8FEB86659FD93


def _lut(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


#: Separators of the word class "anything but ASCII white space".
SPACE = _lut(bytes([0x20, *range(0x09, 0x0E)]))
#: Separators of the word class "ASCII letters and digits, and all of non-ASCII".
PUNCT = _lut(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U) * U(_BASE))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, odd: int):
        self.odd, self.inverse, self.n = odd, pow(odd, -1, 1 << 64), 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, CHUNK)
            self.up, self.down = (self._series(x) for x in (self.odd, self.inverse))
        return self.up[:n], self.down[:n]

    def _series(self, x: int) -> np.ndarray:
        out = np.ones(self.n, U)
        done, step = 1, U(x)
        while done < self.n:
            take = min(done, self.n - done)
            out[done : done + take] = out[:take] * step
            step, done = step * step if take == done else step, done + take
        return out


_BYTES, _WORDS = _Powers(_BASE), _Powers(_STEP)
np.seterr(over="ignore")


@dataclass
class Chunk:
    """Rows ``first`` to ``first + rows`` of a batch; ``data`` holds their bytes back to back."""

    first: int
    rows: int
    data: np.ndarray
    offsets: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK) -> Iterator[Chunk]:
    """Chunks of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield Chunk(at, to - at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


@dataclass
class Words:
    """Words of a chunk: byte bounds, 64-bit hashes, and for each row the range of its words."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    rows: np.ndarray
    lower: np.ndarray

    def count(self) -> np.ndarray:
        return np.diff(self.rows)

    def window(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``size`` words inside one row, and the runs' first words."""
        n = len(self.hash)
        if n < size:
            return np.zeros(0, U), np.zeros(0, np.int64)
        up, down = _WORDS.upto(n)
        total = np.zeros(n + 1, U)
        np.cumsum(self.hash * up, out=total[1:])
        at = np.arange(n - size + 1)
        row_end = np.repeat(self.rows[1:], self.count())[: n - size + 1]
        at = at[at + size <= row_end]
        return mix((total[at + size] - total[at]) * down[at] + U(size)), at


def words(chunk: Chunk, separators: np.ndarray) -> Words:
    """Words between separators; A-Z are lower-cased, other letters stay as they are."""
    data, offsets = chunk.data, chunk.offsets
    lower = LOWER[data]
    n = len(lower)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, U), np.zeros(chunk.rows + 1, np.int64), lower)
    part = ~separators[lower]
    edge = np.zeros(n + 1, bool)  # a word may not cross a row's start
    edge[offsets] = True
    first = part.copy()
    first[1:] &= ~part[:-1] | edge[1:n]
    last = part.copy()
    last[:-1] &= ~part[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _BYTES.upto(n)
    total = np.zeros(n + 1, U)
    np.cumsum(_BYTE[lower] * up, out=total[1:])
    value = mix((total[end] - total[start]) * down[start])
    for i in np.flatnonzero(end - start > LONG_WORD):
        value[i] = xxhash.xxh64_intdigest(lower[start[i] : end[i]].tobytes())
    return Words(start, end, value, np.searchsorted(start, offsets), lower)


def hash_words(items: list[bytes]) -> np.ndarray:
    """The same hashes for words given one by one, already lower-cased."""
    if not items:
        return np.zeros(0, U)
    data = np.frombuffer(b" ".join(items), np.uint8)
    offsets = np.array([0, len(data)])
    return words(Chunk(0, 1, data, offsets), SPACE).hash


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
