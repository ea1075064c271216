"""Vectorised text kernels over Arrow string buffers.

Each kernel sees a whole Arrow batch as one byte buffer, so that no Python object is made per word.
Words are runs of bytes outside a separator set.  A word's hash is a polynomial in its bytes over
2**64 with a random value per byte, mixed at the end; it depends on the word alone, never on the
batch, process or position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
#: A random 64-bit value for each byte, and the odd base of the polynomial.
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C15)
#: Bytes handled at once: a batch is cut between documents near this size; one longer text goes alone.
CHUNK = 1 << 20

#: The six white-space bytes that part words: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Identity, but A-Z map to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_INVERSE = pow(int(BASE), -1, 1 << 64)
_powers = np.ones((2, 1), np.uint64)


def powers(n: int) -> np.ndarray:
    """(2, n or more): the powers of BASE from 0 on, and of its inverse, modulo 2**64."""
    global _powers
    while _powers.shape[1] < n:
        have = _powers.shape[1]
        step = np.array([[pow(b, have, 1 << 64)] for b in (int(BASE), _INVERSE)], np.uint64)
        _powers = np.concatenate([_powers, _powers * step], 1)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits (the published splitmix64 constants)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return offs, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, offsets from 0, bytes) of pieces of about CHUNK bytes, whole texts each."""
    offs, data = buffers(column)
    row, n = 0, len(offs) - 1
    while row < n:
        end = int(np.searchsorted(offs, offs[row] + CHUNK, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, offs[row : end + 1] - offs[row], data[offs[row] : offs[end]]
        row = end


class Words:
    """The words of some texts: hash of each, and where each text's words begin."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, separators: np.ndarray = SPACE, fold: np.ndarray | None = LOWER):
        inside = ~separators[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | edge[1:-1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: words[ptr[i]:ptr[i + 1]] are those of text i
        self.ptr = np.searchsorted(self.starts, offsets)
        self._data, self._fold = data, fold
        self._sums: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, prefix: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word, or of its first ``prefix`` bytes."""
        if self._sums is None:  # running sums of the polynomial's terms at the places in the buffer
            self._sums = np.zeros(len(self._data) + 1, np.uint64)
            np.cumsum((BYTE[self._fold] if self._fold is not None else BYTE)[self._data] * powers(len(self._data))[0, : len(self._data)], out=self._sums[1:])
        ends = self.ends if prefix is None else np.minimum(self.starts + prefix, self.ends)
        return mix((self._sums[ends] - self._sums[self.starts]) * powers(len(self._data))[1][self.starts])


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``width``-word shingles of each text, repeats included, and pointers by text.

    A text of fewer words (but one at least) has its whole sequence as its only shingle.
    """
    ptr, h = words.ptr, words.hashes()
    n = np.diff(ptr)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    out = np.zeros(int(count.sum()), np.uint64)
    at = np.concatenate([[0], np.cumsum(count)])
    if not len(out):
        return out, at
    seeds = mix(np.arange(1, width + 1, dtype=np.uint64) * BASE)
    place = np.arange(len(out)) + np.repeat(ptr[:-1] - at[:-1], count)  # of each shingle's first word
    length = np.repeat(np.minimum(n, width), count)
    for i in range(width):
        word = h[np.minimum(place + i, len(h) - 1)]
        term = mix(word ^ seeds[i]) * (seeds[i] | U64(1))
        out += np.where(i < length, term, U64(0)) if i else term
    return mix(out + length.astype(np.uint64)), at


def sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text."""
    for row, end, offs, data in chunks(column):
        values, at = shingles(Words(offs, data), width)
        for i in range(end - row):
            yield row + i, np.unique(values[at[i] : at[i + 1]])
