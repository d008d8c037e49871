"""Word tables of Arrow string columns, computed on the UTF-8 bytes with numpy.

Every word class used here is a set of ASCII bytes, alone or with all bytes above 0x7F, so words
can be cut and hashed on bytes without decoding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C13)          # odd, 3 modulo 8
MIX_A, MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
LONG_WORD = 64                          # bytes; longer words are hashed one by one
SLICE = 1 << 19

#: [^\x20\x09-\x0D]+
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z became a-z
ALNUM = np.ones(256, bool)
ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * MIX_A
    x = (x ^ (x >> U64(27))) * MIX_B
    return x ^ (x >> U64(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * BASE)


def powers(base: U64, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.cumprod(out, dtype=U64)


def inverse(base: U64) -> U64:
    return U64(pow(int(base), -1, 1 << 64))


UP, DOWN = powers(BASE, SLICE + LONG_WORD + 1), powers(inverse(BASE), SLICE + LONG_WORD + 1)


@dataclass
class Words:
    """Words of a column of texts: byte range [start, end) in ``data``, and for each text its first
    byte and the number of its first word (``offsets`` and ``first`` have one entry more than texts)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    offsets: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """64-bit hash of every word (polynomial over byte values, then mixed)."""
        out = np.zeros(len(self.start), U64)
        size = self.end - self.start
        long = size > LONG_WORD
        at = 0
        while at < len(out):                         # a slice of bytes at a time keeps memory small
            to = max(at + 1, int(np.searchsorted(self.start, self.start[at] + SLICE)))
            a, b = self.start[at], min(self.end[to - 1], self.start[to - 1] + LONG_WORD)
            sums = np.zeros(b - a + 1, U64)
            np.cumsum(BYTE_VALUE[self.data[a:b]] * UP[:b - a], out=sums[1:])
            start, end = self.start[at:to] - a, np.minimum(self.end[at:to] - a, b - a)
            out[at:to] = mix((sums[end] - sums[start]) * DOWN[start] + size[at:to].astype(U64))
            at = to
        for i in np.flatnonzero(long):
            out[i] = xxhash.xxh64_intdigest(self.data[self.start[i]:self.end[i]].tobytes(), seed=1)
        return out


def slices(batch: pa.RecordBatch, n_bytes: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows of a batch, about ``n_bytes`` of text at a time (a longer text alone)."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    place = np.cumsum(size, dtype=np.int64) // n_bytes
    for rows in np.split(np.arange(len(size)), np.flatnonzero(np.diff(place)) + 1):
        if len(rows):
            yield batch.slice(rows[0], len(rows))


def string_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offsets (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1] \
        if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2] if len(column) else None
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def words_of(column: pa.Array | pa.ChunkedArray, in_word: np.ndarray = SPACED, lower: bool = False) -> Words:
    data, offsets = string_bytes(column)
    if lower:
        data = LOWER[data]
    n = len(data)
    inside = in_word[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    edges = offsets[1:-1]                # a text's end also ends a word
    edges = edges[(edges > 0) & (edges < n)]
    opens[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    start = np.flatnonzero(opens)
    return Words(data, start, np.flatnonzero(closes) + 1, np.searchsorted(start, offsets), offsets)


def window_hashes(hashes: np.ndarray, width: int, base: U64 = BASE) -> np.ndarray:
    """Hash of every run of ``width`` consecutive word hashes (crossing texts as well)."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, U64)
    sums = np.zeros(n + 1, U64)
    np.cumsum(hashes * powers(base, n), out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * powers(inverse(base), n)[:n - width + 1])
