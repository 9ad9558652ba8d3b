"""Whole texts as arrays: byte buffers, words and their hashes, checked folders."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
"""Text that the array operators look at in one go; a longer text is a chunk of its own."""

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
"""Separators of words ``[^\\x20\\x09-\\x0D]+``."""

NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = True
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
"""Separators of words of ASCII letters, digits and all characters beyond ASCII."""

_ODD = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the input reaches every bit of the output."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2^64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        table = np.full(n, base, np.uint64)
        table[0] = 1
        out.append(np.multiply.accumulate(table))
    return out[0], out[1]


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint64)
    table[65:91] += np.uint64(32)
    return table + np.uint64(1)


LOWER = _lower_table()
"""What a byte counts as in the hash of a word: A-Z as a-z."""


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, kind)[column.offset:column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with about ``limit`` bytes of text."""
    _, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
    first, n = 0, batch.num_rows
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield batch.slice(first, last - first)
        first = last


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, table=None) -> np.ndarray:
    """A 64-bit hash of each span of bytes and its length, in one pass over the bytes.

    ``table`` gives the number that a byte counts as, from 1 on; by default its value and one.
    """
    n = len(data)
    power, inverse = _powers(1 << max(16, int(n).bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    values = data.astype(np.uint64) + np.uint64(1) if table is None else table[data]
    np.cumsum(values * power[:n], out=sums[1:])
    return mixed((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def prefix_hashes(data: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """``spans_hash`` of the bytes from the last of the places ``opens`` up to each byte, itself left out."""
    n = len(data)
    power, inverse = _powers(1 << max(16, int(n).bit_length()))
    values = data.astype(np.uint64)
    values += np.uint64(1)
    values *= power[:n]
    sums = np.zeros(n, np.uint64)
    np.cumsum(values[:-1], out=sums[1:])
    sizes = np.diff(opens, append=n)
    sums -= np.repeat(sums[opens], sizes)
    sums *= np.repeat(inverse[opens], sizes)
    sums += np.arange(n, dtype=np.uint64)
    sums -= np.repeat(opens.astype(np.uint64), sizes)
    return mixed(sums)


class Words:
    """The words of consecutive texts.

    ``first[i]:first[i + 1]`` are the words of text i; ``start`` and ``end`` are byte places
    in the chunk and ``hash`` is a 64-bit hash of the word with A-Z lower-cased.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITE):
        n = len(data)
        gap = separators[data]
        before = np.ones(n, bool)
        before[1:] = gap[:-1]
        before[offsets[:-1][offsets[:-1] < n]] = True
        after = np.ones(n, bool)
        after[:-1] = gap[1:]
        ends = offsets[1:][offsets[1:] > 0]
        after[ends - 1] = True
        self.start = np.flatnonzero(~gap & before)
        self.end = np.flatnonzero(~gap & after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = spans_hash(data, self.start, self.end, LOWER)

    def document(self) -> np.ndarray:
        """For each word the place of its text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def joined(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` consecutive hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, (width * _ODD) & _MASK, np.uint64)
    for k in range(width):
        total += hashes[k:k + n] * np.uint64(pow(_BASE, k + 1, 1 << 64))
    return mixed(total)


def shingle_sets(words: Words, width: int = 5) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted; a shorter text is one shingle."""
    whole = joined(words.hash, width)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(whole[a:b - width + 1]))
        elif b > a:
            out.append(joined(words.hash[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def required(a, b, percent: int = 75):
    """Smallest overlap with 100 * overlap >= percent * union, for set sizes a and b."""
    return -((-percent * (a + b)) // (100 + percent))


def prefix_length(n, percent: int = 75):
    """Two sets that link share a token among their first so many, in any common order."""
    return n + (-percent * n) // 100 + 1
