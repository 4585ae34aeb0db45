"""Texts of Arrow batches as NumPy byte arrays: words, hashes, shingles.

Everything works on blocks of whole texts of about ``BLOCK`` bytes (one longer
text is a block of its own), so memory follows the longest text, not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
U = np.uint64

#: White space of the word rule: blank and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; a bijection."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _byte_table() -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
    table[65:91] = table[97:123]  # A-Z count as a-z
    return table


BYTE = _byte_table()
BASE, BASE_INV = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, BLOCK + 1), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps)
        if len(have) > 4 * BLOCK:  # one very long text shall not stay in memory
            return have[:n]
        _powers[base] = have
    return have[:n]


@dataclass
class Block:
    """Some whole texts: rows ``first`` to ``last`` of a batch, their bytes end to end."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray  # int64, one more than texts, from 0

    @property
    def n(self) -> int:
        return self.last - self.first


def release() -> None:
    """Give freed memory back to the system: workers outlive their tasks and share an executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        return


def text_array(column: pa.Array) -> pa.Array:
    """Text as large binary without nulls (null counts as empty)."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    return pc.fill_null(column, b"") if column.null_count else column


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[Block]:
    column = text_array(column)
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, len(column))
        yield Block(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


@dataclass
class Words:
    """Words of a block: byte spans, the text of each, its 64-bit hash; ``bounds[t]`` is text t's first word."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray


def words(block: Block, table: np.ndarray = BYTE, space: np.ndarray = SPACE) -> Words:
    data, offsets = block.data, block.offsets
    inside = ~space[data]
    edge = np.zeros(len(data) + 1, bool)  # a word never crosses from one text to the next
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[:1] = True
    np.logical_not(inside[:-1], out=before[1:])
    before |= edge[:-1]
    starts = np.flatnonzero(inside & before)
    after = np.empty(len(data), bool)
    after[-1:] = True
    np.logical_not(inside[1:], out=after[:-1])
    after |= edge[1:]
    ends = np.flatnonzero(inside & after) + 1
    hashes = spans(data, starts, ends, table)
    return Words(starts, ends, hashes, np.searchsorted(starts, offsets))


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
    """Hash of the bytes of each span, the same wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * powers(BASE, len(data)), out=total[1:])
    back = powers(BASE_INV, len(data) + 1)[starts]
    return mix((total[ends] - total[starts]) * back + (ends - starts).astype(np.uint64))


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of every text: sorted hashes end to end, and each text's first.

    Fewer than k words count as one shingle; no word, no shingle.
    """
    n = len(w.hashes)
    counts = np.diff(w.bounds)
    rolled = np.zeros(max(0, n - k + 1), np.uint64)
    for i in range(k if len(rolled) else 0):
        rolled = rolled * U(BASE) + w.hashes[i : n - k + 1 + i]
    rolled = mix(rolled)
    pieces, sizes = [], np.zeros(len(counts), np.int64)
    for t in np.flatnonzero(counts):
        a, b = w.bounds[t], w.bounds[t + 1]
        if b - a >= k:
            own = np.sort(rolled[a : b - k + 1])
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        else:
            own = np.array([b - a], np.uint64)
            for x in w.hashes[a:b]:
                own = mix(own * U(BASE) + x)
        pieces.append(own)
        sizes[t] = len(own)
    first = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(sizes, out=first[1:])
    return (np.concatenate(pieces) if pieces else np.zeros(0, np.uint64)), first
