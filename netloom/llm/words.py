"""Numpy helpers that run inside tasks: words, hashes and n-grams of Arrow text columns, a bounded piece at a time.

A word is a maximal run of bytes other than space and \\t \\n \\v \\f \\r; it is known by a 64-bit hash of its bytes.
Null texts have no words. Memory is bounded by ``CHUNK`` bytes of text plus 16 bytes per word of the longest document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (multiply and xor-shift rounds)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def multipliers(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers that depend on the seed alone."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(_BASE) + U64(seed)) | U64(1)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        inverse = U64(pow(_BASE, -1, 1 << 64))
        up, down = (np.multiply.accumulate(np.concatenate(([U64(1)], np.full(max(n, CHUNK), b, U64)))) for b in (U64(_BASE), inverse))
        if n > 4 * CHUNK:  # one enormous word: not kept
            return up, down
        _powers[:] = [up, down]
    return _powers[0], _powers[1]


def _hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _power_tables(len(data))
    sums = np.empty(len(data) + 1, U64)
    sums[0] = 0
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


@dataclass
class Words:
    """Words of whole documents: hashes, byte spans, and for each document the index of its first word (one more at the end)."""

    row: int
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def documents(self) -> int:
        return len(self.first) - 1


def _spans(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word spans in data; cuts are offsets at which a word must not run on."""
    inside = ~_SPACE[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cuts = cuts[cuts < len(data)]
    begin[cuts] = inside[cuts]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    before = cuts[cuts > 0] - 1
    stop[before] = inside[before]
    return np.flatnonzero(begin), np.flatnonzero(stop) + 1


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column, nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def words_of(column: pa.Array, chunk: int = CHUNK) -> Iterator[Words]:
    """Whole documents in pieces of about ``chunk`` bytes; spans are offsets into the column's bytes (``text_buffer``)."""
    data, offsets = text_buffer(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + chunk, "right")) - 1)
        parts, low = [], int(offsets[row])
        end = int(offsets[last])
        while low < end:
            high = min(end, low + 2 * chunk)
            if high < end:  # a long document is cut between words
                space = np.flatnonzero(_SPACE[data[low:high]])
                while not len(space) and high < end:
                    high = min(end, high + 2 * chunk)
                    space = np.flatnonzero(_SPACE[data[low:high]])
                if high < end:
                    high = low + int(space[-1]) + 1
            piece = data[low:high]
            s, e = _spans(piece, offsets[row:last] - low if low == offsets[row] else np.zeros(0, np.int64))
            parts.append((_hash_spans(piece, s, e), s + low, e + low))
            low = high
        hashes, starts, ends = (np.concatenate(x) if parts else np.zeros(0, t) for x, t in zip(zip(*parts) if parts else ((), (), ()), (U64, np.int64, np.int64)))
        first = np.searchsorted(starts, offsets[row : last + 1])
        yield Words(row, hashes, starts, ends, first)
        row = last


def grams(words: Words, n: int, seed: int = 5, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles in order, and each document's first index. With ``short`` a document of fewer than n
    words gives one shingle of all its words; an empty one gives none."""
    count = np.diff(words.first)
    number = np.maximum(count - n + 1, 0)
    weights = multipliers(n, seed)
    h = words.hashes
    total = max(len(h) - n + 1, 0)
    rolled = np.zeros(total, U64)
    for j in range(n):
        rolled += h[j : j + total] * weights[j]
    rolled = mix(rolled)
    valid = np.zeros(total + 1, np.int64)  # +1 where a document's shingles begin, -1 where they end
    has = number > 0
    np.add.at(valid, words.first[:-1][has], 1)
    np.add.at(valid, words.first[:-1][has] + number[has], -1)
    out = rolled[np.cumsum(valid[:-1]) > 0]
    if short and (few := (count > 0) & (count < n)).any():
        number[few] = 1
        first = np.concatenate(([0], np.cumsum(number)))
        full = np.zeros(first[-1], U64)
        keep = np.ones(len(full), bool)
        keep[first[:-1][few]] = False
        full[keep] = out
        for d in np.flatnonzero(few):
            own = h[words.first[d] : words.first[d + 1]]
            full[first[d]] = mix((own * weights[: len(own)]).sum(dtype=U64)[None] + U64(len(own)))[0]
        return full, first
    return out, np.concatenate(([0], np.cumsum(number)))


def unique_per_document(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each document."""
    if not len(values):
        return values, first
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((values, owner)) if len(first) > 2 else np.argsort(values)
    v, o = values[order], owner[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return v[new], np.concatenate(([0], np.cumsum(np.bincount(o[new], minlength=len(first) - 1))))


def runs(first: np.ndarray) -> np.ndarray:
    """Indices of the documents that have values, as needed for ``reduceat``."""
    return np.flatnonzero(np.diff(first) > 0)
