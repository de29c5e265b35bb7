"""Vectorised text passes over Arrow string columns: words, word hashes, shingle sets.

A batch of texts is one byte buffer with offsets, so every pass is a handful of
numpy operations over the whole buffer; no Python loop runs per word.
Words are maximal runs of bytes other than x20 and x09-x0D; A-Z count as a-z.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lexmill.llm.common import persistent

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes handled at once; a longer text is handled alone.
CHUNK = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits (the public splitmix64 constants)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _tables(n: int):
    kept = persistent("hash_tables")
    if getattr(kept, "n", 0) < n:
        size = max(n, CHUNK + 1)
        inverse = pow(BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            for name, base in (("power", BASE), ("inverse", inverse)):
                x = np.full(size, base, U64)
                x[0] = 1
                setattr(kept, name, np.cumprod(x, dtype=U64))
            lower = np.arange(256)
            lower[65:91] += 32
            kept.letters = mix(np.arange(1, 257, dtype=U64) * U64(BASE))[lower]
        kept.n = size
    return kept


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - (offsets[0] if len(offsets) else 0)


def chunks(offsets: np.ndarray):
    """(first, last) rows whose texts together stay below CHUNK bytes, or a single longer text."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def words_of(data: np.ndarray, offsets: np.ndarray):
    """Word starts, ends and, for each row, where its words begin in those arrays."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before = np.ones(len(data), bool)
    before[1:] = space[:-1]
    before[inner] = True
    after = np.ones(len(data), bool)
    after[:-1] = space[1:]
    after[inner - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: differences of a prefix polynomial, then mixed."""
    t = _tables(len(data) + 1)
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(data) + 1, U64)
        np.cumsum(t.letters[data] * t.power[: len(data)], out=prefix[1:])
        return mix((prefix[ends] - prefix[starts]) * t.inverse[starts])


def shingles(hashes: np.ndarray, firsts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and, for each row, where its own begin.

    A row of fewer than k words (but some) has one shingle, all its words.
    """
    n = np.diff(firsts)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(begin[-1], U64)
    with np.errstate(over="ignore"):
        factors = mix(np.arange(1, k + 1, dtype=U64) * U64(0xD6E8FEB86659FD93))
        full = np.repeat(n >= k, count)
        at = np.repeat(firsts[:-1] - begin[:-1], count) + np.arange(begin[-1])
        where = at[full]
        total = np.zeros(len(where), U64)
        for j in range(k):
            total += hashes[where + j] * factors[j]
        out[full] = mix(total)
        for row in np.flatnonzero((n > 0) & (n < k)):
            own = hashes[firsts[row] : firsts[row + 1]]
            out[begin[row]] = mix((own * factors[: len(own)]).sum(dtype=U64, keepdims=True) + U64(len(own)))[0]
    return out, begin


def shingle_sets(column: pa.Array, k: int):
    """For each row its sorted array of distinct shingle hashes, in order."""
    data, offsets = string_buffer(column)
    for first, last in chunks(offsets):
        own = offsets[first : last + 1]
        part, own = data[own[0] : own[-1]], own - own[0]
        starts, ends, firsts = words_of(part, own)
        out, begin = shingles(word_hashes(part, starts, ends), firsts, k)
        for i in range(last - first):
            yield np.unique(out[begin[i] : begin[i + 1]])
