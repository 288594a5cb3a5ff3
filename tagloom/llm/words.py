"""Words, shingles and their 64-bit hashes over whole Arrow batches (NumPy, inside tasks).

Words are runs of bytes other than space and 0x09-0x0D; A-Z are folded to lower case where asked.
A word's hash is a difference of one running polynomial sum over the slice, so the cost is a few
array passes per byte whatever the number of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SIGNS = np.ones(128, bool)  # ASCII but letters and digits, for word models
SIGNS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
SIGNS = np.concatenate((SIGNS, np.zeros(128, bool)))
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_SYMBOL = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that every bit depends on all others."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if "up" not in _tables or len(_tables["up"]) < n:
        size = max(1 << 21, n)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(size, U(base))
            table[0] = 1
            _tables[name] = np.multiply.accumulate(table)
    return _tables["up"][:n], _tables["down"][:n]


def running(data: np.ndarray, symbols: np.ndarray = _SYMBOL) -> np.ndarray:
    """Prefix sums of the polynomial hash: one more value than there are bytes."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum(symbols[data] * powers(len(data))[0], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans ``[start, end)``: equal spans have equal hashes wherever they lie."""
    down = powers(len(sums))[1]
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def utf8_bytes(column: pa.Array) -> np.ndarray:
    """All bytes of a binary column one after the other."""
    return utf8(column.cast(pa.large_binary()))[0]


def slices(batches: Iterator[pa.RecordBatch], *columns: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the named texts of one piece hold about ``limit`` bytes (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
        total, at = np.cumsum(size), 0
        while at < batch.num_rows:
            before = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, before + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end


@dataclass
class Words:
    """Words of several texts: ``first[i]:first[i+1]`` are those of text ``i``."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray, fold: bool = True, breaks: np.ndarray = SPACE) -> Words:
    inside = ~breaks[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    sums = running(FOLD[data] if fold else data)
    return Words(span_hash(sums, s, e), s, e, np.searchsorted(s, offsets))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` word hashes, as if all texts were one; the caller drops those that cross texts."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    total = np.full(n, U(k))
    for j in range(k):
        total = total * U(0x100000001B3) + hashes[j : n + j]
    return mix(total)


def shingles_of(words: Words, k: int) -> Iterator[np.ndarray]:
    """Per text its ``k``-word shingle hashes with repeats, in text order; a shorter text gives its whole sequence as one."""
    all_grams = grams(words.hashes, k)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= k:
            yield all_grams[a : b - k + 1]
        else:
            yield grams(words.hashes[a:b], b - a) if b > a else np.zeros(0, U)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    if len(values) < 2:
        return values
    ordered = np.sort(values)
    return ordered[np.concatenate(([True], ordered[1:] != ordered[:-1]))]
