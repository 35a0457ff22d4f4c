"""Numpy helpers on Arrow batches of texts: bytes, words, rolling hashes.

Spark partitions and shuffles the rows; these functions work on one slice of a batch at a time, so memory stays
within a few times ``SLICE_BYTES`` or the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
PIECE_BYTES = 256 << 10

U64 = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)

#: The bytes that separate words.
GAPS = np.zeros(256, bool)
GAPS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes one after another, and where each text starts and ends; a null text is empty."""
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive pieces of the batches with at most ``limit`` bytes of text each, or one longer text."""
    for batch in batches:
        _, offsets = utf8(batch.column(column))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, min(to, n) - at)
            at = to


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values one to one."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of a base and of its inverse modulo 2**64; a worker keeps one table of each base."""
    if which not in _POWERS or len(_POWERS[which][0]) < n:
        base, size = BASES[which] | 1, max(1 << 16, n + n // 8)
        tables = []
        for b in (base, pow(base, -1, 1 << 64)):
            table = np.full(size, b, U64)
            table[0] = 1
            tables.append(np.cumprod(table, out=table))
        _POWERS[which] = tables[0], tables[1]
    return _POWERS[which]


@lru_cache(maxsize=2)
def _letters(which: int) -> np.ndarray:
    return mix(np.arange(256, dtype=U64) + U64(1000 * which + 1))


def letters(data: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit value for each byte."""
    return _letters(which)[data]


def prefix_sums(values: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix polynomial hashes of 64-bit values; ``span_hash`` reads any span off them."""
    up, _ = powers(which, len(values) + 1)
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def byte_sums(data: np.ndarray, which: int = 0) -> np.ndarray:
    return prefix_sums(letters(data, which), which)


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of the spans [start, end), equal for equal contents wherever they stand."""
    _, down = powers(which, len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the index of each text's first word (with the count at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    gap = GAPS[data]
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, gap[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, gap[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(before & ~gap), np.flatnonzero(after & ~gap) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of each word, made piece by piece: a hash does not depend on the place, and long tables cost memory."""
    out = np.empty(len(starts), U64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + PIECE_BYTES, "right")))
        out[at:to] = span_hash(byte_sums(data[base : ends[to - 1]], which), starts[at:to] - base, ends[at:to] - base, which)
        at = to
    return out


def gram_hashes(values: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of each run of k consecutive values, at its start."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    sums = prefix_sums(values, which)
    _, down = powers(which, len(sums))
    out = sums[k:] - sums[:-k]  # as span_hash, whose places are all here
    out *= down[:n]
    out += U64(k)
    return mix(out)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data | 32, data)


def owners(first: np.ndarray) -> np.ndarray:
    """Index of the text of each element, from where each text's elements start."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenated ranges start, start + 1, ... of the given lengths."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def list_array(values: pa.Array, lengths: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def hashed_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, limit: int = SLICE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the index of each text's first word; made slice by slice to bound memory."""
    hashes, first, at, n = [], [np.zeros(1, np.int64)], 0, len(offsets) - 1
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1))
        part, own = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        part = lower_ascii(part) if lower else part
        starts, ends, counts = word_spans(part, own)
        hashes.append(word_hashes(part, starts, ends))
        first.append(counts[1:] + first[-1][-1])
        at = to
    return np.concatenate(hashes) if hashes else np.zeros(0, U64), np.concatenate(first)
