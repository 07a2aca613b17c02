"""Vectorised splitting of Arrow text columns, shared by the operators that use numpy.

A word is a run of bytes other than \\x20 and \\x09-\\x0D.  All work is done on the UTF-8 bytes
of a slice of documents at once; per-word work is done once for each distinct word of a slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes that are worked on at once: bounds a worker's memory whatever a batch holds
#: (a single longer document is a slice of its own).
SLICE_BYTES = 2 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.LargeStringArray:
    """The column with nulls as empty texts and 64-bit offsets."""
    col = batch.column(batch.schema.get_field_index(name)).cast(pa.large_string())
    return col.fill_null("") if col.null_count else col


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of documents with about ``limit`` text bytes."""
    col = text_column(batch)
    ends = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    start = 0
    while start < len(col):
        stop = int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), len(col))
        yield batch.slice(start, stop - start)
        start = stop


def raw(col: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each text starts (with the end)."""
    ends = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.LargeStringArray:
    """An Arrow column over bytes cut at offsets; copies nothing."""
    return pa.LargeStringArray.from_buffers(
        len(offsets) - 1,
        pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)),
        pa.py_buffer(np.ascontiguousarray(data)),
    )


class Words:
    """The words of a slice: ``codes`` into ``distinct``, and ``bounds`` of each document's words."""

    def __init__(self, col: pa.LargeStringArray):
        data, ends = raw(col)
        solid = ~SPACE[data]
        first = solid.copy()
        if len(data):
            before = np.empty(len(data), dtype=bool)
            before[0] = False
            before[1:] = solid[:-1]
            before[ends[:-1][ends[:-1] < len(data)]] = False
            first &= ~before
        starts = np.flatnonzero(first)
        self.at = starts  # byte position of each word
        self.ends = ends
        self.bounds = np.searchsorted(starts, ends)
        kept = np.cumsum(solid, dtype=np.int32 if len(data) < 1 << 31 else np.int64)
        offsets = np.append(kept[starts] - 1, kept[-1] if len(kept) else 0).astype(np.int64)
        encoded = strings(data[solid], offsets).dictionary_encode()
        self.codes = np.asarray(encoded.indices)
        self.distinct = encoded.dictionary

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each distinct word."""
        return hash_strings(self.distinct)


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0x9FB21C651E98DF25)


def hash_strings(col: pa.LargeStringArray) -> np.ndarray:
    """A 64-bit hash of each string: a polynomial over its bytes, spread at the end."""
    data, ends = raw(col)
    n = np.diff(ends)
    if not len(n):
        return np.empty(0, np.uint64)
    power = np.cumprod(np.full(int(n.max()) + 1, _BASE, dtype=np.uint64))
    value = _BYTE[data] * power[np.arange(len(data)) - np.repeat(ends[:-1], n)]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    return mix(total[ends[1:]] - total[ends[:-1]] + n.astype(np.uint64))


def segment_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values in each [bounds[i], bounds[i+1]); 0 where that is empty."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), dtype=np.float64)
    np.cumsum(values, axis=0, dtype=np.float64, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i], ..., starts[i] + lengths[i] - 1, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))
