"""Arrow text columns as flat byte arrays: words, hashes and slices of bounded size inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

# Bytes of text worked on at a time; a longer text is worked on alone.
SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
# Between words of letters and digits.
NOT_WORD = np.ones(256, bool)
NOT_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without NULLs, and where each text begins and the last one ends."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[places[0] : places[-1]], places - places[0]


def bounded_slices(
    batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Batches of whole rows with about `limit` bytes of text each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, places = text_buffer(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(places, places[first] + limit, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all else as it is."""
    return _LOWER[data]


def word_spans(
    data: np.ndarray, places: np.ndarray, between: np.ndarray = _SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every run of bytes that are not ASCII white space (or `between`)."""
    inside = ~between[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[places] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | cut[1:-1]
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    begin = np.flatnonzero(starts)
    return begin, np.flatnonzero(ends) + 1, np.searchsorted(places, begin, "right") - 1


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Of a polynomial hash: what `span_hashes` takes differences of."""
    global _powers
    if len(_powers[0]) <= len(data):
        n = (len(data) // (1 << 18) + 1 << 18) + 1
        _powers = tuple(
            np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))
            for base in (_BASE, _BASE_INVERSE)
        )
    sums = np.zeros(len(data) + 1, np.uint64)
    sums[1:] = data
    sums[1:] += np.uint64(1)
    sums[1:] *= _powers[0][: len(data)]
    np.cumsum(sums, out=sums)
    return sums


def forget_powers() -> None:
    """Drop the table that `prefix_sums` keeps, which is as long as the longest data so far."""
    global _powers
    _powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def span_hashes(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from begin to end; equal bytes have equal hashes in every batch."""
    h = (sums[end] - sums[begin]) * _powers[1][begin]
    return mixed(h + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
