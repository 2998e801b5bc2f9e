"""Numpy views on Arrow text columns, and hashes of words and word shingles.

All work inside tasks, on slices of a bounded number of bytes; one text is never cut.
A word is a run of bytes outside space and 0x09-0x0D, so it can be found in UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 21  # text bytes worked on at once (a longer text stands alone)

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_VALUES = np.random.default_rng(20240607).integers(0, 2**64, 256, dtype=np.uint64)
_FOLDED = _VALUES[_LOWER]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLIERS = np.random.default_rng(77).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row slices of about `limit` bytes of `column`."""
    if batch.num_rows == 0:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    group = (np.cumsum(sizes) - sizes) // limit
    cuts = np.flatnonzero(np.diff(group)) + 1
    bounds = [0, *cuts.tolist(), batch.num_rows]
    for a, b in zip(bounds, bounds[1:]):
        yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty.  Offsets start at 0."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64 bits: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(base^i, base^-i) mod 2^64 for i < n at least."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        for key, base in (("up", _BASE), ("down", inverse)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _powers[key] = np.multiply.accumulate(step)
    return _powers["up"], _powers["down"]


def prefix_hashes(data: np.ndarray, fold: bool = False) -> np.ndarray:
    """P with hash(data[a:b]) = (P[b] - P[a]) * base^-a."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _VALUES)[data] * up[: len(data)], out=out[1:])
    return out


@dataclass
class Words:
    """Words of a slice of texts: hashes in order, and where each text's words begin."""

    hashes: np.ndarray  # uint64, one per word
    bounds: np.ndarray  # int64, texts + 1


def word_spans(
    data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SEPARATOR
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end byte, bounds by text) of all words; `separator` by byte value."""
    inside = ~separator[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    starts[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return first, last, np.searchsorted(first, offsets)


def words(column: pa.Array, fold: bool = False) -> Words:
    """All words of a string column as hashes; `fold` takes A-Z as a-z."""
    data, offsets = text_bytes(column)
    if not len(data):
        return Words(np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    first, last, bounds = word_spans(data, offsets)
    sums = prefix_hashes(data, fold)
    _, down = powers(len(data) + 1)
    return Words(mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)), bounds)


def windows_of(found: Words, width: int) -> np.ndarray:
    """Hashes of the `width` words from each word on, across texts; the last ones are cut short."""
    h = found.hashes
    out = np.zeros(len(h), np.uint64)
    for i in range(width):
        out[: len(h) - i] += h[i:] * _MULTIPLIERS[i]
    return mix(out)


def shingle_sets(found: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes, bounds by text).  A text with fewer than `width`
    words has its whole word sequence as one shingle; one without words has none."""
    h, bounds = found.hashes, found.bounds
    windows = windows_of(found, width)
    parts, sizes = [], np.zeros(len(bounds) - 1, np.int64)
    for t, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        if b - a >= width:
            own = np.unique(windows[a : b - width + 1])
        elif b > a:
            own = mix(np.array([(h[a:b] * _MULTIPLIERS[8 : 8 + b - a]).sum(dtype=np.uint64)], np.uint64))
        else:
            continue
        parts.append(own)
        sizes[t] = len(own)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])
