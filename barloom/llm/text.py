"""Vectorised words and hashes of batches of UTF-8 texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes and number of texts handled at once; a longer text is a chunk of its own.
CHUNK, TEXTS = 1 << 18, 1024
_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_B), -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _B), np.full(n, _INV)
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is empty."""
    column = pc.fill_null(pc.cast(column, pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    at = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about CHUNK bytes of text: rows, bytes, offsets."""
    for batch in batches:
        data, at = buffers(batch.column(batch.schema.get_field_index(column)))
        i, n = 0, batch.num_rows
        while i < n:
            j = min(n, i + TEXTS, max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, "right")) - 1))
            yield batch.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i]
            i = j


def spans(data: np.ndarray, at: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text the number of words before it (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~apart[data]
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def prefix(data: np.ndarray) -> np.ndarray:
    """Sums of byte * B ** place before each place."""
    up, _ = _powers(1 << max(19, int(len(data)).bit_length()))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def slice_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of slices, alike for equal bytes."""
    _, down = _powers(1 << max(19, int(len(sums) - 1).bit_length()))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return slice_hashes(prefix(data), starts, ends)


def ordered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of whole numbers of at least 0, ties in any, and the numbers in it; where both fit a word, place and number are sorted as one."""
    bits = np.int64(max(1, len(keys) - 1).bit_length())
    if int(keys.max(initial=0)).bit_length() + bits > 62:
        order = np.argsort(keys)
        return order, keys[order]
    both = keys << bits
    both |= np.arange(len(keys))
    both.sort()
    return both & ((np.int64(1) << bits) - 1), both >> bits


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of ``width`` hashes; windows over two texts are the caller's to drop."""
    n = max(0, len(hashes) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = mix(out ^ hashes[k : k + n]) if k == 0 else (out * _B + hashes[k : k + n])
    return mix(out)
