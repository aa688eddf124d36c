"""Vectorised text helpers for Arrow batches: bounded chunks, word bounds and hashes over raw UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd multiplier of the polynomial byte hash, and the two constants of the 64-bit finaliser.
MULTIPLIER = 0x9E3779B97F4A7C15 | 1
MIX_1, MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)

#: Bytes that end a word: space and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads each 64-bit value over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * MIX_1
    x = x ^ (x >> np.uint64(33))
    x = x * MIX_2
    return x ^ (x >> np.uint64(33))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the row offsets (rows + 1) of a string column; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of about `limit` bytes of text each (one row at least), with the slice's bytes and offsets."""
    for batch in batches:
        data, bounds = utf8(batch.column(batch.schema.get_field_index(column)))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, "right")) - 1)
            j = min(j, batch.num_rows)
            yield batch.slice(i, j - i), data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
            i = j


class Powers:
    """Powers of the multiplier and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, multiplier: int = MULTIPLIER):
        self.factors = multiplier, pow(multiplier, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, f, np.uint64)]), dtype=np.uint64) for f in self.factors)
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[i] the polynomial hash of data[:i]."""
    up, _ = _POWERS.upto(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of data[start:end]; equal bytes give equal values wherever they stand."""
    _, down = _POWERS.upto(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and each row's first word's number (rows + 1)."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~SPACE[data]
    start = inside[1:] & ~inside[:-1]
    inner = bounds[1:-1]
    inner = inner[inner < n]
    start[inner] |= inside[inner + 1]
    end = inside[:-1] & ~inside[1:]
    end[inner] |= inside[inner]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end)
    return starts, ends, np.searchsorted(starts, bounds, "left")


def pieces(data: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """One text's bytes in pieces of about `size` that end at the end of a word; a longer word is in one piece."""
    a = 0
    while a < len(data):
        b = min(a + size, len(data))
        while b < len(data):
            space = np.flatnonzero(SPACE[data[b : b + size]])
            b = b + int(space[0]) if len(space) else min(b + size, len(data))
            if len(space):
                break
        yield data[a:b]
        a = b


def word_hashes(data: np.ndarray, bounds: np.ndarray, size: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of all rows, and each row's first word's number (rows + 1). One very long row goes through in pieces of `size` bytes."""
    if len(bounds) == 2 and len(data) > size:
        parts = [word_hashes(p, np.array([0, len(p)]), len(p))[0] for p in pieces(data, size)]
        return np.concatenate(parts), np.array([0, sum(map(len, parts))])
    starts, ends, first = words(data, bounds)
    return range_hash(prefix_hash(data), starts, ends), first


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's k-word shingles and each row's first shingle's number; a row of 1 to k - 1 words has one, of all its words."""
    counts = np.diff(first)
    per_row = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    out_first = np.concatenate([[0], np.cumsum(per_row)])
    row = np.repeat(np.arange(len(counts)), per_row)
    at = np.arange(out_first[-1]) - out_first[row] + first[row]
    length = np.minimum(counts[row], k)
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    total = np.zeros(len(at), np.uint64)
    for j in range(k):
        total = total * np.uint64(MULTIPLIER) + np.where(j < length, padded[at + j], np.uint64(0))
    return mix(total + length.astype(np.uint64)), out_first
