"""Hashed word shingles of whole texts, many texts at a time in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])  # white space and ASCII punctuation
_DRAW = np.random.default_rng(20240607)
BYTES = _DRAW.integers(0, 1 << 64, 256, np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
PLACES = _DRAW.integers(0, 1 << 63, 16, np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spreads 64-bit values; a bijection for each salt."""
    h = h + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column) or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def words(column: pa.Array, between: np.ndarray = SPACE, beginnings: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased, parted by the bytes `between`) and the number of words of each text.

    With `beginnings` there is a row of hashes for the words and one for the first bytes of them, for each length.
    """
    parts = 1 + len(beginnings)
    raw, at = text_bytes(column)
    if not len(raw):
        return np.zeros((parts, 0) if beginnings else 0, np.uint64), np.zeros(len(column), np.int64)
    inside = ~between[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = at[:-1][at[:-1] < len(raw)]
    first[edge] = inside[edge]  # a text starts a new word
    starts = np.flatnonzero(first)
    counts = np.diff(np.searchsorted(starts, at))
    if not len(starts):
        return np.zeros((parts, 0) if beginnings else 0, np.uint64), counts
    raw, inside = raw[starts[0] :], inside[starts[0] :]
    starts = starts - starts[0]
    place = np.arange(len(raw), dtype=np.int32) - np.repeat(starts.astype(np.int32), np.diff(np.append(starts, len(raw))))
    place[~inside] = 0
    values = BYTES[LOWER[raw]] * powers(int(place.max()) + 1)[place]
    values[~inside] = 0
    whole = mix(np.add.reduceat(values, starts))
    if not beginnings:
        return whole, counts
    return np.stack([whole, *[mix(np.add.reduceat(np.where(place < n, values, 0), starts), 20 + n) for n in beginnings]]), counts


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending and one text after the other, and their numbers.

    A text of fewer words than `size` has one shingle, all its words; one without words has none.
    """
    h, counts = words(column)
    ends = np.cumsum(counts)
    n = len(h)
    g = np.zeros(n, np.uint64)
    for k in range(min(size, n)):
        g[: n - k] += h[k:] * PLACES[k]
    g = mix(g, 1)
    out, sizes = [], np.zeros(len(counts), np.int64)
    for i, (end, count) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
        if count >= size:
            own = np.sort(g[end - count : end - size + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            own = own[keep]
        elif count:
            own = mix(np.array([np.bitwise_xor.reduce(mix(h[end - count : end] * PLACES[: count], count + 8))], np.uint64), 2)
        else:
            continue
        out.append(own)
        sizes[i] = len(own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), sizes


def chunks(batch: pa.RecordBatch, text: int, most: int = 1 << 20, rows: int = 512):
    """Slices of a batch with at most `rows` rows and about `most` bytes of text, one row at least."""
    sizes = np.diff(text_bytes(batch.column(text))[1])
    start = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and (i - start >= rows or total + n > most):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if batch.num_rows > start:
        yield batch.slice(start)
