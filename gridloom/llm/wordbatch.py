"""Whole Arrow batches of texts as numpy arrays of words.

Spark hands ``mapInArrow`` functions record batches; everything here works on
the UTF-8 bytes of a slice of such a batch at once, so no Python code runs per
word.  Slices are bounded by bytes (a single longer text is a slice of its
own), which bounds the memory of a worker.  A null text counts as empty.

Hashes are polynomials modulo 2**64 with odd multipliers, finished by a
bit mixer.  They are the same on every machine and at every batch size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Odd multipliers of the byte and of the word polynomials.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_TILE = 1 << 20
SLICE_BYTES = 1 << 20


def byte_class(*spans: tuple[int, int], inverse: bool = False) -> np.ndarray:
    """256 flags: the bytes in the given closed ranges (or outside them)."""
    flags = np.zeros(256, dtype=bool)
    for lo, hi in spans:
        flags[lo : hi + 1] = True
    return ~flags if inverse else flags


#: ``[^\x20\x09-\x0D]+``
NOT_SPACE = byte_class((0x20, 0x20), (0x09, 0x0D), inverse=True)
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text
ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F), inverse=True)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int = _TILE) -> np.ndarray:
    """``base ** 0 .. base ** (n-1)`` modulo 2**64."""
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(n, base, dtype=U)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of at most ``limit`` bytes together, one row at least."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, len(column))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


class Words:
    """Words of a slice: ``start``/``end`` are byte positions, those of row r are ``ptr[r]:ptr[r+1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        mask = inside[self.data]
        before = np.zeros(len(mask) + 1, dtype=bool)
        before[1:] = mask
        edges = offsets[(offsets > 0) & (offsets < len(mask))]
        before[edges] = False
        self.start = np.flatnonzero(mask & ~before[:-1])
        after = np.zeros(len(mask) + 1, dtype=bool)
        after[:-1] = mask
        after[edges] = False
        self.end = np.flatnonzero(mask & ~after[1:]) + 1
        self.ptr = np.searchsorted(self.start, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.ptr) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each non-empty byte span."""
    if len(start) == 0:
        return np.zeros(0, dtype=U)
    tile = min(_TILE, 1 << int(len(data) - 1).bit_length()) if len(data) > 1 else 1
    power, inverse = powers(BYTE_BASE, tile), powers(pow(BYTE_BASE, -1, 1 << 64), tile)
    sums = np.zeros(len(data) + 1, dtype=U)
    for at in range(0, len(data), tile):
        part = data[at : at + tile].astype(U)
        part += U(1)
        part *= power[: len(part)]
        np.cumsum(part, out=sums[at + 1 : at + 1 + len(part)])
        if at:
            sums[at + 1 : at + 1 + len(part)] += sums[at]
    h = (sums[end] - sums[start]) * inverse[start % tile]
    for i in np.flatnonzero(start // tile != (end - 1) // tile):  # at most one span for each edge of a tile
        total, factor = 0, 1
        for at in range(int(start[i]), int(end[i]), tile):
            part = data[at : min(at + tile, int(end[i]))].astype(U) + U(1)
            total += factor * int((part * power[: len(part)]).sum(dtype=U))
            factor = factor * pow(BYTE_BASE, tile, 1 << 64)
        h[i] = total & 0xFFFFFFFFFFFFFFFF
    return mix(h)


def windows(h: np.ndarray, k: int, base: int = WORD_BASE) -> np.ndarray:
    """Rabin-Karp hash of every run of k values: sum of h[i+j] * base**j in the values' own width, by doubling; ``len(h)-k+1`` values, unmixed."""
    n, kind, limit = len(h) - k + 1, h.dtype.type, 1 << 8 * h.dtype.itemsize
    if n <= 0:
        return h[:0]
    out, done, block, size = None, 0, h, 1
    while True:
        if k & size:
            part = block[done : done + n]
            out = part.copy() if out is None else out + part * kind(pow(base, done, limit))
            done += size
        size *= 2
        if size > k:
            return out
        block = block[: len(block) - size // 2] + block[size // 2 :] * kind(pow(base, size // 2, limit))


def inside_rows(ptr: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, row) of every run of k words that lies in one row."""
    n = np.maximum(np.diff(ptr) - k + 1, 0)
    return ragged(ptr[:-1], n), np.repeat(np.arange(len(n)), n)


def ragged(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The indices start[i] .. start[i]+n[i]-1, one after another."""
    total = int(n.sum())
    if total == 0:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(n)
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(start, dtype=np.int64) - (ends - n), n)


def sliding_min(h: np.ndarray, k: int) -> np.ndarray:
    """Minimum of every run of k values."""
    n, block, size = len(h) - k + 1, h, 1
    if n <= 0:
        return h[:0]
    while size * 2 <= k:
        block = np.minimum(block[: len(block) - size], block[size:])
        size *= 2
    return np.minimum(block[:n], block[k - size : k - size + n])


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each row: (hashes ordered by row and hash, row pointers).

    A row of fewer than k words, but not none, has one shingle: its whole sequence."""
    h = words.hashes()
    first, row = inside_rows(words.ptr, k)
    grams = mix(windows(h, k)[first] + U(k)) if len(first) else np.zeros(0, dtype=U)
    n = words.counts
    short = np.flatnonzero((n > 0) & (n < k))
    extra = np.array([whole_hash(h[words.ptr[r] : words.ptr[r + 1]]) for r in short], dtype=U)
    grams, row = np.concatenate([grams, extra]), np.concatenate([row, short])
    order = np.argsort(grams, kind="stable")
    order = order[np.argsort(row[order].astype(np.int32), kind="stable")]
    grams, row = grams[order], row[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    return grams[new], np.searchsorted(row[new], np.arange(len(n) + 1))


def whole_hash(h: np.ndarray) -> int:
    """Hash of one sequence of word hashes, with its length in it."""
    return int(mix((h * powers(WORD_BASE, max(len(h), 1))[: len(h)]).sum(dtype=U, keepdims=True) + U(len(h)))[0])


def packed(values: np.ndarray, ptr: np.ndarray) -> list[bytes]:
    """The bytes of values[ptr[i]:ptr[i+1]]."""
    raw, size = np.ascontiguousarray(values).tobytes(), values.dtype.itemsize
    return [raw[a * size : b * size] for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True)]


def rows_of(batch: pa.RecordBatch, name: str, lo: int, hi: int) -> np.ndarray:
    """A column's values lo..hi as a numpy array of int64; nulls are refused by the callers' filters."""
    return batch.column(batch.schema.get_field_index(name)).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(np.int64)
