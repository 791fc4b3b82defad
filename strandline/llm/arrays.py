"""Vectorised helpers over the byte buffers of Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Text handled at a time inside a task; one longer document is handled alone.
CHUNK_BYTES = 1 << 21
ROWS_PER_BATCH = 1000

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64
BYTE_CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
# Word characters: all bytes but the space and 0x09-0x0D.
IN_WORD = np.ones(256, bool)
IN_WORD[[0x20, *range(0x09, 0x0E)]] = False


def small_batches(spark) -> None:
    """Keep Arrow batches small enough for very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(31))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(29))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) for slices of a text column of about `limit` bytes. NULL is empty text."""
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset:column.offset + n + 1].astype(np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def split_words(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray = IN_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each row's first word (one more entry than rows)."""
    mask = inside[data]
    if not len(mask):
        empty = np.empty(0, np.int64)
        return empty, empty, np.zeros(len(bounds), np.int64)
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    cuts = bounds[(bounds > 0) & (bounds < len(mask))]
    first[cuts] = mask[cuts]
    last[cuts - 1] = mask[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.empty(0, np.uint64)
    length = ends - starts
    begin = np.cumsum(length) - length
    at = np.arange(int(length.sum())) - np.repeat(begin, length)
    codes = BYTE_CODES[data[at + np.repeat(starts, length)]]
    weights = mix(np.arange(1, int(length.max()) + 1, dtype=np.uint64)) | _U(1)
    return mix(np.add.reduceat(codes * weights[at], begin) + length.astype(np.uint64) * _U(_BASE))


_powers = {"n": 0}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if size > 1 << 23:
            return up, down  # not kept: one very long text
        _powers.update(n=size, up=up, down=down)
    return _powers["up"], _powers["down"]


class Rolling:
    """Hashes of any slice of a sequence of 64-bit codes, from prefix sums."""

    def __init__(self, codes: np.ndarray):
        up, self.down = _power_tables(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * up[:len(codes)], out=self.sums[1:])

    def grams(self, size: int) -> np.ndarray:
        """Hash of each slice of `size` codes."""
        n = max(0, len(self.sums) - size)
        return mix((self.sums[size:size + n] - self.sums[:n]) * self.down[:n])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = (end - start).astype(np.uint64)
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + length * _U(0xD6E8FEB86659FD93))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours; shorter by width - 1."""
    reach = 1
    while reach * 2 <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    return np.minimum(values[:len(values) - (width - reach)], values[width - reach:]) if width > reach else values


def owned_windows(rolling: Rolling, bounds: np.ndarray, window: int, gram: int):
    """Cut the windows of each row into runs that share their least gram.

    Equal windows have equal least grams, wherever they stand. `bounds` are the
    rows' offsets in codes. Gives, per run: row, first window, number of
    windows, hash of the least gram, hash of the run's whole stretch of codes.
    """
    sizes = np.diff(bounds) - window + 1
    rows = np.flatnonzero(sizes > 0)
    none = np.empty(0, np.int64)
    if not len(rows):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    grams = rolling.grams(gram)
    bits = _U(int(len(grams)).bit_length())
    ordered = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    least = sliding_min(ordered, window - gram + 1) & ((_U(1) << bits) - _U(1))
    sizes = sizes[rows]
    begin = np.cumsum(sizes) - sizes
    at = np.arange(int(sizes.sum())) + np.repeat(bounds[:-1][rows] - begin, sizes)
    owner = least[at].astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    start = at[first]
    return (np.repeat(rows, sizes)[first], start - bounds[:-1][np.repeat(rows, sizes)[first]], count, grams[owner[first]],
            rolling.slices(start, start + count + window - 1))


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask of the positions 0..n-1 inside any [start, end)."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:n]) > 0


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
