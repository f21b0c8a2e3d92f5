"""Vectorised helpers for Arrow batches of texts: bytes, word bounds, rolling 64-bit hashes, sliding minima.

All hashes are sums of mixed values times powers of an odd number, modulo 2^64, so that the hash of any span follows
from two prefix sums; they depend on the span's content alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd multipliers of the rolling hashes and their inverses modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)
#: Texts are handled in pieces of about so many bytes, to bound a task's memory.
PIECE_BYTES = 2 << 20
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64, kept for later calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        full = np.full(max(n, 1 << 16), np.uint64(base))
        full[0] = 1
        _powers[base] = have = np.cumprod(full, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], name: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of column ``name``, one row at least."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(name))
        ends = np.cumsum(pc.binary_length(column.cast(pa.large_binary())).fill_null(0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, last byte + 1) of every word, and the offsets of each text's words."""
    inside = np.empty(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(_IS_BLANK[data], out=inside[1:-1])
    begin = inside[1:-1] & ~inside[:-2]
    end = inside[1:-1] & ~inside[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begin[edges] |= inside[1:-1][edges]
    end[edges - 1] |= inside[1:-1][edges - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of ``values[start:end]`` for each span. ``values``: integers, such as bytes or other hashes."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(BASES[which], n), out=sums[1:])
    out = sums[ends] - sums[starts]
    out *= powers(_INVERSES[which], n + 1)[starts]
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(BASES[1 - which]))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each short span, eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), "<u8", padded.tobytes(), strides=(1,))
    length = ends - starts
    out = mix(length.astype(np.uint64) + np.uint64(BASES[0]))
    todo, at = np.arange(len(starts)), 0
    while len(todo):
        left = length[todo] - at
        chunk = eights[starts[todo] + at]
        short = left < 8
        drop = (np.uint64(8) * (np.uint64(8) - left[short].astype(np.uint64))) & np.uint64(63)
        chunk[short] = (chunk[short] << drop) >> drop
        out[todo] = mix((out[todo] ^ chunk) * np.uint64(BASES[0]))
        todo, at = todo[left > 8], at + 8
    return out


def window_hashes(values: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Hash of every ``width`` consecutive values; empty if there are fewer."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(BASES[which], len(values)), out=sums[1:])
    out = sums[width:] - sums[:n]
    out *= powers(_INVERSES[which], n)
    return mix(out)


def sliding(least: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """``np.minimum`` or ``np.maximum`` of every ``width`` consecutive values, by doubling."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    have = 1
    while have * 2 <= width:
        x = least(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return least(x[: len(x) - rest], x[rest:])[:n] if rest else x[:n]


def inside_one(offsets: np.ndarray, width: int) -> np.ndarray:
    """Mask over window starts: which windows of ``width`` lie in one text."""
    n = int(offsets[-1]) - width + 1
    if n <= 0:
        return np.zeros(0, bool)
    edges = np.unique(offsets[1:-1])
    change = np.zeros(n + 1, np.int64)
    lo, hi = np.clip(edges - width + 1, 0, n), np.clip(edges, 0, n)
    np.add.at(change, lo, 1)
    np.add.at(change, hi, -1)
    return np.cumsum(change[:-1]) == 0


def runs(x: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, number) of the maximal runs of equal values of ``x`` where ``ok``."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (ok[1:] != ok[:-1])
    first = np.flatnonzero(new)
    number = np.diff(np.append(first, len(x)))
    good = ok[first]
    return first[good], number[good]


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each span, one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(np.asarray(starts, np.int64) - (np.cumsum(counts) - counts), counts)
    return shift + np.arange(total)


def covered(starts: np.ndarray, width: int | np.ndarray, total: int) -> np.ndarray:
    """Mask of the places that some span ``[start, start + width)`` covers."""
    change = np.zeros(total + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + width, -1)
    return np.cumsum(change[:-1]) > 0


def as_long(x: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark's signed longs."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, most: int) -> Iterator[pa.Table]:
    """Rows sorted by the long column ``key`` in tables of about ``most`` bytes that part no key's rows."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size < most:
            continue
        whole = pa.Table.from_batches(held)
        keys = whole.column(key).to_numpy()
        stop = int(np.searchsorted(keys, keys[-1], "left"))
        if stop:  # the last key may go on in the next batch
            yield whole.slice(0, stop).combine_chunks()
            held = whole.slice(stop).combine_chunks().to_batches()
            size = sum(b.nbytes for b in held)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
