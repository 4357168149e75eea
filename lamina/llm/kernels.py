"""Vectorised byte kernels shared by the text operators.

Everything here works on an Arrow string column as one flat UTF-8 buffer with
row offsets, so a batch of documents costs a few numpy passes and no
per-document Python objects. Slices are cut by bytes, which bounds memory no
matter how rows are sized; a single row larger than the slice is its own slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 20
#: ASCII white space: space and \t \n \v \f \r.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def splitmix(x: np.ndarray) -> np.ndarray:
    """Avalanche 64-bit values (the SplitMix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values for a seed."""
    with np.errstate(over="ignore"):
        base = np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)
        return splitmix(base + U64(seed) * U64(0xD1342543DE82EF95))


BYTE_CODE = stream(11, 256) | U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []
WORD_COEFF = stream(23, 16) | U64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + 65536)
        up, down = np.empty(size, U64), np.empty(size, U64)
        for out, base in ((up, _BASE), (down, _BASE_INV)):
            out[0], filled, step = 1, 1, base
            while filled < size:
                take = min(filled, size - filled)
                np.multiply(out[:take], U64(step), out=out[filled : filled + take])
                filled, step = filled + take, step * step % (1 << 64)
        _POWERS[:] = [up, down]
    return _POWERS[0], _POWERS[1]


def string_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; nulls read as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    lo, hi = int(offsets[0]), int(offsets[-1])
    flat = np.frombuffer(data, np.uint8, hi - lo, lo) if data is not None and hi > lo else np.zeros(0, np.uint8)
    return flat, offsets - lo


def slices(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of at most ``limit`` bytes (one row at least)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def ascii_lower(data: np.ndarray) -> np.ndarray:
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, row and words per row of the maximal runs of non-separators; runs never cross rows."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(len(offsets) - 1, np.int64)
    word = np.zeros(n + 1, dtype=bool)
    np.logical_not(separators[data], out=word[:n])
    first = np.zeros(n + 1, dtype=bool)
    first[offsets[:-1]] = True
    first[n] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | first[1:]
    starts = np.flatnonzero(begins[:n])
    ends_at = np.zeros(n + 1, dtype=bool)
    ends_at[1:] = word[:-1] & (~word[1:] | first[1:])
    ends = np.flatnonzero(ends_at)
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows, np.bincount(rows, minlength=len(offsets) - 1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit content hash of each byte span, independent of its position."""
    with np.errstate(over="ignore"):
        up, down = _powers(len(data) + 1)
        total = np.zeros(len(data) + 1, U64)
        np.cumsum(BYTE_CODE[data] * up[: len(data)], out=total[1:])
        return splitmix((total[ends] - total[starts]) * down[starts])


def shingle_hashes(words: np.ndarray, rows: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``k`` consecutive word hashes of one row, and their rows.

    A row of fewer words gives one hash of its whole sequence, a row without words none.
    """
    with np.errstate(over="ignore"):
        first = np.concatenate(([0], np.cumsum(counts)))[:-1]
        full = np.zeros(0, U64)
        full_rows = np.zeros(0, np.int64)
        if len(words) >= k:
            same = rows[: len(words) - k + 1] == rows[k - 1 :]
            at = np.flatnonzero(same)
            full = words[at] * WORD_COEFF[0]
            for j in range(1, k):
                full += words[at + j] * WORD_COEFF[j]
            full_rows = rows[at]
        parts, part_rows = [full], [full_rows]
        for m in range(1, k):
            short = np.flatnonzero(counts == m)
            if len(short):
                value = np.full(len(short), m, U64) * WORD_COEFF[15]
                for j in range(m):
                    value += words[first[short] + j] * WORD_COEFF[j]
                parts.append(value)
                part_rows.append(short)
        if len(parts) == 1:
            return splitmix(full), full_rows
        values, owners = np.concatenate(parts), np.concatenate(part_rows)
        order = np.argsort(owners, kind="stable")
        return splitmix(values[order]), owners[order]


def row_ranges(rows: np.ndarray, n: int) -> np.ndarray:
    """Offsets into a row-sorted array for rows 0..n."""
    return np.searchsorted(rows, np.arange(n + 1))


def distinct_sorted(values: np.ndarray, ranges: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct values of each row."""
    out = []
    for a, b in zip(ranges[:-1], ranges[1:]):
        part = np.sort(values[a:b])
        if len(part) > 1:
            keep = np.empty(len(part), bool)
            keep[0] = True
            np.not_equal(part[1:], part[:-1], out=keep[1:])
            part = part[keep]
        out.append(part)
    return out


def segment_sum(values: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    """Sums over consecutive ranges, 0 for empty ones."""
    total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))
    return total[ranges[1:]] - total[ranges[:-1]]


