"""Vectorised text kernels that run inside Spark tasks.

The operators of this folder read whole texts.  These helpers see a slice of an
Arrow string column as one byte array, so that words, word hashes and word
shingles of thousands of documents come from a few numpy passes.  Words are
maximal runs of bytes other than space and \\x09-\\x0D, which is the same on
UTF-8 bytes and on code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK_BYTES = 1 << 20

_MUL = U(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: equal inputs only give equal outputs."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U) * _MUL)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        steps = np.full(1 << max(12, (n - 1).bit_length()), base, U)
        steps[0] = 1
        got = _powers[base] = np.cumprod(steps, dtype=U)
    return got[:n]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, bounds) for runs of rows of about ``most`` bytes.

    Row ``first + i`` holds ``bytes[bounds[i]:bounds[i + 1]]``; nulls are empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(at, at[first] + most, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def words(raw: np.ndarray, bounds: np.ndarray, also: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row of each word); a word never crosses a row bound.

    ``also``: further byte offsets that end a word, as line ends would.
    """
    n = len(raw)
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = (raw != 0x20) & (raw - np.uint8(0x09) > 4)
    edge = np.diff(inside)
    edge_start, edge_end = edge == 1, edge == -1
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
    edge_start[cuts] = True
    edge_end[cuts] = True
    starts, ends = np.flatnonzero(edge_start), np.flatnonzero(edge_end)
    return starts, ends, np.repeat(np.arange(len(bounds) - 1), np.diff(np.searchsorted(starts, bounds)))


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes as they are."""
    return raw + (raw - np.uint8(65) < 26).view(np.uint8) * np.uint8(32)


def span_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from prefix sums of a polynomial."""
    return symbol_span_hash(_BYTE[raw], starts, ends)


def symbol_span_hash(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """As ``span_hash``, of symbols that stand as random 64-bit values."""
    n = len(symbols)
    sums = np.zeros(n + 1, U)
    np.cumsum(symbols * _power(_BASE, n), out=sums[1:])
    value = (sums[ends] - sums[starts]) * _power(_INVERSE, n + 1)[starts]
    return mix(value + (ends - starts).astype(U) * _MUL)


#: Longer words are hashed by ``span_hash``.
_WORD_BYTES = 64
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], U)


def word_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each short byte span, eight bytes at a time, which costs less than ``span_hash`` and has other values."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))
    size = ends - starts
    value = mix((eights[starts] & _MASK[np.minimum(size, 8)]) + size.astype(U) * _MUL)
    more, at = np.flatnonzero((size > 8) & (size <= _WORD_BYTES)), 8
    while len(more):
        left = size[more] - at
        value[more] = mix(value[more] * _MUL + (eights[starts[more] + at] & _MASK[np.minimum(left, 8)]))
        more, at = more[left > 8], at + 8
    long = np.flatnonzero(size > _WORD_BYTES)
    if len(long):
        value[long] = span_hash(raw, starts[long], ends[long])
    return value


def windows(hashes: np.ndarray, rows: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each window of ``k`` consecutive words of one row.

    A row with fewer words, but at least one, has one window: all its words.
    """
    count = np.bincount(rows, minlength=n_rows)
    n = len(hashes)
    out, whose = np.zeros(0, U), np.zeros(0, np.int64)
    if n >= k:
        full = rows[: n - k + 1] == rows[k - 1 :]
        value = np.zeros(n - k + 1, U)
        for i in range(k):
            value = value * _MUL + hashes[i : n - k + 1 + i]
        out, whose = mix(value[full]), rows[: n - k + 1][full]
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        first = np.searchsorted(rows, few)
        value = np.zeros(len(few), U)
        for i in range(k - 1):
            live = count[few] > i
            at = np.minimum(first + i, n - 1)
            value = np.where(live, value * _MUL + hashes[at], value)
        short = mix(value ^ mix(count[few].astype(U)))
        out, whose = np.concatenate([out, short]), np.concatenate([whose, few])
        order = np.argsort(whose, kind="stable")
        out, whose = out[order], whose[order]
    return out, whose


def shingles(column: pa.Array, k: int = 5) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, values, bounds) of each run of rows: the sorted distinct ``k``-word shingle hashes of each text, A-Z lowered."""
    for first, raw, bounds in chunks(column):
        n_rows = len(bounds) - 1
        low = lowered(raw)
        starts, ends, rows = words(low, bounds)
        value, whose = windows(span_hash(low, starts, ends), rows, n_rows, k)
        yield first, *distinct_by_row(value, whose, n_rows)


def distinct_by_row(value: np.ndarray, whose: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, bounds): each row's distinct values in ascending order; ``whose`` ascends."""
    at = np.searchsorted(whose, np.arange(n_rows + 1))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a > 1:
            value[a:b].sort()
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (whose[1:] != whose[:-1])
    kept = np.concatenate([[0], np.cumsum(fresh)])
    return value[fresh], kept[at]


def row_sums(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum, modulo 2**64, of each row's values."""
    sums = np.zeros(len(value) + 1, U)
    np.cumsum(value, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def set_ids(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One signed 64-bit id for each row's set of values; equal sets get equal ids."""
    return mix(row_sums(mix(value), bounds) + np.diff(bounds).astype(U) * _MUL).view(np.int64)
