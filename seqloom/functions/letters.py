"""Arrow text columns as arrays of letter codes, and hashes of their windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)


def letters(col: pa.Array, upper: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, offsets, null mask) of a string column; codes are bytes where
    all is ASCII, else code points, so a position is always a letter. Nulls
    have no letters. upper: case is folded."""
    null = col.is_null().to_numpy(zero_copy_only=False)
    col = pc.fill_null(col.cast(pa.large_string()), "")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    codes = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    if len(codes) and codes.max() > 127:
        if upper:
            col = pc.utf8_upper(col)
        sizes = pc.utf8_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
        codes = np.frombuffer("".join(col.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        return codes, np.concatenate([[0], np.cumsum(sizes)]), null
    if upper and len(codes):
        codes = np.where((codes >= 97) & (codes <= 122), codes - 32, codes)
    return codes, offsets - offsets[0], null


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def window_hashes(codes: np.ndarray, k: int, base: np.uint64 = _BASE) -> np.ndarray:
    """A 64-bit hash of every window of k letters, by doubling."""
    if len(codes) < k:
        return np.zeros(0, U)
    power, width = codes.astype(U) + U(1), 1
    out, have = None, 0
    factor = base  # base ** width
    rest = k
    while rest:
        if rest & 1:
            if out is None:
                out, have = power, width
            else:  # out covers `have` letters, the block to its right `width`
                n = len(codes) - have - width + 1
                out = out[:n] * factor + power[have : have + n]
                have += width
        rest >>= 1
        if rest:
            n = len(power) - width
            power = power[:n] * factor + power[width : width + n]
            factor = U(int(factor) * int(factor) & 0xFFFFFFFFFFFFFFFF)
            width *= 2
    return mix(out[: len(codes) - k + 1])


def window_codes(digits: np.ndarray, k: int) -> np.ndarray:
    """Exact two-bit codes of every window of k <= 31 digits 0 to 3, by doubling."""
    out, have, power, width, rest = None, 0, digits.astype(np.int64), 1, k
    while rest:
        if rest & 1:
            if out is None:
                out, have = power, width
            else:
                n = len(digits) - have - width + 1
                out = (out[:n] << 2 * width) | power[have : have + n]
                have += width
        rest >>= 1
        if rest:
            n = len(power) - width
            power = (power[:n] << 2 * width) | power[width : width + n]
            width *= 2
    return out[: max(0, len(digits) - k + 1)]


def row_blocks(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` letters together, one row at least."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def window_index(offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every window of k letters that lies in one row: its row and start."""
    n = np.maximum(np.diff(offsets) - k + 1, 0)
    rows = np.repeat(np.arange(len(n)), n)
    firsts = np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else np.zeros(0, np.int64)
    return rows, np.arange(len(rows)) + np.repeat(offsets[:-1] - firsts, n)
