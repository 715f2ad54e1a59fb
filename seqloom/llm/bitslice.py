"""Bit-sliced comparison of many signatures at once.

Signatures are stored vertically: plane s holds bit s of all records, 64
records a word. Shifting a plane by d records lines every record up with its
d-th neighbour, so one exclusive-or compares a whole word of pairs, and the
distances of all pairs grow together in vertical carry-save counters. Words
(blocks of 64 pairs) whose pairs have all passed the radius are abandoned.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_STEP = 32  # planes between two looks at the counters


def planes(signatures: np.ndarray) -> np.ndarray:
    """(bits, words) planes of (records, bytes) signatures."""
    n, width = signatures.shape
    bits = np.unpackbits(signatures, axis=1, bitorder="little").T
    pad = -n % 64 + 64  # one spare word, so that shifts may read past the end
    packed = np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view(U)


def _shifted(p: np.ndarray, d: int) -> np.ndarray:
    """Planes moved d records towards the front."""
    words, bits = divmod(d, 64)
    n = p.shape[-1]
    out = np.zeros_like(p)
    if words < n:
        out[..., : n - words] = p[..., words:] >> U(bits)
        if bits and words + 1 < n:
            out[..., : n - words - 1] |= p[..., words + 1 :] << U(64 - bits)
    return out


def within_radius(p: np.ndarray, d: int, valid: np.ndarray, radius: int) -> np.ndarray:
    """First records i of the pairs (i, i + d), of those ``valid``, whose
    signatures differ in at most ``radius`` bits."""
    size = p.shape[1] * 64
    alive = np.packbits(np.pad(valid, (0, size - len(valid))), bitorder="little").view(U)
    words = np.flatnonzero(alive)
    if not len(words):
        return np.zeros(0, np.int64)
    alive = alive[words]
    step, shift = divmod(d, 64)
    right = np.minimum(words + step, p.shape[1] - 1)
    right2 = np.minimum(words + step + 1, p.shape[1] - 1)
    counters: list[np.ndarray] = []
    total = p.shape[0]
    for s in range(0, total, _STEP):
        for i in range(s, min(s + _STEP, total), 2):
            a = _differing(p[i], words, right, right2, shift)
            b = _differing(p[i + 1], words, right, right2, shift) if i + 1 < total else np.zeros_like(a)
            # carry-save: the two planes and the lowest counter give a sum and a carry
            if not counters:
                counters.append(np.zeros_like(a))
            half = a ^ b
            carry = (a & b) | (half & counters[0])
            counters[0] = counters[0] ^ half
            level = 1
            while carry.any():
                if level == len(counters):
                    counters.append(np.zeros_like(carry))
                counters[level], carry = counters[level] ^ carry, counters[level] & carry
                level += 1
        if s + _STEP > radius:
            alive = alive & ~_above(counters, radius)
            live = np.flatnonzero(alive)
            if len(live) < len(words):
                if not len(live):
                    return np.zeros(0, np.int64)
                words, right, right2, alive = words[live], right[live], right2[live], alive[live]
                counters = [c[live] for c in counters]
    hit = np.unpackbits(alive.view(np.uint8), bitorder="little").reshape(len(words), 64)
    w, bit = np.nonzero(hit)
    return words[w] * 64 + bit


def _differing(plane: np.ndarray, words: np.ndarray, right: np.ndarray, right2: np.ndarray, shift: int) -> np.ndarray:
    moved = plane[right] >> U(shift)
    if shift:
        moved = moved | (plane[right2] << U(64 - shift))
    return plane[words] ^ moved


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Bits of the pairs whose vertical count is greater than ``radius``."""
    more = np.zeros_like(counters[0])
    equal = ~np.zeros_like(counters[0])
    for level in range(max(len(counters), radius.bit_length()) - 1, -1, -1):
        c = counters[level] if level < len(counters) else np.zeros_like(more)
        if radius >> level & 1:
            equal = equal & c
        else:
            more = more | (equal & c)
            equal = equal & ~c
    return more


def close_pairs(signatures: np.ndarray, bucket: np.ndarray, part: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j) of one bucket that differ in at most ``radius`` bits.

    Records are sorted by bucket. part: records of one bucket with the same
    part >= 0 are not compared with each other; -1 compares with all.
    """
    n = len(bucket)
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, n))
    first, second = [], []
    rest = np.flatnonzero(np.repeat(sizes > 1, sizes))
    if not len(rest):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size_of = np.repeat(sizes, sizes)
    p, d = planes(signatures[rest]), 1
    b, q, reach = bucket[rest], part[rest], size_of[rest]
    while True:
        valid = np.zeros(len(rest), bool)
        valid[: len(rest) - d] = (b[:-d] == b[d:]) & ((q[:-d] != q[d:]) | (q[:-d] < 0))
        i = within_radius(p, d, valid, radius)
        first.append(rest[i])
        second.append(rest[i + d])
        d += 1
        keep = reach > d
        if not keep.any():
            break
        if keep.sum() * 2 < len(rest):  # only records of larger buckets go on
            rest, b, q, reach = rest[keep], b[keep], q[keep], reach[keep]
            p = planes(signatures[rest])
    return np.concatenate(first), np.concatenate(second)
