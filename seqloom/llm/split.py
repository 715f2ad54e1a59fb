"""Cutting oversized items at natural boundaries, by lexical cohesion.

For every place between two units the units just before it and just after it
are compared (two sliding blocks). Where they have little in common cohesion
has a valley, whose depth is one minus the blocks' similarity. Within each
size window the deepest valley is taken, of equally deep ones the last, and
the next piece starts ``overlap`` units before the cut. Where no valley of the
least depth lies in the window, the cut is made at the size limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from seqloom.functions.letters import letters


def valleys(classes: np.ndarray, block: int, n_classes: int, closing: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, depths) of the cohesion valleys of a sequence of class codes.

    The blocks' histograms are compared by cosine. closing: only places that
    directly follow a unit of this class and precede one of another count.
    """
    n = len(classes)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0)
    b = np.arange(1, n)
    if closing is not None:
        b = b[(classes[:-1] == closing) & (classes[1:] != closing)]
    if block == 1:
        depth = (classes[b - 1] != classes[b]).astype(float)
    else:
        dot, left2, right2 = np.zeros(len(b)), np.zeros(len(b)), np.zeros(len(b))
        for c in range(n_classes):
            cum = np.concatenate([[0], np.cumsum(classes == c)])
            left = cum[b] - cum[np.maximum(b - block, 0)]
            right = cum[np.minimum(b + block, n)] - cum[b]
            dot += left * right
            left2 += left * left
            right2 += right * right
        depth = 1 - dot / np.sqrt(np.maximum(left2 * right2, 1))
    keep = depth > 0
    return b[keep], depth[keep]


def term_valleys(terms: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, depths) between the units of a sequence of term numbers: one
    minus the cosine of the term counts of the ``block`` units on either side.

    A pair of equal terms at i < j is in both blocks of the places from j -
    block + 1 to i + block, between i + 1 and j, and in the left (right) block
    of those after j (up to i) that still hold both; so three running sums
    over the pairs of near equal terms give all places at once.
    """
    n = len(terms)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0)
    dot, left, right = np.zeros(n + 2, np.int64), np.zeros(n + 2, np.int64), np.zeros(n + 2, np.int64)

    def add(to: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        ok = lo <= hi
        to += np.bincount(lo[ok], minlength=n + 2) - np.bincount(hi[ok] + 1, minlength=n + 2)

    order = np.argsort(terms, kind="stable")
    own = terms[order]
    at = np.arange(n)
    add(left, at + 1, np.minimum(at + block, n))
    add(right, np.maximum(at - block + 1, 0), at)
    for lag in range(1, n):
        i, j = order[:-lag], order[lag:]
        near = (own[:-lag] == own[lag:]) & (j - i < 2 * block)
        if not near.any():
            break
        i, j = i[near], j[near]
        add(dot, np.maximum(i + 1, j - block + 1), np.minimum(j, i + block))
        close = j - i < block
        i, j = i[close], j[close]
        for _ in range(2):  # (i, j) and (j, i)
            add(left, j + 1, np.minimum(i + block, n))
            add(right, np.maximum(j - block + 1, 0), i)
    dot, left, right = (np.cumsum(x)[1:n] for x in (dot, left, right))
    return np.arange(1, n), 1 - dot / np.sqrt(np.maximum(left * right, 1))


def split_by_topic(df: DataFrame, item: str, text: str, limit: int = 150, overlap: int = 15, block: int = 20, least: int | None = None) -> DataFrame:
    """(item, piece_no, piece_start, piece_stop): pieces of every text of more
    than ``limit`` words, in words counted from 1.

    Terms are words in lower case. Each cut is made at the deepest cohesion
    valley (of equally deep ones the last) that leaves a piece more than
    ``least`` words (half the limit, if None) and at most ``limit``; the next
    piece begins ``overlap`` words before. Null texts and those within the
    limit have no pieces. Texts of any length are taken whole. Repeated rows
    give repeated pieces. An empty table gives an empty result. Other columns
    are not read.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    least = limit // 2 if least is None else least
    kind = df.schema[item].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = pa.compute.utf8_lower(batch.column(1))
            words = pa.compute.split_pattern_regex(pa.compute.utf8_trim_whitespace(low), r"\s+")
            sizes = pa.compute.fill_null(pa.compute.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            terms = words.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            at, no, start, stop = [], [], [], []
            for r in np.flatnonzero(sizes > limit):
                own = pieces(int(sizes[r]), *term_valleys(terms[offsets[r] : offsets[r + 1]], block), limit, overlap, least)
                at += [r] * len(own)
                no += range(1, len(own) + 1)
                start += [a + 1 for a, _ in own]
                stop += [z for _, z in own]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (no, start, stop))], names=[item, "piece_no", "piece_start", "piece_stop"])

    return df.select(df[item].alias("item"), df[text].alias("text")).mapInArrow(cut, f"`{item}` {kind}, piece_no long, piece_start long, piece_stop long")


def pieces(size: int, places: np.ndarray, depths: np.ndarray, limit: int, overlap: int, least: int = 0) -> list[tuple[int, int]]:
    """[start, stop) offsets of the pieces of an item of ``size`` units."""
    out, s = [], 0
    while size - s > limit:
        lo, hi = np.searchsorted(places, [s + max(overlap, least), s + limit], "right")
        if hi > lo:
            own = depths[lo:hi]
            b = int(places[lo + len(own) - 1 - int(np.argmax(own[::-1]))])
        else:
            b = s + limit
        out.append((s, b))
        s = b - overlap
    out.append((s, size))
    return out


def split_oversized(
    df: DataFrame, item: str, text: str, limit: int = 4000, overlap: int = 100, classes: dict[str, str] | None = None, closing: str | None = None, block: int = 1, origin: str | None = None, with_text: bool = False, only_oversized: bool = True, keep: list[str] = ()
) -> DataFrame:
    """Pieces of every item whose text has more than ``limit`` letters.

    Units are letters. ``classes`` maps a class name to the letters in it; all
    others are one class more. ``closing`` names the class at whose end a cut
    may be made (any valley, if None). ``origin`` is the column with the
    position of the first letter (0 if None).

    Result: item, piece_no (from 1), piece_start, piece_stop (inclusive,
    counted from the origin), the piece itself if ``with_text``, and the columns
    to ``keep``. Null
    texts have no pieces; texts within the limit have none either, or one if
    not ``only_oversized`` (an empty text then has none). A null origin gives
    null positions. Repeated rows give repeated pieces. An empty table gives
    an empty result. Columns not named here are not read.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    names = list(classes or {})
    code = {ord(ch): i for i, name in enumerate(names) for ch in classes[name]}
    shut = names.index(closing) if closing is not None else None
    cols = [df[item].alias("item"), df[text].alias("text"), *[df[c].alias(f"keep{i}") for i, c in enumerate(keep)]] + ([df[origin].cast("long").alias("origin")] if origin else [])
    kept = "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    kind = df.schema[item].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, offsets, null = letters(batch.column(1))
            cls = np.full(len(codes), len(names), np.int8)
            for letter, c in code.items():
                cls[codes == letter] = c
            sizes = np.diff(offsets)
            at, no, start, stop = [], [], [], []
            for r in np.flatnonzero((sizes > limit) if only_oversized else (sizes > 0)):
                if sizes[r] > limit:
                    own = pieces(int(sizes[r]), *valleys(cls[offsets[r] : offsets[r + 1]], block, len(names) + 1, shut), limit, overlap)
                else:
                    own = [(0, int(sizes[r]))]
                at += [r] * len(own)
                no += range(1, len(own) + 1)
                start += [a for a, _ in own]
                stop += [z for _, z in own]
            take = pa.array(at, pa.int64())
            base = batch.column(2 + len(keep)).take(take) if origin else pa.array(np.zeros(len(at), np.int64))
            add = lambda x: pa.compute.add(base.cast(pa.int64()), pa.array(x, pa.int64()))
            out = [batch.column(0).take(take), pa.array(no, pa.int64()), add(start), add([z - 1 for z in stop])]
            if with_text:
                texts = batch.column(1)
                out.append(pa.array([texts[r].as_py()[a:z] for r, a, z in zip(at, start, stop)], pa.string()))
            out += [batch.column(2 + i).take(take) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(out, names=[item, "piece_no", "piece_start", "piece_stop", *["piece"] * with_text, *keep])

    return df.select(*cols).mapInArrow(cut, f"`{item}` {kind}, piece_no long, piece_start long, piece_stop long" + ", piece string" * with_text + kept)
