"""Spans of at least a given length that stand letter by letter in another record.

A sparse suffix tree, partitioned by prefix. Of all suffixes those are kept
that begin where a window of ``length`` letters has its least k-letter hash:
the choice depends on the window alone, so equal windows keep the suffix at
the same place, and one suffix stands for up to length - k + 1 windows. A kept
suffix goes, with the letters around it, to the group of its k-letter prefix.
There the suffixes are sorted, their common prefixes give the tree's internal
nodes, and nodes that are deep enough together with the letters before them
give the repeated windows.

The suffixes of every prefix are counted over all records, combined before
the shuffle. A prefix held by more than ``heavy`` suffixes is lengthened: its
suffixes are partitioned by whole windows of ``length`` letters instead, whose
holders are counted before the shuffle as well. So no group is larger than
``heavy`` suffixes. Both ways are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions.letters import U, letters, row_blocks, window_hashes, window_index
from seqloom.operators.periods import merge_intervals

_OTHER = U(0xC2B2AE3D27D4EB4F | 1)


def _sliding(v: np.ndarray, w: int, op) -> np.ndarray:
    """op over every w neighbouring values, by doubling."""
    width = 1
    while width * 2 <= w:
        v = op(v[:-width], v[width:])
        width *= 2
    rest = w - width
    return op(v[: len(v) - rest], v[rest:]) if rest else v


def anchors(codes: np.ndarray, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the kept suffixes of concatenated texts."""
    if len(codes) < length:
        return np.zeros(0, np.int64), np.zeros(0, U)
    w = length - k + 1
    h = np.maximum(window_hashes(codes, k), U(1))
    least = _sliding(h, w, np.minimum)
    inside = np.zeros(len(least), bool)
    _, at = window_index(offsets, length)
    inside[at] = True
    least = np.where(inside, least, U(0))
    reach = _sliding(np.pad(least, (w - 1, w - 1)), w, np.maximum)
    at = np.flatnonzero(reach[: len(h)] == h)
    return at, h[at]


def _blocks(codes: np.ndarray, offsets: np.ndarray, length: int, limit: int = 1_000_000) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, codes, offsets, base): blocks of rows; a text longer than
    the limit comes in slices that overlap so that no window is lost."""
    for lo, hi in row_blocks(offsets, limit):
        own = offsets[lo : hi + 1] - offsets[lo]
        c = codes[offsets[lo] : offsets[hi]]
        if len(c) <= limit:
            yield lo, c, own, 0
        else:
            for a in range(0, max(1, len(c) - length + 1), limit):
                part = c[a : a + limit + length - 1]
                yield lo, part, np.array([0, len(part)]), a


def _pack(ctx: np.ndarray) -> list[bytes]:
    """Letters around a suffix as bytes: two bits a letter where all are of
    A, C, G, T or beyond the text's ends, else as they are.

    A packed row begins with the first and last place that hold letters.
    """
    code = np.full(1 << 8, 255, np.uint8)
    code[list(b"ACGT")] = range(4)
    plain = ctx.astype(np.int64)
    small = np.where(plain < 256, code[plain & 255], 255)
    small = np.where(plain == 0, 0, small)
    pure = (small < 4).all(axis=1)
    width = ctx.shape[1]
    first = (plain != 0).argmax(axis=1).astype(np.uint8)
    last = (width - 1 - (plain != 0)[:, ::-1].argmax(axis=1)).astype(np.uint8)
    s = np.pad(small, ((0, 0), (0, -width % 4))).reshape(len(ctx), -1, 4)
    packed = np.concatenate([first[:, None], last[:, None], (s[:, :, 0] | s[:, :, 1] << 2 | s[:, :, 2] << 4 | s[:, :, 3] << 6).astype(np.uint8)], axis=1)
    raw = np.ascontiguousarray(ctx.astype("<u4"))
    return [packed[i].tobytes() if pure[i] else raw[i].tobytes() for i in range(len(ctx))]


def _unpack(rows: list[bytes], width: int) -> np.ndarray:
    size = 2 + (width + 3) // 4
    out = np.zeros((len(rows), width), np.uint32)
    pure = np.array([len(r) == size for r in rows], bool)
    if pure.any():
        p = np.frombuffer(b"".join(r for r in rows if len(r) == size), np.uint8).reshape(-1, size)
        body = np.stack([p[:, 2:] >> s & 3 for s in (0, 2, 4, 6)], axis=2).reshape(len(p), -1)[:, :width]
        x = np.frombuffer(b"ACGT", np.uint8)[body].astype(np.uint32)
        place = np.arange(width)
        x[(place < p[:, :1]) | (place > p[:, 1:2])] = 0
        out[pure] = x
    if not pure.all():
        out[~pure] = np.frombuffer(b"".join(r for r in rows if len(r) != size), "<u4").reshape(-1, width)
    return out


def repeated_windows(group: np.ndarray, ids: np.ndarray, ctx: np.ndarray, length: int, k: int) -> np.ndarray:
    """(suffixes, w) marks: window o letters before suffix i stands in another
    record. ctx: letters from length - k before to length after the suffix's
    begin, 0 beyond the text."""
    w = length - k + 1
    left, right = ctx[:, : w - 1], ctx[:, w - 1 :]
    # the group's suffixes in order; common prefixes of neighbours are the tree's internal nodes
    order = np.lexsort(tuple(right[:, c] for c in range(right.shape[1] - 1, -1, -1)) + (group,))
    group, ids, left, right = group[order], ids[order], left[order], right[order]
    same = right[1:] == right[:-1]
    lcp = np.where(same.all(axis=1), right.shape[1], same.argmin(axis=1))
    lcp[group[1:] != group[:-1]] = -1
    ends = np.where((right != 0).all(axis=1), right.shape[1], (right != 0).argmin(axis=1))
    marks = np.zeros((len(ids), w), bool)
    before = np.zeros(len(ids), U)
    whole = np.ones(len(ids), bool)
    for o in range(w):
        if o:
            letter = left[:, w - 1 - o]
            whole &= letter != 0
            before = (before + U(1)) * _OTHER ^ letter.astype(U)
        depth = length - o
        node = np.concatenate([[0], np.cumsum(lcp < depth)])
        live = np.flatnonzero(whole & (ends >= depth))
        if len(live) < 2:
            continue
        n, b = node[live], before[live]
        by = np.lexsort((ids[live], b, n))
        n, b, i = n[by], b[by], ids[live][by]
        cut = np.flatnonzero(np.concatenate([[True], (n[1:] != n[:-1]) | (b[1:] != b[:-1])]))
        size = np.diff(np.append(cut, len(n)))
        shared = i[cut] != i[cut + size - 1]
        marks[live[by[np.repeat(shared, size)]], o] = True
    out = np.empty_like(marks)
    out[order] = marks
    return out


def _stretches(ids: np.ndarray, pos: np.ndarray, marks: np.ndarray, length: int) -> pd.DataFrame:
    """Marks as covered positions (1-based, inclusive), a row a run of windows."""
    padded = np.pad(marks.astype(np.int8), ((0, 0), (1, 1)))
    step = np.diff(padded, axis=1)
    i, first = np.nonzero(step == 1)
    _, after = np.nonzero(step == -1)
    return pd.DataFrame({"id": ids[i], "a": pos[i] - (after - 1) + 1, "z": pos[i] - first + length})


_MAP_BITS = 24


def _bit_map(hot: DataFrame) -> np.ndarray:
    """The prefixes of ``hot`` as a map of 2**24 bits, so at most 2**18 words
    come to the driver. A prefix that shares a bit with one of them goes the
    same way, which is exact too."""
    bit = F.pmod("h", F.lit(1 << _MAP_BITS))
    words = hot.select(F.floor(bit / 64).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int")).alias("mask")).groupBy("w").agg(F.bit_or("mask").alias("mask"))
    out = np.zeros(1 << (_MAP_BITS - 6), np.int64)
    for r in words.collect():
        out[r.w] = r["mask"]
    return out


def _held(hot: np.ndarray, h: np.ndarray) -> np.ndarray:
    bit = h & ((1 << _MAP_BITS) - 1)
    return (hot[bit >> 6].view(np.uint64) >> (bit & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def shared_spans(df: DataFrame, id: str, text: str, length: int = 50, k: int = 16, heavy: int = 50_000) -> DataFrame:
    """Maximal stretches of every record that consist of positions in some
    window of ``length`` letters also standing in the text of another record.

    Result: read_id, span_start, span_stop (1-based, inclusive, in letters).
    Letters are compared as stored. heavy: a prefix of more suffixes is
    lengthened to whole windows. Null texts and texts shorter than ``length`` have no spans; texts
    of any length are taken whole. Repeated rows under other ids are other
    records. Ids are unique; rows of the same id count as one record. Extra
    columns are not read. An empty table gives an empty result.
    """
    w = length - k + 1
    rows = df.select(df[id].cast("long").alias("id"), df[text].alias("t")).filter(F.length("t") >= length)
    def each(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            codes, offsets, _ = letters(batch.column(1))
            for lo, c, own, base in _blocks(codes, offsets, length):
                at, h = anchors(c, own, length, k)
                row = np.searchsorted(own, at, "right") - 1
                yield ids[lo + row], at - own[row] + base, at, row, h.astype(np.int64), c, own

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for _, _, _, _, h, _, _ in each(batches):
            held.append(h)
            n += len(h)
            if n > 4_000_000:
                yield counted(held)
                held, n = [], 0
        if held:
            yield counted(held)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int64))], names=["h", "n"])

    hot = _bit_map(rows.mapInArrow(tally, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") > heavy))
    any_hot = bool(hot.any())

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, pos, at, row, h, c, own in each(batches):
            if any_hot:
                keep = ~_held(hot, h)
                ids, pos, at, row, h = ids[keep], pos[keep], at[keep], row[keep], h[keep]
            padded = np.pad(c, (w - 1, length))
            for lo in range(0, len(at), 50_000):
                s = slice(lo, lo + 50_000)
                place = at[s, None] + np.arange(-(w - 1), length)
                ctx = padded[place + w - 1]
                inside = (place >= own[row[s]][:, None]) & (place < own[row[s] + 1][:, None])
                ctx = np.where(inside, ctx, 0)
                yield pa.RecordBatch.from_arrays([pa.array(h[s]), pa.array(ids[s]), pa.array(pos[s]), pa.array(_pack(ctx), pa.binary())], names=["h", "id", "pos", "ctx"])

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
            h, ids = t.column("h").to_numpy(), t.column("id").to_numpy()
            if not len(h):
                return
            cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            size = np.diff(np.append(cut, len(h)))
            several = np.minimum.reduceat(ids, cut) != np.maximum.reduceat(ids, cut)
            at = np.flatnonzero(np.repeat(several, size))
            if not len(at):
                return
            ctx = _unpack(t.column("ctx").take(pa.array(at)).to_pylist(), w - 1 + length)
            marks = repeated_windows(h[at], ids[at], ctx, length, k)
            yield pa.RecordBatch.from_pandas(_stretches(ids[at], t.column("pos").to_numpy()[at], marks, length), preserve_index=False)

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows < 20_000:
                continue
            h = held.column("h").to_numpy()
            whole = int(np.searchsorted(h, h[-1]))
            yield from solve(held.slice(0, whole))
            held = held.slice(whole)
        if held is not None:
            yield from solve(held)

    found = rows.mapInArrow(suffixes, "h long, id long, pos long, ctx binary").repartition("h").sortWithinPartitions("h").mapInArrow(trees, "id long, a long, z long")
    if any_hot:
        found = found.unionByName(_heavy_windows(rows, each, hot, length, w))
    out = merge_intervals(found, ["id"], "a", "z").filter("seg_kind = 'period'")
    return out.select(F.col("id").alias("read_id"), F.col("seg_start").alias("span_start"), F.col("seg_stop").alias("span_stop"))


def _heavy_windows(rows: DataFrame, each, hot: np.ndarray, length: int, w: int) -> DataFrame:
    """Shared windows around the suffixes of hot prefixes, by whole windows."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, at, row, h, c, own in each(batches):
            mine = _held(hot, h)
            if not mine.any():
                continue
            start = (at[mine, None] - np.arange(w)).reshape(-1)
            r = np.repeat(row[mine], w)
            ok = (start >= own[r]) & (start + length <= own[r + 1])
            start, first = np.unique(start[ok], return_index=True)
            r, i = r[ok][first], np.repeat(ids[mine], w)[ok][first]
            base = np.repeat(_[mine] - (at[mine] - own[row[mine]]), w)[ok][first]
            h1, h2 = window_hashes(c, length), window_hashes(c, length, _OTHER)
            yield pa.RecordBatch.from_arrays([pa.array(h1[start].astype(np.int64)), pa.array(h2[start].astype(np.int64)), pa.array(i), pa.array(start - own[r] + base)], names=["h1", "h2", "id", "s"])

    long = rows.mapInArrow(windows, "h1 long, h2 long, id long, s long")
    shared = long.groupBy("h1", "h2").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo <> hi").select("h1", "h2")
    # the holders of one window may be very many: its hash is spread over salts
    salts = 32
    salted = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return long.withColumn("salt", F.pmod("id", F.lit(salts)).cast("int")).join(salted, ["h1", "h2", "salt"]).select("id", (F.col("s") + 1).alias("a"), (F.col("s") + length).alias("z"))
