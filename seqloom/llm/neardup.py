"""Near-duplicate records: pairs of texts whose sets of letter windows have a
Jaccard similarity of at least a threshold, and the groups they form.

1. Every text gets minima of its window hashes (256 of them), the bit of each
   minimum as its signature, and keys of pairs of minima.
2. Exact copies are reduced to one representative, combined before the shuffle.
3. Representatives that share a key meet in a bucket. Their signatures are
   compared bit-sliced, words of pairs being abandoned as soon as all of them
   pass the radius; very large buckets are compared in blocks spread over tasks.
4. The pairs left are checked exactly on their texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions.letters import U, letters, mix, row_blocks, window_hashes, window_index
from seqloom.llm.bitslice import close_pairs
from seqloom.session import materialize

M = 256  # minima, and bits of the signature
TOP = U(0xFFFFFFFFFFFFFFFF)
SALTS = 32  # shares of a bucket that is joined with its number of members
_SKETCH = "field string, kind int, h1 long, h2 long, id long, sig binary, keys array<long>"


def _one_permutation(rows: np.ndarray, h: np.ndarray, minima: np.ndarray) -> None:
    """Lowers the M minima of each row: a window counts in the bin its top bits name."""
    np.minimum.at(minima.reshape(-1), rows * M + (h >> U(56)).astype(np.int64), h << U(8))


def _densified(minima: np.ndarray) -> np.ndarray:
    """Empty bins take the minimum of the next full bin, mixed with the way there."""
    full = minima != TOP
    at = np.where(full, np.arange(M), 4 * M)
    at = np.concatenate([at, np.where(full, np.arange(M, 2 * M), 4 * M)], axis=1)
    nxt = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1][:, :M]
    way = (nxt - np.arange(M)).astype(U)
    return np.where(full, minima, mix(np.take_along_axis(minima, nxt % M, axis=1) + way * U(0xD6E8FEB86659FD93)))


def _estimated(minima: np.ndarray) -> np.ndarray:
    """Number of different windows by the means of the minima, within some 6
    percent (one standard deviation) where it is above M."""
    return M / np.maximum((minima.astype(np.float64) / 2.0**64).mean(axis=1), 1e-12)


def _permutations(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """M minima of each row under M independent orders; for short texts."""
    cuts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out = np.empty((len(sizes), M), U)
    for j in range(M):
        odd, shift = U(2 * int(mix(np.array([j + 1], U))[0] >> U(2)) + 1), mix(np.array([j + 1001], U))[0]
        out[:, j] = np.minimum.reduceat((h ^ shift) * odd, cuts)
    return mix(out)


def _sketches(field: str, ids: np.ndarray, col: pa.Array, k: int, fold: bool, bands: int, short: int, low: float) -> Iterator[pa.RecordBatch]:
    codes, offsets, _ = letters(col, upper=fold)
    for lo, hi in row_blocks(offsets, 1_000_000):
        own = offsets[lo : hi + 1] - offsets[lo]
        c = codes[offsets[lo] : offsets[hi]]
        n = np.maximum(np.diff(own) - k + 1, 0)
        sets = np.flatnonzero(n > 0)
        if not len(sets):
            continue
        minima = np.full((hi - lo, M), TOP, U)
        # of texts that may have few different windows: those windows, each once
        few: dict[int, np.ndarray] = {}
        if hi - lo == 1:  # maybe one very long text: windows in slices
            few[0] = np.zeros(0, U)
            for a in range(0, int(n[0]), 1_000_000):
                h = window_hashes(c[a : min(a + 1_000_000, int(n[0])) + k - 1], k)
                _one_permutation(np.zeros(len(h), np.int64), h, minima)
                if len(few[0]) <= short:
                    few[0] = np.unique(np.concatenate([few[0], h]))
        else:
            rows, at = window_index(own, k)
            h = window_hashes(c, k)[at]
            _one_permutation(rows, h, minima)
            ends = np.cumsum(n)
            for r in sets[(n[sets] <= 2 * short) | (_estimated(minima[sets]) <= 2 * short)]:
                few[int(r)] = np.unique(h[ends[r] - n[r] : ends[r]])
        # the kind of a sketch goes by the number of different windows, so that equal sets get the same
        different = np.array([len(few[int(r)]) if int(r) in few else 2 * short for r in sets])
        digest = [hashlib.blake2b(c[own[r] : own[r + 1]].tobytes(), digest_size=16).digest() for r in sets]
        exact = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
        # texts of middling size get both kinds, so that any two of similar size share one
        for kind in (0, 1):
            mine = different <= short if kind == 0 else different > low * short
            if not mine.any():
                continue
            r = sets[mine]
            m = _permutations(np.concatenate([few[int(x)] for x in r]), different[mine]) if kind == 0 else _densified(minima[r])
            sig = np.packbits((m >> U(21) & U(1)).astype(np.uint8), axis=1, bitorder="little")
            step = (M // 2) // bands
            i = np.arange(bands) * step
            salt = mix(np.array([int.from_bytes(hashlib.blake2b(f"{field}/{kind}/{b}".encode(), digest_size=8).digest(), "little") for b in range(bands)], U))
            keys = mix(mix(m[:, i] + salt) ^ m[:, i + M // 2]).astype(np.int64)
            rows_out = len(r)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([field] * rows_out), pa.array(np.full(rows_out, kind, np.int32)), pa.array(exact[mine, 0]), pa.array(exact[mine, 1]), pa.array(ids[lo + r]),
                    pa.array([s.tobytes() for s in sig], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(rows_out + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1))),
                ],
                names=["field", "kind", "h1", "h2", "id", "sig", "keys"],
            )


class NearDuplicates:
    """Near-duplicates among the texts of one or more fields of ``df``.

    id: a unique whole-number column. fields: name of each text column and
    whether its letter case is folded. k: letters of a window. threshold: the
    least Jaccard similarity of the sets of windows. bands: number of keys a
    text (a pair of similarity s shares none with probability
    (1 - s^2)^bands; 20 bands miss about one in 7,500 at 0.6, and one in 10^7 at
    0.75). radius: most bits of 256 in which the signatures of a pair may
    differ; 90 is six standard deviations above the mean at a similarity of 0.6.
    block: a bucket of more members is compared in blocks of so many.

    Null texts and texts of fewer than k letters are in no pair; other texts
    of any length are taken whole. Texts that are the same (after folding)
    are one class and have similarity 1. Extra columns are not read. An empty
    table gives empty results.
    """

    def __init__(self, df: DataFrame, id: str, fields: dict[str, bool], k: int = 12, threshold: float = 0.6, bands: int = 20, radius: int = 90, block: int = 4000, short: int = 500):
        self.texts = df.select(df[id].cast("long").alias("id"), *[df[f].alias(f"t{i}") for i, f in enumerate(fields)])
        self.fields, self.k, self.threshold, self.radius, self.block = fields, k, threshold, radius, block
        names = list(fields.items())
        low = min(0.9 * threshold, threshold)

        def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                for i, (name, fold) in enumerate(names):
                    yield from _sketches(name, ids, batch.column(i + 1), k, fold, bands, short, low)

        self.sketches = materialize(self.texts.mapInArrow(sketch, _SKETCH))
        self._links: DataFrame | None = None

    def members(self) -> DataFrame:
        """(field, h1, h2, id): the class of exact copies of every text."""
        return self.sketches.select("field", "h1", "h2", "id").distinct()

    def classes(self) -> DataFrame:
        """(field, h1, h2, rep, n_copies), one row a class of exact copies."""
        per = self.sketches.groupBy("field", "kind", "h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n_copies"))
        return per.groupBy("field", "h1", "h2").agg(F.min("rep").alias("rep"), F.max("n_copies").alias("n_copies"))

    def links(self) -> DataFrame:
        """(field, a, b, similarity): pairs a < b of representatives of
        different texts at or above the threshold."""
        if self._links is None:
            self._links = materialize(self._verified(materialize(self._candidates())))
        return self._links

    def _candidates(self) -> DataFrame:
        reps = self.sketches.groupBy("field", "kind", "h1", "h2").agg(F.min("id").alias("id"), F.min_by("sig", "id").alias("sig"), F.min_by("keys", "id").alias("keys"))
        keyed = reps.select("field", "id", "sig", F.explode("keys").alias("bucket"))
        block, radius = self.block, self.radius
        # a bucket that is larger than a block is compared block by block, in tasks of its own
        large = materialize(self.sketches.select(F.explode("keys").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > block))
        small = keyed
        parts = []
        if large.limit(1).count():
            small = keyed.join(large, "bucket", "left_anti")
            n = F.ceil(F.col("m") / block).cast("int")
            mine = F.pmod(F.xxhash64("id", "bucket"), n).cast("int")
            # the members of one bucket may be very many: they are spread over salts
            salted = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            heavy = keyed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["bucket", "salt"]).withColumn("n", n).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
            lo, hi = F.least("mine", "other"), F.greatest("mine", "other")
            parts.append(heavy.select("field", "id", "sig", F.xxhash64("bucket", lo, hi).alias("bucket"), F.when(lo == hi, -1).otherwise(F.col("mine")).alias("part")))
        parts.append(small.withColumn("part", F.lit(-1)))

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: pa.Table | None = None
            for batch in batches:
                t = pa.Table.from_batches([batch])
                held = t if held is None else pa.concat_tables([held, t])
                bucket = held.column("bucket").to_numpy()
                whole = int(np.searchsorted(bucket, bucket[-1])) if len(bucket) else 0
                yield from self_pairs(held.slice(0, whole))
                held = held.slice(whole)
            if held is not None:
                yield from self_pairs(held)

        def self_pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
            if t.num_rows < 2:
                return
            bucket = t.column("bucket").to_numpy()
            same = bucket[1:] == bucket[:-1]
            rows = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
            if not len(rows):
                return
            t = t.take(pa.array(rows))
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(rows), -1)
            i, j = close_pairs(sig, bucket[rows], t.column("part").to_numpy(), radius)
            if len(i):
                ids = t.column("id").to_numpy()
                a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
                yield pa.RecordBatch.from_arrays([t.column("field").take(pa.array(i)).combine_chunks(), pa.array(a), pa.array(b)], names=["field", "a", "b"])

        pairs = [p.select("field", "id", "sig", "bucket", "part").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(compare, "field string, a long, b long") for p in parts]
        out = pairs[0] if len(pairs) == 1 else pairs[0].unionByName(pairs[1])
        return out.filter("a < b").distinct()

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """Exact similarities; of the texts only those in a pair are shuffled,
        picked by a bit map of at most 2**17 words whatever the data's size."""
        bits = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 23))
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
        words = ids.groupBy((bits("id") / 64).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bits("id"), F.lit(64)).cast("int"))).alias("mask"))
        hit = F.getbit("mask", F.pmod(bits("id"), F.lit(64)).cast("int")) == 1
        texts = self.texts.withColumn("w", (bits("id") / 64).cast("int")).join(F.broadcast(words), "w").filter(hit)
        long = texts.select("id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"t{i}").alias("text")) for i, f in enumerate(self.fields)])).alias("x")).select("id", "x.field", "x.text")
        both = pairs.join(long.select("field", F.col("id").alias("a"), F.col("text").alias("ta")), ["field", "a"]).join(long.select("field", F.col("id").alias("b"), F.col("text").alias("tb")), ["field", "b"])
        k, threshold, folded = self.k, self.threshold, {f for f, fold in self.fields.items() if fold}

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fields = batch.column(0).to_pylist()
                sim = np.zeros(len(fields))
                for name in set(fields):
                    at = np.flatnonzero([f == name for f in fields])
                    sides = []
                    for c in (3, 4):
                        codes, offsets, _ = letters(batch.column(c).take(pa.array(at)), upper=name in folded)
                        sides.append((codes.astype(np.uint32), offsets))
                    for x, row in enumerate(at):
                        sets = [np.unique(window_hashes(c[o[x] : o[x + 1]], k)) for c, o in sides]
                        common = len(np.intersect1d(*sets, assume_unique=True))
                        total = len(sets[0]) + len(sets[1]) - common
                        sim[row] = common / total if total else 0.0
                keep = pa.array(np.flatnonzero(sim >= threshold))
                yield pa.RecordBatch.from_arrays([batch.column(i).take(keep) for i in range(3)] + [pa.array(sim).take(keep)], names=["field", "a", "b", "similarity"])

        return both.select("field", "a", "b", "ta", "tb").mapInArrow(exact, "field string, a long, b long, similarity double")

    def pairs(self) -> DataFrame:
        """(field, read_id_a, read_id_b) of all similar rows: the links, spread
        to the copies of either side, and the copies among each other."""
        members = self.members()
        classes = self.classes()
        link = self.links().select("field", F.col("a").alias("x"), F.col("b").alias("y"))
        several = materialize(members.join(classes.filter("n_copies > 1").select("field", "h1", "h2", "rep"), ["field", "h1", "h2"]).select("field", "rep", "id"))
        left = several.select("field", F.col("rep").alias("x"), F.col("id").alias("ia"))
        right = several.select("field", F.col("rep").alias("y"), F.col("id").alias("ib"))
        spread = link.join(left, ["field", "x"], "left").join(right, ["field", "y"], "left").select("field", F.coalesce("ia", "x").alias("i"), F.coalesce("ib", "y").alias("j"))
        copies = several.alias("l").join(several.alias("r"), ["field", "rep"]).filter(F.col("l.id") < F.col("r.id")).select("field", F.col("l.id").alias("i"), F.col("r.id").alias("j"))
        return spread.unionByName(copies).select("field", F.least("i", "j").alias("read_id_a"), F.greatest("i", "j").alias("read_id_b"))

    def groups(self) -> DataFrame:
        """(field, read_id, class_id, n_links, group_id), one row a text:
        class_id is the least id of its exact copies, n_links the number of
        different texts it is linked with, group_id the least id of all texts
        reached over links."""
        links = self.links().select("field", F.col("a").alias("x"), F.col("b").alias("y"))
        both = materialize(links.unionByName(links.select("field", F.col("y").alias("x"), F.col("x").alias("y"))))
        n_links = both.groupBy("field", F.col("x").alias("rep")).agg(F.count(F.lit(1)).alias("n_links"))
        label = materialize(both.groupBy("field", "x").agg(F.least(F.col("x"), F.min("y")).alias("g")))
        while True:
            near = both.join(label.select("field", F.col("x").alias("y"), F.col("g").alias("h")), ["field", "y"]).groupBy("field", "x").agg(F.min("h").alias("h"))
            jump = label.select("field", F.col("x").alias("g"), F.col("g").alias("gg"))
            step = label.join(near, ["field", "x"]).join(jump, ["field", "g"]).select("field", "x", F.least("g", "h", "gg").alias("n"), F.col("g").alias("was"))
            step = materialize(step)
            label = step.select("field", "x", F.col("n").alias("g"))
            if not step.filter("n <> was").limit(1).count():
                break
        reps = self.classes().join(n_links, ["field", "rep"], "left").join(label.select("field", F.col("x").alias("rep"), "g"), ["field", "rep"], "left")
        return self.members().join(reps, ["field", "h1", "h2"]).select(
            "field", F.col("id").alias("read_id"), F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("g", "rep").alias("group_id")
        )
