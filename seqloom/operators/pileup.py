"""Bases by position, their background, and tests for variants."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.functions.cigar import leading_clip
from seqloom.functions.letters import letters
from seqloom.functions.sequence import fisher
from seqloom.operators.kmers import pieces


def drop_crowded_locations(reads: DataFrame, least: int = 10) -> DataFrame:
    """Rows without those of a place (chr, first position before clipping)
    that at least ``least`` rows share; rows without a place stay.

    Places are counted first, combined before the shuffle; only the crowded
    ones are joined back.
    """
    place = reads.withColumn("_at", F.col("pos") - leading_clip("cigar"))
    crowded = place.filter("chr is not null").groupBy("chr", "_at").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).drop("_n")
    return place.join(crowded, ["chr", "_at"], "left_anti").drop("_at")


def base_counts(reads: DataFrame, least_score: int = 13, trim: int = 3, by: str | None = "fragment") -> DataFrame:
    """(chr, pos, a, c, g, t): bases read at each position.

    reads: fragment, chr, pos (of the first base), seq, qual; ungapped.
    Bases within ``trim`` of an end or below ``least_score`` don't count. Of
    the bases of one fragment at one position the best scored counts (then the
    least letter). Reads are parted ``by`` a column that is the same for all
    reads of a fragment; None if those already follow one another in one
    partition, and no contig is too much for one task: counts, not reads, are
    then shuffled, once, by chr.
    """
    rows = reads.select("fragment", "chr", "pos", "seq", "qual").filter("seq is not null and qual is not null and pos is not null")
    # whole reads are shuffled and not their bases, and counts leave each task added up
    together = rows.repartition(by).sortWithinPartitions("fragment") if by else rows
    partial = together.mapInArrow(_counted_bases(least_score, trim), "chr string, pos long, a long, c long, g long, t long")
    return (partial if by else partial.repartition("chr")).groupBy("chr", "pos").agg(*[F.sum(x).alias(x) for x in "acgt"])


def with_reference(counts: DataFrame, contigs: DataFrame, letters: str) -> DataFrame:
    """Adds ref, the letter of the contig (chr, letters; one row each) at pos
    (from 1), to counts. Whole contigs are shuffled and not their places; counts are
    shuffled once, by chr, which also parts them for the sums around them."""
    size = 64  # a letter is reached within its piece
    whole = contigs.select("chr", pieces(letters, size).alias("_pieces"))
    at = F.col("pos") - 1
    piece = F.get("_pieces", F.floor(at / size).cast("int"))
    ref = F.substring(piece, (at % size + 1).cast("int"), F.lit(1))
    return counts.join(whole.hint("merge"), "chr").filter("pos > 0").withColumn("ref", ref).drop("_pieces").filter("ref is not null and ref <> ''")


def _counted_bases(least_score: int, trim: int):
    """Counts by place of reads that come sorted by fragment."""

    def solve(t: pa.Table) -> pa.RecordBatch | None:
        fragment = t.column(0).combine_chunks().dictionary_encode()
        chrom = t.column(1).combine_chunks().dictionary_encode()
        f = np.asarray(fragment.indices.fill_null(-1)).astype(np.int64)
        ch = np.asarray(chrom.indices.fill_null(len(chrom.dictionary))).astype(np.int64)
        start = t.column(2).to_numpy()
        (seq, at, _), (qual, qat, _) = letters(t.column(3).combine_chunks(), upper=True), letters(t.column(4).combine_chunks())
        n = np.maximum(np.minimum(np.diff(at), np.diff(qat)) - 2 * trim, 0)
        row = np.repeat(np.arange(len(n)), n)
        i = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n) + trim
        b, s = seq[at[row] + i], qual[qat[row] + i].astype(np.int64) - 33
        keep = (s >= least_score) & np.isin(b, np.frombuffer(b"ACGT", np.uint8))
        row, i, b, s = row[keep], i[keep], b[keep], s[keep]
        if not len(row):
            return None
        pos = start[row] + i
        low, span = int(pos.min()), int(pos.max() - pos.min()) + 1
        place = ch[row] * span + pos - low
        if (np.bincount(f[f >= 0]) > 1).any() or (f < 0).any():  # of one fragment's bases at a place the best counts
            order = np.lexsort((b, -s, place, f[row]))
            place, b, fr = place[order], b[order], f[row][order]
            first = np.concatenate([[True], (place[1:] != place[:-1]) | (fr[1:] != fr[:-1])])
            place, b = place[first], b[first]
        digit = np.zeros(256, np.int64)
        digit[list(b"ACGT")] = range(4)
        code = place * 4 + digit[b]
        if int(code.max()) < 4 * len(code):
            count = np.bincount(code)
            code = np.flatnonzero(count)
            count = count[code]
        else:
            code, count = np.unique(code, return_counts=True)
        places, where = np.unique(code >> 2, return_inverse=True)
        out = np.zeros((len(places), 4), np.int64)
        out[where, code & 3] = count
        names = pa.array([*chrom.dictionary.to_pylist(), None], pa.string()).take(pa.array(places // span))
        return pa.RecordBatch.from_arrays([names, pa.array(places % span + low), *[pa.array(out[:, j]) for j in range(4)]], names=["chr", "pos", "a", "c", "g", "t"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                t = pa.Table.from_batches([batch.slice(at, 500)])
                held = t if held is None else pa.concat_tables([held, t])
                size += pc.sum(pc.binary_length(t.column(3))).as_py()
                if size < 1_000_000:
                    continue
                # the last fragment may go on in the next rows
                names = held.column(0).to_pylist()
                whole = next((i for i in range(len(names) - 1, 0, -1) if names[i] != names[i - 1]), 0)
                if whole:
                    out = solve(held.slice(0, whole))
                    if out is not None:
                        yield out
                    held, size = held.slice(whole), 0
        if held is not None and held.num_rows:
            out = solve(held)
            if out is not None:
                yield out

    return count


BAND = 1 << 14  # positions of a chromosome that a task looks at together


def around(rows: DataFrame, values: dict[str, str], width: int) -> DataFrame:
    """Adds sums (value: column) over the ``width`` positions to either side
    and the position itself; rows: chr, pos and others. A chromosome is parted
    into bands; rows near a border are seen by both bands."""
    own = F.floor(F.col("pos") / BAND)
    bands = F.array_distinct(F.array(F.floor((F.col("pos") - width) / BAND), own, F.floor((F.col("pos") + width) / BAND)))
    w = W.partitionBy("chr", "_band").orderBy("pos").rangeBetween(-width, width)
    out = rows.withColumn("_band", F.explode(bands))
    for name, column in values.items():
        out = out.withColumn(name, F.sum(column).over(w))
    return out.filter(F.col("_band") == own).drop("_band")


def with_background(counts: DataFrame, width: int = 5) -> DataFrame:
    """Adds the matches and mismatches of the ``width`` positions to either
    side; counts: chr, pos, matches, mismatches. Positions without reads add
    nothing."""
    near = around(counts, {"bg_matches": "matches", "bg_mismatches": "mismatches"}, width)
    return near.withColumn("bg_matches", F.col("bg_matches") - F.col("matches")).withColumn("bg_mismatches", F.col("bg_mismatches") - F.col("mismatches"))


def call_variants(counts: DataFrame, reference: DataFrame | None, known: DataFrame | None = None, width: int = 5, upper: float = 5e-3, depth_unit: float = 50 / 12, least_total: int = 1, least_alternatives: int = 1, least_share: float = 0.0) -> DataFrame:
    """Positions whose mismatches exceed those around them.

    counts: chr, pos, a, c, g, t; reference: chr, pos, ref (None if counts
    have ref; it has a row a place, so it isn't broadcast); known: chr, pos of
    known variants, which don't count as background. The cutoff falls
    with the depth around a position; at least 80 % of the bases around must
    match. Result: chr, pos, ref, alts (by count, then letter), total,
    mismatches, bg_total, bg_mismatches, p, quality.
    """
    joined = counts.join(reference.hint("merge"), ["chr", "pos"]) if reference is not None else counts
    total = F.col("a") + F.col("c") + F.col("g") + F.col("t")
    match = F.when(F.col("ref") == "A", F.col("a")).when(F.col("ref") == "C", F.col("c")).when(F.col("ref") == "G", F.col("g")).when(F.col("ref") == "T", F.col("t"))
    own = joined.withColumn("total", total).withColumn("matches", match).filter("matches is not null").withColumn("mismatches", F.col("total") - F.col("matches"))
    if known is not None:  # known places are no background of others
        marks = known.select("chr", "pos").distinct().withColumn("known", F.lit(True))
        flagged = own.join(marks, ["chr", "pos"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
        quiet = flagged.withColumn("m", F.when(F.col("known"), 0).otherwise(F.col("matches"))).withColumn("x", F.when(F.col("known"), 0).otherwise(F.col("mismatches")))
        near = around(quiet, {"bg_matches": "m", "bg_mismatches": "x"}, width)
        bg = near.withColumn("bg_matches", F.col("bg_matches") - F.col("m")).withColumn("bg_mismatches", F.col("bg_mismatches") - F.col("x")).drop("m", "x", "known")
    else:
        bg = with_background(own, width)
    some = bg.filter((F.col("mismatches") > 0) & (F.col("bg_matches") * 20 > (F.col("bg_matches") + F.col("bg_mismatches")) * 16))
    rich = F.col("mismatches") * F.col("bg_matches") >= F.col("bg_mismatches") * F.col("matches")
    p = F.when(rich, fisher("mismatches", "bg_mismatches", "matches", "bg_matches")).otherwise(1.1)
    depth = (F.col("bg_matches") + F.col("bg_mismatches") + F.col("total")) / (1 + 2 * width)
    cut = F.greatest(F.lit(1e-300), F.least(F.lit(upper), F.pow(F.lit(10.0), -depth / depth_unit)))
    letters = F.array_sort(F.filter(F.array(*[F.struct((-F.col(x.lower())).alias("n"), F.lit(x).alias("x")) for x in "ACGT"]), lambda s: (s.x != F.col("ref")) & (s.n <= -least_alternatives)))
    called = some.withColumn("p", p).filter((F.col("p") < cut) & (F.col("total") >= least_total) & (F.col("mismatches") >= F.lit(least_share) * F.col("total")))
    out = called.withColumn("alts", F.array_join(F.transform(letters, lambda s: s.x), ",")).filter("alts <> ''")
    return out.select("chr", "pos", "ref", "alts", "total", "mismatches", (F.col("bg_matches") + F.col("bg_mismatches")).alias("bg_total"), "bg_mismatches", "p", (-F.log10(F.greatest(F.lit(1e-40), "p"))).alias("quality"))


def shared_variants(rows: DataFrame, n_files: int | None = None) -> DataFrame:
    """Variants (kind, chr, pos, ref, alt) that all files have, each with the
    row of least quality (then first file). n_files: by default as many as
    rows has, a null file being one of its own."""
    files = F.count_distinct("file") + F.coalesce(F.max(F.col("file").isNull().cast("int")), F.lit(0))
    key = ["kind", "chr", "pos", "ref", "alt"]
    per = rows.groupBy(*key).agg(files.alias("n"), F.min(F.struct("quality", "file")).alias("m"))
    return per.filter(F.col("n") == (rows.agg(files.alias("n")).scalar() if n_files is None else n_files)).select(*key, F.col("m.quality").alias("quality"), F.col("m.file").alias("file"))
