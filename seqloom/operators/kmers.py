"""k-mer indexes, seeds and votes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.functions.letters import letters, mix, row_blocks, window_codes, window_index
from seqloom.functions.sequence import reverse_complement


# Two-bit codes of the bases.
CODES = {"A": 0, "G": 1, "C": 2, "T": 3}


def windows(df: DataFrame, seq: str, k: int = 16, step: int = 1, keep: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, of: Broadcast | None = None) -> DataFrame:
    """Rows of ``df`` (without seq) with offset (from 0) and kmer, of windows
    that begin every ``step`` letters and hold only A, C, G and T (any case).
    kmer is the window's two-bit code, k at most 31. keep: tells from offsets
    and the lengths of their texts which windows are wanted. of: a map of the
    k-mers that are wanted (``code_map``); a share of others comes too.

    Windows are cut from whole Arrow batches at once: a column expression
    would walk each text from its start for every window.
    """
    rest = [c for c in df.columns if c != seq]
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField("offset", T.IntegerType()), T.StructField("kmer", T.LongType())])
    digit = np.full(256, 255, np.uint8)
    for base, code in CODES.items():
        digit[ord(base)] = code

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted_codes = np.frombuffer(of.value, np.uint8) if of is not None else None
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(len(rest))), 0).to_numpy(zero_copy_only=False)
            for lo, hi in row_blocks(np.concatenate([[0], np.cumsum(sizes.astype(np.int64))]), 200_000):
                c, own, _ = letters(batch.column(len(rest)).slice(lo, hi - lo), upper=True)
                row, at = window_index(own, k)
                if not len(at):
                    continue
                d = np.where(c < 256, digit[np.minimum(c, 255)], 255)
                bad = np.concatenate([[0], np.cumsum(d == 255)])
                good = ((at - own[row]) % step == 0) & (bad[at + k] == bad[at])
                row, at = row[good], at[good]
                if keep is not None:
                    wanted = keep(at - own[row], np.diff(own)[row])
                    row, at = row[wanted], at[wanted]
                found = window_codes(d & 3, k)[at]
                if wanted_codes is not None:
                    byte, bit = _bits(found)
                    wanted = wanted_codes[byte] & bit > 0
                    row, at, found = row[wanted], at[wanted], found[wanted]
                take = pa.array(lo + row)
                yield pa.RecordBatch.from_arrays([batch.column(i).take(take) for i in range(len(rest))] + [pa.array((at - own[row]).astype(np.int32)), pa.array(found)], names=[*rest, "offset", "kmer"])

    return df.select(*rest, seq).mapInArrow(cut, schema)


MAP_BITS = 28  # 32 MB, whatever the number of k-mers
MAP_PART = 1 << 16  # bytes of a row of it


def _bits(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte of the map and bit in it of each k-mer."""
    h = mix(codes.astype(np.uint64)) >> np.uint64(64 - MAP_BITS)
    return (h >> np.uint64(3)).astype(np.int64), np.uint8(1) << (h & np.uint64(7)).astype(np.uint8)


def code_map(seeds: DataFrame) -> Broadcast:
    """A bit map, of fixed size, of hashes of the k-mers of ``seeds``, sent to
    all tasks. At most 64 tasks make maps, which are joined in parts."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << MAP_BITS - 3, np.uint8)
        for batch in batches:
            np.bitwise_or.at(bits, *_bits(batch.column(0).to_numpy(zero_copy_only=False)))
        for part in range(0, len(bits), MAP_PART):
            if bits[part : part + MAP_PART].any():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([bits[part : part + MAP_PART].tobytes()], pa.binary())], names=["part", "bits"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, bits in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.setdefault(part, np.zeros(MAP_PART, np.uint8))[:] |= np.frombuffer(bits.as_buffer(), np.uint8)
        for part, bits in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["part", "bits"])

    kind = "part int, bits binary"
    whole = np.zeros(1 << MAP_BITS - 3, np.uint8)
    for row in seeds.select("kmer").coalesce(64).mapInArrow(mark, kind).repartition("part").mapInArrow(joined, kind).toLocalIterator():
        whole[row.part : row.part + MAP_PART] = np.frombuffer(row.bits, np.uint8)
    return seeds.sparkSession.sparkContext.broadcast(whole.tobytes())


def pieces(seq: str, size: int, more: int = 0) -> Column:
    """The pieces of ``size`` letters that follow one another in a text, each
    with up to ``more`` letters that follow it. Texts are walked once, and no
    text is copied for each of its pieces."""
    return F.regexp_extract_all(F.col(seq), F.lit(f"(?s)(?=(.{{1,{size + more}}})).{{1,{size}}}"), F.lit(1))


def index(contigs: DataFrame, contig: str, seq: str, start: str | None = None, k: int = 16, step: int = 3, most: int = 100, of: DataFrame | None = None) -> DataFrame:
    """(kmer, contig, pos): places of all k-mers that occur at most ``most``
    times. They are counted behind the shuffle that a join by k-mer needs
    anyway, so texts are cut once and nothing is shuffled for the count.
    of: seeds that will be looked up; places of all their k-mers are given,
    and most others stay where they are."""
    cols = [F.col(contig).alias("contig"), F.col(seq).alias("s"), (F.col(start) if start else F.lit(0)).cast("long").alias("o")]
    places = windows(contigs.select(*cols), "s", k, step, of=code_map(of) if of is not None else None).select("kmer", "contig", (F.col("o") + F.col("offset")).alias("pos"))
    return places.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("kmer"))).filter(F.col("n") <= most).drop("n")


def spaced_seeds(reads: DataFrame, read: str, seq: str, n: int = 10, k: int = 16) -> DataFrame:
    """(read, strand, offset, letters, kmer): ``n`` evenly spaced windows of
    each read of either strand (0 as is, 1 reversed and complemented)."""
    both = reads.filter(F.length(seq) >= k).select(F.col(read).alias("read"), F.explode(F.array(F.struct(F.lit(0).alias("strand"), F.upper(seq).alias("s")), F.struct(F.lit(1).alias("strand"), F.upper(reverse_complement(seq)).alias("s")))).alias("x")).select("read", "x.strand", "x.s")
    spaced = lambda at, size: (at[:, None] == np.arange(n) * (size[:, None] - k) // max(1, n - 1)).any(axis=1)
    digits = F.lpad(F.conv(F.col("kmer").cast("string"), 10, 4), k, "0")
    return windows(both, "s", k, keep=spaced).select("read", "strand", "offset", F.translate(digits, "0123", "".join(CODES)).alias("letters"), "kmer")


def dense_seeds(reads: DataFrame, read: str, seq: str, k: int = 16, step: int = 3) -> DataFrame:
    """(read, strand, offset, kmer): windows of each long read of either strand
    that begin every ``step`` letters, so their number grows with the read."""
    both = reads.filter(F.length(seq) >= k).select(F.col(read).alias("read"), F.explode(F.array(F.struct(F.lit(0).alias("strand"), F.col(seq).alias("s")), F.struct(F.lit(1).alias("strand"), reverse_complement(seq).alias("s")))).alias("x"))
    return windows(both.select("read", "x.strand", "x.s"), "s", k, step)


def votes(seeds: DataFrame, places: DataFrame, tolerance: int = 0) -> DataFrame:
    """(read, strand, contig, diagonal, votes, c_start, c_stop): seeds that
    agree on where the read begins. With a tolerance diagonals are rounded
    down to multiples of tolerance + 1, so that short indels vote together."""
    # both sides have many rows for each row of the tables that Spark estimates them by, so neither may be broadcast
    hits = seeds.drop("letters").join(places.hint("merge"), "kmer").withColumn("diagonal", F.col("pos") - F.col("offset"))
    if tolerance:
        hits = hits.withColumn("diagonal", F.floor(F.col("diagonal") / (tolerance + 1)) * (tolerance + 1))
    # hits are shuffled once, by read; a seed may meet its diagonal at more than one place of a contig's overlapping blocks
    once = hits.select("read", "strand", "contig", "diagonal", "offset").repartition("read").distinct()
    return once.groupBy("read", "strand", "contig", "diagonal").agg(F.count(F.lit(1)).alias("votes"), F.min("offset").alias("c_start"), F.max("offset").alias("c_stop"))


def best_votes(voted: DataFrame, distinct_counts: int = 3, least: int = 1) -> DataFrame:
    """Candidates of each read among its ``distinct_counts`` highest vote
    counts, ranked (1 is best), with the number of equally good ones."""
    w = W.partitionBy("read")
    ranked = voted.filter(F.col("votes") >= least).withColumn("rank", F.dense_rank().over(w.orderBy(F.desc("votes"))))
    return ranked.filter(F.col("rank") <= distinct_counts).withColumn("ties", F.count(F.lit(1)).over(W.partitionBy("read", "rank")))


def full_scan(contigs: DataFrame, contig: str, seq: str, query: str, share: float = 0.8) -> DataFrame:
    """(contig, pos, strand, matches): all places (from 1) where at least
    int(share * length - 0.001) letters of the query stand, on either strand."""
    least = int(share * len(query) - 0.001)
    back = query.upper()[::-1].translate(str.maketrans("ACGT", "TGCA"))
    patterns = [(0, np.frombuffer(query.upper().encode(), np.uint8)), (1, np.frombuffer(back.encode(), np.uint8))]
    kind = contigs.schema[contig].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, offsets, _ = letters(batch.column(1), upper=True)
            for r in range(batch.num_rows):
                text = codes[offsets[r] : offsets[r + 1]]
                n = len(text) - len(query) + 1
                for strand, pattern in patterns if n > 0 else ():
                    match = np.zeros(n, np.int32)
                    for i, letter in enumerate(pattern):
                        match += text[i : i + n] == letter
                    at = np.flatnonzero(match >= least)
                    if len(at):
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(at), r))), pa.array(at + 1), pa.array(np.full(len(at), strand, np.int32)), pa.array(match[at])], names=["contig", "pos", "strand", "matches"])

    return contigs.select(F.col(contig).alias("contig"), F.col(seq).alias("s")).filter("s is not null").mapInArrow(scan, f"contig {kind}, pos long, strand int, matches int")
