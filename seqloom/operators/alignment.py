"""Placing reads: candidates from seed votes, dynamic programming, and events.

Candidates come from equi-joins on k-mers; the reference around each is cut
from the block that holds it by an interval join; only the dynamic program
itself, row by row of the read over all reference places at once, is Python.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.functions.sequence import mapping_quality, splice_class
from seqloom.operators.intervals import containing

#: Scores of the dynamic program: match, mismatch, opening and lengthening a gap.
MATCH, MISMATCH, OPEN, EXTEND = 2, 0, -1, 0


def best_path(read: np.ndarray, ref: np.ndarray, match: int = MATCH, mismatch: int = MISMATCH, gap: int = OPEN) -> tuple[int, int, str, int]:
    """(score, first place in ref, operations, mismatches) of the whole read
    within ref; gaps cost once however long; ends of ref are free.

    Of equal paths the one with fewer gaps, then further left, is taken.
    """
    return _paths(read[None], ref[None], match, mismatch, gap)[0]


def best_paths(pairs: list[tuple[str, str]]) -> list[tuple[int, int, str, int]]:
    """``best_path`` of each read and reference. A read that stands in its
    reference as it is needs no path; others of like lengths are solved together."""
    out: list = [None] * len(pairs)
    like: dict[tuple[int, int], list[int]] = defaultdict(list)
    codes = lambda t: np.frombuffer(t.encode(), np.uint8)
    for i, (s, w) in enumerate(pairs):
        at = w.find(s) if s and s.isascii() and w.isascii() else -1
        if at >= 0:
            out[i] = (MATCH * len(s), at, f"{len(s)}M", 0)
        else:
            like[len(s.encode()), len(w.encode())].append(i)
    for (n, m), rows in like.items():
        step = max(1, 2_000_000 // ((n + 1) * (m + 1)))
        for lo in range(0, len(rows), step):
            own = rows[lo : lo + step]
            read, ref = (np.stack([codes(pairs[i][x]) for i in own]) for x in (0, 1))
            for i, path in zip(own, _paths(read, ref, MATCH, MISMATCH, OPEN)):
                out[i] = path
    return out


def _paths(read: np.ndarray, ref: np.ndarray, match: int, mismatch: int, gap: int) -> list[tuple[int, int, str, int]]:
    """Best paths of reads (one a row) in references (one a row)."""
    (rows, n), m = read.shape, ref.shape[1]
    scale = 1024  # small costs below the unit settle ties
    cost = gap * scale - 1
    low = np.full((rows, 1), -(1 << 40), np.int64)
    d = np.full((n + 1, rows, m + 1), -(1 << 40), np.int64)
    d[0] = 0
    back = np.zeros((n + 1, rows, m + 1), np.int8)  # 0 diagonal, 1 gap in the reference (insertion), 2 gap in the read (deletion)
    column = np.full((rows, m + 1), -(1 << 40), np.int64)
    for i in range(1, n + 1):
        if i > 1:  # an alignment doesn't begin with an insertion
            column = np.maximum(column, d[i - 1])
        s = np.where(read[:, i - 1, None] == ref, match * scale, mismatch * scale)
        diagonal = np.concatenate([low, d[i - 1, :, :-1] + s], axis=1)
        up = column + cost
        own = np.maximum(diagonal, up)
        back[i] = up > diagonal
        if i < n:
            reach = np.concatenate([low, np.maximum.accumulate(own, axis=1)[:, :-1]], axis=1) + cost
            back[i][reach > own] = 2
            own = np.maximum(own, reach)
        d[i] = own
    last = np.argmax(d[n], axis=1)
    return [_traced(read[r], ref[r], d[:, r], back[:, r], int(last[r]), scale, cost) for r in range(rows)]


def _traced(read: np.ndarray, ref: np.ndarray, d: np.ndarray, back: np.ndarray, j: int, scale: int, cost: int) -> tuple[int, int, str, int]:
    """The path that ends at place j, from its end to its start."""
    score, i, ops = int(d[len(read), j]), len(read), []
    wrong = 0
    while i > 0:
        kind = back[i, j]
        if kind == 0:
            wrong += int(read[i - 1] != ref[j - 1])
            ops.append("M")
            i, j = i - 1, j - 1
        elif kind == 1:
            target = d[i, j] - cost
            while True:
                ops.append("I")
                i -= 1
                if i >= 1 and d[i, j] == target:
                    break
        else:
            target = d[i, j] - cost
            while True:
                ops.append("D")
                j -= 1
                if d[i, j] == target:
                    break
    text, run = "", 0
    ops.reverse()
    for x, op in enumerate(ops):
        run += 1
        if x + 1 == len(ops) or ops[x + 1] != op:
            text, run = f"{text}{run}{op}", 0
    return -(-score // scale), j, text, wrong


def align(candidates: DataFrame, reads: DataFrame, blocks: DataFrame, slack: int = 8, least_share: float = 0.6) -> DataFrame:
    """Best places of reads among their candidates.

    candidates: read, strand, contig, diagonal (first place, from 0), votes;
    reads: read, strand, s (letters as on that strand); blocks: contig,
    b_start, b_stop (places, from 0), letters. Result: read, strand, contig,
    pos (from 1), cigar, score, mismatches, mapq, ties. Reads whose best score
    is below ``least_share`` of the greatest possible are left out.
    """
    # reads cut from texts and letters are more than Spark estimates them to be, so they may not be broadcast
    c = candidates.join(reads.hint("merge"), ["read", "strand"]).select("read", "strand", "contig", "diagonal", "s")
    met = containing(c, blocks.hint("merge"), ["contig"], "diagonal", ("b_start", "b_stop"))
    lo = F.greatest(F.lit(0), F.col("diagonal") - F.col("b_start") - slack)
    window = F.substring(F.col("letters"), (lo + 1).cast("int"), (F.length("s") + 2 * slack).cast("int"))
    work = met.select("read", "strand", "contig", (F.col("b_start") + lo).alias("w_start"), F.upper("s").alias("s"), F.upper(window).alias("w")).filter(F.length("w") >= F.length("s") / 2)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out, solved = [], best_paths(list(zip(f["s"], f["w"])))
            for r, (score, at, ops, wrong) in zip(f.itertuples(index=False), solved):
                out.append((r.read, r.strand, r.contig, r.w_start + at + 1, ops, score, wrong, len(r.s)))
            yield pd.DataFrame(out, columns=["read", "strand", "contig", "pos", "cigar", "score", "mismatches", "size"])

    kind = candidates.schema["read"].dataType.simpleString()
    placed = work.mapInPandas(solve, f"read {kind}, strand int, contig string, pos long, cigar string, score long, mismatches int, size int").distinct()
    good = placed.filter(F.col("score") >= F.lit(least_share * MATCH) * F.col("size"))
    w = W.partitionBy("read")
    ranked = good.withColumn("r", F.row_number().over(w.orderBy(F.desc("score"), "mismatches", "contig", "pos", "strand"))).withColumn("top", F.max("score").over(w))
    ranked = ranked.withColumn("ties", F.count_if(F.col("score") == F.col("top")).over(w)).withColumn("n", F.count(F.lit(1)).over(w))
    return ranked.filter("r = 1").select("read", "strand", "contig", "pos", "cigar", "score", "mismatches", mapping_quality(F.col("n"), F.col("mismatches"), F.col("ties") > 1).alias("mapq"), "ties")


def pair_candidates(first: DataFrame, second: DataFrame, least: int = 50, most: int = 600, keep: int = 2) -> DataFrame:
    """Best combinations of the two mates' candidates: (read, places and votes
    of both, weight). Mates on one chromosome, in a fitting distance and on
    opposite strands weigh more; ``keep`` combinations a read are kept."""
    a = first.select("read", *[F.col(c).alias(f"{c}1") for c in ("strand", "contig", "diagonal", "votes")])
    b = second.select("read", *[F.col(c).alias(f"{c}2") for c in ("strand", "contig", "diagonal", "votes")])
    near = (F.col("contig1") == F.col("contig2")) & (F.col("strand1") != F.col("strand2")) & F.abs(F.col("diagonal1") - F.col("diagonal2")).between(least, most)
    # Weights in thousandths.
    weight = F.when(near, 1300).when(F.col("contig1") == F.col("contig2"), 1000).otherwise(800) * (F.col("votes1") + F.col("votes2"))
    scored = a.join(b, "read").withColumn("weight", weight)
    order = W.partitionBy("read").orderBy(F.desc("weight"), "contig1", "diagonal1", "contig2", "diagonal2", "strand1", "strand2")
    return scored.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= keep).drop("r")


def template_length(pos1, span1, pos2, span2):
    """Signed length of a fragment from the first mate: positive if it is leftmost."""
    first, last = F.least(pos1, pos2), F.greatest(pos1 + span1 - 1, pos2 + span2 - 1)
    return F.when(pos1 <= pos2, last - first + 1).otherwise(first - last - 1)


def split_points(pairs: DataFrame) -> DataFrame:
    """Where a read changes from one diagonal to a later one of the same contig.

    pairs: read, contig, left_diagonal, right_diagonal, s, left_ref, right_ref
    (the reference under the whole read along each diagonal, with two letters
    after the left and before the right one's read). The split with the most
    matches is taken; of equals one at a splice site, then the first. Result:
    read, contig, left, right (last and first place from 1), matches,
    splice_class.
    """

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                s = np.frombuffer(r.s.encode(), np.uint8)
                n = len(s)
                a = np.frombuffer(r.left_ref.encode(), np.uint8)
                b = np.frombuffer(r.right_ref.encode(), np.uint8)
                if len(a) < n + 2 or len(b) < n + 2 or n < 2:
                    continue
                ahead = np.concatenate([[0], np.cumsum(a[:n] == s)])
                behind = np.concatenate([np.cumsum((b[2:][:n] == s)[::-1])[::-1], [0]])
                total = (ahead + behind)[1:n]
                best = np.flatnonzero(total == total.max()) + 1
                sites = [(r.left_ref[x : x + 2], r.right_ref[x : x + 2]) for x in best]
                good = [x for x, d in zip(best, sites) if d in (("GT", "AG"), ("CT", "AC"))]
                x = int(good[0] if good else best[0])
                out.append((r.read, r.contig, r.left_diagonal + x, r.right_diagonal + x + 1, int(total.max()), r.left_ref[x : x + 2], r.right_ref[x : x + 2]))
            yield pd.DataFrame(out, columns=["read", "contig", "left", "right", "matches", "donor", "acceptor"])

    kind = pairs.schema["read"].dataType.simpleString()
    found = pairs.mapInPandas(solve, f"read {kind}, contig string, left long, right long, matches int, donor string, acceptor string")
    return found.select("read", "contig", "left", "right", "matches", splice_class(F.col("donor"), F.col("acceptor")).alias("splice_class"))


def indel_events(reads: DataFrame, most: int = 100) -> DataFrame:
    """(chr, pos, kind, length, support): insertions and deletions of at most
    ``most`` letters in alignments, with how many show each. pos is the last
    covered base before the event. reads: chr, sections."""
    pairs = F.zip_with(
        F.slice("sections", 1, F.greatest(F.size("sections") - 1, F.lit(0))), F.slice("sections", 2, F.greatest(F.size("sections") - 1, F.lit(1))),
        lambda a, b: F.struct(a.stop.alias("pos"), b.before.alias("kind"), F.when(b.before == "I", b.read_start - a.read_start - (a.stop - a.start + 1)).otherwise(b.start - a.stop - 1).alias("length")),
    )
    e = reads.filter("chr is not null and size(sections) > 1").select("chr", F.explode(pairs).alias("e")).select("chr", "e.pos", "e.kind", "e.length")
    return e.filter(F.col("kind").isin("I", "D") & (F.col("length") <= most)).groupBy("chr", "pos", "kind", "length").agg(F.count(F.lit(1)).alias("support"))


def indel_quality(support):
    """0.5 ** (30 - support) below 30 reads, else 1."""
    return F.when(support < 30, F.pow(F.lit(0.5), F.lit(30) - support)).otherwise(1.0)


def alternative_splices(junctions: DataFrame, known: DataFrame) -> DataFrame:
    """Junctions (fragment, chr, left, right) of which a known one shares an
    end, but none both."""
    exact = known.select("chr", "left", "right").distinct()
    unknown = junctions.join(exact, ["chr", "left", "right"], "left_anti")
    by_left = unknown.join(exact.select("chr", "left").distinct(), ["chr", "left"], "left_semi")
    by_right = unknown.join(exact.select("chr", "right").distinct(), ["chr", "right"], "left_semi")
    cols = junctions.columns
    return by_left.select(*cols).unionByName(by_right.select(*cols)).distinct()


def dense_windows(voted: DataFrame, width: int = 20_000, keep: int = 3) -> DataFrame:
    """Of every long read the ``keep`` stretches of a contig (strand by strand)
    that gather the most votes: (read, strand, contig, w_start, votes, rank).
    A stretch begins at a vote and ends ``width`` places on."""
    ahead = W.partitionBy("read", "strand", "contig").orderBy("diagonal").rangeBetween(0, width)
    total = voted.withColumn("w_votes", F.sum("votes").over(ahead))
    order = W.partitionBy("read").orderBy(F.desc("w_votes"), "contig", "strand", "diagonal")
    return total.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep).select("read", "strand", "contig", F.col("diagonal").alias("w_start"), F.col("w_votes").alias("votes"), "rank")


def long_read_windows(voted: DataFrame, lengths: DataFrame, keep: int = 3) -> DataFrame:
    """As ``dense_windows``, with stretches by the length of the read: 20,000
    below 10,000 letters, else a third more than the read, 1,500,000 at most.
    lengths: read, length.

    A frame's reach can't differ by row, so ends of stretches are rows among
    the votes, and running sums are subtracted.
    """
    width = F.when(F.col("length") < 10_000, 20_000).otherwise(F.least(F.lit(1_500_000), F.floor(F.col("length") * 4 / 3))).cast("long")
    spots = voted.join(lengths, "read").withColumn("x", F.explode(F.array(F.struct(F.col("diagonal").alias("at"), F.lit(0).alias("side"), F.col("votes").alias("v")), F.struct((F.col("diagonal") + width).alias("at"), F.lit(1).alias("side"), F.lit(0).cast("long").alias("v")))))
    run = W.partitionBy("read", "strand", "contig").orderBy("x.at", "x.side").rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = spots.withColumn("sum", F.sum("x.v").over(run))
    start, stop = F.max(F.when(F.col("x.side") == 0, F.col("sum") - F.col("x.v"))), F.max(F.when(F.col("x.side") == 1, F.col("sum")))
    total = summed.groupBy("read", "strand", "contig", "diagonal").agg((stop - start).alias("w_votes"))
    order = W.partitionBy("read").orderBy(F.desc("w_votes"), "contig", "strand", "diagonal")
    return total.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep).select("read", "strand", "contig", F.col("diagonal").alias("w_start"), F.col("w_votes").alias("votes"), "rank")


def chained(seeds: DataFrame, keys: list[str]) -> DataFrame:
    """The longest chain of seeds of each group that rises in read and
    contig: keys, offset, pos. Groups are the seeds of one window of one read,
    which the read's length bounds."""

    def longest(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["offset", "pos"], ascending=[True, False])
        pos = f["pos"].to_numpy()
        tails: list[int] = []
        where: list[int] = []
        prev = np.full(len(pos), -1)
        for i, p in enumerate(pos):
            k = int(np.searchsorted(tails, p))
            prev[i] = where[k - 1] if k else -1
            if k == len(tails):
                tails.append(p)
                where.append(i)
            else:
                tails[k], where[k] = p, i
        out, at = [], where[-1] if where else -1
        while at >= 0:
            out.append(at)
            at = prev[at]
        return f.iloc[out[::-1]]

    return seeds.groupBy(*keys).applyInPandas(longest, seeds.schema)
