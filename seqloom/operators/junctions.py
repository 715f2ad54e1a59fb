"""Splice junctions: counting them, their sites and genes, and thinning events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.operators.intervals import containing


def fragment_junctions(reads: DataFrame, fragment: str, extra: list[str] | None = None) -> DataFrame:
    """Distinct junctions of every fragment: (fragment, extra..., chr, left,
    right), left being the last base before the gap and right the first after
    it. reads: fragment, chr, sections. A junction in both mates counts once."""
    keep = [fragment, *(extra or []), "chr"]
    pairs = F.zip_with(F.slice("sections", 1, F.greatest(F.size("sections") - 1, F.lit(0))), F.slice("sections", 2, F.greatest(F.size("sections") - 1, F.lit(1))), lambda a, b: F.struct(a.stop.alias("left"), b.start.alias("right"), b.before.alias("kind")))
    spliced = reads.filter("chr is not null and size(sections) > 1").select(*keep, F.explode(pairs).alias("j")).filter("j.kind = 'N'")
    return spliced.select(*keep, "j.left", "j.right").distinct()


def junction_counts(junctions: DataFrame) -> DataFrame:
    return junctions.groupBy("chr", "left", "right").agg(F.count(F.lit(1)).alias("n"))


def site_counts(counts: DataFrame) -> DataFrame:
    """Support of each splice site, sides apart: (chr, site, side, n)."""
    sites = counts.select("chr", "n", F.explode(F.array(F.struct(F.col("left").alias("site"), F.lit("left").alias("side")), F.struct(F.col("right").alias("site"), F.lit("right").alias("side")))).alias("s"))
    return sites.groupBy("chr", "s.site", "s.side").agg(F.sum("n").alias("n"))


def primary_genes(counts: DataFrame, spans: DataFrame) -> DataFrame:
    """Gene of each junction. spans: gene, chr, g_start, g_stop.

    A gene that holds both sites beats one that holds one; if none holds both,
    the site of greater support decides; of equal genes the one that starts
    first (then the first by name). Result: chr, left, right, n,
    primary_gene (null if no gene holds a site), secondary_genes.
    """
    support = site_counts(counts)
    points = support.select("chr", "site", "side", F.col("n").alias("support"))
    held = containing(points, spans, ["chr"], "site", ("g_start", "g_stop"))
    left, right = (held.filter(F.col("side") == s).select("chr", F.col("site").alias(s), "gene", "g_start", "support") for s in ("left", "right"))
    both = counts.join(left, ["chr", "left"]).select("chr", "left", "right", "gene", "g_start", "support").unionByName(counts.join(right, ["chr", "right"]).select("chr", "left", "right", "gene", "g_start", "support"))
    per = both.groupBy("chr", "left", "right", "gene").agg(F.min("g_start").alias("g_start"), F.count(F.lit(1)).alias("sites"), F.max("support").alias("support"))
    rank = F.struct((-F.col("sites")).alias("a"), F.when(F.col("sites") == 1, -F.col("support")).otherwise(0).alias("b"), F.col("g_start"), F.col("gene"))
    best = per.groupBy("chr", "left", "right").agg(F.sort_array(F.collect_list(rank)).alias("r"))
    out = counts.join(best, ["chr", "left", "right"], "left")
    others = F.array_sort(F.transform(F.slice("r", 2, F.greatest(F.size("r") - 1, F.lit(0))), lambda x: x.gene))
    return out.select("chr", "left", "right", "n", F.element_at("r", 1).gene.alias("primary_gene"), F.coalesce(F.array_join(others, ","), F.lit("")).alias("secondary_genes"))


def natural_order(name: Column | str) -> Column:
    """Sort key of chromosome names: by number, X 90, Y 91, M 99, others last."""
    bare = F.upper(F.regexp_replace(name, "^chr", ""))
    number = F.try_to_number(F.nullif(F.regexp_extract(bare, r"^(\d+)$", 1), F.lit("")), F.lit("999999999")).cast("int")
    return F.when(bare == "X", 90).when(bare == "Y", 91).when(bare.isin("M", "MT"), 99).otherwise(F.coalesce(number, F.lit(1000)))


def thin_neighbours(events: DataFrame, left_reach: int = 11, right_reach: int = 4) -> DataFrame:
    """Events without a better-supported neighbour.

    events: chr, left, right, n. An event is removed if another on the
    chromosome has its left side within ``left_reach`` and its right side
    within ``right_reach`` and more support, or as much and an earlier place.
    The self-join is on bins as wide as the reach, so each event meets only
    its own and the next bins.
    """
    bin_of = F.floor(F.col("left") / (left_reach + 1))
    own = events.withColumn("bin", bin_of)
    other = events.select("chr", F.col("left").alias("l2"), F.col("right").alias("r2"), F.col("n").alias("n2")).withColumn("bin", F.explode(F.array(*[F.floor(F.col("l2") / (left_reach + 1)) + d for d in (-1, 0, 1)])))
    better = (F.col("n2") > F.col("n")) | ((F.col("n2") == F.col("n")) & (F.struct("l2", "r2") < F.struct("left", "right")))
    near = (F.abs(F.col("l2") - F.col("left")) <= left_reach) & (F.abs(F.col("r2") - F.col("right")) <= right_reach) & ~((F.col("l2") == F.col("left")) & (F.col("r2") == F.col("right")))
    lost = own.alias("o").join(other, ["chr", "bin"]).filter(near & better).select("chr", "left", "right").distinct()
    return events.join(lost, ["chr", "left", "right"], "left_anti")


def known_junctions(exons: DataFrame, entity: list[str], start: str, stop: str) -> DataFrame:
    """Gaps between neighbouring exons of one entity, as junctions."""
    w = W.partitionBy(*entity).orderBy(start, stop)
    return exons.filter(F.col(start) <= F.col(stop)).withColumn("right", F.lead(start).over(w)).filter(F.col("right") > F.col(stop) + 1).select(*entity, F.col(stop).alias("left"), "right")


def anti_support(coverage: DataFrame, events: DataFrame, inset: int = 5) -> DataFrame:
    """Reads that vote against events: those whose covered stretch holds a
    side strictly within. coverage: read, chr, c_start, c_stop. Once a read
    and event: (chr, left, right, n_against).

    Votes are those for the left side and for the right less those for both,
    so they are counted and no pair of a read and an event is ever made.
    Equal stretches are added up first; what meets in a stretch of ``VOTE_BIN``
    positions is counted together.
    """
    first = lambda c: F.floor(F.col(c) / VOTE_BIN)
    whole = coverage.filter("chr is not null").groupBy("read", "chr").agg(F.min("c_start").alias("a"), F.max("c_stop").alias("z"))
    inner = whole.select("chr", (F.col("a") + inset).alias("p"), (F.col("z") - inset).alias("q")).filter("p <= q").groupBy("chr", "p", "q").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("long")
    stretches = inner.select("chr", F.explode(F.sequence(first("p"), first("q"))).alias("bin"), "p", "q", "n", none.alias("left"), none.alias("right"))
    l, r = (F.col(x).cast("long") for x in ("left", "right"))
    asked = F.array(*[F.struct(p.alias("p"), q.alias("q"), F.lit(n).cast("long").alias("n")) for p, q, n in ((l, l, 1), (r, r, 1), (F.least(l, r), F.greatest(l, r), -1))])
    asks = events.select("chr", l.alias("left"), r.alias("right"), F.explode(asked).alias("x")).select("chr", first("x.p").alias("bin"), "x.p", "x.q", "x.n", "left", "right")
    rows = stretches.unionByName(asks).repartition("chr", "bin").sortWithinPartitions("chr", "bin")
    counted = rows.mapInArrow(_holding, "chr string, left long, right long, n long")
    return counted.groupBy("chr", "left", "right").agg(F.sum("n").alias("n_against")).filter("n_against > 0")


VOTE_BIN = 1 << 16


def _holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signed numbers of stretches (p to q, n of them; left is null) that hold
    p to q of the asks (n is their sign) of the same chr and bin; rows come
    sorted by these."""
    held: list[pa.RecordBatch] = []
    size, due = 0, 400_000
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= due:
            t = pa.Table.from_batches(held).combine_chunks()
            # the last bin may go on in the next rows
            new = np.flatnonzero(_changes(t))
            cut = int(new[-1])
            if cut:
                yield from _held_counts(t.slice(0, cut))
            held, size = t.slice(cut).to_batches(), t.num_rows - cut
            due = max(400_000, 2 * size)
    if size:
        yield from _held_counts(pa.Table.from_batches(held).combine_chunks())


def _changes(t: pa.Table) -> np.ndarray:
    """Rows at which chr or bin is another than in the row before."""
    name = pc.dictionary_encode(t.column("chr").combine_chunks()).indices.to_numpy(zero_copy_only=False)
    at = t.column("bin").to_numpy()
    return np.concatenate([[True], (name[1:] != name[:-1]) | (at[1:] != at[:-1])])


def _held_counts(t: pa.Table) -> Iterator[pa.RecordBatch]:
    group = np.cumsum(_changes(t))
    ask = t.column("left").combine_chunks().is_valid().to_numpy(zero_copy_only=False)
    p, q, n = (t.column(c).to_numpy() for c in ("p", "q", "n"))
    s, a = np.flatnonzero(~ask), np.flatnonzero(ask)
    if not len(s) or not len(a):
        return
    s = s[np.lexsort((p[s], group[s]))]
    # stretches of the group that begin at or before p lie between lo and hi
    low, span = p.min(), int(p.max() - p.min()) + 1
    key = group * span + p - low
    lo, hi = np.searchsorted(group[s], group[a]), np.searchsorted(key[s], key[a], "right")
    ends = np.unique(q[s])
    total = count_from(np.searchsorted(ends, q[s]), n[s], lo, hi, np.searchsorted(ends, q[a])) * n[a]
    take = pa.array(a[total != 0])
    if len(take):
        own = t.select(["chr", "left", "right"]).take(take).combine_chunks()
        yield pa.RecordBatch.from_arrays([*[own.column(c).combine_chunks() for c in range(3)], pa.array(total[total != 0])], names=["chr", "left", "right", "n"])


def count_from(ranks: np.ndarray, weights: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Weights of the places lo to hi - 1 whose rank is ``least`` or more, of
    many questions at once: ranks are parted bit by bit, highest first, and
    places follow their part (a wavelet matrix)."""
    bits = max(1, int(max(ranks.max(initial=0), least.max(initial=0))).bit_length())
    out, lo, hi = np.zeros(len(lo), np.int64), lo.copy(), hi.copy()
    for b in range(bits - 1, -1, -1):
        one = (ranks >> b & 1).astype(bool)
        ones = np.concatenate([[0], np.cumsum(one)])
        weight = np.concatenate([[0], np.cumsum(np.where(one, weights, 0))])
        high = (least >> b & 1).astype(bool)
        out += np.where(high, 0, weight[hi] - weight[lo])
        zeros = len(ranks) - int(ones[-1])
        lo, hi = (np.where(high, zeros + ones[x], x - ones[x]) for x in (lo, hi))
        order = np.concatenate([np.flatnonzero(~one), np.flatnonzero(one)])
        ranks, weights = ranks[order], weights[order]
    rest = np.concatenate([[0], np.cumsum(weights)])
    return out + rest[hi] - rest[lo]
