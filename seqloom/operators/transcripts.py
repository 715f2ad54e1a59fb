"""Exons of genes and transcripts: flattening, unique bases, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.intervals import chopped, gap_bins
from seqloom.operators.periods import merge_intervals


def flatten(exons: DataFrame, gene: list[str], start: str, stop: str, chop: bool = False) -> DataFrame:
    """Each gene's exons merged into disjoint ones, or chopped at all edges."""
    if chop:
        return chopped(exons, gene, start, stop).drop("depth")
    return merge_intervals(exons, gene, start, stop).filter("seg_kind = 'period'").drop("seg_kind")


def unique_bases(exons: DataFrame, transcript: str, gene: list[str], start: str, stop: str) -> DataFrame:
    """(transcript, gene..., unique, total): bases of each transcript, and of
    them those that no other transcript of its gene covers."""
    flat = merge_intervals(exons, [transcript, *gene], start, stop).filter("seg_kind = 'period'")
    pieces = chopped(flat, gene, "seg_start", "seg_stop").filter("depth = 1").select(*[F.col(g).alias(f"_{i}") for i, g in enumerate(gene)], F.col("seg_start").alias("p_start"), F.col("seg_stop").alias("p_stop"))
    on = [flat[g].eqNullSafe(F.col(f"_{i}")) for i, g in enumerate(gene)]
    # a piece of depth 1 lies in exactly one transcript's stretch
    own = flat.join(pieces, [*on, F.col("p_start") >= F.col("seg_start"), F.col("p_stop") <= F.col("seg_stop")]).groupBy(transcript, *gene).agg(F.sum(F.col("p_stop") - F.col("p_start") + 1).alias("n"))
    total = flat.groupBy(transcript, *gene).agg(F.sum(F.col("seg_stop") - F.col("seg_start") + 1).alias("total_bases"))
    right = own.toDF(*[f"r_{c}" for c in own.columns])
    cond = F.lit(True)
    for c in [transcript, *gene]:
        cond = cond & total[c].eqNullSafe(right[f"r_{c}"])
    return total.join(right, cond, "left").select(transcript, *gene, F.coalesce("r_n", F.lit(0)).alias("unique_bases"), "total_bases")


def detection_regions(genes: DataFrame, chr: str, start: str, stop: str, size: int = 2000) -> DataFrame:
    """Bins of ``size`` in the stretches between genes: (chr, bin_start, bin_stop)."""
    gaps = merge_intervals(genes, [chr], start, stop).filter("seg_kind = 'gap'")
    return gap_bins(gaps, "seg_start", "seg_stop", size).select(chr, "bin_start", "bin_stop")
