"""Interval joins, coverage of positions, and cutting at edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.functions.sequence import called_bases, gc_bases
from seqloom.session import materialize

BIN = 1 << 14


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], left_span: tuple[str, str], right_span: tuple[str, str], bin_size: int = BIN) -> DataFrame:
    """Pairs of rows equal in ``on`` whose inclusive intervals overlap.

    Both sides are spread over the bins they touch and joined on (``on``, bin);
    of the bins a pair shares only the later of the two first bins keeps it,
    so no pair comes twice and nothing is de-duplicated afterwards. Spark picks
    the join: a small side is broadcast, otherwise both are shuffled on the
    bin, which also parts a crowded chromosome. Columns other than ``on`` must
    not clash. Null positions match nothing.
    """
    a, z = left_span
    x, y = right_span
    first = lambda c: F.floor(F.col(c) / bin_size)
    spread = lambda df, lo, hi: df.filter(F.col(lo) <= F.col(hi)).withColumn("_bin", F.explode(F.sequence(first(lo), first(hi))))
    joined = spread(left, a, z).join(spread(right, x, y), [*on, "_bin"])
    return joined.filter((F.col(x) <= F.col(z)) & (F.col(y) >= F.col(a)) & (F.col("_bin") == F.greatest(first(a), first(x)))).drop("_bin")


def containing(points: DataFrame, spans: DataFrame, on: list[str], point: str, span: tuple[str, str], bin_size: int = BIN) -> DataFrame:
    """Pairs of a point and a span that holds it; points lie in one bin each."""
    x, y = span
    binned = spans.filter(F.col(x) <= F.col(y)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(x) / bin_size), F.floor(F.col(y) / bin_size))))
    return points.withColumn("_bin", F.floor(F.col(point) / bin_size)).join(binned, [*on, "_bin"]).filter(F.col(point).between(F.col(x), F.col(y))).drop("_bin")


def union_length(spans: Column) -> Column:
    """Positions covered by an array of struct<a, z> (inclusive, disjoint or not)."""
    state = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("top"))

    def step(s: Column, x: Column) -> Column:
        fresh = F.greatest(F.lit(0).cast("bigint"), x["z"] - F.greatest(x["a"] - 1, F.coalesce(s["top"], x["a"] - 1)))
        return F.struct((s["n"] + fresh).alias("n"), F.greatest(s["top"], x["z"]).alias("top"))

    return F.aggregate(F.array_sort(spans), state, step, lambda s: s["n"])


def _edges(df: DataFrame, keys: list[str], start: str, stop: str) -> DataFrame:
    """(keys, at, d): by how much the depth changes at each edge."""
    rows = df.filter(F.col(start) <= F.col(stop)).select(*keys, F.explode(F.array(F.struct(F.col(start).cast("long").alias("at"), F.lit(1).alias("d")), F.struct((F.col(stop) + 1).cast("long").alias("at"), F.lit(-1).alias("d")))).alias("e"))
    return rows.groupBy(*keys, F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d"))


def chopped(df: DataFrame, keys: list[str], start: str, stop: str) -> DataFrame:
    """Every entity's covered positions cut at all edges of its intervals:
    (keys, seg_start, seg_stop, depth), depth being the intervals on a piece.
    Entities are genes and the like, each the work of one task; for
    chromosomes see ``coverage_runs``."""
    w = W.partitionBy(*keys).orderBy("at")
    cut = _edges(df, keys, start, stop).withColumn("depth", F.sum("d").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("next", F.lead("at").over(w))
    return cut.filter("depth > 0").select(*keys, F.col("at").alias("seg_start"), (F.col("next") - 1).alias("seg_stop"), "depth")


BAND = 1 << 20


def coverage_runs(df: DataFrame, keys: list[str], start: str, stop: str) -> DataFrame:
    """Depth of coverage as runs of equal depth, from differences at the edges
    (one row an edge, however long the intervals): (keys, run_start, run_stop, depth).

    A key is parted into bands of positions: the depth runs on within a band,
    and what it is when the band begins comes from the sums of the bands
    before, one row a band. Edges at which nothing changes part no runs."""
    edges = materialize(_edges(df, keys, start, stop).filter("d <> 0").withColumn("_band", F.floor(F.col("at") / BAND)))
    ahead = W.partitionBy(*keys).orderBy("_band")
    bands = edges.groupBy(*keys, "_band").agg(F.sum("d").alias("d"), F.min("at").alias("first"))
    bands = bands.select(*[F.col(c).alias(f"_{c}") for c in keys], F.col("_band").alias("_b"), F.coalesce(F.sum("d").over(ahead.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_carry"), F.lead("first").over(ahead).alias("_after"))
    same = F.col("_band") == F.col("_b")
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    w = W.partitionBy(*keys, "_band").orderBy("at")
    cut = edges.withColumn("_depth", F.sum("d").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_next", F.lead("at").over(w)).join(bands, same)
    depth = F.col("_depth") + F.col("_carry")
    return cut.filter(depth > 0).select(*keys, F.col("at").alias("run_start"), (F.coalesce("_next", "_after") - 1).alias("run_stop"), depth.alias("depth"))


def joined_spans(spans: Column) -> Column:
    """An array of struct<chr, start, stop> as disjoint spans in order; touching
    ones become one. Spans of a null chromosome are left out."""
    one = "struct<chr:string,start:bigint,stop:bigint>"
    sorted_ = F.array_sort(F.filter(spans, lambda x: x["chr"].isNotNull()))
    state = F.struct(F.array().cast(f"array<{one}>").alias("out"), F.lit(None).cast(one).alias("top"))

    def step(s: Column, x: Column) -> Column:
        meets = (s["top"]["chr"] == x["chr"]) & (x["start"] <= s["top"]["stop"] + 1)
        grown = F.struct(x["chr"].alias("chr"), s["top"]["start"].alias("start"), F.greatest(s["top"]["stop"], x["stop"]).alias("stop")).cast(one)
        out = F.when(meets | s["top"].isNull(), s["out"]).otherwise(F.array_append(s["out"], s["top"]))
        return F.struct(out.alias("out"), F.when(meets, grown).otherwise(x.cast(one)).alias("top"))

    return F.aggregate(sorted_, state, step, lambda s: F.when(s["top"].isNull(), s["out"]).otherwise(F.array_append(s["out"], s["top"])))


def binned_coverage(runs: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Covered bases (depth times length) in bins of ``size`` positions, from
    runs of equal depth: (keys, bin, bases). A run is spread over the bins it
    touches and not over its positions."""
    at = runs.withColumn("bin", F.explode(F.sequence(F.floor(F.col("run_start") / size), F.floor(F.col("run_stop") / size))))
    part = F.least(F.col("run_stop"), F.col("bin") * size + size - 1) - F.greatest(F.col("run_start"), F.col("bin") * size) + 1
    return at.groupBy(*keys, "bin").agg(F.sum(part * F.col("depth")).alias("bases"))


def span_gc(spans: DataFrame, blocks: DataFrame, on: list[str], start: str, stop: str) -> DataFrame:
    """gc and called bases of the parts of spans that lie in blocks; blocks:
    ``on``, b_start, b_stop, letters. One row a span and block that overlap."""
    met = overlap_join(spans, blocks, on, (start, stop), ("b_start", "b_stop"))
    lo, hi = F.greatest(F.col(start), F.col("b_start")), F.least(F.col(stop), F.col("b_stop"))
    part = F.substring(F.col("letters"), (lo - F.col("b_start") + 1).cast("int"), (hi - lo + 1).cast("int"))
    return met.withColumn("_part", part).withColumn("gc", gc_bases("_part")).withColumn("called", called_bases("_part")).drop("_part", "letters")


def gap_bins(gaps: DataFrame, start: str, stop: str, size: int = 2000) -> DataFrame:
    """Gaps cut into bins of ``size`` from their start (the last may be short)."""
    n = F.floor((F.col(stop) - F.col(start)) / size)
    out = gaps.filter(F.col(start) <= F.col(stop)).withColumn("bin_no", F.explode(F.sequence(F.lit(0).cast("long"), n)))
    lo = F.col(start) + F.col("bin_no") * size
    return out.withColumn("bin_start", lo).withColumn("bin_stop", F.least(F.col(stop), lo + size - 1))


def shifted(start: Column, stop: Column, minus: Column, shift: int = 0, kind: str = "downstream", five: int = 0, three: int = 0, reduce_to: int = 0, top: Column | None = None) -> tuple[Column, Column]:
    """A read's span moved, lengthened and maybe reduced to one end.

    kind: ``downstream``/``upstream`` (along the strand) or ``right``/``left``;
    five and three lengthen the span at the 5' and 3' end; reduce_to 5 or 3
    keeps only that end's base. All stay within 1 and ``top``.
    """
    sign = {"downstream": 1, "upstream": -1, "right": 1, "left": -1}[kind]
    move = F.when(minus, -sign * shift).otherwise(sign * shift) if kind in ("downstream", "upstream") else F.lit(sign * shift)
    held = (lambda c: F.greatest(F.lit(1), F.least(c, top))) if top is not None else (lambda c: F.greatest(F.lit(1), c))
    a, z = held(start + move), held(stop + move)
    a, z = held(a - F.when(minus, three).otherwise(five)), held(z + F.when(minus, five).otherwise(three))
    if reduce_to:
        at = F.when(minus, z if reduce_to == 5 else a).otherwise(a if reduce_to == 5 else z)
        return at, at
    return a, z


def promoter_spans(genes: DataFrame, start: str, stop: str, strand: str, upstream: int, downstream: int) -> DataFrame:
    """Span around each gene's transcription start, along its strand."""
    minus = F.col(strand) == "-"
    tss = F.when(minus, F.col(stop)).otherwise(F.col(start))
    lo = F.greatest(F.lit(1), tss - F.when(minus, downstream).otherwise(upstream))
    return genes.withColumn("promoter_start", lo).withColumn("promoter_stop", tss + F.when(minus, upstream).otherwise(downstream))
