"""Assigning reads or fragments to features and genes.

Filters give every fragment at most one status, in a fixed order; the rest is
joined to the features it overlaps, scored per target, and the targets of the
greatest score win. Counts are whole numbers of 1/65536 read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.functions import flags as fl
from seqloom.functions.cigar import is_split
from seqloom.operators.intervals import overlap_join, shifted, union_length

UNIT = 65536
# The statuses of a fragment, in the order they are reported.
STATUSES = (
    "Assigned", "Unassigned_Unmapped", "Unassigned_Read_Type", "Unassigned_Singleton", "Unassigned_MappingQuality", "Unassigned_Chimera", "Unassigned_FragmentLength",
    "Unassigned_Duplicate", "Unassigned_MultiMapping", "Unassigned_Secondary", "Unassigned_NonSplit", "Unassigned_Split", "Unassigned_NoFeatures", "Unassigned_Overlapping_Length", "Unassigned_Ambiguity",
)


@dataclass(frozen=True)
class Options:
    """How fragments are filtered, matched and counted."""

    paired: bool = False
    feature_level: bool = False
    strand: int = 0
    allow_overlap: bool = False
    multi_mapping: bool = False
    primary_only: bool = False
    fraction: bool = False
    min_mapq: int = 0
    both_mapped: bool = False
    check_length: bool = False
    least_length: int = 50
    most_length: int = 600
    no_chimera: bool = False
    ignore_duplicates: bool = False
    split: str = ""  # "only" or "none"
    min_overlap: int = 1
    frac_overlap: float = 0.0
    frac_overlap_feature: float = 0.0
    non_overlap: int | None = None
    non_overlap_feature: int | None = None
    largest_overlap: bool = False
    shift: int = 0
    shift_kind: str = "downstream"
    extend_five: int = 0
    extend_three: int = 0
    reduce_to: int = 0

    @property
    def measures(self) -> bool:
        return self.min_overlap > 1 or self.frac_overlap > 0 or self.frac_overlap_feature > 0 or self.largest_overlap or self.non_overlap is not None or self.non_overlap_feature is not None


def filter_status(o: Options) -> Column:
    """First filter a fragment (columns r1, r2) fails, or null. Mate 1 goes
    through all rules before mate 2."""
    r1, r2 = F.col("r1"), F.col("r2")
    both = r1.isNotNull() & r2.isNotNull()
    paired = F.coalesce(fl.has(F.coalesce(r1["flag"], r2["flag"]), fl.PAIRED), F.lit(False)) if o.paired else F.lit(False)
    head = F.coalesce(r1["flag"], r2["flag"])
    unmapped = fl.has(head, fl.UNMAPPED) & (fl.has(head, fl.MATE_UNMAPPED) if o.paired else F.lit(True)) if o.paired else fl.has(head, fl.UNMAPPED)
    rules: list[tuple[Column, str]] = [(unmapped, "Unmapped")]
    if o.paired and o.both_mapped:
        rules.append((~paired | fl.has(head, fl.UNMAPPED) | fl.has(head, fl.MATE_UNMAPPED), "Singleton"))
    if o.min_mapq:
        best = F.greatest(F.coalesce(r1["mapq"], F.lit(0)), F.coalesce(r2["mapq"], F.lit(0))) if o.paired else F.coalesce(r1["mapq"], r2["mapq"], F.lit(0))
        rules.append((best < o.min_mapq, "MappingQuality"))
    if o.paired and (o.check_length or o.no_chimera):
        mapped = both & ~fl.has(r1["flag"], fl.UNMAPPED) & ~fl.has(r2["flag"], fl.UNMAPPED)
        fits = (r1["chr"] == r2["chr"]) & (fl.has(r1["flag"], fl.REVERSE) != fl.has(r2["flag"], fl.REVERSE))
        if o.check_length:
            rules.append((mapped & fits & ~F.abs(r1["tlen"]).between(o.least_length, o.most_length), "FragmentLength"))
        if o.no_chimera:
            rules.append((mapped & ~fits, "Chimera"))
    any_of = lambda test: F.coalesce(test(r1), F.lit(False)) | F.coalesce(test(r2), F.lit(False))
    live = lambda r: r.isNotNull() & ~fl.has(r["flag"], fl.UNMAPPED)
    if o.ignore_duplicates:
        rules.append((any_of(lambda r: fl.has(r["flag"], fl.DUPLICATE)), "Duplicate"))
    if not o.multi_mapping:
        rules.append((any_of(lambda r: live(r) & (r["nh"] > 1)), "MultiMapping"))
    if o.primary_only:
        rules.append((any_of(lambda r: live(r) & fl.has(r["flag"], fl.SECONDARY)), "Secondary"))
    if o.split == "only":
        rules.append((~any_of(lambda r: live(r) & is_split(r["cigar"])), "NonSplit"))
    if o.split == "none":
        rules.append((any_of(lambda r: live(r) & is_split(r["cigar"])), "Split"))
    out = F.lit(None).cast("string")
    for test, name in reversed(rules):
        out = F.when(test, f"Unassigned_{name}").otherwise(out)
    return out


def _ceil(x: Column) -> Column:
    """Whole numbers stay although a product of floats may be a little above."""
    return (F.floor(x) + (x - F.floor(x) >= 0.001).cast("int")).cast("long")


def assign(fragments: DataFrame, features: DataFrame, o: Options = Options()) -> DataFrame:
    """(frag, status, targets, increment) of every fragment.

    fragments: frag (unique), r1, r2 (structs with flag, chr, pos, mapq,
    cigar, nh, tlen, sections; either may be null). features: feature_id
    (unique), gene, chr, start, stop, strand (0 plus, 1 minus, -1 unknown).
    targets are gene names, or feature ids as text; increment is what each of
    them gets, in 1/65536.
    """
    judged = fragments.withColumn("status", filter_status(o))
    found = _winners(judged, features, o).select("frag", "top", "won")
    out = judged.select("frag", "r1", "r2", "status").join(found, "frag", "left")
    n = F.size("won")
    status = F.coalesce("status", F.when(F.col("won").isNull(), "Unassigned_NoFeatures").when(F.col("top") == 0, "Unassigned_Overlapping_Length").when((n > 1) & F.lit(not o.allow_overlap), "Unassigned_Ambiguity").otherwise("Assigned"))
    nh = F.greatest(F.coalesce(F.col("r1.nh"), F.lit(1)), F.coalesce(F.col("r2.nh"), F.lit(1)), F.lit(1))
    done = status == "Assigned"
    return out.select("frag", status.alias("status"), F.when(done, F.col("won")).alias("targets"), F.when(done, _increment(nh, n, o)).alias("increment"))


def count_targets(fragments: DataFrame, features: DataFrame, o: Options = Options()) -> DataFrame:
    """The same as ``target_counts(assign(...))``, for when the statuses aren't
    wanted: fragments are read once and those without hits go no further."""
    won = _winners(fragments.withColumn("status", filter_status(o)), features, o).filter("top > 0")
    if not o.allow_overlap:
        won = won.filter(F.size("won") == 1)
    return won.select(F.explode("won").alias("target"), _increment(F.greatest("nh", F.lit(1)), F.size("won"), o).alias("increment")).groupBy("target").agg(F.sum("increment").alias("count65536"))


def _increment(nh: Column, n: Column, o: Options) -> Column:
    unit = F.floor(F.lit(UNIT) / nh) if o.fraction and not o.primary_only else F.lit(UNIT)
    return (F.floor(unit / n) if o.allow_overlap and o.fraction else unit).cast("long")


def _winners(judged: DataFrame, features: DataFrame, o: Options) -> DataFrame:
    """(frag, nh, top, won): targets of the greatest score of every fragment
    with hits. Hits are shuffled once, by fragment."""
    go = judged.filter("status is null")
    nh = F.greatest(F.coalesce(F.col("r1.nh"), F.lit(1)), F.coalesce(F.col("r2.nh"), F.lit(1))).alias("nh")
    mates = go.select("frag", nh, F.explode(F.filter(F.array(F.struct(F.lit(1).alias("mate"), F.col("r1").alias("r")), F.struct(F.lit(2).alias("mate"), F.col("r2").alias("r"))), lambda x: x.r.isNotNull() & ~fl.has(x.r.flag, fl.UNMAPPED))).alias("m"))
    parts = mates.select("frag", "nh", "m.mate", F.col("m.r.chr").alias("chr"), fl.fragment_strand(F.col("m.r.flag")).alias("read_strand"), fl.has(F.col("m.r.flag"), fl.REVERSE).alias("minus"), F.explode("m.r.sections").alias("s")).select("frag", "nh", "mate", "chr", "read_strand", "minus", F.col("s.start").alias("sec_start"), F.col("s.stop").alias("sec_stop"))
    extra = 1 - o.min_overlap if o.min_overlap < 1 else 0
    if o.shift or o.extend_five or o.extend_three or o.reduce_to or extra:
        lo, hi = shifted(F.col("sec_start"), F.col("sec_stop"), F.col("minus"), o.shift, o.shift_kind, o.extend_five + extra, o.extend_three + extra, o.reduce_to)
        parts = parts.withColumn("_lo", lo).withColumn("_hi", hi).select("frag", "nh", "mate", "chr", "read_strand", F.col("_lo").alias("sec_start"), F.col("_hi").alias("sec_stop"))
    target = F.col("feature_id").cast("string") if o.feature_level else F.col("gene")
    fe = features.select("feature_id", target.alias("target"), "chr", F.col("start").alias("f_start"), F.col("stop").alias("f_stop"), F.col("strand").alias("f_strand"))
    hits = overlap_join(parts, fe, ["chr"], ("sec_start", "sec_stop"), ("f_start", "f_stop"))
    if o.strand:
        same = F.col("read_strand") == F.col("f_strand")
        hits = hits.filter(same if o.strand == 1 else ~same)
    hit = hits.select("frag", "nh", "mate", "target", "feature_id", "f_start", "f_stop", F.greatest("sec_start", "f_start").alias("a"), F.least("sec_stop", "f_stop").alias("z"))
    n_mates = F.bit_count(F.bit_or(F.col("mate"))).alias("mates")  # mates are 1 and 2, so their bits differ
    if o.measures:
        if o.frac_overlap_feature > 0 or o.non_overlap_feature is not None:
            own = hit.groupBy("frag", "feature_id", "f_start", "f_stop").agg(union_length(F.collect_list(F.struct("a", "z"))).alias("n"))
            span = F.col("f_stop") - F.col("f_start") + 1
            least = F.greatest(_ceil(span * F.lit(o.frac_overlap_feature)), span - o.non_overlap_feature if o.non_overlap_feature is not None else F.lit(0))
            hit = hit.join(own.filter(F.col("n") >= least).select("frag", "feature_id"), ["frag", "feature_id"], "left_semi")
        scored = hit.repartition("frag").groupBy("frag", "nh", "target").agg(n_mates, union_length(F.collect_list(F.struct("a", "z"))).alias("bases"))
        if o.frac_overlap > 0 or o.non_overlap is not None:
            length = parts.groupBy("frag").agg(union_length(F.collect_list(F.struct(F.col("sec_start").alias("a"), F.col("sec_stop").alias("z")))).alias("length"))
            scored = scored.join(length, "frag")
        else:
            scored = scored.withColumn("length", F.lit(0))
        votes = F.when(F.col("mates") > 1, 1).otherwise(0) + 2 * F.col("bases") if o.largest_overlap else F.lit(1) if o.allow_overlap else F.col("mates")
        least = F.greatest(F.lit(max(1, o.min_overlap)).cast("long"), _ceil(F.col("length") * F.lit(o.frac_overlap)), F.col("length") - o.non_overlap if o.non_overlap is not None else F.lit(0).cast("long"))
        scored = scored.withColumn("score", F.when(F.col("bases") >= least, votes).otherwise(0))
    else:
        scored = hit.select("frag", "nh", "mate", "target").repartition("frag").groupBy("frag", "nh", "target").agg(n_mates).withColumn("score", F.lit(1) if o.allow_overlap else F.col("mates"))
    top = scored.groupBy("frag", "nh").agg(F.max("score").alias("top"), F.sort_array(F.collect_list(F.struct("score", "target"))).alias("all"))
    winners = F.transform(F.filter("all", lambda x: x.score == F.col("top")), lambda x: x.target)
    return top.select("frag", "nh", "top", winners.alias("won"))


def target_counts(assigned: DataFrame) -> DataFrame:
    """(target, count65536), one row a target with any count."""
    return assigned.filter("status = 'Assigned'").select(F.explode("targets").alias("target"), "increment").groupBy("target").agg(F.sum("increment").alias("count65536"))


def summary(assigned: DataFrame) -> DataFrame:
    """(status, n) for all statuses, 0 where there is none."""
    spark = assigned.sparkSession
    names = spark.createDataFrame([(i, s) for i, s in enumerate(STATUSES)], "no int, status string")
    return names.join(assigned.groupBy("status").agg(F.count(F.lit(1)).alias("c")), "status", "left").select("status", F.coalesce("c", F.lit(0)).alias("n"))


def printed(count: Column) -> Column:
    """A count of 1/65536 as text: whole, or with two decimals."""
    return F.when(count % UNIT == 0, F.floor(count / UNIT).cast("string")).otherwise(F.format_string("%.2f", count / UNIT))


def gene_lengths(features: DataFrame) -> DataFrame:
    """Union length of each gene's features, per chromosome and strand, summed."""
    w = W.partitionBy("gene", "chr", "strand").orderBy("start", "stop").rowsBetween(W.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest(F.col("start") - 1, F.coalesce(F.max("stop").over(w), F.col("start") - 1)))
    return features.withColumn("fresh", fresh).groupBy("gene").agg(F.sum("fresh").cast("long").alias("length"))


MOST_NAMES = 100_000  # names of chromosomes that are sent to all tasks; with more the names are joined


def chromosome_names(names: DataFrame, alias: DataFrame) -> DataFrame:
    """(read_name, chr): every spelling that stands for a name of the
    annotation, made from the annotation's names and the aliases alone: the
    name itself, its aliases, the name after ``chr``, and a name of at most two
    letters without its ``chr``; of several meanings the first of these."""
    known = names.toDF("n").filter("n is not null").distinct()
    bare = F.expr("substring(n, 4)")
    spelt = known.select("n", F.posexplode(F.array("n", F.lit(None), F.concat(F.lit("chr"), "n"), F.when(F.col("n").startswith("chr") & (F.length(bare) <= 2), bare))))
    by_alias = alias.select(F.col("annotation_chr").alias("n"), F.lit(1).alias("pos"), F.col("read_chr").alias("col")).join(known, "n", "left_semi")
    return spelt.unionByName(by_alias).filter("col is not null").groupBy(F.col("col").alias("read_name")).agg(F.min_by("n", F.struct("pos", "n")).alias("chr"))


def resolve_chromosomes(df: DataFrame, columns: dict[str, str], names: DataFrame, alias: DataFrame) -> DataFrame:
    """Adds for each column of chromosome names (key) the annotation's name
    (value), null if none is known. names: one column; alias: annotation_chr,
    read_chr. The map of names is sent to all tasks if it is small."""
    known = chromosome_names(names, alias)
    few = known.limit(MOST_NAMES + 1).collect()
    if len(few) <= MOST_NAMES:
        known = F.broadcast(df.sparkSession.createDataFrame(few, "read_name string, chr string"))
    for column, out in columns.items():
        df = df.join(known.select(F.col("read_name").alias(f"_{out}"), F.col("chr").alias(out)), df[column] == F.col(f"_{out}"), "left").drop(f"_{out}")
    return df
