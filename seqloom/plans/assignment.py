"""Queries of read assignment, pairing and alignment sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import flags as fl
from seqloom.functions.cigar import covered_bases, is_split, leading_clip, left_end, reference_span, reversed_cigar, sections
from seqloom.operators import assign as asg
from seqloom.operators.assign import Options
from seqloom.operators.pairing import fragment_name, mapped_share, pair_mates, with_dummies
from seqloom.plans.general import table

COLUMNS = ["row_id", "flag", "chr", "pos", "mapq", "cigar", "nh", "tlen", "sections", "sample_id"]


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """alignments with chr (the annotation's name), own_chr and mate_chr (the
    same of both mates, as given where it isn't known), nh and sections."""
    al = table(spark, sf_dir, "alignments").select("row_id", "qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "tags", "sample_id")
    known = asg.resolve_chromosomes(al, {"rname": "chr", "rnext": "_mate"}, table(spark, sf_dir, "genes").select("chro_name"), table(spark, sf_dir, "chr_alias"))
    own = F.coalesce("chr", "rname")
    mate = F.when(F.col("rnext") == "=", own).otherwise(F.coalesce("_mate", "rnext"))
    return known.withColumn("own_chr", own).withColumn("mate_chr", mate).drop("_mate").withColumn("nh", fl.hits("tags")).withColumn("sections", sections("pos", "cigar"))


def pairs(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    return pair_mates(reads(spark, sf_dir), columns, "own_chr", "mate_chr")


def fragments(spark: SparkSession, sf_dir: str, paired: bool) -> DataFrame:
    if not paired:
        r = F.struct(*COLUMNS)
        return reads(spark, sf_dir).select(F.col("row_id").alias("frag"), r.alias("r1"), F.when(F.lit(False), r).alias("r2"))
    return pairs(spark, sf_dir, COLUMNS).select(F.least("r1.row_id", "r2.row_id").alias("frag"), "r1", "r2")


def gene_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "genes")
    strand = F.when(F.col("strand") == "+", 0).when(F.col("strand") == "-", 1).otherwise(-1)
    return g.select(F.col("gene_name").alias("feature_id"), F.col("gene_name").alias("gene"), F.col("chro_name").alias("chr"), F.col("start_pos").alias("start"), F.col("end_pos").alias("stop"), strand.alias("strand"))


def exon_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "tx_exons").filter("exon_start <= exon_stop and chro_name is not null")
    return e.select(F.col("exon_id").alias("feature_id"), F.col("gene_name").alias("gene"), F.col("chro_name").alias("chr"), F.col("exon_start").alias("start"), F.col("exon_stop").alias("stop"), F.col("is_negative_strand").alias("strand"))


#: name: (features, options)
VARIANTS: dict[str, tuple[str, Options]] = {
    "a1_gene_counts": ("genes", Options()),
    "a1_fragment_counts": ("genes", Options(paired=True)),
    "a1_exon_counts": ("exons", Options(feature_level=True, allow_overlap=True)),
    "a1_stranded": ("genes", Options(paired=True, strand=1)),
    "a1_reversely_stranded": ("genes", Options(paired=True, strand=2)),
    "a1_overlap_fraction": ("exons", Options(allow_overlap=True, multi_mapping=True, fraction=True)),
    "a1_min_overlap": ("genes", Options(paired=True, min_overlap=125)),
    "a1_frac_overlap": ("exons", Options(frac_overlap=0.62, allow_overlap=True)),
    "a1_frac_overlap_feature": ("exons", Options(frac_overlap_feature=0.3, allow_overlap=True)),
    "a1_largest_overlap": ("exons", Options(paired=True, largest_overlap=True)),
    "a1_non_overlap": ("exons", Options(non_overlap=20)),
    "a1_five_prime_base": ("exons", Options(reduce_to=5, allow_overlap=True)),
    "a1_extended": ("exons", Options(extend_five=30, extend_three=12, allow_overlap=True)),
    "a1_shifted": ("exons", Options(shift=40, shift_kind="upstream", allow_overlap=True)),
    "f_all_filters": ("genes", Options(paired=True, min_mapq=20, both_mapped=True, check_length=True, no_chimera=True, ignore_duplicates=True)),
    "f_primary_split_only": ("genes", Options(multi_mapping=True, primary_only=True, split="only")),
    "f_non_split": ("genes", Options(split="none", ignore_duplicates=True, min_mapq=10)),
}


def _assigned(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    kind, o = VARIANTS[name]
    features = gene_features(spark, sf_dir) if kind == "genes" else exon_features(spark, sf_dir)
    return asg.assign(fragments(spark, sf_dir, o.paired), features, o)


def _counts(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        kind, o = VARIANTS[name]
        features = gene_features(spark, sf_dir) if kind == "genes" else exon_features(spark, sf_dir)
        return asg.count_targets(fragments(spark, sf_dir, o.paired), features, o)

    return query


def _summary(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return asg.summary(_assigned(spark, sf_dir, name))

    return query


def k5_read_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per read: status, number of targets and the targets."""
    a = _assigned(spark, sf_dir, "a1_exon_counts")
    return a.select("frag", "status", F.coalesce(F.size("targets"), F.lit(0)).cast("long").alias("n_targets"), F.coalesce(F.array_join("targets", ","), F.lit("NA")).alias("target_list"))


def k1_gene_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gene, union length of its exons, and counts of every sample there is
    side by side; reads without a sample are in none of the columns."""
    feats = exon_features(spark, sf_dir)
    a = asg.assign(fragments(spark, sf_dir, False), feats, Options(allow_overlap=True))
    samples = table(spark, sf_dir, "alignments").select(F.col("row_id").alias("frag"), "sample_id")
    names = _samples(samples)
    per = a.filter("status = 'Assigned'").join(samples, "frag").select(F.explode("targets").alias("gene"), "sample_id", "increment")
    wide = per.groupBy("gene").pivot("sample_id", names).agg(F.sum("increment"))
    return asg.gene_lengths(feats).join(wide, "gene", "left").select("gene", "length", *[(F.coalesce(c, F.lit(0)) / asg.UNIT).cast("long").alias(c) for c in names])


MOST_SAMPLES = 10_000


def _samples(df: DataFrame) -> list[str]:
    """The samples there are, in order; each becomes a column."""
    names = [r.sample_id for r in df.select("sample_id").filter("sample_id is not null").distinct().limit(MOST_SAMPLES + 1).collect()]
    if len(names) > MOST_SAMPLES:
        raise ValueError(f"more than {MOST_SAMPLES} samples: take k1_sample_counts, which has a row a sample")
    return sorted(names)


def k1_sample_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gene, union length of its exons, and counts in every sample there is, a
    row each; reads without a sample are one of their own."""
    feats = exon_features(spark, sf_dir)
    a = asg.assign(fragments(spark, sf_dir, False), feats, Options(allow_overlap=True))
    al = table(spark, sf_dir, "alignments")
    per = a.filter("status = 'Assigned'").join(al.select(F.col("row_id").alias("frag"), "sample_id"), "frag").select(F.explode("targets").alias("gene"), F.col("sample_id").alias("sample"), "increment")
    counts = per.groupBy("gene", "sample").agg(F.sum("increment").alias("n")).withColumnRenamed("gene", "g")
    cells = asg.gene_lengths(feats).crossJoin(al.select("sample_id").distinct())
    both = cells.join(counts, (F.col("gene") == F.col("g")) & F.col("sample_id").eqNullSafe(F.col("sample")), "left")
    return both.select("gene", "length", "sample_id", (F.coalesce("n", F.lit(0)) / asg.UNIT).cast("long").alias("n"))


def a4_gene_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asg.gene_lengths(exon_features(spark, sf_dir))


def p1c_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "alignments").select("row_id", F.posexplode(sections("pos", "cigar")))
    return s.select("row_id", F.col("pos").cast("long").alias("section_no"), "col.start", "col.stop", "col.read_start", "col.before")


def p_cigar_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    al = table(spark, sf_dir, "alignments")
    right = F.col("pos") + reference_span("cigar") - 1
    return al.select("row_id", covered_bases("cigar").alias("covered"), reference_span("cigar").alias("span"), leading_clip("cigar").alias("clip"), is_split("cigar").alias("split"), reversed_cigar("cigar").alias("reversed"), left_end(right, "cigar").alias("left_end"))


def p_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    al = table(spark, sf_dir, "alignments")
    return al.groupBy("flag").agg(F.count(F.lit(1)).alias("n")).select("flag", "n", fl.fragment_strand("flag").alias("strand"), fl.mate_flag("flag").alias("mate_flag"))


def fn12_chromosomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).groupBy("rname", "chr").agg(F.count(F.lit(1)).alias("n"))


def jc_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mates brought together; a missing one is null."""
    p = pairs(spark, sf_dir, ["row_id", "flag"])
    return p.select("fragment", "hit", F.col("r1.row_id").alias("first_row"), F.col("r2.row_id").alias("second_row"))


def u1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mates with dummies for missing ones, counted by flags."""
    p = with_dummies(pairs(spark, sf_dir, ["row_id", "flag"]))
    return p.groupBy(F.col("r1.flag").alias("flag1"), F.col("r2.flag").alias("flag2"), F.col("r1.row_id").isNull().alias("dummy1"), F.col("r2.row_id").isNull().alias("dummy2")).agg(F.count(F.lit(1)).alias("n"))


def u4_mapped_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    al = table(spark, sf_dir, "alignments")
    out = None
    for unit in (True, False):
        for proper in (True, False):
            one = mapped_share(al, unit, proper).withColumn("fragments", F.lit(unit)).withColumn("proper", F.lit(proper))
            out = one if out is None else out.unionByName(one)
    return out


def u13_mapped_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    al = table(spark, sf_dir, "alignments").filter(~fl.has("flag", fl.UNMAPPED))
    return al.groupBy("sample_id").agg(F.sum(covered_bases("cigar")).alias("bases"))


def a11_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads per fragment name."""
    return table(spark, sf_dir, "alignments").groupBy(fragment_name("qname").alias("fragment")).agg(F.count(F.lit(1)).alias("n"), F.max(~fl.has("flag", fl.UNMAPPED)).alias("mapped"))


OTHER = (k5_read_status, k1_gene_table, k1_sample_counts, a4_gene_lengths, p1c_sections, p_cigar_measures, p_flags, fn12_chromosomes, jc_pairs, u1_repaired, u4_mapped_share, u13_mapped_bases, a11_names)


def queries() -> dict:
    out = {}
    for name in VARIANTS:
        if name.startswith("f_"):
            out[name] = _summary(name)
        else:
            out[name] = _counts(name)
            if name in ("a1_gene_counts", "a1_min_overlap", "a1_largest_overlap"):
                out[name.replace("a1_", "k3_") + "_summary"] = _summary(name)
    return out | {f.__name__: f for f in OTHER}


_READS = r"""
with recursive names as (select distinct chro_name n from genes where chro_name is not null),
own as (select rname from alignments where rname is not null union select rnext from alignments where rnext is not null),
res as (select rname, coalesce(
  (select n from names where n = rname), (select n from names join chr_alias c on n = c.annotation_chr where c.read_chr = rname),
  (select n from names where rname like 'chr%' and n = substr(rname, 4)), (select n from names where length(rname) <= 2 and n = 'chr' || rname)) chr from own),
al as (select a.*, r.chr, coalesce(r.chr, a.rname) own_chr, case when a.rnext = '=' then coalesce(r.chr, a.rname) else coalesce(r2.chr, a.rnext) end mate_chr, coalesce(try_cast(nullif(regexp_extract(tags, '(?:^|\t)NH:[A-Za-z]:([^\t]*)', 1), '') as int), 1) nh, split_part(qname, '/', 1) fragment from alignments a left join res r using (rname) left join res r2 on r2.rname = a.rnext),
ops as (select row_id, pos, unnest(regexp_extract_all(cigar, '(\d+)[MIDNSHP=X]', 1))::bigint n, unnest(regexp_extract_all(cigar, '\d+([MIDNSHP=X])', 1)) op, generate_subscripts(regexp_extract_all(cigar, '(\d+)[MIDNSHP=X]', 1), 1) i from al),
cum as (select *, coalesce(sum(case when op in ('M', '=', 'X', 'D', 'N') then n end) over w, 0) ref, coalesce(sum(case when op in ('M', '=', 'X', 'I', 'S') then n end) over w, 0) rd,
  coalesce(sum(case when op in ('I', 'D', 'N') then 1 end) over w, 0) sec, last_value(case when op in ('I', 'D', 'N') then op end ignore nulls) over w bef from ops window w as (partition by row_id order by i rows between unbounded preceding and 1 preceding)),
sect as (select row_id, sec, cast(min(pos + ref) as bigint) a, cast(max(pos + ref + n - 1) as bigint) z, cast(min(rd + 1) as bigint) rs, min(bef) bef from cum where op in ('M', '=', 'X') group by row_id, sec),
secs as (select * from (select *, row_number() over (partition by row_id order by sec) - 1 no from sect) where no < 10)
"""


# The samples of the test tables, each a column of k1_gene_table.
SAMPLES = ("ctl_a", "ctl_b", "lib07", "lib09", "pool_x", "qc_mix", "trt_a", "trt_b")


def _assign_sql(name: str) -> str:
    kind, o = VARIANTS[name]
    feats = (
        "select gene_name fid, gene_name gene, chro_name chr, start_pos fa, end_pos fz, case strand when '+' then 0 when '-' then 1 else -1 end fs from genes"
        if kind == "genes"
        else "select cast(exon_id as varchar) fid, gene_name gene, chro_name chr, exon_start fa, exon_stop fz, is_negative_strand fs from tx_exons where exon_start <= exon_stop and chro_name is not null"
    )
    if o.paired:
        frag = """
keyed as (select row_id, fragment, flag & 128 <> 0 and flag & 1 <> 0 two, coalesce(nullif(regexp_extract(tags, '(?:^|\\t)HI:[A-Za-z]:([^\\t]*)', 1), ''), '') hit,
  case when flag & 4 = 0 then {'c': own_chr, 'p': pos} end own, case when flag & 8 = 0 then {'c': mate_chr, 'p': pnext} end mate, flag & 64 <> 0 one from al),
fr as (select least(min(row_id) filter (not two), min(row_id) filter (two)) frag, min(row_id) filter (not two) i1, min(row_id) filter (two) i2 from keyed group by fragment, hit, case when one then own else mate end, case when one then mate else own end),
"""
    else:
        frag = "fr as (select row_id frag, row_id i1, null::bigint i2 from al),"
    rules = []
    flag0 = "coalesce(m1.flag, m2.flag)"
    rules.append((f"{flag0} & 4 <> 0" + (f" and {flag0} & 8 <> 0" if o.paired else ""), "Unmapped"))
    if o.both_mapped:
        rules.append((f"{flag0} & 1 = 0 or {flag0} & 12 <> 0", "Singleton"))
    if o.min_mapq:
        rules.append((f"greatest(coalesce(m1.mapq, 0), coalesce(m2.mapq, 0)) < {o.min_mapq}", "MappingQuality"))
    mapped = "m1.row_id is not null and m2.row_id is not null and m1.flag & 4 = 0 and m2.flag & 4 = 0"
    fits = "m1.chr = m2.chr and (m1.flag & 16) <> (m2.flag & 16)"
    if o.check_length:
        rules.append((f"{mapped} and {fits} and abs(m1.tlen) not between {o.least_length} and {o.most_length}", "FragmentLength"))
    if o.no_chimera:
        rules.append((f"{mapped} and not ({fits})", "Chimera"))
    either = lambda t: " or ".join(f"coalesce({t.format(m=m)}, false)" for m in ("m1", "m2"))
    if o.ignore_duplicates:
        rules.append((either("{m}.flag & 1024 <> 0"), "Duplicate"))
    if not o.multi_mapping:
        rules.append((either("({m}.flag & 4 = 0 and {m}.nh > 1)"), "MultiMapping"))
    if o.primary_only:
        rules.append((either("({m}.flag & 4 = 0 and {m}.flag & 256 <> 0)"), "Secondary"))
    split = either("({m}.flag & 4 = 0 and contains({m}.cigar, 'N'))")
    if o.split == "only":
        rules.append((f"not ({split})", "NonSplit"))
    if o.split == "none":
        rules.append((split, "Split"))
    case = "case " + " ".join(f"when {test} then 'Unassigned_{s}'" for test, s in rules) + " end"
    a, z = "s.a", "s.z"
    minus = "m.flag & 16 <> 0"
    if o.shift:
        sign = -1 if o.shift_kind in ("upstream", "left") else 1
        move = f"(case when {minus} then {-sign * o.shift} else {sign * o.shift} end)" if o.shift_kind in ("upstream", "downstream") else str(sign * o.shift)
        a, z = f"greatest(1, {a} + {move})", f"greatest(1, {z} + {move})"
    if o.extend_five or o.extend_three:
        a = f"greatest(1, {a} - case when {minus} then {o.extend_three} else {o.extend_five} end)"
        z = f"greatest(1, {z} + case when {minus} then {o.extend_five} else {o.extend_three} end)"
    if o.reduce_to:
        first, last = (z, a) if o.reduce_to == 5 else (a, z)
        a = z = f"(case when {minus} then {first} else {last} end)"
    strand = {0: "", 1: "and (((m.flag & 16) <> 0) <> ((m.flag & 128) <> 0))::int = f.fs", 2: "and (((m.flag & 16) <> 0) <> ((m.flag & 128) <> 0))::int <> f.fs"}[o.strand]
    union = lambda by: f"sum(greatest(0, z - greatest(a - 1, coalesce(p, a - 1)))) n from (select *, max(z) over (partition by {by} order by a, z rows between unbounded preceding and 1 preceding) p"
    ceil = lambda x: f"(floor({x}) + case when {x} - floor({x}) >= 0.001 then 1 else 0 end)"
    hit = f"select p.frag, p.mate, f.fid, {'f.fid' if o.feature_level else 'f.gene'} target, f.fa, f.fz, greatest(p.a, f.fa) a, least(p.z, f.fz) z from parts p join feats f on p.chr = f.chr and f.fa <= p.z and f.fz >= p.a join al m on m.row_id = p.row_id where f.fa <= f.fz {strand}"
    sql = _READS + f""",
feats as ({feats}), {frag}
jud as (select fr.frag, fr.i1, fr.i2, m1.nh nh1, m2.nh nh2, {case} status from fr left join al m1 on m1.row_id = fr.i1 left join al m2 on m2.row_id = fr.i2),
parts as (select j.frag, x.mate, m.chr, m.row_id, {a} a, {z} z from jud j, (values (1), (2)) x(mate) join al m on m.row_id = case x.mate when 1 then j.i1 else j.i2 end join secs s on s.row_id = m.row_id where j.status is null and m.flag & 4 = 0),
hit0 as ({hit}),
"""
    if o.frac_overlap_feature or o.non_overlap_feature is not None:
        sql += f"keep as (select frag, fid from (select frag, fid, any_value(fz - fa + 1) span, {union('frag, fid')} from hit0) group by frag, fid) where n >= {ceil(f'span * {o.frac_overlap_feature}')}),\nhit as (select h.* from hit0 h semi join keep k on h.frag = k.frag and h.fid = k.fid),\n"
    else:
        sql += "hit as (select * from hit0),\n"
    if o.measures:
        score = "2 * n + case when mates > 1 then 1 else 0 end" if o.largest_overlap else "1" if o.allow_overlap else "mates"
        least = f"greatest({max(1, o.min_overlap)}, {ceil(f'l * {o.frac_overlap}')}" + (f", l - {o.non_overlap})" if o.non_overlap is not None else ")")
        sql += f"""
sc as (select frag, target, count(distinct mate) mates, {union('frag, target')} from hit) group by frag, target),
len as (select frag, n l from (select frag, {union('frag')} from parts) group by frag)),
scored as (select sc.frag, target, case when n >= {least} then {score} else 0 end score from sc join len using (frag)),
"""
    else:
        sql += f"scored as (select frag, target, {'1' if o.allow_overlap else 'count(distinct mate)'} score from hit group by frag, target),\n"
    unit = "(65536 // greatest(coalesce(nh1, 1), coalesce(nh2, 1), 1))" if o.fraction and not o.primary_only else "65536"
    unit = f"({unit} // k)" if o.allow_overlap and o.fraction else unit
    return sql + f"""
best as (select frag, target, score, max(score) over (partition by frag) top from scored),
won as (select frag, any_value(top) top, count(*) k from best where score = top group by frag),
done as (select j.*, w.k, coalesce(status, case when w.k is null then 'Unassigned_NoFeatures' when top = 0 then 'Unassigned_Overlapping_Length' when k > 1 and {'false' if o.allow_overlap else 'true'} then 'Unassigned_Ambiguity' else 'Assigned' end) st, cast({unit} as bigint) inc from jud j left join won w using (frag))
"""


_COUNTS = "select target, cast(sum(inc) as bigint) count65536 from done d join best b on d.frag = b.frag and b.score = b.top where st = 'Assigned' group by target"
_STATUS = "select s.status, count(d.frag) n from (select unnest([{}]) status) s left join done d on d.st = s.status group by s.status".format(", ".join(f"'{s}'" for s in asg.STATUSES))
_LENGTHS = """
select gene_name gene, cast(sum(greatest(0, exon_stop - greatest(exon_start - 1, coalesce(p, exon_start - 1)))) as bigint) length from (
  select *, max(exon_stop) over (partition by gene_name, chro_name, is_negative_strand order by exon_start, exon_stop rows between unbounded preceding and 1 preceding) p from tx_exons where exon_start <= exon_stop and chro_name is not null) group by gene_name"""
_PAIRS = (
    _READS
    + r""",
k as (select *, flag & 128 <> 0 and flag & 1 <> 0 two, coalesce(nullif(regexp_extract(tags, '(?:^|\t)HI:[A-Za-z]:([^\t]*)', 1), ''), '') hit,
  case when flag & 4 = 0 then {'c': own_chr, 'p': pos} end own, case when flag & 8 = 0 then {'c': mate_chr, 'p': pnext} end mate, flag & 64 <> 0 one from al),
p as (select fragment, hit, min(row_id) filter (not two) first_row, min(row_id) filter (two) second_row from k group by fragment, hit, case when one then own else mate end, case when one then mate else own end)
"""
)


def oracle_sql() -> dict[str, str]:
    out = {}
    for name in VARIANTS:
        base = _assign_sql(name)
        if name.startswith("f_"):
            out[name] = base + _STATUS
        else:
            out[name] = base + _COUNTS
            if name in ("a1_gene_counts", "a1_min_overlap", "a1_largest_overlap"):
                out[name.replace("a1_", "k3_") + "_summary"] = base + _STATUS
    mate = "(flag & ~255) | (flag & 3) | ((flag & 4) << 1) | ((flag & 8) >> 1) | ((flag & 16) << 1) | ((flag & 32) >> 1) | ((flag & 64) << 1) | ((flag & 128) >> 1)"
    return out | {
        "k5_read_status": _assign_sql("a1_exon_counts")
        + "select d.frag, st status, case when st = 'Assigned' then k else 0 end n_targets, coalesce(case when st = 'Assigned' then (select string_agg(target, ',' order by target) from best b where b.frag = d.frag and b.score = b.top) end, 'NA') target_list from done d",
        "k1_gene_table": _assign_sql("a1_exon_counts").replace("f.fid target", "f.gene target")
        + f", cnt as (select target gene, m.sample_id, count(*) c from done d join best b on d.frag = b.frag and b.score = b.top join al m on m.row_id = d.frag where st = 'Assigned' group by all), len2 as ({_LENGTHS}) select l.gene, l.length, "
        + ", ".join(f"cast(coalesce(sum(c) filter (sample_id = '{s}'), 0) as bigint) {s}" for s in SAMPLES)
        + " from len2 l left join cnt using (gene) group by l.gene, l.length",
        "k1_sample_counts": _assign_sql("a1_exon_counts").replace("f.fid target", "f.gene target")
        + f""", cnt as (select target gene, m.sample_id, count(*) c from done d join best b on d.frag = b.frag and b.score = b.top join al m on m.row_id = d.frag where st = 'Assigned' group by all), len2 as ({_LENGTHS}), sm as (select distinct sample_id from alignments)
select l.gene, l.length, sm.sample_id, cast(coalesce(c, 0) as bigint) n from len2 l cross join sm left join cnt on cnt.gene = l.gene and cnt.sample_id is not distinct from sm.sample_id""",
        "a4_gene_lengths": _LENGTHS,
        "p1c_sections": _READS + 'select row_id, no section_no, a "start", z "stop", rs read_start, bef "before" from secs',
        "p_cigar_measures": _READS
        + """, t as (select row_id, coalesce(sum(n) filter (op in ('M', '=', 'X')), 0) covered, coalesce(sum(n) filter (op in ('M', '=', 'X', 'D', 'N')), 0) span, coalesce(sum(n) filter (op = 'S' and i = 1), 0) clip, string_agg(n || op, '' order by i desc) reversed from ops group by row_id)
select a.row_id, cast(coalesce(covered, 0) as bigint) covered, cast(coalesce(span, 0) as bigint) span, cast(coalesce(clip, 0) as bigint) clip, contains(a.cigar, 'N') split, coalesce(reversed, '') reversed, a.pos left_end from al a left join t using (row_id)""",
        "p_flags": f"select flag, count(*) n, (((flag & 16) <> 0) <> ((flag & 128) <> 0))::int strand, {mate} mate_flag from alignments group by flag",
        "fn12_chromosomes": _READS + "select rname, chr, count(*) n from al group by rname, chr",
        "jc_pairs": _PAIRS + "select * from p",
        "u1_repaired": _PAIRS
        + f", f as (select a.flag f1, b.flag f2, a.row_id r1, b.row_id r2 from p left join alignments a on a.row_id = first_row left join alignments b on b.row_id = second_row) select coalesce(f1, case when f2 & 1 <> 0 then {mate.replace('flag', 'f2')} end) flag1, coalesce(f2, case when f1 & 1 <> 0 then {mate.replace('flag', 'f1')} end) flag2, r1 is null dummy1, r2 is null dummy2, count(*) n from f group by all",
        "u4_mapped_share": " union all ".join(
            f"select count(*) n_all, count(*) filter (ok) n_mapped, count(*) filter (ok) / count(*) share, {str(unit).lower()} fragments, {str(proper).lower()} proper from (select "
            + ("bool_or" if unit else "")
            + f"((flag & 4 = 0){' and flag & 2 <> 0' if proper else ''}) ok from alignments{' group by split_part(qname, chr(47), 1)' if unit else ''})"
            for unit in (True, False)
            for proper in (True, False)
        ),
        "u13_mapped_bases": _READS + "select sample_id, cast(coalesce(sum(n), 0) as bigint) bases from al left join ops on al.row_id = ops.row_id and op in ('M', '=', 'X') where flag & 4 = 0 group by sample_id",
        "a11_names": "select split_part(qname, '/', 1) fragment, count(*) n, bool_or(flag & 4 = 0) mapped from alignments group by 1",
    }



