"""Queries of junctions, locations, coverage, pileup and transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import flags as fl
from seqloom.operators import intervals as iv
from seqloom.operators import junctions as jn
from seqloom.operators import pileup as pl
from seqloom.operators import transcripts as tr
from seqloom.operators.pairing import fragment_name
from seqloom.plans.assignment import _READS, _assign_sql, exon_features, fragments, reads
from seqloom.plans.general import table
from seqloom.session import materialize


def _junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = reads(spark, sf_dir).filter(~fl.has("flag", fl.UNMAPPED)).select(fragment_name("qname").alias("fragment"), "chr", "sections")
    return jn.fragment_junctions(mapped, "fragment")


def a7_junction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jn.junction_counts(_junctions(spark, sf_dir))


def a8_site_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jn.site_counts(a7_junction_counts(spark, sf_dir))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "genes").select(F.col("gene_name").alias("gene"), F.col("chro_name").alias("chr"), F.col("start_pos").alias("g_start"), F.col("end_pos").alias("g_stop"))


def k4_junction_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Junctions with their genes, in natural chromosome order."""
    # the counts are used four times and are small beside the alignments
    j = jn.primary_genes(materialize(a7_junction_counts(spark, sf_dir)), _spans(spark, sf_dir))
    return j.withColumn("chr_order", jn.natural_order("chr"))


def k7_junction_bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve-column lines of the junctions, with the longest blocks on either side."""
    rows = reads(spark, sf_dir).filter(~fl.has("flag", fl.UNMAPPED) & F.col("chr").isNotNull()).select(fragment_name("qname").alias("fragment"), "chr", "sections").filter("size(sections) > 1")
    s = rows.select("fragment", "chr", F.explode(F.zip_with(F.slice("sections", 1, F.size("sections") - 1), F.slice("sections", 2, F.size("sections") - 1), lambda a, b: F.struct(a.start.alias("from"), a.stop.alias("left"), b.start.alias("right"), b.stop.alias("to"), b.before.alias("kind")))).alias("j")).filter("j.kind = 'N'")
    g = s.groupBy("chr", "j.left", "j.right").agg(F.count_distinct("fragment").alias("n"), F.min("j.from").alias("from"), F.max("j.to").alias("to"))
    sizes = F.concat_ws(",", F.col("left") - F.col("from") + 1, F.col("to") - F.col("right") + 1)
    return g.select("chr", (F.col("from") - 1).alias("chrom_start"), F.col("to").alias("chrom_stop"), "n", F.lit(2).alias("blocks"), sizes.alias("block_sizes"), F.concat_ws(",", F.lit(0), F.col("right") - F.col("from")).alias("block_starts"))


def jm_thinned_junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    coarse = materialize(a7_junction_counts(spark, sf_dir))
    return jn.thin_neighbours(coarse, 2000, 2000)


def g8_known_junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    exons = table(spark, sf_dir, "tx_exons").filter("chro_name is not null").select("transcript_id", "chro_name", "exon_start", "exon_stop").distinct()
    return jn.known_junctions(exons, ["transcript_id", "chro_name"], "exon_start", "exon_stop").groupBy("chro_name", "left", "right").agg(F.count(F.lit(1)).alias("n"))


def a22_anti_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = materialize(a7_junction_counts(spark, sf_dir))
    cover = reads(spark, sf_dir).filter("chr is not null and size(sections) > 0").select(F.col("row_id").alias("read"), "chr", F.element_at("sections", 1).start.alias("c_start"), F.element_at("sections", -1).stop.alias("c_stop"))
    return jn.anti_support(cover, counts)


def jg_sites_in_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = a8_site_counts(spark, sf_dir)
    return iv.containing(sites, _spans(spark, sf_dir), ["chr"], "site", ("g_start", "g_stop")).select("chr", "site", "side", "gene")


def ja_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exons of one gene that overlap genes of other names."""
    e = exon_features(spark, sf_dir).select("feature_id", "chr", "start", "stop")
    return iv.overlap_join(e, _spans(spark, sf_dir), ["chr"], ("start", "stop"), ("g_start", "g_stop")).select("feature_id", "gene")


def a10_uncrowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads per chromosome after crowded locations are dropped."""
    rows = reads(spark, sf_dir).select("row_id", "chr", "pos", "cigar")
    return pl.drop_crowded_locations(rows, 2).groupBy("chr").agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("ids"))


def _fragment_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chr, start, stop): what fragments cover; where their mates or sections
    overlap they cover it once."""
    f = fragments(spark, sf_dir, True)
    of = lambda r: F.transform(F.col(f"{r}.sections"), lambda s: F.struct(F.col(f"{r}.chr").alias("chr"), s.start.alias("start"), s.stop.alias("stop")))
    none = F.array().cast("array<struct<chr:string,start:bigint,stop:bigint>>")
    both = F.concat(F.coalesce(of("r1"), none), F.coalesce(of("r2"), none))
    return f.select(F.explode(iv.joined_spans(both)).alias("s")).select("s.chr", "s.start", "s.stop")


def a13_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.coverage_runs(_fragment_spans(spark, sf_dir), ["chr"], "start", "stop")


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long reads laid over short invented contigs, for want of places."""
    r = table(spark, sf_dir, "long_reads")
    return r.select(F.col("read_name").alias("fragment"), F.concat(F.lit("c"), (F.col("read_id") % 5).cast("string")).alias("chr"), (F.col("read_id") * 37 % 1000 + 1).alias("pos"), F.col("read_text").alias("seq"), F.col("qual_text").alias("qual"))


def a12_pileup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.base_counts(_placed(spark, sf_dir))


def w1_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = pl.base_counts(_placed(spark, sf_dir)).select("chr", "pos", F.greatest("a", "c", "g", "t").alias("matches"), (F.col("a") + F.col("c") + F.col("g") + F.col("t") - F.greatest("a", "c", "g", "t")).alias("mismatches"))
    return pl.with_background(c)


def _variant_rows(al: DataFrame) -> DataFrame:
    return al.select(F.lit("SNP").alias("kind"), F.col("rname").alias("chr"), F.floor(F.col("pos") / 1_000_000).alias("pos"), F.substring("cigar", 1, 1).alias("ref"), F.substring("cigar", -1, 1).alias("alt"), F.col("mapq").alias("quality"), F.col("sample_id").alias("file"))


def jk_shared_by_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants that all samples there are share."""
    return pl.shared_variants(_variant_rows(table(spark, sf_dir, "alignments")))


def u2_flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.flatten(exon_features(spark, sf_dir), ["gene", "chr", "strand"], "start", "stop")


def u3_chopped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.flatten(exon_features(spark, sf_dir), ["gene", "chr", "strand"], "start", "stop", chop=True)


def u6_unique_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "tx_exons").filter("chro_name is not null")
    return tr.unique_bases(e, "transcript_id", ["gene_name", "chro_name", "is_negative_strand"], "exon_start", "exon_stop")


def u9_gap_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "genes")
    return tr.detection_regions(g, "chro_name", "start_pos", "end_pos").groupBy("chro_name").agg(F.count(F.lit(1)).alias("bins"), F.sum(F.col("bin_stop") - F.col("bin_start") + 1).alias("bases"))


def u19_promoters(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "genes")
    return iv.promoter_spans(g, "start_pos", "end_pos", "strand", 3000, 2000).select("gene_name", "promoter_start", "promoter_stop")


def k13_coverage_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.binned_coverage(a13_coverage(spark, sf_dir), ["chr"], 100_000)


def u9_exon_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GC content of the parts of genes' flattened exons that lie within a block."""
    b = table(spark, sf_dir, "index_blocks").filter("base_values is not null").select(F.col("chro_name").alias("chr"), "block_id", F.col("start_base_offset").alias("b_start"), (F.col("start_base_offset") + F.length("base_values") - 1).alias("b_stop"), F.col("base_values").alias("letters"))
    met = iv.span_gc(u2_flattened(spark, sf_dir), b, ["chr"], "seg_start", "seg_stop")
    return met.groupBy("gene", "block_id").agg(F.sum("gc").cast("long").alias("gc"), F.sum("called").cast("long").alias("called"))


def g1_contig_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks by name: repeated, empty or with letters that aren't bases."""
    b = table(spark, sf_dir, "index_blocks")
    odd = F.length(F.regexp_replace(F.coalesce("base_values", F.lit("")), "[ACGTNacgtn]", ""))
    return b.groupBy("chro_name").agg(F.count(F.lit(1)).alias("blocks"), (F.count(F.lit(1)) - F.count_distinct("start_base_offset")).alias("repeated"), F.count_if(F.coalesce(F.length("base_values"), F.lit(0)) == 0).alias("empty"), F.sum(odd).alias("odd_letters"))


def o4_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments in the order of place, natural names first."""
    rows = reads(spark, sf_dir)
    return rows.select("row_id", "chr", "pos", jn.natural_order("chr").alias("chr_order")).orderBy("chr_order", "chr", "pos", "row_id")


def s11_tagged_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Barcode and tag at the head of each read, counted."""
    r = table(spark, sf_dir, "long_reads").filter("length(read_text) >= 20")
    return r.groupBy(F.substring("read_text", 1, 8).alias("barcode"), F.substring("read_text", 9, 4).alias("umi")).agg(F.count(F.lit(1)).alias("n"))


ALL = (
    k13_coverage_bins, u9_exon_gc, g1_contig_check, o4_sorted, s11_tagged_reads,
    a7_junction_counts, a8_site_counts, k4_junction_genes, k7_junction_bed, jm_thinned_junctions, g8_known_junctions, a22_anti_support, jg_sites_in_genes, ja_overlaps, a10_uncrowded,
    a13_coverage, a12_pileup, w1_background, jk_shared_by_all, u2_flattened, u3_chopped, u6_unique_bases, u9_gap_bins, u19_promoters,
)


def queries() -> dict:
    return {f.__name__: f for f in ALL}


_J = (
    _READS
    + """,
nb as (select s.*, al.fragment, al.chr, lag(z) over (partition by s.row_id order by no) pz, lag(a) over (partition by s.row_id order by no) pa from secs s join al using (row_id) where flag & 4 = 0),
js as (select fragment, chr, pz "left", a "right", pa fr, z til from nb where bef = 'N' and pz is not null and chr is not null),
jc as (select chr, "left", "right", count(distinct fragment) n from js group by all),
st as (select chr, site, side, cast(sum(n) as bigint) n from (select chr, "left" site, 'left' side, n from jc union all select chr, "right", 'right', n from jc) group by all)
"""
)
_EXONS = "select exon_id feature_id, gene_name gene, chro_name chr, exon_start \"start\", exon_stop stop, is_negative_strand strand from tx_exons where exon_start <= exon_stop and chro_name is not null"
_PILE = """
with r as (select read_name fragment, 'c' || (read_id % 5) chr, read_id * 37 % 1000 + 1 pos, read_text s, qual_text q, least(length(read_text), length(qual_text)) n from long_reads),
e as (select *, unnest(range(4, n - 2)) i from r where n > 6),
b as (select fragment, chr, pos + i - 1 pos, upper(substr(s, i, 1)) b, unicode(substr(q, i, 1)) - 33 sc from e),
f as (select chr, pos, fragment, arg_min(b, (-sc, b)) b from b where sc >= 13 and b in ('A', 'C', 'G', 'T') group by all),
p as (select chr, pos, count(*) filter (b = 'A') a, count(*) filter (b = 'C') c, count(*) filter (b = 'G') g, count(*) filter (b = 'T') t from f group by chr, pos)
"""


def _merged(rows: str, keys: str) -> str:
    return f"""m as (select {keys}, min(a) a, max(z) z from (select *, sum(case when p is null or a > p + 1 then 1 else 0 end) over (partition by {keys} order by a, z rows unbounded preceding) i from (
  select *, max(z) over (partition by {keys} order by a, z rows between unbounded preceding and 1 preceding) p from ({rows}))) group by {keys}, i)"""


def _cut(rows: str, keys: str) -> str:
    return f"""cut as (select {keys}, e a, lead(e) over (partition by {keys} order by e) - 1 z, sum(d) over (partition by {keys} order by e rows unbounded preceding) depth from (
  select {keys}, e, sum(d) d from (select {keys}, a e, 1 d from ({rows}) union all select {keys}, z + 1, -1 from ({rows})) group by all))"""


def oracle_sql() -> dict[str, str]:
    order = "case when b = 'X' then 90 when b = 'Y' then 91 when b in ('M', 'MT') then 99 else coalesce(try_cast(nullif(regexp_extract(b, '^(\\d+)$', 1), '') as int), 1000) end"

    # sections of both mates of a fragment, each position once
    mates = _assign_sql("a1_fragment_counts").split(",\njud as")[0].rstrip().rstrip(",")
    spans = mates + ", fx as (select frag, unnest([i1, i2]) row_id from fr), " + _merged("select fx.frag, al.chr, s.a, s.z from fx join al using (row_id) join secs s using (row_id) where al.chr is not null", "frag, chr") + ", sx as (select chr, a, z from m)"

    ex = 'select gene_name gene, chro_name chr, is_negative_strand strand, exon_start a, exon_stop z from tx_exons where exon_start <= exon_stop and chro_name is not null'
    tx = ex.replace("gene_name gene, chro_name chr, is_negative_strand strand", "transcript_id, gene_name, chro_name, is_negative_strand")
    return {
        "a7_junction_counts": _J + "select * from jc",
        "a8_site_counts": _J + "select * from st",
        "k4_junction_genes": _J
        + f""", held as (select st.chr, site, side, n sup, gene_name gene, start_pos gs from st join genes g on g.chro_name = st.chr and site between start_pos and end_pos),
per as (select jc.chr, "left", "right", gene, min(gs) gs, count(*) sites, max(sup) sup from jc join held h on h.chr = jc.chr and ((side = 'left' and site = "left") or (side = 'right' and site = "right")) group by all),
rk as (select *, row_number() over (partition by chr, "left", "right" order by -sites, case when sites = 1 then -sup else 0 end, gs, gene) k from per)
select jc.chr, jc."left", jc."right", jc.n, max(gene) filter (k = 1) primary_gene, coalesce(string_agg(gene, ',' order by gene) filter (k > 1), '') secondary_genes, any_value({order.replace("b ", "upper(regexp_replace(jc.chr, '^chr', '')) ").replace("(b,", "(upper(regexp_replace(jc.chr, '^chr', '')),")}) chr_order
from jc left join rk using (chr, "left", "right") group by jc.chr, jc."left", jc."right", jc.n""",
        "k7_junction_bed": _J
        + """, g as (select chr, "left" l, "right" r, count(distinct fragment) n, min(fr) f, max(til) t from js group by all)
select chr, f - 1 chrom_start, t chrom_stop, n, 2 blocks, concat(l - f + 1, ',', t - r + 1) block_sizes, concat(0, ',', r - f) block_starts from g""",
        "jm_thinned_junctions": _J + """select * from jc a where not exists (select 1 from jc b where a.chr = b.chr and abs(a."left" - b."left") <= 2000 and abs(a."right" - b."right") <= 2000 and (b.n > a.n or (b.n = a.n and (b."left" < a."left" or (b."left" = a."left" and b."right" < a."right")))))""",
        "g8_known_junctions": """with e as (select distinct transcript_id, chro_name, exon_start a, exon_stop z from tx_exons where chro_name is not null and exon_start <= exon_stop)
select chro_name, z "left", r "right", count(*) n from (select *, lead(a) over (partition by transcript_id, chro_name order by a, z) r from e) where r > z + 1 group by all""",
        "a22_anti_support": _J
        + """, cv as (select al.row_id, al.chr, min(s.a) + 5 a, max(s.z) - 5 z from al join secs s using (row_id) where al.chr is not null group by all)
select jc.chr, "left", "right", count(distinct row_id) n_against from jc join cv on cv.chr = jc.chr and ("left" between a and z or "right" between a and z) group by all""",
        "jg_sites_in_genes": _J + "select st.chr, site, side, gene_name gene from st join genes g on g.chro_name = st.chr and site between start_pos and end_pos",
        "ja_overlaps": f"with e as ({_EXONS}) select feature_id, gene_name gene from e join genes g on g.chro_name = e.chr and start_pos <= stop and end_pos >= \"start\"",
        "a10_uncrowded": _READS
        + """, c as (select row_id, chr, pos - coalesce(try_cast(nullif(regexp_extract(cigar, '^(?:\\d+H)?(\\d+)S', 1), '') as bigint), 0) e from al), k as (select *, count(*) over (partition by chr, e) n from c)
select chr, count(*) n, cast(sum(row_id) as bigint) ids from k where chr is null or n < 2 group by chr""",
        "a13_coverage": spans
        + ", "
        + _cut("select * from sx", "chr")
        + """, c2 as (select *, case when lag(depth) over (partition by chr order by a) = depth then 0 else 1 end f from cut)
select chr, cast(depth as bigint) depth, min(a) run_start, max(z) run_stop from (select *, sum(f) over (partition by chr order by a rows unbounded preceding) g from c2) where depth > 0 group by chr, depth, g""",
        "k13_coverage_bins": spans
        + """, b as (select chr, a, z, unnest(range(a // 100000, z // 100000 + 1)) bin from sx)
select chr, bin, cast(sum(least(z, bin * 100000 + 99999) - greatest(a, bin * 100000) + 1) as bigint) bases from b group by chr, bin""",
        "u9_exon_gc": "with " + _merged(ex, "gene, chr, strand") + """, x as (select gene, block_id, substr(base_values, greatest(a, start_base_offset) - start_base_offset + 1, least(z, start_base_offset + length(base_values) - 1) - greatest(a, start_base_offset) + 1) s
  from m join index_blocks b on m.chr = b.chro_name and a <= start_base_offset + length(base_values) - 1 and z >= start_base_offset where length(base_values) > 0)
select gene, block_id, cast(sum(length(regexp_replace(s, '[^GCgc]', '', 'g'))) as bigint) gc, cast(sum(length(regexp_replace(s, '[^ACGTacgt]', '', 'g'))) as bigint) called from x group by gene, block_id""",
        "g1_contig_check": """select chro_name, count(*) blocks, count(*) - count(distinct start_base_offset) repeated, count(*) filter (coalesce(length(base_values), 0) = 0) empty, cast(sum(length(regexp_replace(coalesce(base_values, ''), '[ACGTNacgtn]', '', 'g'))) as bigint) odd_letters from index_blocks group by chro_name""",
        "o4_sorted": _READS + f""" select row_id, chr, pos, {order.replace("b ", "upper(regexp_replace(chr, '^chr', '')) ").replace("(b,", "(upper(regexp_replace(chr, '^chr', '')),")} chr_order from al""",
        "s11_tagged_reads": "select substr(read_text, 1, 8) barcode, substr(read_text, 9, 4) umi, count(*) n from long_reads where length(read_text) >= 20 group by all",
        "a12_pileup": _PILE + "select * from p",
        "w1_background": _PILE
        + """, m as (select chr, pos, greatest(a, c, g, t) matches, a + c + g + t - greatest(a, c, g, t) mismatches from p)
select chr, pos, matches, mismatches, cast(sum(matches) over w - matches as bigint) bg_matches, cast(sum(mismatches) over w - mismatches as bigint) bg_mismatches from m window w as (partition by chr order by pos range between 5 preceding and 5 following)""",
        "jk_shared_by_all": """with v as (select 'SNP' kind, rname chr, pos // 1000000 pos, substr(cigar, 1, 1) "ref", right(cigar, 1) alt, mapq quality, sample_id file from alignments)
select kind, chr, pos, "ref", alt, min(quality) quality, arg_min(file, (quality, file)) file from v group by kind, chr, pos, "ref", alt having count(distinct file) + max((file is null)::int) = (select count(distinct sample_id) + max((sample_id is null)::int) from alignments)""",
        "u2_flattened": "with " + _merged(ex, "gene, chr, strand") + " select gene, chr, strand, a seg_start, z seg_stop from m",
        "u3_chopped": "with " + _cut(ex, "gene, chr, strand") + " select gene, chr, strand, a seg_start, z seg_stop from cut where depth > 0",
        "u6_unique_bases": "with " + _merged(tx, "transcript_id, gene_name, chro_name, is_negative_strand") + ", " + _cut("select * from m", "gene_name, chro_name, is_negative_strand")
        + """ select transcript_id, m.gene_name, m.chro_name, m.is_negative_strand, cast(coalesce(sum(u), 0) as bigint) unique_bases, cast(sum(z - a + 1) as bigint) total_bases from (
  select m.*, (select sum(c.z - c.a + 1) from cut c where c.depth = 1 and c.gene_name = m.gene_name and c.chro_name = m.chro_name and c.is_negative_strand = m.is_negative_strand and c.a >= m.a and c.z <= m.z) u from m) m group by all""",
        "u9_gap_bins": "with " + _merged("select chro_name, start_pos a, end_pos z from genes where start_pos <= end_pos", "chro_name")
        + """, g as (select chro_name, lag(z) over (partition by chro_name order by a) + 1 lo, a - 1 hi from m)
select chro_name, cast(sum((hi - lo) // 2000 + 1) as bigint) bins, cast(sum(hi - lo + 1) as bigint) bases from g where lo is not null group by chro_name""",
        "u19_promoters": """select gene_name, greatest(1, case when strand = '-' then end_pos - 2000 else start_pos - 3000 end) promoter_start, case when strand = '-' then end_pos + 3000 else start_pos + 2000 end promoter_stop from genes""",
    }
