"""Queries that write whole tables in a format and read them back, and the
tables that are made of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import flags as fl
from seqloom.operators import assign as asg
from seqloom.operators.assign import Options
from seqloom.plans.assignment import _READS, VARIANTS, _assign_sql, exon_features, fragments, gene_features, reads
from seqloom.plans.general import table
from seqloom.session import scratch
from seqloom.sources import binary, text, writers

_SAM = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "tags")


def _alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    al = table(spark, sf_dir, "alignments").select(*_SAM)
    return al.withColumn("pnext", F.col("pnext").cast("long")).withColumn("tlen", F.col("tlen").cast("long")).withColumn("seq", F.lit("*")).withColumn("qual", F.lit("*"))


def _sam(spark: SparkSession, sf_dir: str) -> str:
    path = scratch(spark)
    writers.write_lines(writers.sam_lines(_alignments(spark, sf_dir)), path)
    return path


def s1_sam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.read_sam(spark, _sam(spark, sf_dir)).select(*_SAM)


def _bam(spark: SparkSession, sf_dir: str, sort: bool) -> str:
    al = _alignments(spark, sf_dir)
    # names of the header; a reference has no more than its contigs
    names = [r.n for r in al.select(F.explode(F.array("rname", "rnext")).alias("n")).filter("n is not null and n not in ('*', '=')").distinct().orderBy("n").collect()]
    path = scratch(spark)
    binary.write_bam(al, path, [(n, 2**31 - 1) for n in names], sort=sort)
    binary.register(spark)
    return path


def s2_bam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed files read back by ranges that are far smaller than the files."""
    path = _bam(spark, sf_dir, False)
    return spark.read.format("bam").option("split", 100_000).load(path).select(*_SAM)


def k6_sorted_bam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by chromosome of files written in order of place."""
    path = _bam(spark, sf_dir, True)
    return spark.read.format("bam").load(path).groupBy("rname").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("places"))


def _fastq(spark: SparkSession, sf_dir: str) -> str:
    path = scratch(spark)
    r = table(spark, sf_dir, "long_reads").filter("length(read_text) = length(qual_text) and length(read_text) > 0")
    writers.write_lines(writers.fastq_lines(r, F.concat(F.lit("r"), "read_id"), F.col("read_text"), F.col("qual_text")), path)
    return path


def s4_fastq(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _fastq(spark, sf_dir)
    binary.register(spark)
    got = spark.read.format("fastq").option("split", 1 << 20).load(f"{path}/*.txt")
    return got.select("name", F.md5("seq").alias("seq"), F.md5("qual").alias("qual"))


def _fasta(spark: SparkSession, sf_dir: str) -> str:
    path = scratch(spark)
    writers.write_lines(writers.fasta_lines(table(spark, sf_dir, "index_blocks").filter("length(base_values) > 0"), F.concat(F.lit("b"), "block_id"), F.col("base_values")), path)
    return path


def s5_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.read_fasta(spark, _fasta(spark, sf_dir)).select("name", F.length("seq").cast("long").alias("letters"), F.md5("seq").alias("seq"))


def _exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "tx_exons").filter("chro_name is not null and gene_name is not null and exon_start >= 1 and exon_start <= exon_stop")


def s6_gtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    strand = F.when(F.col("is_negative_strand") == 1, "-").otherwise("+")
    names = F.format_string('gene_id "%s"; transcript_id "%s";', "gene_name", "transcript_id")
    e = _exons(spark, sf_dir)
    writers.write_lines(e.select(writers.tab_line("chro_name", F.lit("x"), F.lit("exon"), F.col("exon_start").cast("long"), F.col("exon_stop").cast("long"), F.lit("."), strand, F.lit("."), names).alias("value")), path)
    return text.read_gtf(spark, path, extra=("transcript_id",)).drop("feature_id")


def s7_saf(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    writers.write_lines(table(spark, sf_dir, "genes").select(writers.tab_line("gene_name", "chro_name", "start_pos", "end_pos", "strand").alias("value")), path, header=["GeneID\tChr\tStart\tEnd\tStrand"])
    return text.read_saf(spark, path).drop("feature_id")


def s9_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    writers.write_lines(table(spark, sf_dir, "chr_alias").select(F.concat_ws(",", "annotation_chr", "read_chr").alias("value")), path, header=["# names"])
    return text.read_alias(spark, path)


def s14_vcf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of single-letter variants among lines of all kinds."""
    path = scratch(spark)
    al = table(spark, sf_dir, "alignments").filter("rname is not null and rname <> '*'")
    alt = F.when(F.col("flag") % 3 == 0, "G,GT").when(F.col("flag") % 3 == 1, "AC").otherwise("T")
    info = F.when(F.col("row_id") % 5 == 0, "INDEL;DP=3").otherwise("DP=3")
    writers.write_lines(al.select(writers.tab_line("rname", "pos", F.lit("."), F.lit("A"), alt, "mapq", F.lit("."), info).alias("value")), path, header=["##fileformat=VCFv4.0"])
    return text.known_snps(text.read_vcf(spark, path)).groupBy("chr").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("places"))


def s15_junction_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    bare = F.regexp_replace("chro_name", "^chr", "")
    writers.write_lines(_exons(spark, sf_dir).select(writers.tab_line("transcript_id", bare, F.col("exon_start").cast("long"), F.col("exon_stop").cast("long")).alias("value")), path)
    return text.read_junction_table(spark, path)


def s17_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of files by their first bytes."""
    out = None
    for name, folder in {"fasta": _fasta, "fastq": _fastq, "sam": _sam, "bam": lambda s, d: _bam(s, d, False)}.items():
        one = text.sniff(spark, folder(spark, sf_dir)).filter("kind <> 'empty'").select(F.lit(name).alias("written"), "kind").distinct()
        out = one if out is None else out.unionByName(one)
    return out


def k2_feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exons in the order of the annotation, with lengths and counts."""
    feats = exon_features(spark, sf_dir)
    kind, o = VARIANTS["a1_exon_counts"]
    counts = asg.count_targets(fragments(spark, sf_dir, o.paired), feats, o).withColumnRenamed("count65536", "c")
    out = feats.join(counts, F.col("feature_id").cast("string") == F.col("target"), "left")
    return out.select("feature_id", "gene", "chr", "start", "stop", (F.col("stop") - F.col("start") + 1).cast("long").alias("length"), (F.coalesce("c", F.lit(0)) / asg.UNIT).cast("long").alias("n")).orderBy("feature_id")


def a6_counts_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gene counts for each value of an optional tag (as by read group; these
    tables have none, so by nM). Reads without the tag are left out."""
    tagged = reads(spark, sf_dir).withColumn("value", fl.tag("tags", "nM")).filter("value is not null")
    a = asg.assign(fragments(spark, sf_dir, False), gene_features(spark, sf_dir), Options())
    per = a.filter("status = 'Assigned'").join(tagged.select(F.col("row_id").alias("frag"), "value"), "frag")
    return per.select("value", F.explode("targets").alias("target"), "increment").groupBy("value", "target").agg(F.sum("increment").alias("count65536"))


def a23_mapping_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of each sample: all, mapped, at one place, at more, in proper pairs."""
    r = table(spark, sf_dir, "alignments").select("sample_id", "flag", fl.hits("tags").alias("nh"))
    mapped = ~fl.has("flag", fl.UNMAPPED)
    return r.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(mapped).alias("mapped"), F.count_if(mapped & (F.col("nh") <= 1)).alias("at_one_place"), F.count_if(mapped & (F.col("nh") > 1)).alias("at_more"), F.count_if(mapped & fl.has("flag", 0x2)).alias("proper"))


def o5_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments in the order of names, mates and secondary places together."""
    return table(spark, sf_dir, "alignments").select("qname", "flag", "row_id").orderBy("qname", "flag", "row_id")


ALL = (s1_sam, s2_bam, k6_sorted_bam, s4_fastq, s5_fasta, s6_gtf, s7_saf, s9_alias, s14_vcf, s15_junction_table, s17_kinds, k2_feature_table, a6_counts_by_tag, a23_mapping_counters, o5_by_name)


def queries() -> dict:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    exons = "tx_exons where chro_name is not null and gene_name is not null and exon_start >= 1 and exon_start <= exon_stop"
    plain = "coalesce(qname, '*') qname, flag, coalesce(rname, '*') rname, coalesce(pos, 0) pos, coalesce(mapq, 0) mapq, coalesce(cigar, '*') cigar"
    numbers = "cast(coalesce(pnext, 0) as bigint) pnext, cast(coalesce(tlen, 0) as bigint) tlen, tags"
    return {
        "s1_sam": f"select {plain}, coalesce(rnext, '*') rnext, {numbers} from alignments",
        "s2_bam": f"select {plain}, case when rname <> '*' and (rnext = '=' or rnext = rname) then '=' when rnext = '=' then '*' else coalesce(rnext, '*') end rnext, {numbers} from alignments",
        "k6_sorted_bam": "select coalesce(rname, '*') rname, count(*) n, cast(sum(coalesce(pos, 0)) as bigint) places from alignments group by 1",
        "s4_fastq": "select 'r' || read_id as name, md5(upper(read_text)) seq, md5(qual_text) qual from long_reads where length(read_text) = length(qual_text) and length(read_text) > 0",
        "s5_fasta": "select 'b' || block_id as name, length(base_values) letters, md5(upper(base_values)) seq from index_blocks where length(base_values) > 0",
        "s6_gtf": f"select gene_name gene, chro_name chr, exon_start::bigint \"start\", exon_stop::bigint stop, case when is_negative_strand = 1 then 1 else 0 end strand, transcript_id from {exons}",
        "s7_saf": "select gene_name gene, chro_name chr, start_pos \"start\", end_pos stop, case strand when '+' then 0 when '-' then 1 else -1 end strand from genes",
        "s9_alias": "select annotation_chr, read_chr from chr_alias",
        "s14_vcf": "select rname chr, count(distinct pos) n, cast(sum(distinct pos) as bigint) places from alignments where rname <> '*' and row_id % 5 <> 0 and flag % 3 <> 1 group by rname",
        "s15_junction_table": f"select transcript_id as name, case when length(c) < 3 then 'chr' || c else c end chr, a \"left\", z \"right\" from (select transcript_id, regexp_replace(chro_name, '^chr', '') c, exon_start::bigint a, exon_stop::bigint z from {exons})",
        "s17_kinds": "select unnest(['fasta', 'fastq', 'sam', 'bam']) written, unnest(['fasta', 'fastq', 'sam', 'bam']) kind",
        "k2_feature_table": _assign_sql("a1_exon_counts")
        + """, cnt as (select target, count(*) c from done d join best b on d.frag = b.frag and b.score = b.top where st = 'Assigned' group by target)
select exon_id feature_id, gene_name gene, chro_name chr, exon_start "start", exon_stop stop, (exon_stop - exon_start + 1)::bigint length, coalesce(c, 0) n from tx_exons left join cnt on target = cast(exon_id as varchar) where exon_start <= exon_stop and chro_name is not null""",
        "a6_counts_by_tag": _assign_sql("a1_gene_counts")
        + r""", tg as (select row_id, nullif(regexp_extract(tags, '(?:^|\t)nM:[A-Za-z]:([^\t]*)', 1), '') v from alignments)
select v as value, target, cast(sum(inc) as bigint) count65536 from done d join best b on d.frag = b.frag and b.score = b.top join tg on tg.row_id = d.frag where st = 'Assigned' and v is not null group by all""",
        "a23_mapping_counters": _READS + " select sample_id, count(*) n, count(*) filter (flag & 4 = 0) mapped, count(*) filter (flag & 4 = 0 and nh <= 1) at_one_place, count(*) filter (flag & 4 = 0 and nh > 1) at_more, count(*) filter (flag & 6 = 2) proper from al group by sample_id",
        "o5_by_name": "select qname, flag, row_id from alignments",
    }
