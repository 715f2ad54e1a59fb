"""Queries that place reads and find the events in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import flags as fl
from seqloom.functions.cigar import reference_span
from seqloom.functions.sequence import reverse_complement
from seqloom.operators import alignment as al
from seqloom.operators import junctions as jn
from seqloom.operators import kmers
from seqloom.operators.intervals import union_length
from seqloom.operators.pairing import fragment_name, pair_mates
from seqloom.plans.assignment import _READS, fragments, reads
from seqloom.plans.genome import _J, g8_known_junctions
from seqloom.plans.general import table
from seqloom.plans.sequence import READS_A_BLOCK, _cut_reads
from seqloom.session import materialize


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "index_blocks").filter("base_values is not null")
    return b.select(F.col("chro_name").alias("contig"), F.col("start_base_offset").alias("b_start"), (F.col("start_base_offset") + F.length("base_values") - 1).alias("b_stop"), F.col("base_values").alias("letters"))


def _changed_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads cut from the blocks; of every fifth two letters are left out."""
    s = F.when((F.floor(F.col("read") / READS_A_BLOCK) % 5 == 0) & (F.length("s") == 100), F.concat(F.substring("s", 1, 50), F.substring("s", 53, 48))).otherwise(F.col("s"))
    return _cut_reads(spark, sf_dir).select("read", s.alias("s"))


def g10_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads cut from the blocks, placed again."""
    r = _changed_reads(spark, sf_dir)
    both = r.select("read", F.explode(F.array(F.struct(F.lit(0).alias("strand"), F.upper("s").alias("s")), F.struct(F.lit(1).alias("strand"), F.upper(reverse_complement("s")).alias("s")))).alias("x")).select("read", "x.*")
    seeds = kmers.spaced_seeds(r, "read", "s")
    index = kmers.index(table(spark, sf_dir, "index_blocks"), "chro_name", "base_values", "start_base_offset", step=1, most=100, of=seeds)
    best = kmers.best_votes(kmers.votes(seeds, index), 2, 2)
    return al.align(best, both, _blocks(spark, sf_dir))


def g5_paired_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mates of 90 letters, 90 apart, from every 400 letters of each block."""
    index = kmers.index(table(spark, sf_dir, "index_blocks"), "chro_name", "base_values", "start_base_offset", step=1, most=100)
    b = table(spark, sf_dir, "index_blocks").filter("length(base_values) >= 400")
    cut = b.select((F.col("block_id") * READS_A_BLOCK).alias("b"), "base_values", F.explode(F.sequence(F.lit(0), F.floor(F.length("base_values") / 400).cast("int") - 1)).alias("k"))
    letters = lambda at: F.upper(F.substring(F.col("base_values"), F.col("k") * 400 + at, F.lit(90)))
    mates = cut.select((F.col("b") + F.col("k")).alias("read"), letters(21).alias("s1"), reverse_complement(letters(201)).alias("s2"))
    c1, c2 = (kmers.votes(kmers.spaced_seeds(mates, "read", s), index) for s in ("s1", "s2"))
    return al.pair_candidates(c1, c2)


def g14_dense_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 20,000 of the long reads whose id is divisible by 20 (a
    stated set of searches), against all blocks; a seed every third letter."""
    index = kmers.index(table(spark, sf_dir, "index_blocks"), "chro_name", "base_values", "start_base_offset", step=1, most=100)
    r = table(spark, sf_dir, "long_reads").filter("read_id % 20 = 0 and read_text is not null")
    return al.dense_windows(kmers.votes(kmers.dense_seeds(r, "read_id", "read_text"), index))


def g14_long_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of all long reads, each with seeds over its whole length."""
    index = kmers.index(table(spark, sf_dir, "index_blocks"), "chro_name", "base_values", "start_base_offset", step=1, most=100)
    r = table(spark, sf_dir, "long_reads").filter("read_text is not null")
    voted = kmers.votes(kmers.dense_seeds(r, "read_id", "read_text"), index)
    return al.long_read_windows(voted, r.select(F.col("read_id").alias("read"), F.length("read_text").alias("length")))


def u18_indels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.indel_events(reads(spark, sf_dir).select("chr", "sections")).withColumn("quality", F.round(al.indel_quality(F.col("support")) * 2**30, 3))


def _junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = reads(spark, sf_dir).filter(~fl.has("flag", fl.UNMAPPED)).select(fragment_name("qname").alias("fragment"), "chr", "sections")
    return jn.fragment_junctions(mapped, "fragment")


def jl_supported_splices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Junctions that share one end, but not both, with those seen in at least
    two fragments or given by the annotation."""
    j = materialize(_junctions(spark, sf_dir))
    given = g8_known_junctions(spark, sf_dir).select(F.col("chro_name").alias("chr"), "left", "right")
    seen = jn.junction_counts(j).filter("n >= 2").select("chr", "left", "right")
    return al.alternative_splices(j, seen.unionByName(given)).groupBy("chr", "left", "right").agg(F.count(F.lit(1)).alias("n"))


def fn5_fragment_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bases that the mates of each fragment cover together; of mates on
    different chromosomes the sum."""
    f = fragments(spark, sf_dir, True)
    spans = lambda r: F.transform(F.coalesce(F.col(f"{r}.sections"), F.array().cast("array<struct<start:bigint,stop:bigint,read_start:bigint,before:string>>")), lambda s: F.struct(s.start.alias("a"), s.stop.alias("z")))
    apart = F.coalesce(F.col("r1.chr") != F.col("r2.chr"), F.lit(False))
    return f.select("frag", F.when(apart, union_length(spans("r1")) + union_length(spans("r2"))).otherwise(union_length(F.concat(spans("r1"), spans("r2")))).alias("bases"))


def fn22_template_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pair_mates(reads(spark, sf_dir).filter(~fl.has("flag", fl.UNMAPPED)), ["row_id", "own_chr", "pos", "cigar"], "own_chr", "mate_chr").filter("r1.own_chr = r2.own_chr")
    return p.select(F.col("r1.row_id").alias("row_id"), al.template_length(F.col("r1.pos"), reference_span(F.col("r1.cigar")), F.col("r2.pos"), reference_span(F.col("r2.cigar"))).alias("template_length"))


ALL = (g10_aligned, g5_paired_candidates, g14_dense_windows, g14_long_reads, u18_indels, jl_supported_splices, fn5_fragment_lengths, fn22_template_lengths)


def queries() -> dict:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    from seqloom.plans.assignment import _PAIRS, _assign_sql
    from seqloom.plans.sequence import oracle_sql as sequences

    cut = sequences()["a16_votes"]
    rc = "reverse(translate(read_text, 'ACGTacgt', 'TGCAtgca'))"
    long = f"""with bo as (select read_id "read", 0 strand, upper(read_text) s from long_reads where read_id % 20 = 0 and length(read_text) >= 16 union all select read_id, 1, upper({rc}) from long_reads where read_id % 20 = 0 and length(read_text) >= 16),
seeds as (select * from (select "read", strand, o "offset", substr(s, o + 1, 16) kmer from (select *, unnest(range(0, length(s) - 15, 3)) o from bo)) where not regexp_matches(kmer, '[^ACGT]')), pl as """
    votes = long + cut.split("pl as ", 1)[1].removesuffix("select * from v")
    union = lambda rows, by: f"select {by}, sum(greatest(0, z - greatest(a - 1, coalesce(p, a - 1)))) n from (select *, max(z) over (partition by {by} order by a, z rows between unbounded preceding and 1 preceding) p from ({rows})) group by {by}"
    frags = _assign_sql("a1_fragment_counts").split(",\njud as")[0].rstrip().rstrip(",")
    return {
        "g14_dense_windows": votes
        + ', t as (select *, sum(votes) over (partition by "read", strand, contig order by diagonal range between current row and 20000 following) wv from v), r as (select *, cast(row_number() over (partition by "read" order by wv desc, contig, strand, diagonal) as int) rank from t) select "read", strand, contig, diagonal w_start, cast(wv as bigint) votes, rank from r where rank <= 3',
        "u18_indels": _READS
        + """, nx as (select chr, lag(z) over w pos, bef kind, case when bef = 'I' then rs - lag(rs) over w - (lag(z) over w - lag(a) over w + 1) else a - lag(z) over w - 1 end length from secs join al using (row_id) where chr is not null window w as (partition by row_id order by no))
select chr, pos, kind, length, count(*) support, round(case when count(*) < 30 then pow(0.5, 30 - count(*)) else 1 end * pow(2, 30), 3) quality from nx where pos is not null and kind in ('I', 'D') and length <= 100 group by all""",
        "jl_supported_splices": _J
        + """, e as (select distinct transcript_id, chro_name, exon_start a, exon_stop z from tx_exons where chro_name is not null and exon_start <= exon_stop),
kn as (select chr, "left" l, "right" r from jc where n >= 2 union select chro_name, z, r from (select *, lead(a) over (partition by transcript_id, chro_name order by a, z) r from e) where r > z + 1)
select chr, "left", "right", n from jc where not exists (select 1 from kn where kn.chr = jc.chr and l = "left" and r = "right") and (exists (select 1 from kn where kn.chr = jc.chr and l = "left") or exists (select 1 from kn where kn.chr = jc.chr and r = "right"))""",
        "fn5_fragment_lengths": frags
        + f""", fx as (select frag, unnest([i1, i2]) row_id from fr), fs as (select fx.frag, case when (select count(distinct al2.chr) from fx f2 join al al2 on al2.row_id = f2.row_id where f2.frag = fx.frag) > 1 then fx.row_id else 0 end part, s.a, s.z from fx join secs s on s.row_id = fx.row_id),
un as ({union('select * from fs', 'frag, part')}) select fr.frag, cast(coalesce(sum(n), 0) as bigint) bases from fr left join un on un.frag = fr.frag group by fr.frag""",
        "fn22_template_lengths": _PAIRS.replace("from al),\np as", "from al where flag & 4 = 0),\np as")
        + r""", sp as (select row_id, own_chr, pos, coalesce(list_sum(list_transform(regexp_extract_all(cigar, '(\d+)[M=XDN]', 1), lambda x: x::bigint)), 0) span from al)
select a.row_id, cast(case when a.pos <= b.pos then greatest(a.pos + a.span - 1, b.pos + b.span - 1) - a.pos + 1 else b.pos - greatest(a.pos + a.span - 1, b.pos + b.span - 1) - 1 end as bigint) template_length from p join sp a on a.row_id = first_row join sp b on b.row_id = second_row where a.own_chr = b.own_chr""",
    }
