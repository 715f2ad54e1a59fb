"""Queries of the two general data problems, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators.heavy_keys import heavy_keys, key_profile
from seqloom.operators.periods import merge_intervals

SEG_KEYS = ["transcript_id", "chro_name", "is_negative_strand"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        heavy_keys(table(spark, sf_dir, t), k, "loaded_at").select(F.lit(t).alias("table_name"), "key_value")
        for t, k in (("alignments", "gene_name"), ("tx_exons", "chro_name"))
    ]
    return parts[0].unionByName(parts[1])


def _profile(df: DataFrame, key: str, value) -> DataFrame:
    return key_profile(df, key, "loaded_at", value)


def p1_gene_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(table(spark, sf_dir, "alignments"), "gene_name", F.abs("tlen"))


def p1_chro_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = F.when(F.col("exon_start") <= F.col("exon_stop"), F.col("exon_stop") - F.col("exon_start") + 1)
    return _profile(table(spark, sf_dir, "tx_exons"), "chro_name", length)


def p3_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    exons = table(spark, sf_dir, "tx_exons").filter(F.col("chro_name").isNotNull())
    return merge_intervals(exons, SEG_KEYS, "exon_start", "exon_stop")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_segments(spark, sf_dir)


def p3_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered and uncovered length of every transcript."""
    size = F.col("seg_stop") - F.col("seg_start") + 1
    return p3_segments(spark, sf_dir).groupBy(*SEG_KEYS).agg(
        F.count_if(F.col("seg_kind") == "period").alias("n_periods"),
        F.sum(F.when(F.col("seg_kind") == "period", size).otherwise(0)).alias("covered"),
        F.sum(F.when(F.col("seg_kind") == "gap", size).otherwise(0)).alias("uncovered"),
        F.min("seg_start").alias("span_start"),
        F.max("seg_stop").alias("span_stop"),
    )


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_gene_profile, p1_chro_profile, p3_found, p3_coverage)}


_PROFILE = """
with r as (select {key} k, loaded_at, cast(loaded_at as date) d, {value} v from {table}),
days as (select k, d, date_diff('day', lag(d) over (partition by k order by d), d) g from (select distinct k, d from r where d is not null)),
gaps as (select k, count(*) n_days, coalesce(max(g), 0) gap from days group by k),
tot as (select k, count(*) n_rows, count(v) n_values, cast(coalesce(sum(v), 0) as bigint) total, epoch_us(max(loaded_at)) last_load from r group by k)
select t.k key_value, n_rows, n_values, total, last_load, cast(coalesce(n_days, 0) as bigint) n_days, cast(coalesce(gap, 0) as bigint) longest_gap_days
from tot t left join gaps g on t.k is not distinct from g.k
"""

_SEGMENTS = """
with x as (select distinct transcript_id, chro_name, is_negative_strand, exon_start a, exon_stop z from tx_exons
  where chro_name is not null and exon_start is not null and exon_stop is not null and exon_start <= exon_stop),
y as (select *, max(z) over (partition by transcript_id, chro_name, is_negative_strand order by a, z rows between unbounded preceding and 1 preceding) p from x),
s as (select *, sum(case when p is null or a > p + 1 then 1 else 0 end) over (partition by transcript_id, chro_name, is_negative_strand order by a, z rows unbounded preceding) i from y),
per as (select transcript_id, chro_name, is_negative_strand, i, min(a) a, max(z) z from s group by all),
gap as (select transcript_id, chro_name, is_negative_strand, lag(z) over (partition by transcript_id, chro_name, is_negative_strand order by i) + 1 a, a - 1 z from per),
seg as (select transcript_id, chro_name, is_negative_strand, 'period' seg_kind, a seg_start, z seg_stop from per
  union all select transcript_id, chro_name, is_negative_strand, 'gap', a, z from gap where a is not null)
"""


def oracle_sql() -> dict[str, str]:
    keys = ", ".join(SEG_KEYS)
    return {
        "p1_found": """
select 'alignments' table_name, gene_name key_value from alignments where gene_name is not null group by 2
having count(*) >= 0.02 * (select count(*) from alignments)
union all
select 'tx_exons', chro_name from tx_exons where chro_name is not null group by 2
having count(*) >= 0.02 * (select count(*) from tx_exons)""",
        "p1_gene_profile": _PROFILE.format(key="gene_name", value="abs(tlen)", table="alignments"),
        "p1_chro_profile": _PROFILE.format(key="chro_name", value="case when exon_start <= exon_stop then exon_stop - exon_start + 1 end", table="tx_exons"),
        "p3_found": _SEGMENTS + "select * from seg",
        "p3_coverage": _SEGMENTS + f"""
select {keys}, count(*) filter (seg_kind = 'period') n_periods,
  cast(sum(case when seg_kind = 'period' then seg_stop - seg_start + 1 else 0 end) as bigint) covered,
  cast(sum(case when seg_kind = 'gap' then seg_stop - seg_start + 1 else 0 end) as bigint) uncovered,
  min(seg_start) span_start, max(seg_stop) span_stop from seg group by {keys}""",
    }
