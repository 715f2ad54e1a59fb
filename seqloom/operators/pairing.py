"""Bringing the two mates of a fragment together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.flags import FIRST, PAIRED, SECOND, UNMAPPED, has, mate_flag, tag


def fragment_name(qname: Column | str) -> Column:
    """Read name up to a slash."""
    return F.substring_index(qname, "/", 1)


def pair_key(df: DataFrame, chr: str = "rname", mate_chr: str | None = None) -> list[Column]:
    """Columns that both mates of one reported place share: the name, the
    chromosomes and places of mate 1 and mate 2 (null if unmapped) and the hit
    number. chr, mate_chr: columns of one naming for both mates; by default
    rname and rnext as they are."""
    here, there = ~has("flag", UNMAPPED), ~has("flag", 0x8)
    other = F.col(mate_chr) if mate_chr else F.when(F.col("rnext") == "=", F.col(chr)).otherwise(F.col("rnext"))
    own = {"chr": F.when(here, F.col(chr)), "pos": F.when(here, F.col("pos"))}
    mate = {"chr": F.when(there, other), "pos": F.when(there, F.col("pnext"))}
    first = has("flag", FIRST)
    sides = [f(c) for c in ("chr", "pos") for f in (lambda c: F.when(first, own[c]).otherwise(mate[c]).alias(f"{c}1"), lambda c: F.when(first, mate[c]).otherwise(own[c]).alias(f"{c}2"))]
    return [fragment_name("qname").alias("fragment"), *sides, F.coalesce(tag("tags", "HI"), F.lit("")).alias("hit")]


def pair_mates(df: DataFrame, columns: list[str], chr: str = "rname", mate_chr: str | None = None) -> DataFrame:
    """One row a fragment place: (fragment, chr1, chr2, pos1, pos2, hit, r1,
    r2), r1 and r2 being structs of ``columns`` of the first and second mate,
    null if absent.

    A full outer join of first and second mates by one grouping: partial
    aggregates are made before the shuffle. Of rows given twice the one of
    least columns stays. Single reads are rows with r1 alone.
    """
    row = F.struct(*columns)
    second = has("flag", PAIRED) & has("flag", SECOND)
    return df.groupBy(*pair_key(df, chr, mate_chr)).agg(F.min(F.when(~second, row)).alias("r1"), F.min(F.when(second, row)).alias("r2"))


def with_dummies(pairs: DataFrame, flag: str = "flag") -> DataFrame:
    """Pairs in which a missing mate is a row of its own: unmapped place,
    inferred flag, all else null."""
    fields = pairs.schema["r1"].dataType.fields
    out = pairs
    for have, lack in (("r1", "r2"), ("r2", "r1")):
        made = F.struct(*[(mate_flag(F.col(have)[flag]).cast(f.dataType) if f.name == flag else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields])
        out = out.withColumn(lack, F.when(F.col(lack).isNull() & F.col(have).isNotNull() & has(F.col(have)[flag], PAIRED), made).otherwise(F.col(lack)))
    return out


def mapped_share(df: DataFrame, fragments: bool = True, proper: bool = False) -> DataFrame:
    """(n_all, n_mapped, share) of fragments, or of single rows."""
    ok = ~has("flag", UNMAPPED) & (has("flag", 0x2) if proper else F.lit(True))
    units = df.groupBy(fragment_name("qname").alias("f")).agg(F.max(ok).alias("ok")) if fragments else df.select(ok.alias("ok"))
    return units.agg(F.count(F.lit(1)).alias("n_all"), F.count_if("ok").alias("n_mapped")).withColumn("share", F.col("n_mapped") / F.col("n_all"))
