"""Alignment strings (CIGAR) as arrays of sections, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqloom.functions.flags import FIRST, REVERSE, has, tag

_OP = r"(\d+)([MIDNSHP=X])"
SECTION = "struct<start:bigint,stop:bigint,read_start:bigint,before:string>"


def operations(cigar: Column | str) -> Column:
    """array<struct<n, op>>; empty for null, ``*`` and text without operations."""
    parts = F.coalesce(F.regexp_extract_all(cigar, F.lit(_OP), F.lit(0)), F.array().cast("array<string>"))
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, _OP, 1).cast("bigint").alias("n"), F.regexp_extract(p, _OP, 2).alias("op")))


def sections(pos: Column | str, cigar: Column | str, most: int = 10) -> Column:
    """Sections of the reference that a read covers (1-based, inclusive).

    M, = and X extend a section; I, D and N close it; soft clips move the
    place in the read; H and P do nothing. Only the first ``most`` sections
    are kept. Each has its start, stop, read_start (from 1) and the operation
    before it (I, D, N; null for the first).
    """
    pos = F.col(pos) if isinstance(pos, str) else pos
    zero = F.lit(0).cast("bigint")
    none = F.lit(None).cast("string")
    state = F.struct(pos.cast("bigint").alias("at"), F.lit(1).cast("bigint").alias("read"), zero.alias("run"), none.alias("last"), F.array().cast(f"array<{SECTION}>").alias("out"))

    def closed(s: Column) -> Column:
        new = F.struct((s["at"] - s["run"]).alias("start"), (s["at"] - 1).alias("stop"), (s["read"] - s["run"]).alias("read_start"), s["last"].alias("before"))
        return F.when(s["run"] > 0, F.array_append(s["out"], new.cast(SECTION))).otherwise(s["out"])

    def step(s: Column, o: Column) -> Column:
        n, op = o["n"], o["op"]
        covers, closes = op.isin("M", "=", "X"), op.isin("I", "D", "N")
        return F.struct(
            F.when(covers | op.isin("D", "N"), s["at"] + n).otherwise(s["at"]).alias("at"),
            F.when(covers | op.isin("I", "S"), s["read"] + n).otherwise(s["read"]).alias("read"),
            # a closed section's run is 0 again; its place is taken from before the gap
            F.when(covers, s["run"] + n).when(closes, zero).otherwise(s["run"]).alias("run"),
            F.when(closes, op).otherwise(s["last"]).alias("last"),
            F.when(closes, closed(s)).otherwise(s["out"]).alias("out"),
        )

    # a soft clip at the end would move the place in the read past the open section
    trimmed = F.regexp_replace(cigar, r"\d+[SHP]+$", "")
    return F.aggregate(operations(trimmed), state, step, lambda s: F.slice(closed(s), 1, most))


def is_split(cigar: Column | str) -> Column:
    return F.coalesce(F.contains(F.col(cigar) if isinstance(cigar, str) else cigar, F.lit("N")), F.lit(False))


def covered_bases(cigar: Column | str) -> Column:
    """Bases of the reference that sections cover."""
    return F.aggregate(operations(cigar), F.lit(0).cast("bigint"), lambda t, o: t + F.when(o["op"].isin("M", "=", "X"), o["n"]).otherwise(0))


def reference_span(cigar: Column | str) -> Column:
    """Length from first to last covered base, gaps included."""
    return F.aggregate(operations(cigar), F.lit(0).cast("bigint"), lambda t, o: t + F.when(o["op"].isin("M", "=", "X", "D", "N"), o["n"]).otherwise(0))


def leading_clip(cigar: Column | str) -> Column:
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(cigar, r"^(?:\d+H)?(\d+)S", 1), F.lit("")), F.lit("999999999")).cast("bigint"), F.lit(0).cast("bigint"))


def reversed_cigar(cigar: Column | str) -> Column:
    """The operations in reverse order."""
    return F.concat_ws("", F.reverse(F.coalesce(F.regexp_extract_all(cigar, F.lit(_OP), F.lit(0)), F.array().cast("array<string>"))))


def left_end(right: Column | str, cigar: Column | str) -> Column:
    """First covered base of an alignment that ends at ``right``."""
    right = F.col(right) if isinstance(right, str) else right
    return right - reference_span(cigar) + 1


def chimeric_sections(tags: Column | str, flag: Column | str) -> Column:
    """Sections of a read's other part, given in tags: CC its chromosome, CP
    its place, CG its operations, CT its strand. array<struct<chr, sections>>,
    empty unless all four are there.

    Where CT differs from the read's own strand, CP is the right end.
    """
    cc, cp, cg, ct = (tag(tags, x) for x in ("CC", "CP", "CG", "CT"))
    own_minus = (has(flag, FIRST) == has(flag, REVERSE)) & has(flag, FIRST) | (~has(flag, FIRST) & ~has(flag, REVERSE))
    place = F.try_to_number(cp, F.lit("999999999999")).cast("bigint")
    start = F.when((ct == "-") == own_minus, place).otherwise(place - reference_span(cg) + 1)
    there = cc.isNotNull() & place.isNotNull() & cg.isNotNull() & ct.isNotNull()
    return F.when(there, F.array(F.struct(cc.alias("chr"), sections(start, cg).alias("sections")))).otherwise(F.array().cast(f"array<struct<chr:string,sections:array<{SECTION}>>>"))
