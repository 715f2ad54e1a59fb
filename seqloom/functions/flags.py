"""Bits of alignment flags, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bits of the alignment flag.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, FIRST, SECOND, SECONDARY, DUPLICATE = 0x1, 0x2, 0x4, 0x8, 0x10, 0x20, 0x40, 0x80, 0x100, 0x400


def has(flag: Column | str, bit: int) -> Column:
    return F.coalesce(F.col(flag) if isinstance(flag, str) else flag, F.lit(0)).bitwiseAND(bit) != 0


def fragment_strand(flag: Column | str) -> Column:
    """0 plus, 1 minus: of the fragment a read belongs to; a second mate's own
    strand is the opposite of its fragment's."""
    return (has(flag, REVERSE) != has(flag, SECOND)).cast("int")


def mate_flag(flag: Column | str) -> Column:
    """Flag of the mate that isn't there: unmapped, strand and order bits swap."""
    f = F.coalesce(F.col(flag) if isinstance(flag, str) else flag, F.lit(0))
    swapped = f.bitwiseAND(~(UNMAPPED | MATE_UNMAPPED | REVERSE | MATE_REVERSE | FIRST | SECOND) & 0xFFFF)
    for a, b in ((UNMAPPED, MATE_UNMAPPED), (REVERSE, MATE_REVERSE), (FIRST, SECOND)):
        swapped = swapped.bitwiseOR(F.when(has(f, a), b).otherwise(0)).bitwiseOR(F.when(has(f, b), a).otherwise(0))
    return swapped


def tag(tags: Column | str, name: str) -> Column:
    """Value of a tag in tab-separated ``NAME:TYPE:VALUE`` text, or null."""
    value = F.regexp_extract(tags, rf"(?:^|\t){name}:[A-Za-z]:([^\t]*)", 1)
    return F.nullif(value, F.lit(""))


def hits(tags: Column | str) -> Column:
    """Number of reported places of a read (1 where the tag is absent)."""
    return F.coalesce(F.try_to_number(tag(tags, "NH"), F.lit("999999999")).cast("int"), F.lit(1))


def proper_pair(f1: Column, f2: Column, chr1: Column, chr2: Column, tlen: Column, least: int = 50, most: int = 600) -> Column:
    """Both mapped, on one chromosome, on opposite strands and a length in range."""
    return ~has(f1, UNMAPPED) & ~has(f2, UNMAPPED) & (chr1 == chr2) & (has(f1, REVERSE) != has(f2, REVERSE)) & F.abs(tlen).between(least, most)
