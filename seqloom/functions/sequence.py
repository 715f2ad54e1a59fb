"""Functions of base and quality texts, as columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Splice-site dinucleotides (donor, acceptor) and their class.
SPLICE_CLASSES = {("GT", "AG"): 1, ("CT", "AC"): 2, ("GC", "AG"): 3, ("CT", "GC"): 4, ("AT", "AC"): 5, ("GT", "AT"): 6}


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def kmer_code(kmer: Column | str, k: int = 16) -> Column:
    """Two bits a base (A 0, G 1, C 2, T 3), first base highest; null where
    another letter stands."""
    kmer = F.col(kmer) if isinstance(kmer, str) else kmer
    digits = F.conv(F.translate(F.upper(kmer), "AGCT", "0123"), 4, 10).cast("long")
    return F.when(F.upper(kmer).rlike(f"^[ACGT]{{{k}}}$"), digits)


def scores(qual: Column | str, zero: int = 33) -> Column:
    """Scores of a quality text; ``zero`` is 33 or 64."""
    return F.transform(F.filter(F.split(qual, ""), lambda c: c != ""), lambda c: F.ascii(c) - zero)


def hamming(a: Column | str, b: Column | str) -> Column:
    """Number of differing letters of two texts of one length, else null."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.when(F.length(a) == F.length(b), F.aggregate(pairs, F.lit(0), lambda t, x: t + F.coalesce(x, F.lit(0))))


def splice_class(donor: Column, acceptor: Column) -> Column:
    out = F.lit(0)
    for (d, a), n in SPLICE_CLASSES.items():
        out = F.when((F.upper(donor) == d) & (F.upper(acceptor) == a), n).otherwise(out)
    return out


def junction_strand(donor: Column, acceptor: Column) -> Column:
    c = splice_class(donor, acceptor)
    return F.when(c == 1, "+").when(c == 2, "-").otherwise("NA")


def mapping_quality(candidates: Column, mismatches: Column, tied: Column) -> Column:
    return F.when(tied, 0).otherwise(F.floor(F.lit(40) / (candidates + mismatches))).cast("int")


def gc_bases(seq: Column | str) -> Column:
    return F.length(F.regexp_replace(seq, "[^GCgc]", ""))


def called_bases(seq: Column | str) -> Column:
    return F.length(F.regexp_replace(seq, "[^ACGTacgt]", ""))


def trimmed(seq: Column | str, five: int, three: int) -> Column:
    seq = F.col(seq) if isinstance(seq, str) else seq
    return F.when(F.length(seq) <= five + three, "").otherwise(F.substring(seq, F.lit(five + 1), F.length(seq) - five - three))


def _log_choose(n: np.ndarray, k: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[n] - table[k] - table[n - k]


def fisher_one_sided(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """P of a table [[a, b], [c, d]] at least as rich in a, by the hypergeometric
    distribution with a cumulated table of log factorials."""
    a, b, c, d = (np.asarray(x, dtype=np.int64) for x in (a, b, c, d))
    if not len(a):
        return np.zeros(0)
    top = int((a + b + c + d).max())
    table = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, top + 1)))])
    out = np.zeros(len(a))
    most = np.minimum(b, c)
    base = _log_choose(a + c, a, table) + _log_choose(b + d, b, table) - _log_choose(a + b + c + d, a + b, table)
    p = np.exp(base)
    x, term = np.zeros(len(a), np.int64), p.copy()
    out += p
    live = most > 0
    while live.any():
        i = np.flatnonzero(live)
        # next table: a, d up by one; b, c down by one
        term[i] *= (b[i] - x[i]) * (c[i] - x[i]) / ((a[i] + x[i] + 1.0) * (d[i] + x[i] + 1.0))
        out[i] += term[i]
        x[i] += 1
        live[i] = (x[i] < most[i]) & (term[i] > 1e-18 * np.maximum(out[i], 1e-300))
    return np.minimum(out, 1.0)


@F.pandas_udf(T.DoubleType())
def fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series(fisher_one_sided(a, b, c, d))


@F.pandas_udf(T.DoubleType())
def inverse_normal(p: pd.Series) -> pd.Series:
    """Quantiles of the standard normal distribution, by Newton's method."""
    x = np.where(p < 0.5, -1.0, 1.0) * np.sqrt(np.maximum(0, -2 * np.log(np.minimum(p, 1 - p)))) * 0.8
    erf = np.vectorize(math.erf)
    for _ in range(30):
        x = x - np.clip((0.5 * (1 + erf(x / math.sqrt(2))) - p) / np.maximum(np.exp(-x * x / 2) / math.sqrt(2 * math.pi), 1e-300), -1, 1)
    return pd.Series(x)
