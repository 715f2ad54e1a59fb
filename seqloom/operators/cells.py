"""Single-cell counting: barcodes, molecule tags, matrices and cell ranks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.functions.sequence import hamming
from seqloom.operators.sampling import numbered
from seqloom.session import materialize


def _halves(c: str) -> Column:
    """Two keys of which texts at distance 1 share at least one: the letters
    at odd and those at even places."""
    chars = F.split(c, "")
    odd, even = (F.concat_ws("", F.filter(chars, (lambda p: lambda x, i: i % 2 == p)(p))) for p in (0, 1))
    return F.array(F.concat(F.lit("o"), odd), F.concat(F.lit("e"), even))


def match_barcodes(reads: DataFrame, barcode: str, known: DataFrame, known_barcode: str, order: str) -> DataFrame:
    """Adds ``matched``: the known barcode that is the same, else the first by
    ``order`` at distance exactly 1, else null.

    Only distinct barcodes that are not exact take part in the search; they
    meet the known ones over half keys (equi-joins), never all of them.
    """
    k = known.select(F.col(known_barcode).alias("kb"), F.col(order).alias("ko"))
    own = reads.select(F.col(barcode).alias("rb")).filter("rb is not null").distinct()
    exact = own.join(k, F.col("rb") == F.col("kb")).groupBy("rb").agg(F.min("kb").alias("m"))
    rest = own.join(k.select(F.col("kb").alias("rb")).distinct(), "rb", "left_anti")
    near = rest.withColumn("h", F.explode(_halves("rb"))).join(k.withColumn("h", F.explode(_halves("kb"))), "h").filter(hamming("rb", "kb") == 1)
    fuzzy = near.groupBy("rb").agg(F.min(F.struct("ko", "kb")).kb.alias("m"))
    found = exact.unionByName(fuzzy).withColumnRenamed("m", "matched")
    return reads.join(found, reads[barcode] == F.col("rb"), "left").drop("rb")


def match_samples(reads: DataFrame, tag: str, lane: str, sheet: DataFrame) -> DataFrame:
    """Adds ``sample``: of the sheet's rows (sample, row_no, index1, index2 or
    null, sheet_lane or ``*``) the first whose lane fits and whose indexes
    differ in at most one letter each from the tag's parts (index1 before
    index2). A sheet is a few rows by its nature; only distinct tags meet it."""
    own = reads.select(F.col(tag).alias("_tag"), F.col(lane).cast("string").alias("_lane")).distinct()
    n1 = F.length("index1")
    first = hamming(F.substring(F.col("_tag"), F.lit(1), n1), F.col("index1")) <= 1
    second = F.col("index2").isNull() | (hamming(F.substring(F.col("_tag"), n1 + 1, F.length("index2")), F.col("index2")) <= 1)
    fits = (F.col("sheet_lane") == "*") | (F.col("sheet_lane") == F.col("_lane"))
    found = own.join(F.broadcast(sheet), first & second & fits).groupBy("_tag", "_lane").agg(F.min(F.struct("row_no", "sample")).sample.alias("sample"))
    return reads.join(found, (reads[tag] == F.col("_tag")) & (reads[lane].cast("string") == F.col("_lane")), "left").drop("_tag", "_lane")


def merge_similar_tags(molecules: DataFrame, keys: list[str]) -> DataFrame:
    """Step 1: within (cell, gene) tags of distance 1 are folded, in order of
    falling reads, then tag, each into the first tag accepted before it.

    molecules: keys..., umi, reads. The order is the rule, so it runs per
    group in Python; a group is the tags of one gene in one cell.
    """
    schema = molecules.select(*keys, "umi", "reads").schema

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["reads", "umi"], ascending=[False, True])
        codes = [np.frombuffer(u.encode(), np.uint8) for u in f["umi"]]
        kept, total = [], []
        for i, (code, n) in enumerate(zip(codes, f["reads"])):
            for j, k in enumerate(kept):
                other = codes[k]
                if len(other) == len(code) and np.count_nonzero(other != code) < 2:
                    total[j] += n
                    break
            else:
                kept.append(i)
                total.append(n)
        return f.iloc[kept].assign(reads=total)[[*keys, "umi", "reads"]]

    return molecules.groupBy(*keys).applyInPandas(fold, schema)


def resolve_genes(molecules: DataFrame, cell: list[str], gene: str) -> DataFrame:
    """Step 2: a tag of one cell in several genes stays with the gene of
    strictly most reads, and is dropped if there is none."""
    w = W.partitionBy(*cell, "umi").orderBy(F.desc("reads"), gene)
    ranked = molecules.withColumn("r", F.row_number().over(w)).withColumn("second", F.lead("reads").over(w))
    return ranked.filter((F.col("r") == 1) & (F.col("second").isNull() | (F.col("second") < F.col("reads")))).drop("r", "second")


def cell_gene_counts(molecules: DataFrame, cell: list[str], gene: str) -> DataFrame:
    return molecules.groupBy(*cell, gene).agg(F.count(F.lit(1)).alias("n"))


def ranked_cells(counts: DataFrame, cell: str, sample: list[str] | None = None) -> DataFrame:
    """(sample..., cell, total, rank): cells by falling total, then name."""
    by = sample or []
    totals = counts.groupBy(*by, cell).agg(F.sum("n").alias("total"))
    ranks = numbered(totals, [*by, F.desc("total"), cell], "_no")
    if not by:
        return ranks.select(cell, "total", (F.col("_no") + 1).cast("int").alias("rank"))
    ranks = materialize(ranks)
    first = ranks.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.min("_no").alias("_first"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return ranks.join(first, same).select(*by, cell, "total", (F.col("_no") - F.col("_first") + 1).cast("int").alias("rank"))


def ambient_profile(counts: DataFrame, ranks: DataFrame, cell: str, gene: str, low: int = 45_000, high: int = 90_000) -> DataFrame:
    """Counts by gene over the cells of ranks low to high (exclusive)."""
    return counts.join(ranks.filter((F.col("rank") > low) & (F.col("rank") <= high)).select(cell), cell).groupBy(gene).agg(F.sum("n").alias("n"))


def cell_cutoff(totals: np.ndarray, rounds: int = 100, step: int = 11_218_439) -> int:
    """Number of cells: the mean over rounds of how many totals reach a tenth
    of the one at place n - 30 of a resampling by prime steps, rounded."""
    n = len(totals)
    if n <= 30:
        return n
    ordered = np.sort(totals)
    seed, found = n // 2, []
    for _ in range(rounds):
        picks = (seed + step * np.arange(1, n + 1, dtype=np.int64)) % n
        seed = int(picks[-1])
        drawn = np.sort(ordered[np.sort(picks)])
        cut = int(drawn[n - 30] / 10 + 0.5)
        found.append(int((ordered >= cut).sum()))
    return int(np.mean(found) + 0.5)


def rescue_candidates(ranks: DataFrame, n_cells: int, low: int = 45_000, least: int = 500, share: float = 0.01, most: int = 20_000) -> DataFrame:
    """Cells behind the first ``n_cells`` that may yet be cells: ranks below
    ``low``, totals of at least ``least`` and ``share`` of the first cells'
    median, at most ``most`` of them."""
    median = ranks.filter(F.col("rank") <= n_cells).select(F.percentile("total", F.lit(0.5))).scalar()
    return ranks.filter((F.col("rank") > n_cells) & (F.col("rank") < low) & (F.col("total") >= F.greatest(F.lit(float(least)), median * share))).filter(F.col("rank") <= n_cells + most)


def matrix(counts: DataFrame, cell: str, gene: str) -> DataFrame:
    """Coordinate form of the matrix: (gene_no, cell_no, n), numbered from 1 in
    the order of names. Distinct names are numbered, then joined back."""
    def names(c: str, no: str) -> DataFrame:
        return numbered(counts.select(c).distinct(), [c], no).withColumn(no, (F.col(no) + 1).cast("int"))

    return counts.join(names(gene, "gene_no"), gene).join(names(cell, "cell_no"), cell).select("gene_no", "cell_no", "n")
