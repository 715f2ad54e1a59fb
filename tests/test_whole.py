"""Queries that must take in the whole of their tables."""

import random

from pyspark.sql import functions as F

from seqloom.operators import cells, pileup
from seqloom.plans.aligning import g14_long_reads, jl_supported_splices
from seqloom.plans.sequence import a20_ambient_ranks, fn16_window_codes, k10_planted_variants, w6_rescue_called
from seqloom.plans.assignment import k1_sample_counts

SF = "/root/testdata/sf0.01"


def test_counts_of_every_sample(spark, tmp_path):
    al = spark.read.parquet(f"{SF}/alignments.parquet").withColumn("sample_id", F.when(F.col("row_id") % 7 > 0, F.col("sample_id")))
    for name in ("genes", "tx_exons", "chr_alias"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    al.write.parquet(f"{tmp_path}/alignments.parquet")
    got, whole = (k1_sample_counts(spark, d).toPandas() for d in (str(tmp_path), SF))
    samples = {r.sample_id for r in al.select("sample_id").distinct().collect()}
    assert None in samples and len(samples) > 4 and set(got.sample_id.astype(object).where(got.sample_id.notna(), None)) == samples
    assert got.n.sum() == whole.n.sum() > 0 and got.n[got.sample_id.isna()].sum() > 0
    assert len(got) == got.gene.nunique() * len(samples)


def test_variants_shared_by_all_files(spark):
    rows = [("SNP", "c", p, "A", "G", 10 + i, f) for p in (1, 2) for i, f in enumerate(("a", "b", None, "d")) if (p, f) not in ((2, None), (2, "d"))]
    v = spark.createDataFrame(rows, "kind string, chr string, pos long, ref string, alt string, quality int, file string")
    assert [(r.pos, r.quality, r.file) for r in pileup.shared_variants(v).collect()] == [(1, 10, "a")]


def test_long_reads_are_placed_whole(spark, tmp_path):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    often = text(40)  # stands 50 times: below the threshold of 100
    contig = text(9_000) + often * 50 + text(30_000)
    back = contig[15_000:21_000][::-1].translate(str.maketrans("ACGT", "TGCA"))
    # only the middle of the first read is of the contig, between places where ten spaced seeds fall
    reads = [(1, text(700) + contig[3_000:3_300] + text(5_000)), (2, back), (3, text(3_000)), (4, contig[12_000:38_000]), (5, often[:30]), (6, None)]
    spark.createDataFrame([(1, "c", 1_000, contig)], "block_id long, chro_name string, start_base_offset long, base_values string").write.parquet(f"{tmp_path}/index_blocks.parquet")
    spark.createDataFrame(reads, "read_id long, read_text string").write.parquet(f"{tmp_path}/long_reads.parquet")
    got = {(r.read, r["rank"]): r for r in g14_long_reads(spark, str(tmp_path)).collect()}
    best = {k: (r.strand, r.w_start, r.votes) for (k, rank), r in got.items() if rank == 1}
    assert best[1][:2] == (0, 1_000 + 3_000 - 700) and best[1][2] >= 90
    assert best[2] == (1, 16_000, (6_000 - 16) // 3 + 1)
    assert best[4] == (0, 13_000, (26_000 - 16) // 3 + 1)
    assert 3 not in best and best[5][2] == 5 * 50 and 6 not in best


def test_variants_all_over_the_blocks(spark):
    got = {(r.chr, r.pos) for r in k10_planted_variants(spark, SF).select("chr", "pos").collect()}
    planted = set()
    for b in spark.read.parquet(f"{SF}/index_blocks.parquet").filter("base_values is not null").collect():
        s = b.base_values.upper()
        # near an end there are few reads, and letters that aren't bases have no variants
        planted |= {(f"{b.chro_name}/{b.block_id}", p) for p in range(101, len(s) - 100, 260) if s[p - 1] in "ACGT"}
    assert max(p for _, p in planted) > 10_000
    assert len(planted & got) >= 0.99 * len(planted)
    assert all(p % 260 == 101 for _, p in got)


def test_codes_of_every_window(spark):
    windows = sum(max(0, len(r.read_text or "") - 15) for r in spark.read.parquet(f"{SF}/long_reads.parquet").collect())
    assert 0.9 * windows < fn16_window_codes(spark, SF).count() <= windows


def test_known_splices_by_support(spark, tmp_path):
    for name in ("genes", "tx_exons", "chr_alias"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0 if name == "tx_exons" else 10**6).write.parquet(f"{tmp_path}/{name}.parquet")
    chrom = spark.read.parquet(f"{SF}/genes.parquet").first().chro_name
    # (left, right, fragments): 1,000 and 2,002 are no multiples of 3, 3,000 is one
    junctions = [(1_000, 1_501, 2), (1_000, 1_701, 1), (2_002, 2_501, 2), (2_102, 2_501, 1), (3_000, 3_501, 1), (3_000, 3_701, 1)]
    reads = [(f"j{i}x{k}", left - 49, f"50M{right - left - 1}N50M") for i, (left, right, n) in enumerate(junctions) for k in range(n)]
    al = spark.read.parquet(f"{SF}/alignments.parquet")
    row = al.filter("sample_id is not null").first().asDict()
    rows = [row | {"row_id": i, "qname": q, "flag": 0, "rname": chrom, "pos": p, "cigar": c, "tags": None} for i, (q, p, c) in enumerate(reads)]
    spark.createDataFrame(rows, al.schema).write.parquet(f"{tmp_path}/alignments.parquet")
    got = {(r.left, r.right, r.n) for r in jl_supported_splices(spark, str(tmp_path)).collect()}
    assert got == {(1_000, 1_701, 1), (2_102, 2_501, 1)}


def _read_log(spark, tmp_path, totals: dict[int, int]) -> str:
    """A log of cells x<no>/0 with as many rows as given, each of its own gene."""
    t = spark.createDataFrame(list(totals.items()), "no long, n int")
    log = t.select(F.format_string("x%06d", "no").alias("run_id"), F.lit(50).cast("long").alias("log_id"), F.format_string("g%d", "no").alias("sample_id"), F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    log.write.parquet(f"{tmp_path}/read_log.parquet")
    return str(tmp_path)


def test_ambient_ranks(spark, tmp_path):
    d = _read_log(spark, tmp_path, {i: 2 if i <= 45_000 else 1 for i in range(1, 90_003)})
    got = sorted(int(r.gene[1:]) for r in a20_ambient_ranks(spark, d).select("gene").collect())
    assert (got[0], got[-1], len(got)) == (45_001, 90_000, 45_000)


def test_cells_behind_the_bootstrap(spark, tmp_path):
    # the bootstrap calls the first 60 of 2,060; of the others those of 500 and more may yet be cells, 1,500 of them
    d = _read_log(spark, tmp_path, {i: 8_000 if i <= 60 else 500 if i <= 1_560 else 499 for i in range(1, 2_061)})
    got = w6_rescue_called(spark, d).agg(F.min("rank"), F.max("rank"), F.count("rank")).first()
    assert tuple(got) == (61, 1_560, 1_500)


def test_rescue_ends_at_its_rank(spark):
    ranks = spark.range(1, 60_001).select(F.col("id").cast("string").alias("cell"), F.lit(900).cast("long").alias("total"), F.col("id").cast("int").alias("rank"))
    for n_cells, last in ((30_000, 44_999), (10_000, 30_000)):
        assert tuple(cells.rescue_candidates(ranks, n_cells).agg(F.min("rank"), F.max("rank")).first()) == (n_cells + 1, last)
