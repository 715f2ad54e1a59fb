"""Readers and writers on small hand-written files, and round trips."""

import gzip
import random

import pytest

from seqloom.operators.assign import Options, assign, gene_lengths, summary, target_counts
from seqloom.functions.cigar import sections
from seqloom.functions.flags import hits
from seqloom.sources import binary, text, writers
from pyspark.sql import functions as F


def test_sam(spark, tmp_path):
    p = tmp_path / "a.sam"
    p.write_text("@HD\tVN:1.0\n@SQ\tSN:chr1\tLN:1000\n@PG\nr1\t99\tchr1\t10\t60\t5M\t=\t50\t45\tACGTA\tIIIII\tNH:i:2\tHI:i:1\nr2\t4\t*\t*\t*\t*\t*\t*\t*\tN\tI\nshort\tline\n")
    rows = {r.qname: r for r in text.read_sam(spark, str(p)).collect()}
    assert rows["r1"].pos == 10 and rows["r1"].tags == "NH:i:2\tHI:i:1" and rows["r2"].pos is None and rows["r2"].tags is None and len(rows) == 2
    assert [tuple(r) for r in text.read_sam_references(spark, str(p)).collect()] == [("chr1", 1000)]


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">c1 first\nacgt\nNN\n>c2\nGG>A\n>c3\n\n")
    assert sorted(tuple(r) for r in text.read_fasta(spark, str(tmp_path / "a.fa")).collect()) == [("c1", "ACGTNN"), ("c2", "GG>A"), ("c3", "")]


def test_annotations(spark, tmp_path):
    (tmp_path / "a.gtf").write_text('#c\nchr1\tx\texon\t5\t9\t.\t+\t.\tgene_id "g1"; transcript_id "t1";\nchr1\tx\tCDS\t5\t9\t.\t+\t.\tgene_id "g1";\nchr2\tx\texon\t1\t3\t.\t.\t.\tID=e1;gene_id=g2\n')
    rows = sorted(tuple(r)[1:] for r in text.read_gtf(spark, str(tmp_path / "a.gtf"), extra=("transcript_id",)).collect())
    assert rows == [("g1", "chr1", 5, 9, 0, "t1"), ("g2", "chr2", 1, 3, -1, None)]
    (tmp_path / "b.gtf").write_text("chr1\tx\texon\t9\t5\t.\t+\t.\tother x\n")
    with pytest.raises(Exception, match="bad feature"):
        text.read_gtf(spark, str(tmp_path / "b.gtf")).collect()
    assert text.read_gtf(spark, str(tmp_path / "b.gtf"), strict=False).count() == 0
    (tmp_path / "a.saf").write_text("geNeiD\tchR\tstart\tEnd\tStrand\n@SQ\tx\ng1\tchr1\t5\t9\t-\ng2\tchr1\t5\t9\t\ng3\tchr1\t5\t9\t?\n")
    assert sorted(tuple(r)[1:] for r in text.read_saf(spark, str(tmp_path / "a.saf")).collect()) == [("g1", "chr1", 5, 9, 1), ("g2", "chr1", 5, 9, 0), ("g3", "chr1", 5, 9, -1)]
    (tmp_path / "al.txt").write_text("#x\nchr3,III\n")
    assert [tuple(r) for r in text.read_alias(spark, str(tmp_path / "al.txt")).collect()] == [("chr3", "III")]


def test_small_formats(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("##x\n#CHROM\nc1\t5\t.\tA\tG,CT\t12.5\t.\tDP=3\nc1\t9\t.\tAC\tG\t.\t.\tDP=3\nc1\t11\t.\tA\tAT\t3\t.\tINDEL;DP=1\n")
    v = text.read_vcf(spark, str(tmp_path / "a.vcf"))
    assert v.count() == 3 and [tuple(r) for r in text.known_snps(v).collect()] == [("c1", 5)]
    (tmp_path / "a.bed").write_text("track x\nc1\t4\t9\tn\t0\t+\nc2\t0\t1\n")
    assert sorted(tuple(r) for r in text.read_bed(spark, str(tmp_path / "a.bed")).collect())[0] == ("c1", 5, 9, "n", "0", "+")
    (tmp_path / "j.txt").write_text("j1\t1\t5\t9\nj2\tchrX\t7\t8\nbad\n")
    assert sorted(tuple(r) for r in text.read_junction_table(spark, str(tmp_path / "j.txt")).collect()) == [("j1", "chr1", 5, 9), ("j2", "chrX", 7, 8)]
    (tmp_path / "b.txt").write_text("ACGT-1\nGGTT\n\n")
    assert sorted(r.barcode for r in text.read_barcodes(spark, str(tmp_path / "b.txt")).collect()) == ["ACGT", "GGTT"]
    (tmp_path / "s.csv").write_text("EMFileVersion,4\n[Data]\nLane,SampleName,Index1\n*,s1,ACGT\n2,s2,GG\n")
    assert [(r.sample, r.fields["Lane"]) for r in text.read_sample_sheet(spark, str(tmp_path / "s.csv")).orderBy("row_no").collect()] == [("s1", "*"), ("s2", "2")]


@pytest.mark.parametrize("split", [64 << 20, 100, 37])
def test_fastq_ranges(spark, tmp_path, split):
    binary.register(spark)
    rng = random.Random(1)
    rows = []
    for i in range(60):
        n = rng.randrange(1, 30)
        rows.append((f"r{i}", "".join(rng.choice("ACGTN") for _ in range(n)), "@" + "".join(rng.choice("@+I#") for _ in range(n - 1))))
    (tmp_path / "a.fq").write_text("".join(f"@{a} x\n{s}\n+\n{q}\n" for a, s, q in rows))
    got = spark.read.format("fastq").option("split", split).load(str(tmp_path / "a.fq")).collect()
    assert sorted(tuple(r)[:3] for r in got) == sorted(rows)
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write("@a\nACGT\n+\nhhhh\n")
    assert [tuple(r)[:3] for r in spark.read.format("fastq").option("phred", 64).option("trim5", 1).load(str(tmp_path / "b.fq.gz")).collect()] == [("a", "CGT", "III")]


def test_bam_round_trip(spark, tmp_path):
    binary.register(spark)
    rng = random.Random(2)
    rows = []
    for i in range(6000):
        n = rng.randrange(1, 120)
        seq = "".join(rng.choice("ACGTN") for _ in range(n))
        unmapped = i % 11 == 0
        rows.append((f"read{i}/1", 4 if unmapped else 99, "*" if unmapped else rng.choice(["chr1", "chr2"]), 0 if unmapped else rng.randrange(1, 10**6), rng.randrange(60), "*" if unmapped else f"{n}M", "*" if unmapped else "=", 0 if unmapped else rng.randrange(1, 10**6), rng.randrange(-500, 500), seq, "".join(chr(33 + rng.randrange(40)) for _ in range(n)), rng.choice([None, "NH:i:3\tXT:Z:g1"])))
    schema = "qname string, flag int, rname string, pos long, mapq int, cigar string, rnext string, pnext long, tlen long, seq string, qual string, tags string"
    df = spark.createDataFrame(rows, schema)
    folder = str(tmp_path / "bam")
    binary.write_bam(df.repartition(2), folder, [("chr1", 10**7), ("chr2", 10**7)])
    for split in (1 << 26, 70_000, 9_000):
        got = spark.read.format("bam").option("split", split).load(folder).drop("input_file").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, rows))
    assert {r.kind for r in text.sniff(spark, folder).collect()} == {"bam"}
    binary.write_bam(df, str(tmp_path / "sorted"), [("chr1", 10**7), ("chr2", 10**7)], sort=True)
    got = [(r.rname, r.pos) for r in spark.read.format("bam").load(str(tmp_path / "sorted")).collect()]
    assert got == sorted(got, key=lambda x: ({"chr1": 0, "chr2": 1, "*": 2}[x[0]], x[1]))


def test_writers(spark, tmp_path):
    sam = spark.createDataFrame([("r", 0, "c", 5, 9, "3M", None, None, None, "ACG", "III", "NH:i:1")], "qname string, flag int, rname string, pos long, mapq int, cigar string, rnext string, pnext long, tlen long, seq string, qual string, tags string")
    writers.write_lines(writers.sam_lines(sam), str(tmp_path / "o.sam"), ["@HD\tVN:1.0"], single=True)
    assert [r.qname for r in text.read_sam(spark, str(tmp_path / "o.sam")).collect()] == ["r"]
    fa = spark.createDataFrame([("c", "ACGT" * 40)], "n string, s string")
    writers.write_lines(writers.fasta_lines(fa, "n", "s"), str(tmp_path / "o.fa"))
    assert [tuple(r) for r in text.read_fasta(spark, str(tmp_path / "o.fa")).collect()] == [("c", "ACGT" * 40)]
    lines, head = writers.matrix_lines(spark.createDataFrame([(1, 1, 5), (2, 1, 7)], "gene_no int, cell_no int, n long"))
    assert head[1] == "2 1 2" and [r.value for r in lines.collect()] == ["1 1 5", "2 1 7"]


def fragments(rows, spark):
    df = spark.createDataFrame(rows, "frag long, flag int, chr string, pos long, mapq int, cigar string, tags string, tlen long")
    r = F.struct("flag", "chr", "pos", "mapq", "cigar", "tlen", hits("tags").alias("nh"), sections("pos", "cigar").alias("sections"))
    return df.select("frag", r.alias("r1"), F.when(F.lit(False), r).alias("r2"))


def features(rows, spark):
    return spark.createDataFrame(rows, "feature_id long, gene string, chr string, start long, stop long, strand int")


def test_fractions_as_worked_by_hand(spark, tmp_path):
    """Three genes share a place; reads with 1 to 3 hits give floors of floors."""
    feats = features([(1, "g1", "c", 1, 300, 0), (2, "g2", "c", 200, 500, 0), (3, "g3", "c", 200, 290, 0)], spark)
    reads = fragments([(1, 0, "c", 210, 9, "50M", "NH:i:3", 0), (2, 0, "c", 10, 9, "50M", "NH:i:3", 0), (3, 0, "c", 100, 9, "50M", "NH:i:3", 0), (4, 0, "c", 400, 9, "50M", "NH:i:1", 0), (5, 4, "*", 0, 0, "*", None, 0), (6, 0, "x", 5, 9, "5M", None, 0)], spark)
    a = assign(reads, feats, Options(allow_overlap=True, multi_mapping=True, fraction=True))
    got = {r.target: r.count65536 for r in target_counts(a).collect()}
    third = 65536 // 3
    assert got == {"g1": third // 3 + 2 * third, "g2": third // 3 + 65536, "g3": third // 3}
    s = {r.status: r.n for r in summary(a).collect()}
    assert s["Assigned"] == 4 and s["Unassigned_Unmapped"] == 1 and s["Unassigned_NoFeatures"] == 1 and sum(s.values()) == 6
    assert {r.gene: r.length for r in gene_lengths(feats).collect()} == {"g1": 300, "g2": 301, "g3": 91}
    t = writers.gene_table(feats, gene_lengths(feats), target_counts(a).withColumnRenamed("target", "gene").withColumnRenamed("count65536", "f1"), ["f1"])
    assert [tuple(r)[-1] for r in t.collect()] == ["0.78", "1.11", "0.11"]


def test_sections_of_all_operations(spark):
    cigars = ["10M", "3S10M2S", "5M2I5M", "5M3D5M", "5M100N5M", "2H3S4=1X5M", "5M2P5M", "*", None, "1M1N" * 12 + "1M"]
    df = spark.createDataFrame([(i, 100, c) for i, c in enumerate(cigars)], "i int, pos long, c string")
    got = {r.i: [(s.start, s.stop, s.read_start, s.before) for s in r.s] for r in df.select("i", sections("pos", "c").alias("s")).collect()}
    assert got[0] == [(100, 109, 1, None)] and got[1] == [(100, 109, 4, None)]
    assert got[2] == [(100, 104, 1, None), (105, 109, 8, "I")] and got[3] == [(100, 104, 1, None), (108, 112, 6, "D")]
    assert got[4] == [(100, 104, 1, None), (205, 209, 6, "N")] and got[5] == [(100, 109, 4, None)] and got[6] == [(100, 109, 1, None)]
    assert got[7] == got[8] == [] and len(got[9]) == 10


def test_streams(spark, tmp_path):
    from seqloom.streaming.counts import stream_gene_counts, total_counts, windowed_lengths

    feats = features([(1, "g1", "c", 1, 300, 0)], spark)
    rows = fragments([(i, 0, "c", 10 + i, 9, "50M", None, 0) for i in range(40)], spark)
    for i in range(4):
        rows.filter(F.col("frag") % 4 == i).write.parquet(str(tmp_path / f"in/part={i}"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in/*"))
    for _ in range(2):  # a second start finds nothing new
        stream_gene_counts(stream, feats, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        assert [tuple(r) for r in total_counts(spark, str(tmp_path / "out")).collect()] == [("g1", 40 * 65536)]
    log = spark.read.parquet("/root/testdata/sf0.001/read_log.parquet")
    log.write.parquet(str(tmp_path / "log"))
    q = windowed_lengths(spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))).writeStream.outputMode("complete").format("memory").queryName("lengths").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("lengths").agg(F.sum("n")).first()[0] == log.filter("read_length >= 1").count()


def test_bam_of_long_records_is_whole_at_any_range(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for i in range(24):
        n = 400_000 if i % 3 else rng.randrange(1, 300)
        seq = "".join(rng.choices("ACGTN", k=2000)) * (n // 2000) + "A" * (n % 2000)
        rows.append((f"read{i}", 0, "chr1", 100 * i + 1, 60, f"{n}M", "*", 0, 0, seq, "".join(rng.choices("!5I~", k=500)) * (n // 500) + "I" * (n % 500), "NH:i:1"))
    df = spark.createDataFrame(rows, "qname string, flag int, rname string, pos long, mapq int, cigar string, rnext string, pnext long, tlen long, seq string, qual string, tags string")
    binary.register(spark)
    folder = str(tmp_path / "long")
    binary.write_bam(df.coalesce(1), folder, [("chr1", 10**7)])
    for split in (1 << 16, 300_000, 1 << 20, 2 << 20, 64 << 20):
        got = spark.read.format("bam").option("split", split).load(folder).select("qname", F.md5("seq").alias("s"), F.md5("qual").alias("q")).collect()
        assert sorted((r.qname, r.s, r.q) for r in got) == sorted((r.qname, r.s, r.q) for r in df.select("qname", F.md5("seq").alias("s"), F.md5("qual").alias("q")).collect())
