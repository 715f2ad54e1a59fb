"""Operators that SQL doesn't express, against plain versions."""

import random
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import sequence as sq
from seqloom.functions.flags import hits, mate_flag
from seqloom.operators import alignment, cells, intervals, kmers, pileup, sampling
from seqloom.operators.assign import Options, assign, count_targets, resolve_chromosomes, target_counts
from seqloom.operators.pairing import pair_mates
from seqloom.functions.cigar import sections
from seqloom.plans.aligning import g10_aligned
from seqloom.plans.sequence import READS_A_BLOCK


def test_fisher_against_sums():
    rng = random.Random(1)
    rows = [[rng.randrange(12) for _ in range(4)] for _ in range(300)] + [[0, 0, 0, 0], [30, 2, 70, 900]]
    got = sq.fisher_one_sided(*np.array(rows).T)
    for (a, b, c, d), p in zip(rows, got):
        n, k, m = a + b + c + d, a + b, a + c
        want = sum(comb(m, x) * comb(n - m, k - x) for x in range(a, min(k, m) + 1)) / comb(n, k)
        assert p == pytest.approx(want, rel=1e-9)


def test_inverse_normal(spark):
    got = spark.createDataFrame([(0.5,), (0.975,), (0.0001,)], "p double").select(sq.inverse_normal("p").alias("x")).collect()
    assert [round(r.x, 4) for r in got] == [0.0, 1.96, -3.719]


def naive_path(read, ref):
    """Best score by trying every gap length, for small inputs."""
    n, m = len(read), len(ref)
    d = [[0.0] * (m + 1)] + [[-1e9] * (m + 1) for _ in range(n)]
    for i in range(1, n + 1):
        for j in range(m + 1):
            best = -1e9
            if j:
                best = d[i - 1][j - 1] + (2 if read[i - 1] == ref[j - 1] else 0)
            for k in range(1, i):
                best = max(best, d[k][j] - 1)
            if i < n:
                for k in range(j):
                    best = max(best, d[i][k] - 1)
            d[i][j] = best
    return max(d[n])


def test_dynamic_program():
    rng = random.Random(2)
    for _ in range(60):
        ref = "".join(rng.choice("ACGT") for _ in range(rng.randrange(8, 26)))
        a = rng.randrange(len(ref) - 4)
        read = list(ref[a : a + rng.randrange(4, 18)])
        if rng.random() < 0.5 and len(read) > 5:
            del read[3 : 3 + rng.randrange(1, 3)]
        if rng.random() < 0.5:
            read.insert(2, rng.choice("ACGT"))
        read = "".join(read)
        codes = lambda t: np.frombuffer(t.encode(), np.uint8)
        score, at, ops, wrong = alignment.best_path(codes(read), codes(ref))
        assert score == naive_path(read, ref)
        i, j, s, bad, last = 0, at, 0, 0, ""
        import re

        for n, op in re.findall(r"(\d+)([MID])", ops):
            n = int(n)
            if op == "M":
                hit = sum(x == y for x, y in zip(read[i : i + n], ref[j : j + n]))
                s, bad, i, j = s + 2 * hit, bad + n - hit, i + n, j + n
            else:
                s -= 1
                i, j = (i + n, j) if op == "I" else (i, j + n)
        assert i == len(read) and s == score and bad == wrong


def test_reads_are_placed_again(spark):
    sf = "/root/testdata/sf0.01"
    blocks = {r.block_id: r for r in spark.read.parquet(f"{sf}/index_blocks.parquet").collect()}
    got = g10_aligned(spark, sf).collect()
    assert len(got) > 100
    right = 0
    for r in got:
        b, k = blocks[r.read // READS_A_BLOCK], r.read % READS_A_BLOCK
        cut = b.block_id % 5 == 0 and len(b.base_values) >= k * 100 + 100
        right += r.contig == b.chro_name and r.strand == b.block_id % 2 and abs(r.pos - (b.start_base_offset + 1 + k * 100)) <= 2 and ("2D" in r.cigar) == cut
    assert right >= 0.95 * len(got)


def test_full_scan(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("ACGTN") for _ in range(rng.choice([0, 3, 200])))) for i in range(20)] + [(99, None)]
    q = "ACGTAAC"
    back = q[::-1].translate(str.maketrans("ACGT", "TGCA"))
    want = set()
    for i, t in rows:
        for p in range(len(t or "") - len(q) + 1):
            for strand, pat in ((0, q), (1, back)):
                m = sum(x == y for x, y in zip(t[p:], pat))
                if m >= 5:
                    want.add((i, p + 1, strand, m))
    got = kmers.full_scan(spark.createDataFrame(rows, "i int, t string"), "i", "t", q)
    assert {tuple(r) for r in got.collect()} == want


def test_tags_fold_in_order(spark):
    rows = [("c", "g", "AAAA", 5), ("c", "g", "AAAT", 5), ("c", "g", "AATT", 4), ("c", "g", "GGGG", 1), ("c", "h", "AAAA", 9), ("d", "g", "AAAT", 1)]
    df = spark.createDataFrame(rows, "cell string, gene string, umi string, reads long")
    got = {tuple(r) for r in cells.merge_similar_tags(df, ["cell", "gene"]).collect()}
    # AAAT folds into AAAA; AATT is two off AAAA and stays
    assert got == {("c", "g", "AAAA", 10), ("c", "g", "AATT", 4), ("c", "g", "GGGG", 1), ("c", "h", "AAAA", 9), ("d", "g", "AAAT", 1)}


def test_cell_cutoff():
    totals = np.concatenate([np.full(100, 5000), np.full(2000, 3)])
    assert cells.cell_cutoff(totals) == 100
    assert cells.cell_cutoff(np.array([4, 2])) == 2


def test_variants_planted(spark):
    rng = random.Random(5)
    ref = "".join(rng.choice("ACGT") for _ in range(120))
    reads = []
    for i in range(60):
        s = list(ref)
        if i % 2 == 0:
            s[60] = "ACGT"["ACGT".index(ref[60]) - 1]
        if rng.random() < 0.3:
            s[rng.randrange(120)] = "A"
        reads.append((f"r{i}", "c", 1, "".join(s), "I" * 120))
    reads.append(("r0", "c", 1, ref, "#" * 120))  # a worse mate of r0 doesn't count
    df = spark.createDataFrame(reads, "fragment string, chr string, pos long, seq string, qual string")
    counts = pileup.base_counts(df, least_score=0)
    row = counts.filter("pos = 61").first()
    assert row.a + row.c + row.g + row.t == 60
    reference = spark.createDataFrame([("c", i + 1, x) for i, x in enumerate(ref)], "chr string, pos long, ref string")
    got = pileup.call_variants(counts, reference).collect()
    assert [(r.pos, r.mismatches) for r in got] == [(61, 30)]
    near = spark.createDataFrame([("c", 61)], "chr string, pos long")
    assert [r.pos for r in pileup.call_variants(counts, reference, near).collect()] == [61]


def test_sampling(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.lit("x").alias("row_no2"))
    n = {r.k: r.row_no for r in sampling.numbered(df, "k").collect()}
    assert n == {k: k for k in range(1000)}
    picked = sorted(r.k for r in sampling.systematic_sample(df, "k", 100).collect())
    assert 95 <= len(picked) <= 101 and picked[0] == 0 and max(b - a for a, b in zip(picked, picked[1:])) <= 11
    shares = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "n string, w long")
    assert {r.n: r[1] for r in sampling.allocated(shares.withColumnRenamed("n", "name"), "name", "w", 10).withColumnRenamed("n", "x").withColumnRenamed("name", "n").collect()} == {"a": 4, "b": 3, "c": 3}


def test_overlap_join_brute_force(spark):
    rng = random.Random(7)
    make = lambda n, far: [(i, rng.choice("xy"), a := rng.randrange(5000), a + rng.randrange(far)) for i in range(n)]
    left, right = make(200, 900), make(200, 90)
    a = spark.createDataFrame(left + [(999, "x", None, 5), (998, "x", 9, 5)], "i int, c string, a long, z long")
    b = spark.createDataFrame(right, "j int, c string, x long, y long")
    for size in (64, 1000, 1 << 14):
        got = [tuple(r) for r in intervals.overlap_join(a, b, ["c"], ("a", "z"), ("x", "y"), size).select("i", "j").collect()]
        assert len(got) == len(set(got)) and set(got) == {(l[0], r[0]) for l in left for r in right if l[1] == r[1] and l[2] <= r[3] and r[2] <= l[3]}


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("options", [Options(), Options(allow_overlap=True), Options(strand=1), Options(strand=2, feature_level=True), Options(min_overlap=12), Options(largest_overlap=True), Options(frac_overlap=0.5), Options(paired=True)])
def test_assignment_brute_force(spark, seed, options):
    rng = random.Random(seed)
    feats = [(i, f"g{rng.randrange(6)}", rng.choice("xy"), a := rng.randrange(1, 400), a + rng.randrange(5, 60), rng.choice([0, 1, -1])) for i in range(30)]
    rows = []
    for i in range(80):
        mates = []
        for m in (0x40, 0x80):
            flag = (1 | m if options.paired else 0) | rng.choice([0, 16])
            mates.append((flag, rng.choice("xyz"), rng.randrange(1, 400), 60, rng.choice(["20M", "10M15N10M", "5S12M"]), 0, rng.choice([1, 1, 1, 2])))
        rows.append((i, mates[0], mates[1] if options.paired else None))
    t = "struct<flag:int,chr:string,pos:long,mapq:int,cigar:string,tlen:long,nh:int>"
    df = spark.createDataFrame(rows, f"frag long, a {t}, b {t}")
    full = lambda m: F.when(F.col(m).isNotNull(), F.struct(*[F.col(f"{m}.{c}").alias(c) for c in ("flag", "chr", "pos", "mapq", "cigar", "tlen", "nh")], sections(F.col(f"{m}.pos"), F.col(f"{m}.cigar")).alias("sections")))
    frag = df.select("frag", full("a").alias("r1"), full("b").alias("r2"))
    fd = spark.createDataFrame(feats, "feature_id long, gene string, chr string, start long, stop long, strand int")
    blocks = {"20M": [(0, 20)], "10M15N10M": [(0, 10), (25, 10)], "5S12M": [(0, 12)]}
    want, wanted_status = {}, {}
    for i, *mates in rows:
        mates = [m for m in mates if m]
        if any(m[6] > 1 for m in mates):
            wanted_status[i] = "Unassigned_MultiMapping"
            continue
        cover, votes, everything = {}, {}, set()
        for no, m in enumerate(mates):
            strand = int(bool(m[0] & 16) != bool(m[0] & 0x80))
            for off, n in blocks[m[4]]:
                span = set(range(m[2] + off, m[2] + off + n))
                everything |= span
                for f in feats:
                    if f[2] == m[1] and span & set(range(f[3], f[4] + 1)) and (options.strand == 0 or (f[5] == strand) == (options.strand == 1)):
                        key = str(f[0]) if options.feature_level else f[1]
                        cover.setdefault(key, set()).update(span & set(range(f[3], f[4] + 1)))
                        votes.setdefault(key, set()).add(no)
        score = {}
        for key, bases in cover.items():
            s = 2 * len(bases) + (len(votes[key]) > 1) if options.largest_overlap else 1 if options.allow_overlap else len(votes[key])
            score[key] = s if len(bases) >= max(options.min_overlap, np.ceil(options.frac_overlap * len(everything) - 0.001) if options.frac_overlap else 0) else 0
        top = [k for k, s in score.items() if s == max(score.values())]
        if not score:
            wanted_status[i] = "Unassigned_NoFeatures"
        elif max(score.values()) == 0:
            wanted_status[i] = "Unassigned_Overlapping_Length"
        elif len(top) > 1 and not options.allow_overlap:
            wanted_status[i] = "Unassigned_Ambiguity"
        else:
            wanted_status[i] = "Assigned"
            for k in top:
                want[k] = want.get(k, 0) + 65536
    a = assign(frag, fd, options)
    assert {r.frag: r.status for r in a.collect()} == wanted_status
    assert {r.target: r.count65536 for r in target_counts(a).collect()} == want
    assert {r.target: r.count65536 for r in count_targets(frag, fd, options).collect()} == want


def test_places_on_two_chromosomes_are_two_pairs(spark):
    rows = [(1, "f", 67, "c1", 10, "=", 50), (2, "f", 131, "c1", 50, "=", 10), (3, "f/1", 67, "c2", 10, "c2", 50), (4, "f/2", 131, "c2", 50, "=", 10), (5, "f", 67, "c1", 10, "c2", 50), (6, "f", 131, "c2", 50, "c1", 10), (7, "f", 73, "c1", 10, "*", None)]
    df = spark.createDataFrame(rows, "id long, qname string, flag int, rname string, pos long, rnext string, pnext long").withColumn("tags", F.lit(None).cast("string"))
    got = {(r.r1.id if r.r1 else None, r.r2.id if r.r2 else None) for r in pair_mates(df, ["id"]).collect()}
    assert got == {(1, 2), (3, 4), (5, 6), (7, None)}


def test_names_and_flags(spark):
    names = spark.createDataFrame([("chr1",), ("2",), ("chr3",), ("MT",)], "n string")
    alias = spark.createDataFrame([("chr3", "III"), ("MT", "chrM")], "annotation_chr string, read_chr string")
    df = spark.createDataFrame([(x,) for x in ("chr1", "1", "chr2", "III", "chrM", "chr9", None, "*")], "c string")
    assert {r.c: r.chr for r in resolve_chromosomes(df, {"c": "chr"}, names, alias).collect()} == {"chr1": "chr1", "1": "chr1", "chr2": "2", "III": "chr3", "chrM": "MT", "chr9": None, None: None, "*": None}
    f = spark.createDataFrame([(99, "NH:i:4\tHI:i:1"), (0, "XNH:i:9"), (73, None)], "flag int, tags string").select(mate_flag("flag").alias("m"), hits("tags").alias("n")).collect()
    assert [tuple(r) for r in f] == [(147, 4), (0, 1), (133, 1)]


def test_chains_and_splits(spark):
    seeds = spark.createDataFrame([(1, 0, 10), (1, 5, 15), (1, 6, 3), (1, 9, 19), (1, 12, 18), (2, 1, 1)], "r int, offset int, pos int")
    assert sorted(tuple(r) for r in alignment.chained(seeds, ["r"]).collect()) in ([(1, 0, 10), (1, 5, 15), (1, 9, 19), (2, 1, 1)], [(1, 0, 10), (1, 5, 15), (1, 12, 18), (2, 1, 1)])
    left, right = "ACGTACGGTTTTTTTT", "AAAAAAAGCCATCCATGG"
    pairs = spark.createDataFrame([(1, "c", 100, 500, "ACGTACG" + "CATCCATG"[0:7], left + "TT", right)], "read int, contig string, left_diagonal long, right_diagonal long, s string, left_ref string, right_ref string")
    r = alignment.split_points(pairs).first()
    assert r.left < r.right and r.matches >= 7


def test_chimeric_sections(spark):
    from seqloom.functions.cigar import chimeric_sections

    tags = "NH:i:1\tCC:Z:chr9\tCP:i:100\tCG:Z:10M5N10M\tCT:Z:"
    df = spark.createDataFrame([(1, tags + "-", 0x40 | 0x10), (2, tags + "+", 0x40 | 0x10), (3, "NH:i:1", 0), (4, None, 0)], "i int, tags string, flag int")
    got = {r.i: [(x.chr, [(s.start, s.stop) for s in x.sections]) for x in r.c] for r in df.select("i", chimeric_sections("tags", "flag").alias("c")).collect()}
    assert got == {1: [("chr9", [(100, 109), (115, 124)])], 2: [("chr9", [(76, 85), (91, 100)])], 3: [], 4: []}
