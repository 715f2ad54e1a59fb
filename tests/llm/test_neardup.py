"""Bit-sliced distances and near-duplicate pairs against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm.bitslice import close_pairs
from seqloom.llm.neardup import NearDuplicates


@pytest.mark.parametrize("seed,n,buckets", [(1, 700, 60), (2, 400, 1), (3, 130, 130), (4, 1, 1), (5, 65, 2)])
def test_bitsliced_distances(seed, n, buckets):
    rng = np.random.default_rng(seed)
    sig = rng.integers(0, 256, (n, 32), dtype=np.uint8)
    for i in range(0, n - 1, 5):
        sig[i + 1] = sig[i]
        sig[i + 1, : rng.integers(0, 14)] ^= 0xB5
    bucket = np.sort(rng.integers(0, buckets, n))
    part = np.where(bucket % 2 == 0, -1, rng.integers(0, 3, n))
    i, j = close_pairs(sig, bucket, part, 60)
    bits = np.unpackbits(sig, axis=1).astype(int)
    want = {
        (a, b) for a in range(n) for b in range(a + 1, n)
        if bucket[a] == bucket[b] and (part[a] != part[b] or part[a] < 0) and np.abs(bits[a] - bits[b]).sum() <= 60
    }
    assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)


def edited(rng, t, times):
    t = list(t)
    for _ in range(times):
        at = rng.randrange(len(t))
        t[at : at + rng.choice([0, 1, 2])] = rng.choice(["A", "", "CG", "T"])
    return "".join(t)


def corpus(seed):
    rng = random.Random(seed)
    rows = [(0, None, "x"), (1, "", ""), (2, "*", "!"), (3, "ACGTACGTACG", "short")]
    for base in range(40):
        size = rng.choice([12, 30, 90, 250, 480, 520, 900, 3000])
        t = "GATTACAGATTACACC" + "".join(rng.choice("ACGT") for _ in range(size))
        for _ in range(rng.choice([1, 2, 4])):
            u = edited(rng, t, rng.choice([0, 0, 1, size // 150, size // 60]))
            rows.append((len(rows) * 3, u.lower() if rng.random() < 0.2 else u, "".join(chr(33 + rng.randrange(40)) for _ in range(60)) + "é"))
    rows += [(9000 + i, "A" * 500, None) for i in range(4)] + [(9100 + i, "N" * (600 + i), None) for i in range(6)]
    return rows


def brute(rows, col, fold, k, threshold):
    sets = {}
    for r in rows:
        t = r[col]
        if t is not None and len(t) >= k:
            t = t.upper() if fold else t
            sets[r[0]] = {t[i : i + k] for i in range(len(t) - k + 1)}
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


@pytest.mark.parametrize("seed,block", [(1, 4000), (2, 3)])
def test_pairs_match_brute_force(spark, seed, block):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "rid long, seq string, qual string").withColumn("field", F.lit(1)).withColumn("id", F.lit(2)).withColumn("h1", F.lit(3))
    near = NearDuplicates(df, "rid", {"seq": True, "qual": False}, block=block)
    got = [tuple(r) for r in near.pairs().collect()]
    assert len(got) == len(set(got))
    assert {g[1:] for g in got if g[0] == "seq"} == brute(rows, 1, True, 12, 0.6)
    assert {g[1:] for g in got if g[0] == "qual"} == brute(rows, 2, False, 12, 0.6)


def test_repeats_and_constant_texts_of_any_length(spark):
    rng = random.Random(21)
    rows = []
    for n in range(30):
        unit = "".join(rng.choice("ACGT") for _ in range(rng.choice([1, 3, 40, 200, 290, 420, 600])))
        for times in rng.sample([2, 4, 7, 16, 40], 3):
            t = unit * times
            rows.append((len(rows), t, edited(rng, t, rng.choice([0, 1, 2])) if len(t) > 20 else t))
    rows += [(500 + i, None, "I" * (200 * (i + 1))) for i in range(6)] + [(600, "ACGT" * 400_000, None), (601, "ACGT" * 5, None)]
    df = spark.createDataFrame(rows, "rid long, seq string, qual string")
    got = [tuple(r) for r in NearDuplicates(df, "rid", {"seq": True, "qual": False}).pairs().collect()]
    for field, col in (("seq", 1), ("qual", 2)):
        want = brute(rows, col, field == "seq", 12, 0.6)
        own = {g[1:] for g in got if g[0] == field}
        assert own <= want and len(own & want) >= 0.99 * len(want) and len(want) > 60


def test_groups(spark):
    rows = corpus(5)
    df = spark.createDataFrame(rows, "rid long, seq string, qual string")
    pairs = brute(rows, 1, True, 12, 0.6)
    group = {r[0]: r[0] for r in rows if r[1] is not None and len(r[1]) >= 12}
    for _ in rows:
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    got = {r.read_id: r.group_id for r in NearDuplicates(df, "rid", {"seq": True}).groups().collect()}
    assert got == group


def test_empty_table(spark):
    near = NearDuplicates(spark.createDataFrame([], "rid long, seq string"), "rid", {"seq": True})
    assert near.pairs().collect() == [] and near.groups().collect() == []


def test_one_very_long_text(spark):
    rng = random.Random(8)
    t = "".join(rng.choice("ACGT") for _ in range(1_300_000))
    df = spark.createDataFrame([(1, t), (2, edited(rng, t, 2000)), (3, t[:700_000])], "rid long, seq string")
    assert [tuple(r) for r in NearDuplicates(df, "rid", {"seq": True}).pairs().collect()] == [("seq", 1, 2)]
