"""Shared spans against brute force, by trees and by whole windows."""

import random

import pytest
from pyspark.sql import functions as F

from seqloom.llm.spans import shared_spans


def brute(rows, length):
    holders = {}
    for i, t in rows:
        for x in range(len(t or "") - length + 1):
            holders.setdefault(t[x : x + length], set()).add(i)
    out = set()
    for i, t in rows:
        covered = set()
        for x in range(len(t or "") - length + 1):
            if len(holders[t[x : x + length]]) > 1:
                covered.update(range(x, x + length))
        for p in sorted(covered):
            if p - 1 not in covered:
                start = p
            if p + 1 not in covered:
                out.add((i, start + 1, p + 1))
    return out


def reads(seed, alphabet, n):
    rng = random.Random(seed)
    core = "".join(rng.choice(alphabet) for _ in range(400))
    rows = []
    for i in range(n):
        a = rng.randrange(300)
        t = "".join(rng.choice("ACGT") for _ in range(rng.randrange(60))) + core[a : a + rng.randrange(130)] + "A" * rng.choice([0, 20, 70, 90])
        rows.append((i * 7, None if i % 40 == 0 else "" if i % 41 == 0 else t))
    return rows + [(99991, rows[5][1]), (99992, rows[5][1])]


@pytest.mark.parametrize("seed,alphabet,heavy", [(1, "ACGT", 50_000), (2, "ACGTacgtN", 15), (3, "ACGTñ", 50_000), (4, "ACGTñ", 10)])
def test_matches_brute_force(spark, seed, alphabet, heavy):
    rows = reads(seed, alphabet, 250)
    df = spark.createDataFrame(rows, "rid long, seq string").withColumn("id", F.lit(1)).withColumn("t", F.lit("x")).withColumn("h", F.lit(0))
    got = [tuple(r) for r in shared_spans(df, "rid", "seq", heavy=heavy).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 50)


def test_other_lengths_and_empty(spark):
    rows = reads(6, "ACGT", 80)
    df = spark.createDataFrame(rows, "rid long, seq string")
    assert {tuple(r) for r in shared_spans(df, "rid", "seq", 30, k=12).collect()} == brute(rows, 30)
    assert shared_spans(df.limit(0), "rid", "seq").collect() == []


def test_very_long_text(spark):
    rng = random.Random(9)
    t = "".join(rng.choice("ACGT") for _ in range(2_300_000))
    rows = [(1, t), (2, t[999_980:1_000_060] + "G" * 60), (3, t[1_999_990:2_000_100]), (4, t[-55:])]
    df = spark.createDataFrame(rows, "rid long, seq string")
    got = {tuple(r) for r in shared_spans(df, "rid", "seq").collect()}
    assert {(1, 999_981, 1_000_060), (1, 1_999_991, 2_000_100), (1, len(t) - 54, len(t)), (3, 1, 110), (4, 1, 55)} <= got
