"""Votes against junctions, counted without pairs, against plain counts."""

import random

import numpy as np

from seqloom.operators import junctions


def test_weights_from_a_rank():
    rng = np.random.default_rng(4)
    for n in (1, 7, 300):
        ranks, weights = rng.integers(0, n, n), rng.integers(1, 5, n)
        lo = rng.integers(0, n + 1, 200)
        hi = np.maximum(lo, rng.integers(0, n + 1, 200))
        least = rng.integers(0, n + 2, 200)
        got = junctions.count_from(ranks, weights, lo, hi, least)
        assert [int(weights[a:z][ranks[a:z] >= x].sum()) for a, z, x in zip(lo, hi, least)] == got.tolist()


def _cover(spark, rows):
    return spark.createDataFrame(rows, "read long, chr string, c_start long, c_stop long")


def test_votes_against(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice("ab"), a, a + rng.choice([3, 60, 5_000, 90_000, 300_000])) for i in range(4_000) for a in [rng.choice([rng.randrange(400_000), 65_530])]]
    events = list({(rng.choice("abc"), x, x + rng.choice([1, 70, 4_000, 100_000])) for x in [*range(65_500, 65_560, 3), *[rng.randrange(500_000) for _ in range(300)]]})
    got = {tuple(r) for r in junctions.anti_support(_cover(spark, rows + rows[:50]), spark.createDataFrame(events, "chr string, left long, right long")).collect()}
    want = set()
    for c, x, y in events:
        n = sum(k == c and (a + 5 <= x <= z - 5 or a + 5 <= y <= z - 5) for _, k, a, z in rows)
        if n:
            want.add((c, x, y, n))
    assert got == want


def test_pairs_of_reads_and_events_are_not_made(spark):
    # 20,000 reads hold 4,000 junctions: 80,000,000 pairs
    cover = spark.range(20_000).selectExpr("id read", "'a' chr", "1000 - id % 100 c_start", "30000 + id % 77 c_stop")
    events = spark.range(4_000).selectExpr("'a' chr", "2000 + id left", "9000 + 2 * id right")
    votes = junctions.anti_support(cover, events)
    assert "Join" not in votes._jdf.queryExecution().executedPlan().toString()
    assert {(r.n_against, r["count"]) for r in votes.groupBy("n_against").count().collect()} == {(20_000, 4_000)}
