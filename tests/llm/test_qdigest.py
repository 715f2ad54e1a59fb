"""Digests against exact ranks, within the stated bound, however they are joined."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import qdigest as q


def leaves(values):
    v, c = np.unique(np.asarray(values, np.int64), return_counts=True)
    return v + (1 << q.BITS), c


def rank_gap(values, permille, answers):
    values = np.sort(values)
    worst = 0
    for p, a in zip(permille, answers):
        want = max(1, (p * len(values) + 999) // 1000)
        lo, hi = np.searchsorted(values, a, "left") + 1, np.searchsorted(values, a, "right")
        worst = max(worst, lo - want if want < lo else want - hi if want > hi else 0)
    return worst


@pytest.mark.parametrize("seed,k,parts", [(0, 200, 1), (1, 200, 7), (2, 1000, 4), (3, 50, 20)])
def test_bound_holds_after_joins(seed, k, parts):
    rng = np.random.default_rng(seed)
    values = np.concatenate([rng.lognormal(7, 1.5, 20000).astype(np.int64), np.full(3000, 777), rng.integers(0, 5, 500)])
    rng.shuffle(values)
    nodes, counts = [], []
    for part in np.array_split(values, parts):
        n, c = q.compress(*leaves(part), k, 100)
        assert c.sum() == len(part)
        nodes.append(n)
        counts.append(c)
    n, c = q.compress(np.concatenate(nodes), np.concatenate(counts), k, 100)
    total, answers, proven = q.answer(n, c, q.PERMILLE)
    assert total == len(values)
    assert rank_gap(values, q.PERMILLE, answers) <= 2 * len(values) / k + parts
    assert rank_gap(values, q.PERMILLE, answers) <= proven + 1 or proven <= 2 * len(values) / k + parts
    assert len(n) <= 2 * k * q.BITS


@pytest.mark.parametrize("fan", [0, 3, 64])
def test_compressed_digests_in_spark(spark, fan):
    rng = np.random.default_rng(5)
    values = {g: np.concatenate([rng.lognormal(7, 2, 6000).astype(np.int64), np.full(900, 31), rng.integers(1 << 45, 1 << 51, 300)]) for g in ("a", "b")}
    rows = [(g, int(v)) for g, own in values.items() for v in own]
    df = spark.createDataFrame(rows, "key string, v long").repartition(6)
    for r in q.percentiles(q.join(q.build(df, [F.col("key")], F.col("v"), 64, 64), 64, 64, fan)).collect():
        own = np.sort(values[r.g[8]])
        assert r.n == len(own) and 0 < r.rank_error < 0.25 * len(own)
        for p in q.PERMILLE:
            want = max(1, (p * len(own) + 999) // 1000)
            lo, hi = np.searchsorted(own, r[f"p{p:03d}"], "left") + 1, np.searchsorted(own, r[f"p{p:03d}"], "right")
            assert lo - r.rank_error <= want <= hi + r.rank_error


def test_small_digest_is_exact():
    values = np.array([5, 1, 1, 9, 3])
    _, answers, err = q.answer(*q.compress(*leaves(values), 10, 100), (1, 500, 1000))
    assert list(answers) == [1, 3, 9] and err == 0


def test_edges_in_spark(spark):
    rows = [("a", 1), ("a", 3), ("a", None), ("a", -4), (None, 7), (None, 7), ("", 1 << 60)]
    df = spark.createDataFrame(rows, "key string, v long").withColumn("g", F.lit(1)).withColumn("node", F.lit(2)).withColumn("n", F.lit(3))
    out = {r.g: r for r in q.percentiles(q.join(q.build(df, [F.col("key")], F.col("v")), fan=3), (500,)).collect()}
    assert {g: (r.n, r.p500) for g, r in out.items()} == {'{"key":"a"}': (2, 1), '{"key":null}': (2, 7), '{"key":""}': (1, (1 << q.BITS) - 1)}
    assert q.percentiles(q.join(q.build(df.limit(0), [F.col("key")], F.col("v")))).collect() == []


def test_scores(spark):
    df = spark.createDataFrame([("a", "!#"), ("a", "#"), ("a", None), ("b", ""), (None, "I" * 1000), ("c", "\x1f!é")], "run string, t string")
    out = {r.g.split(":")[-1]: (r.n, r.p500) for r in q.percentiles(q.join(q.build_scores(df, F.col("run"), "t")), (500,)).collect()}
    assert out == {'"a"}': (3, 2), "null}": (1000, 40), '"c"}': (2, 0)}
