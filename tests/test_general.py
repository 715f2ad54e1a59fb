"""Heavy keys and periods against brute force on small fixtures."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators.heavy_keys import heavy_keys, key_profile
from seqloom.operators.periods import merge_intervals

DAY = dt.datetime(2024, 1, 1)


def brute_periods(rows):
    by = {}
    for k, a, z in rows:
        if a is not None and z is not None and a <= z:
            by.setdefault(k, []).append((a, z))
    out = set()
    for k, xs in by.items():
        merged = []
        for a, z in sorted(xs):
            if merged and a <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], z)
            else:
                merged.append([a, z])
        out |= {(k, "period", a, z) for a, z in merged}
        out |= {(k, "gap", x[1] + 1, y[0] - 1) for x, y in zip(merged, merged[1:])}
    return out


@pytest.mark.parametrize("seed,hot,span,parts", [(1, 0.4, 3000, 5), (2, 1.0, 20000, 7), (3, 0.9, 200, 3), (4, 0.5, 100000, 16)])
def test_periods_match_brute_force(spark, seed, hot, span, parts):
    rng = random.Random(seed)
    rows = []
    for _ in range(3000):
        k = "hot" if rng.random() < hot else rng.choice([None, "", "a", "b", "c"])
        a = rng.choice([None, *[rng.randrange(span)] * 30])
        z = None if a is None else a + rng.choice([-5, 0, 0, 3, 20, 20, span // 3 if rng.random() < 0.01 else 10])
        rows.append((k, a, z))
    rows += rows[:200]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "k string, a long, z long").withColumn("pid", F.lit(1)).withColumn("seg_kind", F.lit("x"))
        got = [tuple(r) for r in merge_intervals(df, ["k"], "a", "z").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(got) == len(set(got))
    assert set(got) == brute_periods(rows)


def test_periods_of_empty_and_invalid(spark):
    df = spark.createDataFrame([("a", 5, 1), ("a", None, 3)], "k string, a long, z long")
    assert merge_intervals(df, ["k"], "a", "z").collect() == []
    assert merge_intervals(df.limit(0), ["k"], "a", "z").collect() == []


@pytest.mark.parametrize("seed,parts", [(1, 3), (2, 9)])
def test_profile_matches_brute_force(spark, seed, parts):
    rng = random.Random(seed)
    rows = []
    for _ in range(2000):
        k = "hot" if rng.random() < 0.7 else rng.choice([None, "", "x", "y"])
        t = None if rng.random() < 0.05 else DAY + dt.timedelta(days=rng.randrange(400), seconds=rng.randrange(80000))
        rows.append((k, t, rng.choice([None, 1, 5, -3])))
    rows.append(("undated", None, None))
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "g string, t timestamp, v int").withColumn("k", F.lit(7)).withColumn("n", F.lit("n"))
        got = {r[0]: tuple(r)[1:] for r in key_profile(df.repartition(4), "g", "t", F.col("v")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = {}
    for k in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == k]
        days = sorted({r[1].date() for r in own if r[1]})
        vals = [r[2] for r in own if r[2] is not None]
        last = max((r[1] for r in own if r[1]), default=None)
        micros = None if last is None else int((last - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
        want[k] = (len(own), len(vals), sum(vals), micros, len(days), max(((b - a).days for a, b in zip(days, days[1:])), default=0))
    assert got == want


def test_heavy_keys_edges(spark):
    df = spark.createDataFrame([("a", DAY)] * 2 + [(None, DAY)] * 97 + [("b", None)], "g string, t timestamp")
    assert [r.key_value for r in heavy_keys(df, "g", "t").collect()] == ["a"]
    assert heavy_keys(df.limit(0), "g", "t").collect() == []
