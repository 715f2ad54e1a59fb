"""Rows that a function made out of texts aren't counted by Spark's estimates,
so joins of such rows must not be left to them."""

import pytest
from pyspark.sql import functions as F

from seqloom.operators import kmers
from seqloom.plans import all_queries

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["a16_votes", "w3_best_votes", "k10_planted_variants", "g10_aligned"])
def test_places_and_seeds_are_not_broadcast(spark, name):
    df = all_queries()[name](spark, SF)
    assert "Broadcast" not in _plan(df) and "SortMergeJoin" in _plan(df)
    df.collect()
    assert "Broadcast" not in _plan(df)


def test_pieces_are_the_whole_text(spark):
    texts = ["", "a", "abc", "äb\ncdefgh" * 40_000, None, "x" * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {(r.i, r.k): r.s for r in df.select("i", F.posexplode(kmers.pieces("t", 3, 2)).alias("k", "s")).collect()}
    assert got == {(i, k): t[k * 3 : k * 3 + 5] for i, t in enumerate(texts) if t for k in range((len(t) + 2) // 3)}


def test_places_of_hot_kmers(spark):
    texts = [("a", "ACGTACGTACGTACGTA"), ("b", "ACGTACGTACGTACGT"), ("c", "TTTTTTTTTTTTTTTTTTnTT"), ("d", None)]
    df = spark.createDataFrame(texts, "c string, s string")
    got = sorted((r.contig, r.pos) for r in kmers.index(df, "c", "s", step=1, most=2).collect())
    assert got == [("a", 0), ("a", 1), ("b", 0)]


def test_wanted_places_are_whole(spark):
    sf = "/root/testdata/sf0.01"
    b = spark.read.parquet(f"{sf}/index_blocks.parquet")
    seeds = kmers.spaced_seeds(b.filter("block_id % 10 = 0"), "block_id", "base_values")
    whole, some = (kmers.index(b, "chro_name", "base_values", step=1, of=of) for of in (None, seeds))
    assert some.count() < 0.1 * whole.count()
    of = lambda places: sorted(tuple(r) for r in places.join(seeds, "kmer", "left_semi").collect())
    assert of(some) == of(whole) != []
