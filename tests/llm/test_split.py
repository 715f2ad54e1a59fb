"""Pieces against a letter-by-letter version, and their round trip."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from seqloom.llm.split import split_by_topic, split_oversized, term_valleys, valleys


def brute(text, limit, overlap):
    out, s = [], 0
    while len(text) - s > limit:
        cut = [b for b in range(s + overlap + 1, s + limit + 1) if text[b - 1] in "Nn" and text[b] not in "Nn"]
        b = cut[-1] if cut else s + limit
        out.append((s, b))
        s = b - overlap
    return out + [(s, len(text))]


def test_matches_brute_force_and_joins_again(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        size = rng.choice([0, 10, 40, 41, 90, 300, 1000])
        rows.append((i, None if i % 13 == 0 else "".join(rng.choice("ACGTacgt" + "Nn" * rng.choice([0, 3]) + "é-") for _ in range(size)), i * 10))
    rows += [(100, "N" * 200, 5), (101, "ACGT" * 60, None), (102, "A" * 40, 1), (100, "N" * 200, 5)]
    df = spark.createDataFrame(rows, "block_id long, t string, o long").withColumn("piece_no", F.lit("x")).withColumn("text", F.lit("y"))
    got = split_oversized(df, "block_id", "t", 40, 7, {"gap": "Nn"}, "gap", 1, "o", with_text=True).collect()
    want = []
    for i, t, o in rows:
        if t is not None and len(t) > 40:
            want += [(i, n, None if o is None else o + a, None if o is None else o + z - 1, t[a:z]) for n, (a, z) in enumerate(brute(t, 40, 7), 1)]
    key = lambda r: (r[0], r[1], r[4])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert all(len(r.piece) <= 40 for r in got)
    for i, t, _ in rows[:60]:
        own = sorted((r.piece_no, r.piece) for r in got if r.block_id == i)
        if own:
            assert own[0][1] + "".join(p[7:] for _, p in own[1:]) == t


def test_whole_items_and_empty(spark):
    df = spark.createDataFrame([(1, "abc"), (2, ""), (3, None)], "i long, t string")
    assert [tuple(r) for r in split_oversized(df, "i", "t", 10, 2, only_oversized=False).collect()] == [(1, 1, 0, 2)]
    assert split_oversized(df, "i", "t", 10, 2).collect() == []
    assert split_oversized(df.limit(0), "i", "t").collect() == []


def test_very_long_text(spark):
    text = ("ACGT" * 900 + "NN") * 300
    df = spark.createDataFrame([(1, text)], "i long, t string")
    got = [(r.piece_start, r.piece_stop + 1) for r in split_oversized(df, "i", "t", classes={"gap": "Nn"}, closing="gap").orderBy("piece_no").collect()]
    assert got == brute(text, 4000, 100)


def test_wide_blocks_find_the_change_of_topic():
    rng = np.random.default_rng(1)
    seq = np.concatenate([rng.integers(0, 2, 200), rng.integers(2, 4, 200)])
    places, depths = valleys(seq, 20, 4, None)
    assert places[np.argmax(depths)] == 200 and depths.max() > 0.99


def plain_depth(terms, b, block):
    left, right = Counter(terms[max(0, b - block) : b]), Counter(terms[b : b + block])
    dot = sum(n * right[t] for t, n in left.items())
    return 1 - dot / (sum(n * n for n in left.values()) * sum(n * n for n in right.values())) ** 0.5


def test_term_valleys_match_plain_cosines():
    rng = np.random.default_rng(7)
    for n, k, block in ((2, 1, 3), (50, 4, 5), (90, 30, 20), (40, 1, 60), (1, 1, 2)):
        terms = rng.integers(0, k, n)
        places, depths = term_valleys(terms, block)
        assert list(places) == list(range(1, n))
        assert np.allclose(depths, [plain_depth(terms.tolist(), b, block) for b in places])


def test_topics_in_spark(spark):
    rng = random.Random(9)
    topics = [[f"w{t}x{i}" for i in range(30)] for t in range(6)]
    texts, changes = [], []
    for _ in range(5):
        sizes = [rng.randrange(60, 90) for _ in topics]
        texts.append(" ".join(rng.choice(own).upper() if rng.random() < 0.3 else rng.choice(own) for own, n in zip(topics, sizes) for _ in range(n)))
        changes.append(set(np.cumsum(sizes).tolist()))
    rows = [(i, "  " + t.replace(" ", "\n ", 3)) for i, t in enumerate(texts)] + [(10, None), (11, ""), (12, "a " * 150), (13, "a " * 151)]
    df = spark.createDataFrame(rows, "doc long, t string").withColumn("item", F.lit(1))
    got = [tuple(r) for r in split_by_topic(df, "doc", "t", 150, 15).collect()]
    assert split_by_topic(df.limit(0), "doc", "t").collect() == []
    for i, text in [*enumerate(texts), (13, "a " * 151)]:
        own = sorted(g[1:] for g in got if g[0] == i)
        assert [g[0] for g in own] == list(range(1, len(own) + 1)) and own[0][1] == 1 and own[-1][2] == len(text.split())
        assert all(z - a < 150 for _, a, z in own) and all(b == z - 14 for (_, _, z), (_, b, _) in zip(own, own[1:]))
        if i < 5:
            assert sum(any(abs(z - c) <= 2 for c in changes[i]) for _, _, z in own[:-1]) >= len(own) - 2
    assert not {g[0] for g in got} & {10, 11, 12}
