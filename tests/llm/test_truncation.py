"""Cut-off texts: planted cuts against ends that merely lack a mark."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from seqloom.llm.postings import letter_places, letter_stream
from seqloom.llm.truncation import _prefix_sums, last_unit, like_whole, prefix_hashes, truncated

GOODS = ["soap", "starch", "boots", "tea"]
PHRASES = ["post free", "terms moderate", "sold everywhere", "per dozen"]


def corpus(seed, n=1500):
    rng = random.Random(seed)
    lexicon = ["".join(rng.choice("aeioubdlmnrst") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    docs, cut = [], set()
    for i in range(n):
        sentences = [" ".join(rng.choice(lexicon) for _ in range(rng.randrange(4, 12))).capitalize() + "." for _ in range(rng.randrange(3, 30))]
        text = " ".join(sentences)
        kind = rng.random()
        source = rng.choice(["a", "b", None, "c"])
        if kind < 0.15:
            text = "\n".join(rng.choice(PHRASES) for _ in range(5)) + f"\nTHE {rng.choice(lexicon).upper()}'S {rng.choice(GOODS).upper()}" * rng.choice([0, 1])
        elif kind < 0.3:
            text += "\nA Ratepayer" if rng.random() < 0.5 else "\nContinued on page 6"
        elif kind < 0.36:
            text += " so it went ..."
        elif kind < 0.46:
            at = rng.randrange(20, len(text) - 3)
            while text[at - 1] in ". " or not text[at].isalpha():
                at -= 1
            text = text[:at]
            cut.add(i)
        if source == "b" and len(text) > 400:
            text = text[:397] + "..."
            cut.add(i)
        elif source == "c" and len(text) > 300 and text[299] not in ".":
            text = text[:300]
            if text.rstrip()[-1] != ".":
                cut.add(i)
        elif source == "c" and len(text) > 300:
            text = text[:300]
            cut.discard(i)
        docs.append((i, text, source))
    return docs, cut


def test_planted_cuts(spark):
    docs, cut = corpus(1)
    df = spark.createDataFrame(docs + [(90_001, None, "a"), (90_002, "", "a"), (90_003, "  ", None)], "doc long, text string, feed string").withColumn("unit", F.lit(1)).withColumn("doc_id", F.lit(2)).withColumn("source", F.lit(3))
    got = {r.doc_id for r in truncated(df, "doc", "text", "feed").collect()}
    assert len(cut - got) <= 0.01 * len(cut) and len(got - cut) <= 0.02 * len(cut)


def test_longer_copy_is_named(spark):
    page = "word " * 100 + "and so it ended here."
    df = spark.createDataFrame([(1, page, "a"), (2, page[:300] + "wo", "a"), (3, "An other page with a whole end.", "a")], "doc long, text string, feed string")
    assert [tuple(r) for r in truncated(df, "doc", "text", "feed").collect()] == [(2, "a", "prefix", 1)]
    assert truncated(df.limit(0), "doc", "text", "feed").collect() == []


def test_copies_are_strict_prefixes_and_repeats_are_no_endings(spark):
    rng = random.Random(4)
    lexicon = ["".join(rng.choice("aeioubdlmnrst") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    page = lambda: " ".join(" ".join(rng.choice(lexicon) for _ in range(9)).capitalize() + "." for _ in range(12))
    head = "THE EVENING HERALD. PUBLISHED DAILY, AND SOLD BY ALL AGENTS THROUGHOUT THE COUNTRY.\n"
    docs = [(i, head + page(), "a") for i in range(200)]
    cut = docs[7][1][:400].rsplit(" ", 1)[0] + " th"
    docs += [(1000 + i, cut, "a") for i in range(30)]  # a broken-off page, delivered again and again, under a masthead that all have
    whole = "Boots cheap\nterms moderate"
    docs += [(2000 + i, head + page() + "\n" + whole, "b") for i in range(20)]
    docs += [(3000, docs[5][1][:500].rstrip(" .") + " ...", None), (3001, docs[230][1] + "\nTea and coffee\nof the best.", "b")]
    longer = docs[9][1].replace("THE EVENING", "The Evening")  # marks and letter case are no letters of their own
    docs += [(4000, longer[: longer.index(" ", 300) + 3].rstrip(".! "), "a")]
    df = spark.createDataFrame(docs, "doc long, text string, feed string")
    got = {r.doc_id: (r.reason, r.copy_id) for r in truncated(df, "doc", "text", "feed").collect()}
    stream = {d: letter_stream(t) for d, t, _ in docs}
    for d, (_, copy) in got.items():
        longer_ones = [x for x, t in stream.items() if len(t) > len(stream[d]) and t.startswith(stream[d])]
        assert (copy is None) == (not longer_ones)
        if copy is not None:
            most = max(len(stream[x]) for x in longer_ones)
            assert copy == min(x for x in longer_ones if len(stream[x]) == most)
    assert all(got[1000 + i][0] in ("broken", "prefix") for i in range(30)) and not any(2000 + i in got for i in range(20))
    assert got[3000] == ("prefix", 5) and got[4000] == ("prefix", 9)


def test_prefix_hashes_of_any_block():
    texts = pa.array(["abcabc", "abc", None, "", "xabc", "ABC-abc", "é" * 40])
    codes, offsets, _, _ = letter_places(texts)
    sums = _prefix_sums(codes, offsets)
    h = prefix_hashes(sums, offsets[[0, 1, 5]], np.array([3, 3, 3]))
    assert len(set(h[0].tolist())) == len(set(h[1].tolist())) == 1
    assert prefix_hashes(sums, offsets[[0]], np.array([6]))[0][0] == prefix_hashes(sums, offsets[[5]], np.array([6]))[0][0] != h[0][0]


def test_ends():
    assert last_unit("It was so.") == ("closed", "")
    assert last_unit("It was so ...")[0] == "omitted"
    assert last_unit("It was s...")[0] == "broken" and last_unit("It was-")[0] == "broken"
    assert last_unit("x, sold\nevery-\nwhere\n") == ("open", "sold everywhere")
    assert last_unit("THE MAYOR'S SOAP") == ("open", "^soap") and last_unit("SOAP ! TEA") == ("open", "^!tea")
    assert last_unit("per dozen, franco") == ("open", ",franco")
    whole = {"a r": [], "ara": ["aratepayer"], "$yer": ["aratepayer"]}
    assert like_whole("a ratepayer", whole) and like_whole("a rateqayer", whole) and not like_whole("a ratepay", whole)
