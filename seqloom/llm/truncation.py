"""Texts cut by a field limit or a broken transfer.

A cut value is a strict prefix of the longer value it was cut from. Whole
texts are joined by hashed prefixes: of every letter stream the prefixes of
16, 32, 64 ... letters are hashed; a text that lacks a closing mark looks for
longer ones under its own longest such prefix, and these are asked for the
hash of their first n letters, n being all it has. So the join is exact, and
no group is larger than the texts that share half of a text. A text whose
longer copy goes on within the line was cut.

Most cut texts have no longer copy in a corpus, so the ends of texts are held
against each other as well: the ends that lack a closing mark are grouped by
their last units (word pairs; in lines of capitals single words), and a unit
counts as whole if different texts end with it again and again and the corpus
does not mostly carry it on as part of something longer. A text that lacks a
closing mark, and whose end isn't such a whole unit up to misread letters, was
cut. A source's field limit, the length at which its texts pile up and beyond
which it has next to none, settles texts of just that length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions.letters import U, mix, row_blocks
from seqloom.llm.postings import letter_places
from seqloom.session import materialize

# Marks that close a text, and marks that say something was left out.
CLOSING = ".!?\"')]»”’“"
OMISSION = ("...", "…")

_END = "doc_id long, source string, n_chars long, n_bytes long, n_mark int, mark string, unit string, n_letters long, h1 long, h2 long, levels array<long>"
_LEAST = 16  # letters of the shortest prefix that is hashed
_BASES = (U(0x9E3779B97F4A7C15 | 1), U(0xC2B2AE3D27D4EB4F | 1))


def last_unit(text: str) -> tuple[str, str]:
    """(mark, unit) of a text's end. mark: ``closed``, ``omitted`` (a mark of
    omission that follows a blank), ``broken`` (one within a word, a hyphen, a
    broken letter, a comma and the like) or ``open``. unit, if open: the last
    two words of the last phrase (``,`` and the word if it has but one), or ``^``
    and the last word of a line of capitals (``^!`` if marks part its words),
    in lower case."""
    t = text.rstrip()
    if not t:
        return "closed", ""
    for mark in OMISSION:
        if t.endswith(mark):
            rest = t[: -len(mark)]
            return ("omitted" if rest[-1:].isspace() or not rest else "broken"), ""
    if t[-1] in CLOSING:
        return "closed", ""
    if not t[-1].isalnum():
        return "broken", ""
    size = 400
    while True:  # as much of the end as holds its line and last phrase
        tail = t[-size:]
        if size >= len(t) or ("\n" in tail and len(re.split(r"[\s,;:]+", tail.rsplit("\n", 1)[0])) > 4):
            break
        size *= 2
    tail = re.sub(r"-\n\s*", "", tail)
    line = tail.rsplit("\n", 1)[-1]
    phrase = re.split(r"[,;:]", tail)[-1].split()
    last = re.split(r"[\s,;:]+", tail)[-1].lower()
    cased = [c for c in line if c.isalpha()]
    if cased and sum(c.isupper() for c in cased) >= 0.8 * len(cased) > 0 and line.split()[-1][:1].isupper():
        return "open", ("^!" if "!" in line else "^") + last
    return "open", " ".join(phrase[-2:]).lower() if len(phrase) > 1 else "," + last


def _prefix_sums(codes: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Per base the running sums of letter times power of the base, the powers
    counted from each text's begin: what lies between two sums of a text's
    begin and its n-th letter depends on those n letters only."""
    size = np.diff(offsets)
    at = np.arange(len(codes)) - np.repeat(offsets[:-1], size)
    out = []
    for base in _BASES:
        power = np.cumprod(np.concatenate([[U(1)], np.full(int(size.max()) if len(size) else 0, base)]), dtype=U)
        out.append(np.concatenate([[U(0)], np.cumsum((codes.astype(U) + U(1)) * power[at], dtype=U)]))
    return out


def prefix_hashes(sums: list[np.ndarray], begin: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of the first n letters of texts that begin at ``begin``."""
    return [mix((s[begin + n] - s[begin]) + n.astype(U) * b).astype(np.int64) for s, b in zip(sums, _BASES)]


def _ends(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    rows = docs.select(docs[doc_id].cast("long").alias("d"), docs[source].cast("string").alias("s"), docs[text].alias("t")).filter(F.col("t").isNotNull())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            marks, units = zip(*map(last_unit, texts)) if texts else ((), ())
            codes, offsets, _, _ = letter_places(batch.column(2))
            size, h1, h2 = np.diff(offsets), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            most = max(0, int(size.max() // _LEAST).bit_length()) if len(size) else 0
            levels = np.zeros((len(texts), most), np.int64)
            for lo, hi in row_blocks(offsets, 2_000_000):
                own = offsets[lo : hi + 1] - offsets[lo]
                sums = _prefix_sums(codes[offsets[lo] : offsets[hi]], own)
                h1[lo:hi], h2[lo:hi] = prefix_hashes(sums, own[:-1], size[lo:hi])
                for level in range(most):
                    long = np.flatnonzero(size[lo:hi] >= _LEAST << level)
                    levels[lo + long, level] = prefix_hashes(sums, own[long], np.full(len(long), _LEAST << level))[0]
            has = (size[:, None] >= (_LEAST << np.arange(most))[None, :]) if most else np.zeros((len(texts), 0), bool)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.compute.utf8_length(batch.column(2)).cast(pa.int64()), pa.compute.binary_length(batch.column(2)).cast(pa.int64()),
                    pa.array([next((len(m) for m in OMISSION if x.rstrip().endswith(m)), 0) for x in texts], pa.int32()), pa.array(marks, pa.string()), pa.array(units, pa.string()), pa.array(size.astype(np.int64)),
                    pa.array(h1), pa.array(h2), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has.sum(axis=1))]).astype(np.int32)), pa.array(levels[has])),
                ],
                names=["doc_id", "source", "n_chars", "n_bytes", "n_mark", "mark", "unit", "n_letters", "h1", "h2", "levels"],
            )

    return rows.mapInArrow(read, _END)


def prefix_copies(docs: DataFrame, doc_id: str, text: str, ends: DataFrame) -> DataFrame:
    """(n_letters, h1, h2, copy_id, goes_on) of the letter streams that lack a
    closing mark and are strict prefixes of longer ones: the longest of those
    (of equally long ones the least id), and whether one of them goes on
    within the line in which the shorter one ends. Streams of fewer than 16
    letters are not looked at.
    """
    keyed = ends.select("doc_id", "n_letters", "h1", "h2", "mark", F.posexplode("levels").alias("level", "h"))
    # prefixes held by texts of different lengths
    several = materialize(keyed.groupBy("level", "h").agg(F.min("n_letters").alias("lo"), F.max("n_letters").alias("hi")).filter("lo < hi"))
    last = F.size("levels") - 1
    short = ends.filter("mark <> 'closed' and size(levels) > 0").select("n_letters", "h1", "h2", last.alias("level"), F.element_at("levels", -1).alias("h")).distinct()
    short = materialize(short.join(several, ["level", "h"]).filter("hi > n_letters").select("level", "h", "n_letters", "h1", "h2"))
    # as many lengths of one prefix at most as it has letters
    asked = short.groupBy("level", "h").agg(F.sort_array(F.collect_set("n_letters")).alias("asked"))
    long = keyed.join(asked, ["level", "h"]).filter(F.col("n_letters") > F.element_at("asked", 1))
    long = long.groupBy("n_letters", "h1", "h2").agg(F.min("doc_id").alias("d"), F.array_distinct(F.flatten(F.collect_set("asked"))).alias("asked"))
    long = materialize(long.select("d", F.filter("asked", lambda n: n < F.col("n_letters")).alias("asked")).filter("size(asked) > 0"))
    rows = docs.select(docs[doc_id].cast("long").alias("d"), docs[text].alias("t")).filter(F.col("t").isNotNull()).join(long, "d").select("d", "t", "asked")

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, offsets, places, raw = letter_places(batch.column(1))
            n = batch.column(2).combine_chunks() if isinstance(batch.column(2), pa.ChunkedArray) else batch.column(2)
            row = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(n).to_numpy(zero_copy_only=False))
            n = n.flatten().to_numpy(zero_copy_only=False)
            ok = np.flatnonzero(n < np.diff(offsets)[row])
            row, n = row[ok], n[ok]
            h1, h2 = (np.zeros(len(n), np.int64) for _ in range(2))
            for r in np.unique(row):
                own = np.flatnonzero(row == r)
                sums = _prefix_sums(codes[offsets[r] : offsets[r + 1]], np.array([0, offsets[r + 1] - offsets[r]]))
                h1[own], h2[own] = prefix_hashes(sums, np.zeros(len(own), np.int64), n[own])
            at = offsets[row] + n
            stop = np.isin(raw, [ord(c) for c in CLOSING + "\n"])
            before = np.concatenate([[0], np.cumsum(stop)])
            goes_on = before[places[at]] == before[places[at - 1]] if len(at) else np.zeros(0, bool)
            size = np.diff(offsets)[row]
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(h1), pa.array(h2), pa.array(batch.column(0).to_numpy(zero_copy_only=False)[row]), pa.array(size.astype(np.int64)), pa.array(goes_on)], names=["n_letters", "h1", "h2", "d", "size", "goes_on"])

    held = rows.mapInArrow(prefixes, "n_letters long, h1 long, h2 long, d long, size long, goes_on boolean")
    best = held.groupBy("n_letters", "h1", "h2").agg(F.max(F.struct("size", (-F.col("d")).alias("d"))).alias("m"), F.bool_or("goes_on").alias("goes_on"))
    return best.join(short.select("n_letters", "h1", "h2").distinct(), ["n_letters", "h1", "h2"]).select("n_letters", "h1", "h2", (-F.col("m.d")).alias("copy_id"), "goes_on")


def field_limits(ends: DataFrame, pile: float = 0.02, floor: int = 4) -> DataFrame:
    """(source, unit_of_length, max_length): the lengths at which a source's
    texts pile up and beyond which it has next to none. One row at most for
    each of characters and bytes, the greater pile winning."""
    long = ends.select("source", F.explode(F.array(F.struct(F.lit("chars").alias("u"), F.col("n_chars").alias("n")), F.struct(F.lit("bytes").alias("u"), F.col("n_bytes").alias("n")))).alias("x")).select("source", "x.u", "x.n")
    by = long.groupBy("source", "u", "n").agg(F.count(F.lit(1)).alias("c"))
    peak = by.groupBy("source", "u").agg(F.sum("c").alias("total"), F.max(F.struct("c", "n")).alias("p"))
    near = by.join(peak, ["source", "u"]).filter(F.col("n") > F.col("p.n")).groupBy("source", "u").agg(F.sum("c").alias("above"))
    ok = peak.join(near, ["source", "u"], "left").filter((F.col("p.c") >= floor) & (F.col("p.c") >= F.lit(pile) * F.col("total")) & (F.coalesce("above", F.lit(0)) <= 0.05 * F.col("total")))
    best = ok.groupBy("source").agg(F.max(F.struct(F.col("p.c").alias("c"), F.when(F.col("u") == "chars", 1).otherwise(0).alias("chars"), F.col("p.n").alias("n"))).alias("b"))
    return best.select("source", F.when(F.col("b.chars") == 1, "chars").otherwise("bytes").alias("unit_of_length"), F.col("b.n").alias("max_length"))


def whole_units(docs: DataFrame, text: str, ends: DataFrame, often: float = 0.0004, floor: int = 3, carried: float = 0.01) -> DataFrame:
    """(unit, n_end, n_all): units that texts end with although the corpus
    doesn't mostly carry them on.

    A pair of words qualifies if at least max(floor, often * texts) different
    texts end with it and those are at least ``carried`` of all its occurrences; a
    single word (after a comma, or of a line of capitals) if a quarter as many
    end with it. So there are at most 4 / often units.
    """
    total = ends.count()
    one = F.substring("unit", 1, 1).isin("^", ",")
    # a text delivered again says nothing new about its end
    ended = ends.filter("mark = 'open'").select("unit", "h1", "h2").distinct().groupBy("unit").agg(F.count(F.lit(1)).alias("n_end"))
    # single words of one or two letters are rests of words
    ended = ended.filter(~one | (F.length(F.regexp_replace("unit", "[\\^!,]", "")) > 2))
    ended = materialize(ended.filter(F.col("n_end") >= F.when(one, max(2, int(often / 4 * total))).otherwise(max(floor, int(often * total)))))
    known = {r.unit for r in ended.select("unit").collect()}
    pairs, singles = {u for u in known if u[0] not in "^,"}, {u[1:] for u in known if u[0] == ","}

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[str, int] = {}
        for batch in batches:
            for t in batch.column(0).to_pylist():
                words = re.split(r"[\s,;:]+", t.lower())
                for pair in map(" ".join, zip(words, words[1:])):
                    if pair in pairs:
                        count[pair] = count.get(pair, 0) + 1
                for word in re.findall(r",\s+(\w+)", t.lower()):
                    if word in singles:
                        count["," + word] = count.get("," + word, 0) + 1
        yield pa.RecordBatch.from_pydict({"unit": list(count), "n": list(count.values())}, schema=pa.schema([("unit", pa.string()), ("n", pa.int64())]))

    everywhere = docs.select(text).filter(F.col(text).isNotNull()).mapInArrow(tally, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n_all"))
    return ended.join(everywhere, "unit", "left").filter(F.col("unit").startswith("^") | (F.col("n_end") >= F.lit(carried) * F.coalesce("n_all", F.lit(0))))


def _distance(a: str, b: str, most: int) -> int:
    """Edit distance, or most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
        if min(row) > most:
            return most + 1
    return row[-1]


def like_whole(unit: str, whole: dict[str, list[str]]) -> bool:
    """Is the unit, but for misread letters, one of the whole units?

    A unit that a whole one begins with is that unit cut short, not misread.
    """
    bare = unit.replace(" ", "")
    most = max(1, len(bare) // 5)
    if len(bare) < 4:
        return False
    for key in {bare[:3], "$" + bare[-3:]}:
        for w in whole.get(key, ()):
            if (w != bare and w.startswith(bare)) or re.match(r"[\^!,]*", w)[0] != re.match(r"[\^!,]*", bare)[0]:
                continue
            if _distance(bare, w, most) <= most:
                return True
    # blanks lost before the unit: it may end with a whole one
    return any(len(w) >= 8 and len(bare) > len(w) and bare.endswith(w) for w in whole.get("$" + bare[-3:], ()))


def truncated(docs: DataFrame, doc_id: str, text: str, source: str, often: float = 0.0004) -> DataFrame:
    """(doc_id, source, reason, copy_id): the texts that were cut.

    reason: ``limit`` (as long as the source's field holds), ``prefix`` (a
    longer copy goes on within the line) or ``broken``. copy_id: the document
    of the longest text of whose letters those of this one are a strict
    prefix; null if there is none.

    Null and empty texts are not cut. A text that ends in a closing mark is
    not, nor one whose mark of omission follows a blank, unless it is as long
    as its source's limit or a longer copy goes on. Null sources are a source
    of their own. Repeated texts are each judged alike. An empty table gives
    an empty result. Extra columns are not read.
    """
    ends = materialize(_ends(docs, doc_id, text, source))
    copies = materialize(prefix_copies(docs, doc_id, text, ends))
    units = [r.unit for r in whole_units(docs, text, ends, often).select("unit").collect()]
    whole: dict[str, list[str]] = {}
    for u in units:
        bare = u.replace(" ", "")
        whole.setdefault(bare[:3], []).append(bare)
        whole.setdefault("$" + bare[-3:], []).append(bare)
    known = set(units)

    limits = field_limits(ends).withColumnRenamed("source", "s")
    judged = ends.filter("mark <> 'closed'").join(F.broadcast(limits) if ends.select("source").distinct().count() <= 10_000 else limits, F.col("source").eqNullSafe(F.col("s")), "left")
    # a mark of omission takes the room of three letters, whichever sign it is
    letters_ = F.col("n_chars") + F.when(F.col("n_mark") > 0, 3 - F.col("n_mark")).otherwise(0)
    size = F.when(F.col("unit_of_length") == "chars", letters_).otherwise(F.col("n_bytes"))
    # a limit in bytes may fall within a letter, which is then left out
    at_limit = F.coalesce((size <= F.col("max_length")) & (size > F.col("max_length") - F.when(F.col("unit_of_length") == "chars", 1).otherwise(2)), F.lit(False))

    def misread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units_ = batch.column(batch.schema.get_field_index("unit")).to_pylist()
            ok = pa.array([u in known or like_whole(u, whole) for u in units_], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, ok], names=[*batch.schema.names, "is_whole"])

    judged = judged.withColumn("at_limit", at_limit).select("doc_id", "source", "mark", "unit", "n_letters", "h1", "h2", "at_limit")
    schema = "doc_id long, source string, mark string, unit string, n_letters long, h1 long, h2 long, at_limit boolean, is_whole boolean"
    judged = judged.mapInArrow(misread, schema).join(copies, ["n_letters", "h1", "h2"], "left")
    goes_on = F.coalesce("goes_on", F.lit(False))
    broken = (F.col("mark") == "broken") | ((F.col("mark") == "open") & ~F.col("is_whole"))
    reason = F.when(F.col("at_limit"), "limit").when(goes_on, "prefix").when(broken, "broken")
    return judged.select("doc_id", "source", reason.alias("reason"), "copy_id").filter("reason is not null")
