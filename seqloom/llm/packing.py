"""Filling containers of a fixed capacity with items of varying length.

The lengths are counted to a histogram, whose size is bounded by the capacity.
Over the histogram the configuration linear program (fewest containers, each
filled by one configuration of lengths, all items covered) is solved by
multiplicative weights: a length's price is its size, lowered exponentially by
the share of its items that are placed, so that all lengths are covered at one
pace and short ones are left for the gaps to the end. In every round a knapsack
over the prices finds the best configuration, which is used for a bounded share
of the items its scarcest length has left, rounded to whole containers. So the
solution is whole as it stands, and each round's prices also prove a bound:
no packing has fewer containers than the value of all items over the value of
the best configuration. The plan then tells every item its container from its
rank among the items of its length, without a group of items ever being
gathered.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.session import materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that byte-level BPE splits text by before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def token_counts(df: DataFrame, id: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """(id, n): tokens of each text under a byte-level BPE vocabulary, a file of
    lines of a base64 token and its rank that every executor can read: the one
    given, or that of the setting ``spark.seqloom.vocabulary``. Null texts
    count as empty."""
    vocabulary = vocabulary or df.sparkSession.conf.get("spark.seqloom.vocabulary", VOCABULARY)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            n = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["id", "n"])

    return df.select(df[id].cast("long").alias("id"), df[text].alias("t")).mapInArrow(count, "id long, n long")


def best_configuration(sizes: np.ndarray, values: np.ndarray, most: np.ndarray, capacity: int) -> np.ndarray:
    """How often each size goes into one container for the greatest value.

    Dynamic program over the capacity; each size at most ``most`` times, by
    binary parts.
    """
    parts: list[tuple[int, int]] = []
    for i in np.flatnonzero((most > 0) & (sizes <= capacity)):
        left, times = min(int(most[i]), capacity // int(sizes[i])), 1
        while left > 0:
            parts.append((int(i), min(times, left)))
            left -= min(times, left)
            times *= 2
    best, with_it, used = np.zeros(capacity + 1), np.empty(capacity + 1), np.zeros((len(parts), capacity + 1), bool)
    for p, (i, times) in enumerate(parts):
        weight = times * int(sizes[i])
        room = capacity + 1 - weight
        np.add(best[:room], times * values[i], out=with_it[:room])
        np.greater(with_it[:room], best[weight:] + 1e-12, out=used[p, weight:])
        np.maximum(best[weight:], with_it[:room], out=best[weight:])
    out = np.zeros(len(sizes), np.int64)
    at = int(np.argmax(best))
    for p in range(len(parts) - 1, -1, -1):
        if used[p, at]:
            i, times = parts[p]
            out[i] += times
            at -= times * int(sizes[i])
    return out


Plan = list[tuple[np.ndarray, np.ndarray, int]]


def fractional_value(sizes: np.ndarray, values: np.ndarray, most: np.ndarray, capacity: int) -> float:
    """Value of the best configuration if items could be cut: no whole one has more."""
    order = np.argsort(-values / sizes, kind="stable")
    filled = np.cumsum((most * sizes)[order])
    n = int(np.searchsorted(filled, capacity))
    whole = float((most * values)[order[:n]].sum())
    if n == len(order):
        return whole
    return whole + (capacity - (int(filled[n - 1]) if n else 0)) * float(values[order[n]] / sizes[order[n]])


def priced_configuration(sizes: np.ndarray, values: np.ndarray, most: np.ndarray, capacity: int, top: float, core: int, slack: float, octave: np.ndarray) -> np.ndarray:
    """A configuration whose value is within ``slack`` of the best of all lengths.

    The knapsack is solved over a core, the lengths of the best value for
    their room in each octave of sizes. If its value is near ``top``, which
    bounds that of any configuration, no other length can better it by more;
    otherwise the core is doubled, up to all lengths.
    """
    have = np.flatnonzero(most > 0)
    order = have[np.lexsort((-(values / sizes)[have], octave[have]))]
    place = np.arange(len(order)) - np.searchsorted(octave[order], octave[order])
    while True:
        pick = np.sort(order[place < core])
        use = best_configuration(sizes[pick], values[pick], most[pick], capacity)
        if len(pick) == len(have) or float((use * values[pick]).sum()) >= (1 - slack) * top:
            out = np.zeros(len(sizes), np.int64)
            out[pick] = use
            return out
        core *= 2


def whole_program(sizes: np.ndarray, counts: np.ndarray, capacity: int, worth: np.ndarray, eta: float, core: int, slack: float, bounded_by: np.ndarray) -> tuple[Plan, float]:
    """Multiplicative weights in whole containers over the items ``counts``;
    prices are ``worth`` times exp(-eta * share placed). The bound is one for
    the items ``bounded_by``."""
    left, plan, bound = counts.copy(), [], 0.0
    fit, octave = np.maximum(capacity // sizes, 1), np.log2(sizes).astype(np.int64)
    while left.any():
        price = worth * np.exp(-eta * (1 - left / np.maximum(counts, 1)))
        if len(plan) % 50 == 0:
            bound = max(bound, float((price * bounded_by).sum()) / fractional_value(sizes, price, np.minimum(bounded_by, fit), capacity))
        most = np.minimum(left, fit)
        times = priced_configuration(sizes, price, most, capacity, fractional_value(sizes, price, most, capacity), core, slack, octave)
        own = np.flatnonzero(times)
        n = int((left[own] // times[own]).min())
        left[own] -= n * times[own]
        plan.append((sizes[own], times[own], n))
    return plan, bound


def fractional_program(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int, eps: float = 0.1) -> tuple[dict[tuple, float], np.ndarray, float]:
    """(containers of each configuration, prices, bound) by multiplicative
    weights in fractions of containers, every knapsack over all lengths.

    A step covers its scarcest length by a share ``eps``, so no weight falls by
    more than that; the solution is scaled to cover every length just once.
    """
    weight = np.log(sizes * counts / float((sizes * counts).sum()))  # of all items of a length
    covered, use = np.zeros(len(sizes)), {}
    best_y, bound = sizes.astype(float), 0.0
    most = np.minimum(counts, np.maximum(capacity // sizes, 1))
    for _ in range(rounds):
        y = np.exp(weight - weight.max()) / counts
        times = best_configuration(sizes, y, most, capacity)
        proven = float((y * counts).sum() / (y * times).sum())
        if proven > bound:
            best_y, bound = y, proven
        own = np.flatnonzero(times)
        step = eps * float((counts[own] / times[own]).min())
        key = (tuple(own.tolist()), tuple(times[own].tolist()))
        use[key] = use.get(key, 0.0) + step
        covered[own] += step * times[own] / counts[own]
        weight[own] -= step * times[own] / counts[own]
    return {k: v / max(float(covered.min()), 1.0) for k, v in use.items()}, best_y, bound


def solve(sizes: np.ndarray, counts: np.ndarray, capacity: int, close: float = 0.001, eta: float = 1.0, favour: float = 0.1, core: int = 8, slack: float = 0.05, rounds: int = 400) -> tuple[Plan, float]:
    """(plan, bound): (sizes, times of each, number of containers) entries that
    place every item once, and the number below which no plan can be.

    The program is first solved in whole containers from prices that are the
    room taken (``favour``: how much dearer room is for items as long as the
    capacity, as short ones fit later gaps). If the plan isn't within ``close``
    of the bound, it is solved in fractions by ``rounds`` steps, rounded down,
    and the rest placed by its prices; the better plan is taken. eta: how much
    a length's price falls until all its items are placed. core and slack: see
    ``priced_configuration``.
    """
    if not len(sizes):
        return [], 0.0
    counts = counts.astype(np.int64)
    full = sizes == capacity
    alone: Plan = [(sizes[full], np.ones(1, np.int64), int(counts[full][0]))] if full.any() else []
    sizes, counts = sizes[~full], counts[~full]
    if not len(sizes):
        return alone, float(alone[0][2])
    plan, bound = whole_program(sizes, counts, capacity, sizes * (1 + favour * sizes / capacity), eta, core, slack, counts)
    # prices that are the room taken, and prices of one for every item over half the capacity, prove bounds too
    bound = np.ceil(max(bound, float((sizes * counts).sum()) / capacity, float(counts[2 * sizes > capacity].sum())) - 1e-6)
    containers = lambda p: sum(n for *_, n in p)
    if containers(plan) > (1 + close) * bound:
        use, prices, proven = fractional_program(sizes, counts, capacity, rounds)
        bound = max(bound, np.ceil(proven - 1e-6))
        left, rounded = counts.copy(), []
        for (own, times), n in sorted(use.items(), key=lambda x: -x[1]):
            i, t = np.array(own), np.array(times)
            n = min(int(n), int((left[i] // t).min()))
            if n > 0:
                left[i] -= n * t
                rounded.append((sizes[i], t, n))
        some = left > 0
        if some.any():
            rounded += whole_program(sizes[some], left[some], capacity, prices[some] * (1 + favour * sizes[some] / capacity), eta, core, slack, left[some])[0]
        plan = min(plan, rounded, key=containers)
    return alone + plan, float(bound) + containers(alone)


BROADCAST = 128 << 20  # bytes of a plan that is sent to all tasks; a larger one is joined


def pack(items: DataFrame, capacity: int, share: int = 1_000_000) -> DataFrame:
    """Container of every piece of every item of (id, n).

    Result: id, piece_no (from 1), n_tokens, container_id (from 0). An item of
    more than the capacity fills containers of its own, and what is left over
    is a piece like other items; no other item is split. Items without tokens
    are in no container, as they need no room. Lengths that are null or
    negative count as 0. Ids may be repeated, then each row is an item. Items
    of one length are ranked in shares of some 64th of them, or of ``share`` if
    that is less, so that no task ranks more. An empty table gives an empty result.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    n = F.greatest(F.coalesce(F.col("n"), F.lit(0)), F.lit(0)).cast("long")
    # the last piece is the rest; pieces before it are as long as the capacity
    made = items.select("id", n.alias("n")).filter(F.col("n") > 0).withColumn("piece_no", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("n") / capacity).cast("long"))))
    size = F.when(F.col("piece_no") * capacity <= F.col("n"), F.lit(capacity)).otherwise(F.col("n") % capacity).cast("long")
    pieces = materialize(made.select("id", "piece_no", size.alias("size"), F.xxhash64("id", "piece_no").alias("salt")))
    salts = max(64, -(-pieces.count() // share))
    pieces = pieces.withColumn("salt", F.pmod("salt", F.lit(salts)).cast("int"))
    shares = materialize(pieces.groupBy("size", "salt").agg(F.count(F.lit(1)).alias("c")))
    # at most ``capacity`` rows
    histogram = shares.groupBy("size").agg(F.sum("c").alias("c")).orderBy("size").collect()
    sizes = np.array([r["size"] for r in histogram], np.int64)
    counts = np.array([r["c"] for r in histogram], np.int64)
    plan, _ = solve(sizes, counts, capacity)
    slots: dict[int, list[tuple[int, int, int]]] = {}
    given: dict[int, int] = {}
    base = 0
    for own, times, containers in plan:
        for s, t in zip(map(int, own), map(int, times)):
            slots.setdefault(s, []).append((given.get(s, 0), base, t))
            given[s] = given.get(s, 0) + t * containers
        base += containers
    spark = items.sparkSession
    # one row a length, and in it one entry a configuration of the plan that holds the length
    table = spark.createDataFrame(list(slots.items()), "size long, slots array<struct<rank: long, base: long, times: long>>")
    if 24 * sum(map(len, slots.values())) <= BROADCAST:
        table = F.broadcast(table)
    ranked = pieces.withColumn("r", F.row_number().over(W.partitionBy("size", "salt").orderBy("id", "piece_no")) - 1)
    before = shares.withColumn("skip", F.coalesce(F.sum("c").over(W.partitionBy("size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("c")
    placed = ranked.join(before, ["size", "salt"]).withColumn("rank", F.col("r") + F.col("skip")).join(table, "size")
    slot = F.element_at(F.filter("slots", lambda x: x.rank <= F.col("rank")), -1)
    return placed.withColumn("s", slot).select(
        "id", "piece_no", F.col("size").alias("n_tokens"), (F.col("s.base") + F.floor((F.col("rank") - F.col("s.rank")) / F.col("s.times"))).cast("long").alias("container_id")
    )
