"""Quantile digests over a bounded ordered universe (q-digests).

A digest is a set of nodes of the dyadic tree over [0, 2**BITS): node 1 is the
root, node i has the children 2i and 2i + 1, and value v is the leaf
2**BITS + v. Digests are ordinary rows (group, node, count), so joining those
of days or partitions is the addition of counts by node, which Spark combines
before its shuffle. A digest of more than ``cap`` nodes is compressed: maximal
subtrees of at most n / k values are folded into their top node.

Rank error: a fold moves values of at most n_i / k within one subtree of one
digest, so a digest that went through t rounds of compression answers any
percentile within t * n / k ranks. Every answer also carries the bound that
its own digest proves: the counts held by nodes above the leaf that straddle
the answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.functions.letters import letters, row_blocks

BITS = 52  # node numbers stay exact as doubles
PERMILLE = (10, 50, 100, 250, 500, 750, 900, 950, 990)


def _depth(nodes: np.ndarray) -> np.ndarray:
    return np.frexp(nodes.astype(np.float64))[1].astype(np.int64) - 1


def compress(nodes: np.ndarray, counts: np.ndarray, k: int, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Fold light subtrees of one digest; sorted nodes, no node twice."""
    order = np.argsort(nodes, kind="stable")
    nodes, counts = nodes[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1]])) if len(nodes) else np.zeros(0, np.int64)
    nodes, counts = nodes[at], np.add.reduceat(counts, at) if len(at) else counts
    if len(nodes) <= cap:
        return nodes, counts
    limit = int(counts.sum()) // k
    # subtree weights of every ancestor, level by level from the leaves
    depth = _depth(nodes)
    cur_n, cur_c = nodes[:0], counts[:0]
    folded_n, folded_c = [], []
    weight = np.zeros(0, np.int64)  # of the whole subtree at cur_n; cur_c: what was folded into it
    for level in range(int(depth.max()), -1, -1):
        own = depth == level
        n = np.concatenate([cur_n, nodes[own]])
        w = np.concatenate([weight, counts[own]])
        c = np.concatenate([cur_c, counts[own]])
        order = np.argsort(n, kind="stable")
        n, w, c = n[order], w[order], c[order]
        at = np.flatnonzero(np.concatenate([[True], n[1:] != n[:-1]])) if len(n) else np.zeros(0, np.int64)
        if len(at):
            n, w, c = n[at], np.add.reduceat(w, at), np.add.reduceat(c, at)
        if level == 0:
            folded_n.append(n[c > 0])
            folded_c.append(c[c > 0])
            break
        # a pair of siblings is light together if it may be folded into the parent
        parent = n >> 1
        at = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]])) if len(n) else np.zeros(0, np.int64)
        pw = np.add.reduceat(w, at) if len(at) else w
        pc_ = np.add.reduceat(c, at) if len(at) else c
        light = pw <= limit
        heavy = np.repeat(~light, np.diff(np.append(at, len(n))))
        keep = heavy & (c > 0)
        folded_n.append(n[keep])
        folded_c.append(c[keep])
        cur_n, weight = parent[at], pw
        cur_c = np.where(light, pc_, 0)
    n, c = np.concatenate(folded_n), np.concatenate(folded_c)
    order = np.argsort(n)
    return n[order], c[order]


def answer(nodes: np.ndarray, counts: np.ndarray, permille: tuple[int, ...]) -> tuple[int, np.ndarray, int]:
    """(n, values at the ranks ceil(p n / 1000), proven rank error)."""
    shift = BITS - _depth(nodes)
    low = (nodes << shift) - (1 << BITS)
    high = low + (np.int64(1) << shift) - 1
    order = np.lexsort((low, high))
    low, high, counts, shift = low[order], high[order], counts[order], shift[order]
    total = int(counts.sum())
    cum = np.cumsum(counts)
    ranks = np.maximum(1, (np.array(permille, dtype=np.int64) * total + 999) // 1000)
    values = high[np.searchsorted(cum, ranks)]
    inner = shift > 0
    err = 0
    if inner.any():
        for v in values:
            err = max(err, int(counts[inner & (low <= v) & (v <= high)].sum()))
    return total, values, err


def build(df: DataFrame, keys: list[Column], value: Column, k: int = 4096, cap: int = 8192) -> DataFrame:
    """Digests (g, part, node, n) of the whole-number ``value`` by the text key g.

    ``keys`` become one text key, their JSON (null is a key of its own). Each
    task keeps one digest a group and compresses those of more than ``cap``
    nodes before anything is shuffled. Values that are null or below 0 are no
    values; values beyond 2**BITS - 1 count as the greatest of the universe.
    Ties and repeated rows count as often as they stand. Empty in, empty out.
    """
    rows = df.select(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("g"), value.cast("long").alias("v")).filter(F.col("v").isNotNull() & (F.col("v") >= 0))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _NONE
        for batch in batches:
            node = np.minimum(batch.column(1).to_numpy(zero_copy_only=False), (1 << BITS) - 1) + (1 << BITS)
            held = _add([held, pa.table({"g": batch.column(0), "node": pa.array(node), "n": pa.array(np.ones(len(node), np.int64))})])
            held, out = _bounded(held, k, cap)
            yield from _tagged(out)
        yield from _tagged(_compressed(held, k, cap))

    return rows.mapInArrow(digests, _DIGEST)


_DIGEST = "g string, part int, node long, n long"
_NONE = pa.table({"g": pa.array([], pa.string()), "node": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})


def _tagged(t: pa.Table) -> list[pa.RecordBatch]:
    part = pa.array(np.full(t.num_rows, TaskContext.get().partitionId(), np.int32))
    return t.add_column(1, "part", part).to_batches() if t.num_rows else []


def _bounded(held: pa.Table, k: int, cap: int) -> tuple[pa.Table, pa.Table]:
    """What a task goes on holding, and what it hands on: with very many
    groups it hands on all it has."""
    if held.num_rows <= 400_000:
        return held, _NONE
    held = _compressed(held, k, cap)
    return (held, _NONE) if held.num_rows <= 300_000 else (_NONE, held)


def _add(parts: list[pa.Table]) -> pa.Table:
    g = pa.concat_tables(parts).group_by(["g", "node"]).aggregate([("n", "sum")])
    return g.rename_columns(["g", "node", "n"]).select(["g", "node", "n"])


def _compressed(t: pa.Table, k: int, cap: int) -> pa.Table:
    f = t.to_pandas()
    large = f.groupby("g", sort=False)["n"].transform("size").to_numpy() > cap
    out = [f[~large]]
    for g, own in f[large].groupby("g", sort=False):
        nodes, counts = compress(own["node"].to_numpy(), own["n"].to_numpy(), k, cap)
        out.append(pd.DataFrame({"g": g, "node": nodes, "n": counts}))
    return pa.Table.from_pandas(pd.concat(out), schema=t.schema, preserve_index=False)


def join(digests: DataFrame, k: int = 4096, cap: int = 8192, fan: int = 64) -> DataFrame:
    """One digest a group (g, part, node, n) from many, by addition of nodes.

    fan: the digests of a group are first joined in so many shares (by the
    task that made them), so that of ten thousand tasks' digests no task holds
    more than a share; 0 joins them at once. Either way counts of the same
    node are added before the shuffle.
    """
    if fan:
        digests = digests.groupBy("g", F.pmod("part", F.lit(fan)).alias("part"), "node").agg(F.sum("n").alias("n"))
        digests = digests.groupBy("g", "part").applyInPandas(lambda f: _fold(f, k, cap), _DIGEST)
    added = digests.groupBy("g", "node").agg(F.sum("n").alias("n")).withColumn("part", F.lit(0))
    return added.groupBy("g").applyInPandas(lambda f: _fold(f, k, cap), _DIGEST)


def _fold(f: pd.DataFrame, k: int, cap: int) -> pd.DataFrame:
    nodes, counts = compress(f["node"].to_numpy(), f["n"].to_numpy(), k, cap)
    return pd.DataFrame({"g": f["g"].iloc[0], "part": np.int32(f["part"].iloc[0]), "node": nodes, "n": counts})


def percentiles(digests: DataFrame, permille: tuple[int, ...] = PERMILLE) -> DataFrame:
    """(g, n, p<permille>..., rank_error) of joined digests."""
    fields = [T.StructField("g", T.StringType()), T.StructField("n", T.LongType())]
    fields += [T.StructField(f"p{p:03d}", T.LongType()) for p in permille] + [T.StructField("rank_error", T.LongType())]

    def one(f: pd.DataFrame) -> pd.DataFrame:
        n, values, err = answer(f["node"].to_numpy(), f["n"].to_numpy(), permille)
        return pd.DataFrame([[f["g"].iloc[0], n, *map(int, values), err]], columns=[x.name for x in fields])

    return digests.groupBy("g").applyInPandas(one, T.StructType(fields))


def build_scores(df: DataFrame, key: Column, text: str, dim: str = "run_id", zero: int = 33) -> DataFrame:
    """Digests of the scores that the letters of a quality text stand for.

    A letter is the score code - ``zero``; letters below it are no scores.
    Texts are counted whole where they lie: a task hands on at most one row a
    group and score. Null and empty texts have no scores.
    """
    rows = df.select(F.to_json(F.struct(F.lit(dim).alias("dim"), key.cast("string").alias("key")), {"ignoreNullFields": "false"}).alias("g"), df[text].alias("t"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _NONE
        for batch in batches:
            groups = batch.column(0).dictionary_encode()
            row_group = np.asarray(groups.indices).astype(np.int64)
            codes, offsets, _ = letters(batch.column(1))
            for lo, hi in row_blocks(offsets, 2_000_000):
                c = codes[offsets[lo] : offsets[hi]].astype(np.int64) - zero
                g = np.repeat(row_group[lo:hi], np.diff(offsets[lo : hi + 1]))
                g, c = g[c >= 0], c[c >= 0]
                if not len(c):
                    continue
                width = int(c.max()) + 1
                if width * len(groups.dictionary) <= 4 * len(c) + 100_000:
                    tally = np.bincount(g * width + c)
                    at = np.flatnonzero(tally)
                    tally = tally[at]
                else:
                    at, tally = np.unique(g * width + c, return_counts=True)
                node = pa.array(at % width + (1 << BITS))
                held = _add([held, pa.table({"g": groups.dictionary.take(pa.array(at // width)), "node": node, "n": pa.array(tally)})])
            held, out = _bounded(held, 4096, 8192)
            yield from _tagged(out)
        yield from _tagged(held)

    return rows.mapInArrow(digests, _DIGEST)
