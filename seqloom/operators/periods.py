"""Merging overlapping intervals per entity into periods, and their gaps.

The aggregate is a sorted list of disjoint intervals. Level 0 makes such lists
from each batch of rows where it lies; level 1 range-partitions the lists on
(entity, start) and merges them linearly within each partition; the top level
stitches what crosses partition borders: of the first and last entity of each
partition one summary row is carried on to the partitions behind, and their
periods are held against it. An entity of any size is spread over partitions,
and no list is held whole anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.session import materialize

_NONE = -(1 << 63)  # no period before; no position is that low


def merge_sorted(group: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linear merge of intervals sorted by (group, start).

    Returns the index at which each disjoint stretch begins, and its stop.
    Inclusive positions; touching intervals are one stretch.
    """
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    levels, rank = np.unique(stop, return_inverse=True)
    g = np.cumsum(np.concatenate([[0], (group[1:] != group[:-1]).astype(np.int64)]))
    top = levels[np.maximum.accumulate(rank.astype(np.int64) + g * len(levels)) - g * len(levels)]
    begins = np.concatenate([[True], (group[1:] != group[:-1]) | (start[1:] > top[:-1] + 1)])
    at = np.flatnonzero(begins)
    return at, top[np.append(at[1:], len(start)) - 1]


def _group_codes(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    return frame.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()


def merge_intervals(df: DataFrame, keys: list[str], start: str, stop: str) -> DataFrame:
    """Periods and gaps of every entity.

    Result: the keys, seg_kind (``period`` or ``gap``), seg_start, seg_stop.
    A period is a maximal stretch of positions each covered by some interval
    (inclusive; stop + 1 = start is no gap), a gap the stretch between two
    neighbouring periods of an entity.

    Rows with a null or reversed start and stop are left out. Null keys are
    keys like others. Ties and repeated rows change nothing. An empty table
    gives an empty result. Further columns are not read.
    """
    kf = [f"k{i}" for i in range(len(keys))]
    rows = df.filter(F.col(start).isNotNull() & F.col(stop).isNotNull() & (F.col(start) <= F.col(stop))).select(
        *[df[k].alias(a) for k, a in zip(keys, kf)], df[start].cast("long").alias("a"), df[stop].cast("long").alias("z")
    )
    schema = T.StructType([T.StructField(a, rows.schema[a].dataType) for a in kf] + [T.StructField("a", T.LongType()), T.StructField("z", T.LongType())])
    run_schema = T.StructType([*schema.fields, T.StructField("before", T.LongType()), T.StructField("pid", T.IntegerType()), T.StructField("edge", T.BooleanType())])

    def lists(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            g = _group_codes(f, kf)
            order = np.lexsort((f["a"].to_numpy(), g))
            f, g = f.iloc[order], g[order]
            at, z = merge_sorted(g, f["a"].to_numpy(), f["z"].to_numpy())
            yield f.iloc[at].assign(z=z)

    def runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Periods of a sorted partition; edge: of its first or last key."""
        pid = TaskContext.get().partitionId()
        held: pd.DataFrame | None = None  # the last key's open period, and those of the key so far that aren't out
        first: tuple | None = None
        for f in frames:
            if not len(f):
                continue
            if held is not None:
                f = pd.concat([held[[*kf, "a", "z", "before"]], f.assign(before=_NONE)], ignore_index=True)
                before0 = held["before"].iloc[0]
            else:
                before0 = _NONE
            g = _group_codes(f, kf)
            at, z = merge_sorted(g, f["a"].to_numpy(), f["z"].to_numpy())
            out = f.iloc[at].assign(z=z)
            og = g[at]
            before = np.concatenate([[_NONE], np.where(og[1:] == og[:-1], z[:-1], _NONE)]).astype(np.int64)
            before[0] = before0
            out = out.assign(before=before, pid=pid)
            if first is None:
                first = tuple(out[kf].iloc[0])
            # the last period stays open; others are whole within this partition
            edge = np.zeros(len(out), bool)
            edge[:] = (og == og[-1]) | _same(out, kf, first)
            out = out.assign(edge=edge)
            held = out.iloc[-1:]
            closed = out.iloc[:-1]
            # periods of the last key are marked as edge at once: the key may end here or go on in the next partition
            if len(closed):
                yield _finish(closed)
        if held is not None:
            yield _finish(held.assign(edge=True))

    def _same(out: pd.DataFrame, cols: list[str], key: tuple) -> np.ndarray:
        hit = np.ones(len(out), bool)
        for c, v in zip(cols, key):
            hit &= out[c].isna().to_numpy() if pd.isna(v) else (out[c] == v).fillna(False).to_numpy()
        return hit

    def _finish(out: pd.DataFrame) -> pd.DataFrame:
        before = out["before"].astype("Int64")
        return out.assign(before=before.mask(before == _NONE))[[*kf, "a", "z", "before", "pid", "edge"]]

    partial = materialize(rows.mapInPandas(lists, schema))
    sorted_runs = materialize(partial.repartitionByRange(*kf, "a").sortWithinPartitions(*kf, "a").mapInPandas(runs, run_schema))
    inner = sorted_runs.filter(~F.col("edge")).select(*kf, "a", "z", "before")

    # periods of the first and the last key of a partition, and of the last key of a batch
    edges = sorted_runs.filter("edge")
    ahead = W.partitionBy(*kf).orderBy("pid").rowsBetween(W.unboundedPreceding, -1)
    carry = edges.groupBy(*kf, "pid").agg(F.max("z").alias("top")).withColumn("carry", F.max("top").over(ahead)).drop("top")

    def on(right: DataFrame, cols: list[str]) -> tuple[DataFrame, Column]:
        """``right`` under other names, and the null-safe condition on ``cols``."""
        right = right.toDF(*[f"r_{c}" if c in cols else c for c in right.columns])
        cond = F.lit(True)
        for c in cols:
            cond = cond & F.col(c).eqNullSafe(F.col(f"r_{c}"))
        return right, cond

    right, cond = on(carry, [*kf, "pid"])
    carried = edges.join(right, cond).select(*kf, "a", "z", "before", "pid", "carry")
    carried = carried.withColumn("taken", F.col("carry").isNotNull() & (F.col("a") <= F.col("carry") + 1))
    tails = carried.groupBy(*kf, "pid").agg(F.max(F.when(~F.col("taken"), F.col("a"))).alias("own"), F.max(F.when(F.col("taken"), F.col("z"))).alias("more"))
    owner = F.last(F.when(F.col("own").isNotNull(), F.struct("pid", "own")), ignorenulls=True).over(ahead)
    grown = tails.withColumn("o", owner).filter(F.col("more").isNotNull() & F.col("o").isNotNull()).groupBy(*kf, F.col("o.pid").alias("pid"), F.col("o.own").alias("a")).agg(F.max("more").alias("more"))
    right, cond = on(grown, [*kf, "pid", "a"])
    outer = carried.filter(~F.col("taken")).join(right, cond, "left").select(*kf, "a", F.greatest("z", "more").alias("z"), F.greatest("before", "carry").alias("before"))
    periods = inner.unionByName(outer)
    segs = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("a").alias("lo"), F.col("z").alias("hi")),
        F.struct(F.lit("gap").alias("kind"), (F.col("before") + 1).alias("lo"), (F.col("a") - 1).alias("hi")),
    )
    out = periods.withColumn("s", F.explode(F.filter(segs, lambda x: x.lo.isNotNull())))
    return out.select(*[F.col(a).alias(k) for a, k in zip(kf, keys)], F.col("s.kind").alias("seg_kind"), F.col("s.lo").alias("seg_start"), F.col("s.hi").alias("seg_stop"))
