"""Per-key results when a few keys hold most of the rows.

Rows are first reduced where they lie to one partial state per (key, order
bucket). The states are then range-partitioned on the composite (key, bucket)
with quantiles that Spark samples from them, so that a heavy key is split over
several partitions and a partition may hold many light keys. Every partition
reduces its sorted stretch to one state per key, and the states of the keys
that cross partition borders are stitched in partition order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.session import materialize

_PARTIAL = "k string, b long, n long, m long, total long, last long"
_SEGMENT = "k string, pid int, n long, m long, total long, last long, first_b long, last_b long, n_b long, gap long"


def _reduce_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partial state per (key, bucket) of a partition; flushed when large."""
    held: list[pa.Table] = []
    rows = 0

    def combine(parts: list[pa.Table]) -> pa.Table:
        g = pa.concat_tables(parts).group_by(["k", "b"]).aggregate([("n", "sum"), ("m", "sum"), ("total", "sum"), ("last", "max")])
        return g.rename_columns(["k", "b", "n", "m", "total", "last"]).select(["k", "b", "n", "m", "total", "last"])

    for batch in batches:
        held.append(combine([pa.Table.from_batches([batch])]))
        rows += held[-1].num_rows
        if rows > 500_000:
            held = [combine(held)]
            rows = held[0].num_rows
            if rows > 250_000:
                yield from held[0].to_batches()
                held, rows = [], 0
    if held:
        yield from combine(held).to_batches()


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States of a sorted partition, one per key, in order."""
    pid = TaskContext.get().partitionId()
    carry: dict | None = None

    def row(s: dict) -> dict:
        return s | {"pid": pid}

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0)
        codes = keys.dictionary_encode()
        idx = np.asarray(codes.indices.fill_null(-1))
        cut = np.flatnonzero(np.concatenate([[True], idx[1:] != idx[:-1]]))
        stops = np.append(cut[1:], len(idx))
        b_null = np.asarray(batch.column(1).is_null().to_numpy(zero_copy_only=False))
        b = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False)
        sums = [np.add.reduceat(batch.column(i).to_numpy(zero_copy_only=False), cut) for i in (2, 3, 4)]
        last = batch.column(5).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        last = np.maximum.reduceat(last, cut)
        out = []
        for i, (lo, hi) in enumerate(zip(cut, stops)):
            own = b[lo:hi][~b_null[lo:hi]]
            steps = np.diff(own)
            state = {
                "k": None if idx[lo] < 0 else codes.dictionary[int(idx[lo])].as_py(),
                "n": int(sums[0][i]), "m": int(sums[1][i]), "total": int(sums[2][i]),
                "last": None if last[i] == np.iinfo(np.int64).min else int(last[i]),
                "first_b": int(own[0]) if len(own) else None,
                "last_b": int(own[-1]) if len(own) else None,
                "n_b": int(1 + np.count_nonzero(steps)) if len(own) else 0,
                "gap": int(steps.max()) if len(steps) else 0,
            }
            if carry is not None and carry["k"] == state["k"]:
                carry = _stitch(carry, state)
            else:
                if carry is not None:
                    out.append(row(carry))
                carry = state
        if out:
            yield _segment_batch(out)
    if carry is not None:
        yield _segment_batch([row(carry)])


def _stitch(a: dict, b: dict) -> dict:
    """The state of a stretch and the one after it."""
    both = a["last_b"] is not None and b["first_b"] is not None
    lasts = [x["last"] for x in (a, b) if x["last"] is not None]
    return {
        "k": a["k"], "n": a["n"] + b["n"], "m": a["m"] + b["m"], "total": a["total"] + b["total"],
        "last": max(lasts) if lasts else None,
        "first_b": a["first_b"] if a["first_b"] is not None else b["first_b"],
        "last_b": b["last_b"] if b["last_b"] is not None else a["last_b"],
        "n_b": a["n_b"] + b["n_b"] - int(both and a["last_b"] == b["first_b"]),
        "gap": max(a["gap"], b["gap"], b["first_b"] - a["last_b"] if both else 0),
    }


def _segment_batch(rows: list[dict]) -> pa.RecordBatch:
    schema = pa.schema([("k", pa.string()), ("pid", pa.int32()), ("n", pa.int64()), ("m", pa.int64()), ("total", pa.int64()), ("last", pa.int64()), ("first_b", pa.int64()), ("last_b", pa.int64()), ("n_b", pa.int64()), ("gap", pa.int64())])
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _micros(df: DataFrame, order: str) -> Column:
    """Microseconds since 1970; a timestamp without zone is taken as it reads."""
    if df.schema[order].dataType.simpleString() == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), df[order])
    return F.unix_micros(df[order].cast("timestamp"))


def key_profile(df: DataFrame, key: str, order: str, value: Column | None = None) -> DataFrame:
    """Counts, lengths, last load and load gaps of every key of ``key``.

    ``order`` is a timestamp; its UTC days are the secondary order. ``value``
    is a whole number to be added up (null values add nothing).

    Result: key_value, n_rows, n_values (rows whose value isn't null), total,
    last_load (microseconds since 1970), n_days (days with a row), longest_gap_days (greatest distance
    between neighbouring days with rows, 0 for a single day).

    Null keys form one result row of their own with key_value null. Rows whose
    order is null count in n_rows and total but have no day. Repeated rows
    count as often as they stand. Ties in the order are one bucket and do no
    harm. An empty table gives an empty result. Further columns of ``df`` are
    not read, so their names cannot clash.
    """
    value = F.lit(None) if value is None else value
    rows = df.select(
        df[key].cast("string").alias("k"),
        F.unix_date(F.to_date(df[order])).cast("long").alias("b"),
        F.lit(1).cast("long").alias("n"),
        value.isNotNull().cast("long").alias("m"),
        F.coalesce(value.cast("long"), F.lit(0).cast("long")).alias("total"),
        _micros(df, order).alias("last"),
    )
    partial = materialize(rows.mapInArrow(_reduce_batches, _PARTIAL))
    pieces = partial.repartitionByRange("k", "b").sortWithinPartitions("k", "b").mapInArrow(_segments, _SEGMENT)
    states = pieces.groupBy("k").agg(
        F.sum("n").alias("n_rows"), F.sum("m").alias("n_values"), F.sum("total").alias("total"), F.max("last").alias("last_load"),
        F.array_sort(F.collect_list(F.struct("pid", "first_b", "last_b", "n_b", "gap"))).alias("s"),
    )
    dated = F.filter("s", lambda x: x.first_b.isNotNull())
    zero = F.struct(F.lit(None).cast("long").alias("last_b"), F.lit(0).cast("long").alias("n_b"), F.lit(0).cast("long").alias("gap"))

    def stitch(a: Column, x: Column) -> Column:
        return F.struct(
            x.last_b.alias("last_b"),
            (a.n_b + x.n_b - F.when(a.last_b == x.first_b, 1).otherwise(0)).cast("long").alias("n_b"),
            F.greatest(a.gap, x.gap, F.coalesce(x.first_b - a.last_b, F.lit(0))).cast("long").alias("gap"),
        )

    return states.withColumn("r", F.aggregate(dated, zero, stitch)).select(
        F.col("k").alias("key_value"), "n_rows", "n_values", "total", "last_load", F.col("r.n_b").alias("n_days"), F.col("r.gap").alias("longest_gap_days"),
    )


def heavy_keys(df: DataFrame, key: str, order: str, share: float = 0.02) -> DataFrame:
    """Keys that hold at least ``share`` of all rows (null keys count in the
    total but are no key), with their profile. Empty for an empty table."""
    profile = materialize(key_profile(df, key, order))
    total = profile.select(F.sum("n_rows")).scalar()
    return profile.filter(F.col("key_value").isNotNull() & (F.col("n_rows") >= F.lit(share) * total))
