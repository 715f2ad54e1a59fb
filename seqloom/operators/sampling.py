"""Systematic samples of rows, and shares of simulated reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.session import materialize


def numbered(df: DataFrame, order: list[Column | str], out: str = "row_no") -> DataFrame:
    """Rows with their number (from 0) in an order, without bringing them to
    one task: they are range-partitioned by Spark's sampled quantiles and
    sorted, and the numbers of rows of the partitions before (one a partition,
    added up by the driver) put on their places. The order should be total."""
    # the lower 33 bits of the id are the row's place in its partition
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).select(*df.columns, F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_i"))
    placed = materialize(placed)
    sizes = sorted((r["_p"], r["n"]) for r in placed.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect())
    skip, before = [], 0
    for p, n in sizes:
        skip.append((p, before))
        before += n
    table = df.sparkSession.createDataFrame(skip, "_p int, _skip long")
    return placed.join(F.broadcast(table), "_p").withColumn(out, F.col("_i") + F.col("_skip")).drop("_p", "_i", "_skip")


def systematic_sample(df: DataFrame, order: str, wanted: int) -> DataFrame:
    """About ``wanted`` rows at even distances: row i is taken when it is the
    first at or beyond the next mark; marks are max(1, (N - 0.1) / wanted) apart."""
    rows = numbered(df, [order])
    n = materialize(df.agg(F.count(F.lit(1)).alias("n"))).first().n
    step = max(1.0, (n - 0.1) / max(1, wanted))
    mark = F.ceil(F.col("row_no") / step - 1e-10)
    before = F.ceil((F.col("row_no") - 1) / step - 1e-10)
    return rows.filter((F.col("row_no") == 0) | (mark > before) & (F.floor((F.col("row_no") + 1e-10) / step) > F.floor((F.col("row_no") - 1 + 1e-10) / step))).drop("row_no")


def allocated(shares: DataFrame, name: str, weight: str, total: int) -> DataFrame:
    """(name, n): ``total`` reads shared out by weight: whole parts first, the
    rest one each to the largest remainders (then by name)."""
    everything = shares.select(F.sum(weight)).scalar()
    exact = shares.select(F.col(name), (F.col(weight) * total / everything).alias("x")).withColumn("whole", F.floor("x"))
    left = exact.select(F.lit(total) - F.sum("whole")).scalar()
    rest = F.round(F.col("x") - F.col("whole"), 9)
    return numbered(exact, [F.desc(rest), name], "r").select(name, (F.col("whole") + (F.col("r") < left).cast("int")).cast("long").alias("n"))
