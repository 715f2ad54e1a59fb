"""Running counts over arriving files.

Gene counts are additive, so each micro-batch is assigned like a batch of
files and its counts are written under the batch's number; a batch that is
tried again overwrites its own folder, so totals stay exact. Windowed counts
use event time and a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seqloom.operators.assign import Options, assign, target_counts


def stream_gene_counts(fragments: DataFrame, features: DataFrame, out: str, checkpoint: str, options: Options = Options()) -> StreamingQuery:
    """Starts counting a stream of fragments; ``total_counts`` reads the sums."""

    def write(batch: DataFrame, number: int) -> None:
        target_counts(assign(batch, features, options)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return fragments.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def total_counts(spark, out: str) -> DataFrame:
    return spark.read.parquet(out).groupBy("target").agg(F.sum("count65536").alias("count65536"))


def windowed_lengths(log: DataFrame, length: str = "1 day", late: str = "30 days") -> DataFrame:
    """Reads and bases per run and window of logged_at; rows later than the
    watermark are left out by the stream."""
    rows = log.filter("read_length >= 1").withColumn("logged_at", F.col("logged_at").cast("timestamp")).withWatermark("logged_at", late)
    return rows.groupBy(F.window("logged_at", length).start.alias("window_start"), "run_id").agg(F.count(F.lit(1)).alias("n"), F.sum("read_length").alias("bases"))
