"""Structured Streaming extension: tumbling-window aggregation with a watermark, and incremental conversion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadstone.functions.text import exact_sum


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Rows and summed value per tumbling window and key; rows later than the watermark are dropped by the stream, as asked.

    Works on a stream or a table; sums are decimals, so both agree.
    """
    rows = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late) if events.isStreaming else events.withColumn("__t", F.col(time).cast("timestamp"))
    g = rows.groupBy(F.window("__t", window).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), exact_sum("value").alias("total"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), key, "n", "total")


def run_available(spark: SparkSession, path: str, out: str, checkpoint: str) -> None:
    """Process all files below `path` that no earlier run with the same checkpoint took, once; window_totals() reads the result.

    The checkpoint folder is the record of what was converted: an unchanged source adds nothing. Every batch writes its
    partial totals into a folder of its own, so a batch that is tried again replaces what it wrote.
    """
    source = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)

    def keep(batch: DataFrame, number: int) -> None:
        windowed_counts(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    source.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def window_totals(spark: SparkSession, out: str, key: str = "event_type") -> DataFrame:
    """The totals of all runs: one row per window and key, however many runs and batches a window spans."""
    return spark.read.parquet(out).groupBy("day", key).agg(F.sum("n").alias("n"), exact_sum("total").alias("total"))


def stateful_totals(events: DataFrame, out: str, checkpoint: str, late: str = "7 days", key: str = "event_type") -> DataFrame:
    """Windowed totals of a stream whose state Spark keeps, until all available input is taken; the newest of each window.

    Every batch writes the windows it changed into a folder of its own (update mode), so nothing is held by the driver and a
    batch that is tried again replaces what it wrote. Rows later than the watermark, that of the batches before, are dropped.
    """
    spark = events.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    windowed_counts(events, key=key, late=late).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    written = spark.read.parquet(out)
    newest = written.groupBy("day", key).agg(F.max_by(F.struct("n", "total"), "batch").alias("v"))
    return newest.select("day", key, "v.n", "v.total")
