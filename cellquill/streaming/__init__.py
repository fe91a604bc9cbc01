"""Structured Streaming. Record-wise operators run on a stream as they are; this adds a source and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.text import from_lines


def record_stream(spark: SparkSession, path: str) -> DataFrame:
    """Records of text files as they arrive in a folder."""
    return from_lines(spark.readStream.text(path))


def event_counts(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by type and window of event time, with a watermark for late ones."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def cell_totals(records: DataFrame, path: str, checkpoint: str):
    """Keeps per-cell sums of each micro-batch in Parquet; sums of those are the running totals."""

    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy("barcode").agg(F.sum("count").alias("reads"), F.count(F.lit(1)).alias("records")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return records.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).start()
