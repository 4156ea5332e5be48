"""Event-time aggregates over unbounded arrays of readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def windowed_histogram(events: DataFrame, window: str = "1 hour", late: str = "2 hours", bins: int = 16, width: float = 32.0) -> DataFrame:
    """Counts by event-time window and bin; works on a stream (with a watermark) and on a
    table alike."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    b = F.greatest(F.least(F.floor(F.col("value") / width), F.lit(bins - 1)), F.lit(0)).cast("int")
    return events.groupBy(F.window("ts", window).alias("w"), b.alias("bin")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "bin", "n")


def sliding_mean(events: DataFrame, window: str = "1 hour", step: str = "15 minutes", late: str = "2 hours") -> DataFrame:
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", window, step).alias("w")).agg(F.avg("value").alias("mean"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), "mean", "n")


def run_to_memory(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Drains a stream's present input into a table."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def per_frame(frames: DataFrame, query, sink) -> object:
    """Each micro-batch is a frame: ``query`` maps it as a table, ``sink`` stores it."""
    return frames.writeStream.foreachBatch(lambda df, epoch: sink(query(df), epoch)).trigger(availableNow=True).start()
