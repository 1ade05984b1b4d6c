"""Timed events as streams: watermarked window counts, suppression by micro-batch, sessions.

An extension: the operators over batches have no stream of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The events files at ``path`` as a stream; time as a timestamp, which watermarks need."""
    schema = spark.read.parquet(path).schema
    every = path if "*" in path else f"{path}*"  # a stream takes a folder or a pattern, not one file
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(every).withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, late: str = "1 hour", length: str = "6 hours", slide: str | None = None) -> DataFrame:
    """(start, label, n, total) by event-time window; events later than the watermark are dropped."""
    by = F.window("ts", length, slide) if slide else F.window("ts", length)
    counted = events.withWatermark("ts", late).groupBy(by.alias("w"), F.col("event_type").alias("label")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), "label", "n", "total")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """(user_id, start, stop, n) of runs of events with gaps under ``gap``."""
    counted = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def latest(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Runs an aggregating stream over all that is there, each result replacing the one before in a Parquet folder."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(folder)

    stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
