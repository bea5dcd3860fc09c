"""Streams over a landing folder: records as they arrive, and windowed audits with late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 64) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_labels(stream: DataFrame, at: str, label: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and extremes of each label in event-time windows; rows later than the watermark are dropped."""
    event_time = F.col(at).cast("timestamp")
    return stream.withColumn("_at", event_time).withWatermark("_at", late).groupBy(F.window("_at", width), label).agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("greatest")).select(F.col("window.start").alias("window_start"), label, "n", "least", "greatest")


def first_seen(stream: DataFrame, at: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """First-wins dedup of a stream within the watermark."""
    return stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late).dropDuplicatesWithinWatermark(keys)


def each_batch(stream: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None], once: bool = True) -> StreamingQuery:
    """Run a batch plan on each micro-batch; with once, over what is there and then stop."""
    w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(work)
    return (w.trigger(availableNow=True) if once else w).start()
