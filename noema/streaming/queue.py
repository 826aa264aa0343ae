"""Queue behaviours as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def job_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def unique_requests(requests: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """Requests without repeats of a key within the watermark: enqueueing twice is enqueueing once."""
    return requests.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def heartbeats(events: DataFrame, key: str, at: str, late: str, window: str) -> DataFrame:
    """Last sign of life and number of events of each job and window."""
    return events.withWatermark(at, late).groupBy(F.window(at, window), key).agg(F.max(at).alias("last_activity"), F.count("*").alias("events"))


def sessions(events: DataFrame, key: str, at: str, late: str, gap: str) -> DataFrame:
    """Segments of events without a pause of the gap."""
    grouped = events.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("events"))
    return grouped.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def drain(stream: DataFrame, apply: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Work through all that is there in idempotent batches: a batch that is run again overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        apply(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
