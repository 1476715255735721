"""Structured Streaming over events: an extension, as nothing here streams elsewhere."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import table


def _timed(events: DataFrame) -> DataFrame:
    """With ``ts`` as an instant: a stream's watermark takes no time without a zone; the session's zone counts."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; the same plan for a batch and a stream."""
    return _timed(events).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Events of a user that follow each other within the gap."""
    return _timed(events).withWatermark("ts", "10 minutes").groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there and return its result."""
    name = f"quire_{uuid.uuid4().hex}"
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
