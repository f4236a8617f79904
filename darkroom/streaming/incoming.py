"""Streams of file records (an extension): arrivals without repeats, and counts per day of arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arrivals(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New parquet files of file records in a folder, as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def first_arrivals(stream: DataFrame, event_time: str = "ingested_at", delay: str = "1 day", key: str = "file_hash") -> DataFrame:
    """Each content once within the watermark; state older than the delay is dropped. Rows with a null key equal no other and all pass."""
    marked = stream.withWatermark(event_time, delay)
    once = marked.filter(F.col(key).isNotNull()).dropDuplicatesWithinWatermark([key])
    return once.unionByName(marked.filter(F.col(key).isNull()))


def daily_counts(stream: DataFrame, event_time: str = "ingested_at", delay: str = "1 day") -> DataFrame:
    """Files and bytes per day of arrival; late rows within the delay are counted."""
    windowed = stream.withWatermark(event_time, delay).groupBy(F.window(event_time, "1 day").alias("day"))
    return windowed.agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes")).select(F.col("day.start").alias("day"), "files", "bytes")
