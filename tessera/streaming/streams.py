"""Structured Streaming forms of ingest dedup, windowed counts and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 1) -> DataFrame:
    """New Parquet files of a folder; event time as TIMESTAMP, which watermarks need."""
    d = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return d.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame, keys: list[str], within: str = "72 hours") -> DataFrame:
    """The first event of each key; state is dropped once the watermark has passed."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)


def negative_windows(events: DataFrame, size: str = "24 hours", slide: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) by sliding window of event time."""
    d = events.withWatermark("ts", late).groupBy(F.window("ts", size, slide), "event_type")
    return d.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def alerts_once(batch: DataFrame, sent: DataFrame, key: str = "dedup_key") -> DataFrame:
    """For foreachBatch: alerts of a micro-batch that were not sent before, one a key."""
    return batch.dropDuplicates([key]).join(sent.select(key), key, "left_anti")
