"""The ledger as a stream: hourly counts with a watermark, batch and streaming from one expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hourly(events: DataFrame) -> DataFrame:
    """Events and value by hour and type; works on a table and on a stream with a watermark."""
    out = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return out.select(F.col("w.start").alias("hour_start"), "event_type", "n", F.round("value", 4).alias("value"))


def read(spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def deduplicated(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Replayed events once, within the watermark; times without a zone are the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def write(rows: DataFrame, path: str, checkpoint: str):
    """Appends a stream to a folder; the checkpoint makes restarts exact."""
    return rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def hourly_final(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """`hourly` of a stream, each hour once, when the watermark has passed it; events that come later still are dropped (sink.LateRows counts them)."""
    return hourly(events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay))
