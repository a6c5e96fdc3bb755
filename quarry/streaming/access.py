"""Structured Streaming forms of the time-bucketed operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def access_counts(log: DataFrame, width: str = "1 hour", late: str = "2 hours", ts: str = "ts", keys: tuple[str, ...] = ("entity", "secret")) -> DataFrame:
    """Tumbling counts by key; buckets close once the watermark has passed, later rows are dropped."""
    return log.withWatermark(ts, late).groupBy(*keys, F.window(ts, width)).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("window.start").alias("bucket"), "n")


def first_seen(rows: DataFrame, keys: list[str], late: str = "2 hours", ts: str = "ts") -> DataFrame:
    """Rows whose keys weren't seen within the watermark."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def append_snapshots(rows: DataFrame, path: str, checkpoint: str):
    """A running file sink; each batch adds Parquet files under path."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
