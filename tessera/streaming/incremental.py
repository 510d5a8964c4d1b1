"""Evidence as a stream: an extension of the batch operators, for folders that only grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arrivals(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def first_arrivals(stream: DataFrame, key: list[str], time: str, late: str = "1 day") -> DataFrame:
    """Each key once while it may still arrive again: the state is bounded by the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def windowed_counts(stream: DataFrame, time: str, group: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event-time window, final once the watermark has passed it."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), group).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), group, "n")


def into_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what has arrived and ends; a rerun goes on where the last one stopped."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
