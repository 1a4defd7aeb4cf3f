"""Structured Streaming over event logs: windowed counts with a watermark, sessions, and de-duplication by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from forgeline.session import scratch_path


def event_stream(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", files_at_once: int = 8) -> DataFrame:
    """The Parquet files of a folder as a stream, old ones first."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def timed(stream: DataFrame, at: str, late: str) -> DataFrame:
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)


def tumbling_counts(stream: DataFrame, at: str, by: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``window_start, by, n_events, total`` of windows of one width; rows later than ``late`` are dropped."""
    w = timed(stream, at, late).groupBy(F.window(at, width), by).agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("window_start"), by, "n_events", "total")


def session_counts(stream: DataFrame, at: str, by: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    w = timed(stream, at, late).groupBy(F.session_window(at, gap), by).agg(F.count(F.lit(1)).alias("n_events"))
    return w.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), by, "n_events")


def first_of_each(stream: DataFrame, at: str, key: str, within: str = "1 hour") -> DataFrame:
    """Events without those that repeat a key within the time."""
    return timed(stream, at, within).dropDuplicatesWithinWatermark([key])


def run_to_end(result: DataFrame, name: str) -> DataFrame:
    """Run a streaming query over all there is, into a table of the shared folder, and read that: the windows that
    the watermark has closed."""
    spark = result.sparkSession
    out = scratch_path(spark, name)
    query = result.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, name + "-state")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(out)
