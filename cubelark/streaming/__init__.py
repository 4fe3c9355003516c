"""Reductions and calendar bins over arriving slabs, as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubelark.functions.calendar import cycle_bin
from cubelark.operators.reduce import aggregate


def slabs(spark: SparkSession, path: str, schema, files_per_batch: int = 64) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed(stream: DataFrame, value: str, operation: str = "average", time: str = "t", window: str = "1 hour", slide: str | None = None, late: str = "0 seconds", keys: tuple[str, ...] = ()) -> DataFrame:
    """A reduction by window of time; rows later than the watermark are dropped, state of closed windows too."""
    stream = stream.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", late)
    span = F.window("_time", window, slide) if slide else F.window("_time", window)
    found = stream.groupBy(span.alias("window"), *keys).agg(aggregate(operation, F.col(value)).alias(value))
    return found.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, value)


def cycles(stream: DataFrame, value: str, operation: str = "average", time: str = "t", cycle: str = "hour", keys: tuple[str, ...] = ()) -> DataFrame:
    """A running reduction by place in a calendar cycle; state is bounded by the cycle and keys (output mode complete or update)."""
    return stream.groupBy(cycle_bin(F.col(time), cycle).alias("bin"), *keys).agg(aggregate(operation, F.col(value)).alias(value))
