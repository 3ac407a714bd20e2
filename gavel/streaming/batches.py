"""Streaming forms of the scheduled batches: everything that is there now, then stop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet folder, or a single file, as a stream.

    A stream watches folders, so a single file is its folder filtered by the file's name.
    """
    path = path.rstrip("/")
    folder, _, name = path.rpartition("/")
    found = spark.read.schema(schema).parquet(path).inputFiles()
    if len(found) == 1 and found[0].endswith(f"/{name}"):
        return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return spark.readStream.schema(schema).parquet(path)


def window_counts(events: DataFrame, at: str, key: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events per key and window that the watermark has closed."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    counted = timed.groupBy(F.window(at, width), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), key, "n")


def first_seen(rows: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """The first row of each key; keys are forgotten once the watermark has passed them."""
    timed = rows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.dropDuplicatesWithinWatermark(keys)


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; a rerun goes on where this one ended."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def each_batch(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand every micro-batch that is available to ``apply``, as for upserts into a store."""
    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
