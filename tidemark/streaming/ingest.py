"""Incremental bars: a stream of events becomes append-only bar revisions.

Each micro-batch updates the hourly aggregates it touched and writes their new
values as revisions in a folder of its own.  A replayed batch overwrites its
folder, so every revision is stored exactly once; readers take the newest
revision of a bar, as every other as-of read does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.asof import newest
from ..sources.bars import table
from ..sources.shared import fresh_folder

#: How late an event may arrive and still change its bar.
LATENESS = "2 days"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files: one file of its name, or all part files of its folder."""
    events = table(spark, sf_dir, "events")
    if not any(f.endswith("/events.parquet") for f in events.inputFiles()):
        return spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet")
    return spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(sf_dir)


def event_bars(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Hourly bars of each event type under a watermark; state holds only the hours still open."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    bars = timed.groupBy(F.window("ts", "1 hour").alias("w"), F.col("event_type").alias("symbol")).agg(
        F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "event_id").alias("close"), F.count(F.lit(1)).cast("double").alias("volume")
    )
    return bars.select("symbol", F.col("w.start").alias("event_time"), "open", "high", "low", "close", "volume")


def append_revisions(bars: DataFrame, store: str, checkpoint: str) -> None:
    """Run the stream over all input at hand; batch n writes its bars as revision n + 1."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("revision", F.lit(number + 1)).write.mode("overwrite").parquet(f"{store}/batch={number}")

    bars.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def stored_bars(spark: SparkSession, store: str) -> DataFrame:
    """The newest revision of every bar in the store."""
    rows = spark.read.option("basePath", store).parquet(f"{store}/batch=*").drop("batch")
    return newest(rows, ["symbol", "event_time"], "revision").drop("revision")


def streamed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events to bars through the stream, then read back."""
    store = fresh_folder(spark, "bars")
    append_revisions(event_bars(event_stream(spark, sf_dir)), store, fresh_folder(spark, "bars-state"))
    return stored_bars(spark, store)
