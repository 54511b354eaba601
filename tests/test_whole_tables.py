"""Every row of a side table counts, whatever its number, and a table may be a file or a folder."""

from pyspark.sql import functions as F

from tidemark.operators import calendars, operations
from tidemark.streaming.ingest import event_stream


def test_all_holidays_count(spark):
    days = spark.range(100_050).select(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).alias("holiday_date"))
    holidays = days.select(F.lit(None).cast("string").alias("symbol"), "holiday_date", F.lit("closed").alias("kind"), F.lit(0).alias("opens_at"), F.lit(86400).alias("closes_at"))
    rows = days.select(F.lit("a").alias("symbol"), F.col("holiday_date").cast("timestamp").alias("event_time"))
    found = calendars.is_open(rows, *calendars.CRYPTO_HOURS, holidays=holidays)
    assert found.count() == 100_050 and found.where("is_open").count() == 0


def test_all_policies_count(spark):
    policy = spark.range(10_050).select(F.col("id").cast("string").alias("kind"), F.lit(1).alias("keep_days"))
    rows = policy.select("kind", F.lit("2020-01-01 00:00:00").cast("timestamp").alias("at"), F.lit(False).alias("protected"))
    assert operations.retention(rows, policy, "2021-01-01 00:00:00").where("removable = 1").count() == 10_050


def test_events_as_a_folder(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/data/events.parquet")
    for place, name in ((f"{tmp_path}/data", "as_folder"), (sf, "as_file")):
        event_stream(spark, place).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
        assert spark.table(name).count() == events.count() > 0
