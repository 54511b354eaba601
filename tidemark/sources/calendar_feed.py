"""The economic calendar: an XML feed of releases, its clock, and whether that clock has moved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Timed releases that a doubt needs, hours of the day that a real week covers, and offsets of the places shown.
LEAST_TIMED, LEAST_HOURS = 20, 6
PLACES = {"Chicago": -5.0, "New York": -4.0, "UTC": 0.0, "London": 1.0, "Frankfurt": 2.0, "Tehran": 3.5, "Tokyo": 9.0, "Sydney": 10.0, "Wellington": 12.0}
_FIELDS = "title string, country string, date string, time string, impact string, forecast string, previous string, url string"


def release_time(date: Column, clock: Column) -> Column:
    """``08-16-2026`` and ``10:30pm`` as an instant; null for a date or clock of another form, such as All Day."""
    day = lambda k: F.try_element_at(F.regexp_extract_all(F.trim(date), F.lit(r"^(\d{1,2})-(\d{1,2})-(\d{4})$"), F.lit(k)), F.lit(1)).cast("int")
    plain = F.regexp_replace(F.lower(clock), r"\s", "")
    part = lambda k: F.try_element_at(F.regexp_extract_all(plain, F.lit(r"^(\d{1,2}):(\d{2})(am|pm)$"), F.lit(k)), F.lit(1))
    hour = part(1).cast("int")
    return F.when(hour.between(1, 12), F.try_make_timestamp(day(3), day(1), day(2), hour % 12 + F.when(part(3) == "pm", 12).otherwise(0), part(2).cast("int"), F.lit(0).cast("decimal(16,6)")))


def releases(spark: SparkSession, path: str) -> DataFrame:
    """Releases of XML files of ``<event>`` elements; those without a title are left out, empty fields are null.

    ``at`` is null for entries without a clock; readers list those last.
    """
    rows = spark.read.format("xml").option("rowTag", "event").schema(_FIELDS).load(path)
    text = {name: F.trim(F.coalesce(F.col(name), F.lit(""))) for name in rows.columns}
    some = lambda name: F.when(text[name] != "", text[name])
    at = release_time(text["date"], text["time"])
    out = rows.select(at.alias("at"), text["title"].alias("title"), F.upper(text["country"]).alias("currency"), F.coalesce(some("impact"), F.lit("Low")).alias("impact"), some("forecast").alias("forecast"), some("previous").alias("previous"), some("url").alias("url"))
    return out.where("title <> ''").withColumn("all_day", F.col("at").isNull())


def clock_doubts(found: DataFrame, *keys: str) -> DataFrame:
    """Timed releases and distinct hours by ``keys``; doubtful where at least 20 fall into fewer than 6 hours of the day."""
    out = found.groupBy(*keys).agg(F.count("at").alias("timed"), F.count_distinct(F.hour("at")).alias("hours"))
    return out.withColumn("doubtful", (F.col("timed") >= LEAST_TIMED) & (F.col("hours") < LEAST_HOURS))


def local_times(moment: Column, broker_offset: Column | None = None) -> Column:
    """The instant at each place, from west to east, at fixed offsets in hours; the broker's server only where its offset is known."""
    local = lambda hours: F.date_format(F.timestamp_seconds(F.unix_timestamp(moment) + (hours * 3600).cast("long")), "yyyy-MM-dd HH:mm")
    entry = lambda name, hours: F.struct(hours.cast("double").alias("offset"), F.lit(name).alias("name"), local(hours).alias("local"))
    known = [entry(n, F.lit(h)) for n, h in PLACES.items()]
    broker = [] if broker_offset is None else [F.when(broker_offset.isNotNull(), entry("Broker server", broker_offset))]
    return F.array_sort(F.array_compact(F.array(*known, *broker)))
