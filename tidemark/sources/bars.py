"""Bars derived from the event and transaction tables, and their bitemporal form.

A bar is (symbol, event_time, open, high, low, close, volume); ``event_time``
is its open, in UTC.  The bitemporal form adds ``revision`` and ``ingested_at``:
a correction is a new row, never an update.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed-grid timeframes in seconds.  W1 and MN1 follow the calendar and have no grid.
TIMEFRAME_SECONDS = {"M1": 60, "M5": 300, "M15": 900, "M30": 1800, "H1": 3600, "H4": 14400, "D1": 86400}
HOUR, WEEK = 3600, 7 * 86400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly_event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of each event type: one partial aggregation, one shuffle."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").cast("timestamp").alias("event_time")).agg(
        F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "event_id").alias("close"), F.count(F.lit(1)).cast("double").alias("volume")
    )


def weekly_supplier_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly unit-price bars of each supplier; first and last by a total order, as struct extremes (no window)."""
    px = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", px.alias("px"))
    lines = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"), F.date_trunc("week", "l_shipdate").cast("timestamp").alias("event_time"), px.alias("px"), order.alias("o"), "l_quantity")
    return lines.groupBy("symbol", "event_time").agg(F.min("o")["px"].alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max("o")["px"].alias("close"), F.sum("l_quantity").alias("volume"))


def weekly_nation_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly order-price bars of each nation."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return orders.groupBy(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("symbol"), F.date_trunc("week", "o_orderdate").cast("timestamp").alias("event_time")).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.max_by("o_totalprice", "o_orderkey").alias("close"), F.count(F.lit(1)).cast("double").alias("volume")
    )


def seconds(column: str = "event_time"):
    """Epoch seconds of a timestamp column."""
    return F.unix_timestamp(column)


def bitemporal(bars: DataFrame, delta: int = HOUR, revise_every: int = 17, revised_after: int = 48 * HOUR) -> DataFrame:
    """First revisions known one bar later, and a correction of every ``revise_every``-th bar known later still.

    The correction moves the close by one per cent.  One pass: each bar makes an array of its revisions.
    """
    late = F.pmod(F.floor(seconds() / delta), F.lit(revise_every)) == 0
    first = F.struct(F.lit(1).alias("revision"), F.timestamp_seconds(seconds() + delta).alias("ingested_at"), F.col("high").alias("high"), F.col("close").alias("close"))
    second = F.struct(F.lit(2).alias("revision"), F.timestamp_seconds(seconds() + revised_after).alias("ingested_at"), F.greatest("high", F.col("close") * 1.01).alias("high"), (F.col("close") * 1.01).alias("close"))
    rows = bars.withColumn("r", F.explode(F.when(late, F.array(first, second)).otherwise(F.array(first))))
    return rows.select("symbol", "event_time", "open", "r.high", "low", "r.close", "volume", "r.revision", "r.ingested_at")


def by_time(*keys: str) -> Window:
    """The one window order that features, outcomes and detectors share."""
    return Window.partitionBy(*(keys or ("symbol",))).orderBy("event_time")


#: Seconds whose bars are numbered together, and bars of a symbol that one window task sees (beside their context).
SPAN_SECONDS, CHUNK_ROWS = 90 * 86400, 1 << 16


def spans(time: str = "event_time") -> Column:
    """The span of time that a row is in; rows without a time are before all."""
    return F.coalesce(F.floor(F.unix_timestamp(time) / SPAN_SECONDS), F.lit(-(1 << 40))).cast("long")


def numbered(bars: DataFrame, key: str = "symbol", time: str = "event_time") -> DataFrame:
    """Bars with ``_i``, their number by time within the symbol, from 1.

    Bars are sorted span by span; where a span begins comes from a small table
    of counts, so a symbol's history is never in one task.  Bars that carry
    numbers keep them, so that several windows can share one numbering.
    """
    if "_i" in bars.columns:
        return bars
    rows = bars.withColumn("_span", spans(time))
    counts = rows.groupBy(key, "_span").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(key).orderBy("_span")) - F.col("_c")
    local = F.row_number().over(Window.partitionBy(key, "_span").orderBy(time))
    met = rows.join(counts.select(key, "_span", before.alias("_before")), [key, "_span"], "left")
    return met.withColumn("_i", F.coalesce("_before", F.lit(0)) + local).drop("_span", "_before")


def chunked(bars: DataFrame, before: int = 0, after: int = 0, key: str = "symbol", size: int | None = None) -> DataFrame:
    """Numbered bars cut into chunks for windows of bounded reach.

    Every bar is its own (``_own``) in one chunk; bars within ``before`` of the next
    chunk's beginning, or ``after`` behind the last one's end, are there as context.
    """
    size = max(size or CHUNK_ROWS, before, after, 1)
    at = F.col("_i") - 1
    home, place = F.floor(at / size).cast("long"), at % size
    where = F.array_compact(F.array(home, F.when(place >= size - before, home + 1), F.when((place < after) & (home > 0), home - 1)))
    rows = numbered(bars, key).withColumn("_chunk", F.explode(where))
    return rows.withColumn("_own", F.col("_chunk") == home)


def by_chunk(key: str = "symbol") -> Window:
    return Window.partitionBy(key, "_chunk").orderBy("event_time")


def own(rows: DataFrame) -> DataFrame:
    """Chunked rows without their context."""
    return rows.where("_own").drop("_chunk", "_own")
