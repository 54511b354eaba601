"""Sessions, opening hours, expected grids, gaps and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Liquidity sessions as (zone, local opening hour, local closing hour), weekdays only.
SESSIONS = {"sydney": ("Australia/Sydney", 7, 16), "tokyo": ("Asia/Tokyo", 9, 18), "london": ("Europe/London", 8, 17), "new_york": ("America/New_York", 8, 17)}
# Weekly hours by asset class as (Monday-based weekday, opening second, closing second) and zone.
FX_HOURS = ([(6, 17 * 3600, 86400), *[(d, 0, 86400) for d in range(4)], (4, 0, 17 * 3600)], "America/New_York")
CRYPTO_HOURS = ([(d, 0, 86400) for d in range(7)], "Etc/UTC")
EQUITY_HOURS = ([(d, 34200, 57600) for d in range(5)], "America/New_York")


def default_hours(asset_class: str) -> tuple[list[tuple[int, int, int]], str]:
    if asset_class == "crypto":
        return CRYPTO_HOURS
    return EQUITY_HOURS if asset_class in ("stock", "index") else FX_HOURS


def _local(moment: Column, zone: str) -> Column:
    return F.from_utc_timestamp(moment, zone)


def second_of_day(moment: Column) -> Column:
    return F.hour(moment) * 3600 + F.minute(moment) * 60 + F.second(moment)


def active_sessions(moment: Column) -> Column:
    """Names of the sessions open at a UTC instant; ``off`` where none is."""
    open_now = []
    for name, (zone, opens, closes) in SESSIONS.items():
        local = _local(moment, zone)
        open_now.append(F.when((F.weekday(local) < 5) & F.hour(local).between(opens, closes - 1), F.lit(name)))
    found = F.array_compact(F.array(*open_now))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("off")))


def within_hours(moment: Column, hours: list[tuple[int, int, int]], zone: str) -> Column:
    """Whether a UTC instant lies in the weekly hours."""
    local = _local(moment, zone)
    clock, day = second_of_day(local), F.weekday(local)
    out = F.lit(False)
    for d, opens, closes in hours:
        out = out | ((day == d) & (clock >= opens) & (clock < closes))
    return out


def is_open(rows: DataFrame, hours: list[tuple[int, int, int]], zone: str, holidays: DataFrame | None = None, time: str = "event_time") -> DataFrame:
    """Rows with ``is_open``; holidays are (symbol or null, holiday_date, kind, opens_at, closes_at), seconds of day, and a symbol's own row wins."""
    local = _local(F.col(time), zone)
    rows = rows.withColumn("_open", within_hours(F.col(time), hours, zone))
    if holidays is None:
        return rows.withColumnRenamed("_open", "is_open")
    rows = rows.withColumn("_date", F.to_date(local)).withColumn("_clock", second_of_day(local))
    days = F.struct("kind", "opens_at", "closes_at")
    market = holidays.where("symbol is null").groupBy(F.col("holiday_date").alias("_date")).agg(F.max(days).alias("_m"))
    own = holidays.where("symbol is not null").groupBy("symbol", F.col("holiday_date").alias("_date")).agg(F.max(days).alias("_s"))
    both = rows.join(market, "_date", "left").join(own, ["symbol", "_date"], "left").withColumn("_h", F.coalesce("_s", "_m"))
    shut = (F.col("_h.kind") == "closed") | (F.col("_clock") >= F.col("_h.closes_at")) | (F.col("_clock") < F.col("_h.opens_at"))
    return both.withColumn("is_open", F.col("_open") & ~F.coalesce(shut, F.lit(False))).drop("_open", "_date", "_clock", "_m", "_s", "_h")


def grid(bounds: DataFrame, step: int, hours: list[tuple[int, int, int]] | None = None, zone: str = "Etc/UTC") -> DataFrame:
    """Expected bar times of (symbol, first, last): epoch-aligned, both ends included, open slots only."""
    first = F.ceil(F.unix_timestamp("first") / step) * step
    slots = bounds.select("symbol", F.explode(F.sequence(first.cast("long"), F.unix_timestamp("last").cast("long"), F.lit(step).cast("long"))).alias("_t")).select("symbol", F.timestamp_seconds("_t").alias("event_time"))
    return slots if hours is None else slots.where(within_hours(F.col("event_time"), hours, zone))


def missing_runs(bars: DataFrame, step: int, hours: list[tuple[int, int, int]] | None = None, zone: str = "Etc/UTC") -> DataFrame:
    """Runs of expected slots without a bar: (symbol, window_start, window_end, slots).

    A run is over open slots, so a weekend between two missing slots does not split it.
    """
    bounds = bars.groupBy("symbol").agg(F.min("event_time").alias("first"), F.max("event_time").alias("last"))
    w = Window.partitionBy("symbol").orderBy("event_time")
    slots = grid(bounds, step, hours, zone).withColumn("slot", F.row_number().over(w))
    gone = slots.join(bars.select("symbol", "event_time").distinct(), ["symbol", "event_time"], "left_anti")
    island = gone.withColumn("island", F.col("slot") - F.row_number().over(w))
    return island.groupBy("symbol", "island").agg(F.min("event_time").alias("window_start"), F.max("event_time").alias("window_end"), F.count(F.lit(1)).alias("slots")).drop("island")


def next_open_close(rows: DataFrame, hours: list[tuple[int, int, int]], zone: str, time: str = "at", horizon_days: int = 14, probe: int = 900) -> DataFrame:
    """The next opening and closing after each instant, on a 15-minute probe grid; null where it never changes."""
    start = (F.floor(F.unix_timestamp(time) / probe) * probe).cast("long")
    steps = F.sequence(start + probe, start + horizon_days * 86400, F.lit(probe).cast("long"))
    state = rows.withColumn("_now", within_hours(F.col(time), hours, zone)).withColumn("_p", F.explode(steps)).withColumn("_o", within_hours(F.timestamp_seconds("_p"), hours, zone))
    keys = list(rows.columns)
    return state.groupBy(*keys, "_now").agg(F.min(F.when(F.col("_o"), F.col("_p"))).alias("_a"), F.min(F.when(~F.col("_o"), F.col("_p"))).alias("_b")).select(
        *keys, F.when(~F.col("_now"), F.timestamp_seconds("_a")).alias("next_open"), F.when(F.col("_now"), F.timestamp_seconds("_b")).alias("next_close")
    )


def hours_table(spark: SparkSession) -> DataFrame:
    """Default weekly hours by asset class, as rows."""
    rows = [(c, d, o, e, zone) for c in ("forex", "crypto", "stock", "index") for hours, zone in [default_hours(c)] for d, o, e in hours]
    return spark.createDataFrame(rows, "asset_class string, weekday int, opens_at int, closes_at int, zone string")
