"""Bars from files: comma-separated ones by symbol and timeframe, and binary candle and tick records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Sizes of the big-endian records, and price scales in the order in which they are tried.
CANDLE_BYTES, TICK_BYTES = 24, 20
SCALES, SCALE_TOLERANCE = (1e5, 1e3, 1e2, 1e4, 1e6), 0.25
#: Columns that a CSV file may lack.
CSV_OPTIONAL = ("volume", "tick_volume", "spread")


def csv_bars(spark: SparkSession, root: str, timeframe: str, start: str, end: str) -> DataFrame:
    """Bars of ``root/<symbol>/<timeframe>.csv`` with start <= time < end.

    Files may have volume, tick_volume and spread, in any order behind the
    prices: each column is found by its name in the file's own header.  Blank
    and unreadable numbers are null, lines without a time are left out.  A
    timeframe that no symbol has is an error.  Nothing is sorted or made unique: defects
    of the source are for the quality checks.
    """
    lines = spark.read.text(f"{root}/*/{timeframe}.csv").select(F.col("_metadata.file_path").alias("file"), F.split("value", ",").alias("cells"))
    heads = lines.where(F.lower(F.trim(F.col("cells")[0])) == "time").groupBy("file").agg(F.first(F.transform("cells", lambda c: F.lower(F.trim(c)))).alias("names"))
    met = lines.join(F.broadcast(heads), "file")  # one row a file
    cell = lambda name: F.try_element_at("cells", F.nullif(F.array_position("names", F.lit(name)).cast("int"), F.lit(0)))
    symbol = F.regexp_extract("file", rf"([^/]+)/{timeframe}\.csv", 1)
    number = lambda name: F.trim(cell(name)).try_cast("double").alias(name)
    rows = met.select(symbol.alias("symbol"), F.trim(cell("time")).try_cast("timestamp").alias("event_time"), *[number(n) for n in ("open", "high", "low", "close", *CSV_OPTIONAL)], F.concat_ws(":", F.lit("csv"), symbol, F.lit(timeframe)).alias("source_ref"))
    return rows.where((F.col("event_time") >= F.lit(start).cast("timestamp")) & (F.col("event_time") < F.lit(end).cast("timestamp")))


def _unsigned(record: Column, at: int) -> Column:
    """The big-endian 32-bit number at a byte of a record."""
    return F.conv(F.hex(F.substring(record, at + 1, 4)), 16, 10).cast("long")


def _real(record: Column, at: int) -> Column:
    """The big-endian 32-bit floating-point number at a byte of a record."""
    bits = _unsigned(record, at)
    sign = F.when(F.shiftright(bits, 31) == 1, -1.0).otherwise(1.0)
    exponent, fraction = F.shiftright(bits, 23).bitwiseAND(255), bits.bitwiseAND((1 << 23) - 1)
    return sign * F.when(exponent == 0, fraction * F.lit(2.0**-149)).otherwise((1 + fraction / F.lit(2.0**23)) * F.pow(F.lit(2.0), exponent - 127))


def _records(files: DataFrame, size: int) -> DataFrame:
    """One row for each record of ``content``; a file that is no whole number of them fails the job."""
    whole = F.assert_true(F.octet_length("content") % size == 0, F.lit(f"a file is not a whole number of {size}-byte records"))
    checked = files.where(F.coalesce(whole.cast("string"), F.lit("")) == "").where(F.octet_length("content") > 0)
    starts = F.sequence(F.lit(0), F.floor(F.octet_length("content") / size).cast("int") - 1)
    each = checked.withColumn("_k", F.explode(starts))
    return each.withColumn("_record", F.substring("content", F.col("_k") * size + 1, F.lit(size))).drop("content", "_k")


def _after(start: str, milliseconds: Column) -> Column:
    return F.timestamp_millis(F.unix_millis(start) + milliseconds)


def candles(files: DataFrame) -> DataFrame:
    """Bars of (symbol, period_start, scale, content): seconds, open, close, low, high, volume; records without a price are no bars."""
    r = F.col("_record")
    rows = _records(files, CANDLE_BYTES).where(_unsigned(r, 4) != 0)
    price = {name: (_unsigned(r, at) / F.col("scale")).alias(name) for name, at in (("open", 4), ("high", 16), ("low", 12), ("close", 8))}
    return rows.select("symbol", _after("period_start", _unsigned(r, 0) * 1000).alias("event_time"), *price.values(), _real(r, 20).alias("volume"))


def ticks(files: DataFrame) -> DataFrame:
    """Quotes of (symbol, period_start, scale, content): milliseconds, ask, bid and their volumes."""
    r = F.col("_record")
    return _records(files, TICK_BYTES).select("symbol", _after("period_start", _unsigned(r, 0)).alias("event_time"), (_unsigned(r, 4) / F.col("scale")).alias("ask"), (_unsigned(r, 8) / F.col("scale")).alias("bid"), _real(r, 12).alias("ask_volume"), _real(r, 16).alias("bid_volume"))


def price_scale(raw: Column, reference: Column) -> Column:
    """The first scale that brings a raw price within a quarter of a known one; null where none does."""
    out = F.lit(None).cast("double")
    for scale in reversed(SCALES):
        out = F.when(F.abs(raw / scale - reference) / reference <= SCALE_TOLERANCE, scale).otherwise(out)
    return F.when((raw > 0) & (reference > 0), out)
