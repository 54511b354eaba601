"""Point-in-time laws: nothing from after the cutoff counts, and streams equal batches."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import asof, outcomes
from tidemark.sources import bars as B
from tidemark.sources.shared import fresh_folder

START = datetime(2024, 3, 4)
BAR = "symbol string, event_time timestamp, open double, high double, low double, close double, volume double"


def series(spark, highs, lows, symbol="X"):
    return spark.createDataFrame([(symbol, START + timedelta(hours=i), 1.0, h, w, 1.0, 1.0) for i, (h, w) in enumerate(zip(highs, lows, strict=True))], BAR)


def test_later_knowledge_changes_nothing(spark, sf):
    cutoff = "2024-01-10 00:00:00"
    bars = B.bitemporal(B.hourly_event_bars(spark, sf))
    future = bars.where(F.col("ingested_at") > F.lit(cutoff).cast("timestamp")).withColumn("close", F.col("close") * 99).withColumn("revision", F.col("revision") + 7)
    seen, again = (sorted(map(str, asof.bars_asof(b, cutoff, B.HOUR).collect())) for b in (bars, bars.unionByName(future)))
    assert seen and seen == again


def test_newest_known_revision(spark):
    rows = [("X", START, r, START + timedelta(hours=h), c) for r, h, c in ((1, 1, 1.0), (2, 5, 2.0), (3, 50, 3.0))]
    bars = spark.createDataFrame(rows, "symbol string, event_time timestamp, revision int, ingested_at timestamp, close double")
    for at, close in ((2, 1.0), (6, 2.0), (60, 3.0)):
        assert [r["close"] for r in asof.bars_asof(bars, str(START + timedelta(hours=at)), B.HOUR).collect()] == [close]
    assert asof.bars_asof(bars, str(START), B.HOUR).count() == 0


def test_lookahead_guard_fails(spark):
    bars = spark.createDataFrame([("X", START)], "symbol string, event_time timestamp")
    with pytest.raises(Exception, match="after the cutoff"):
        asof.no_lookahead(bars, str(START), B.HOUR).collect()


def test_asof_join_takes_same_instant_and_keeps_unmatched(spark):
    left = spark.createDataFrame([("a", START, 1), ("a", START - timedelta(hours=1), 2), ("b", START, 3)], "k string, t timestamp, id int")
    right = spark.createDataFrame([("a", START, 7), ("a", START + timedelta(hours=1), 8)], "k string, t timestamp, v int")
    assert {(r["id"], r["v"]) for r in asof.asof_join(left, right, "k", "t", ["v"]).collect()} == {(1, 7), (2, None), (3, None)}


def test_chunks_change_nothing(spark, sf, monkeypatch):
    from tidemark.operators import crosssection, features

    bars = B.hourly_event_bars(spark, sf).cache()
    decisions = bars.select("symbol", "event_time", F.lit(1).alias("side"), F.col("close").alias("entry"), (F.col("close") * 0.8).alias("stop"), (F.col("close") * 1.3).alias("target"))
    make = [lambda: features.compute(bars), lambda: features.with_steps(bars), lambda: outcomes.forward(bars, 6), lambda: crosssection.stretches(bars, 20), lambda: outcomes.resolved(bars, decisions, 9)]
    rounded = lambda df: df.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in df.dtypes])
    whole = [sorted(map(str, rounded(f()).collect())) for f in make]
    monkeypatch.setattr(B, "CHUNK_ROWS", 64)
    monkeypatch.setattr(B, "SPAN_SECONDS", 86400)
    for before, f in zip(whole, make, strict=True):
        assert before == sorted(map(str, rounded(f()).collect())) != []
    left = bars.select("symbol", "event_time", F.col("close").alias("mine"))
    right = bars.where(F.hour("event_time") % 7 == 0).select("symbol", "event_time", "close")
    small = asof.asof_join(left, right, "symbol", "event_time", ["close"])
    got = sorted(map(str, small.collect()))
    monkeypatch.setattr(B, "SPAN_SECONDS", 1 << 40)
    assert got == sorted(map(str, asof.asof_join(left, right, "symbol", "event_time", ["close"]).collect()))


DECISIONS = [(1, 1, 1.0, 0.9, 1.2, "win"), (2, 1, 1.0, 0.95, 1.5, "loss"), (3, -1, 1.0, 1.2, 0.9, "loss"), (4, 1, 1.0, 0.97, 1.02, "abandoned"), (5, 1, 1.0, 0.1, 9.0, "abandoned")]
HIGHS, LOWS = [1.0, 1.05, 1.25, 1.0, 1.0, 1.0], [1.0, 0.96, 0.99, 0.92, 1.0, 1.0]


def test_first_touch_by_hand(spark):
    bars = series(spark, HIGHS, LOWS)
    rows = [(i, "X", START, s, e, x, t) for i, s, e, x, t, _ in DECISIONS]
    decisions = spark.createDataFrame(rows, "decision_id int, symbol string, event_time timestamp, side int, entry double, stop double, target double")
    found = {r["decision_id"]: r["status"] for r in outcomes.resolved(bars, decisions, 5).collect()}
    assert found == {d[0]: d[5] for d in DECISIONS}


def test_fingerprint_ignores_volatile_parts(spark):
    rows = spark.createDataFrame([("Failed after 12ms at 2024-01-01 10:00:00",), ("failed  after 15ms at 2024-02-01 11:30:00",), ("other",)], "m string")
    keys = [r[0] for r in rows.select(text.fingerprint(F.lit("s"), F.col("m"))).collect()]
    assert keys[0] == keys[1] != keys[2]
    apart = spark.createDataFrame([("abc1234",), ("abc5678",), ("port 8080",), ("port 9090",), ("code 42",), ("code 43",)], "m string")
    keys = [r[0] for r in apart.select(text.fingerprint(F.lit("s"), F.col("m"))).collect()]
    assert keys[0] != keys[1] and keys[2] == keys[3] and keys[4] != keys[5]


SYMBOLS = {
    "EURUSD": "EURUSD", "eurusd": "EURUSD", "EURUSD.m": "EURUSD", "EURUSD-ECN": "EURUSD", "EURUSD_micro": "EURUSD", "XAUUSD#": "XAUUSD", "BTC/USD": "BTCUSD", "USDINR": "USDINR", "USDZAR": "USDZAR",
    "USDIDR": "USDIDR", "EURCZK": "EURCZK", "USDMYR": "USDMYR", "EURUSDm": "EURUSD", "USDINR.m": "USDINR", "USDZAR-ECN": "USDZAR", "EURUSD.pro.raw.m": "EURUSD", "US500": "US500", "GBPUSDcent": "GBPUSD", "": "",
}
CLASSES = {"EURUSD": ("forex", "EUR", "USD"), "XAUUSD": ("metal", "XAU", "USD"), "BTCUSD": ("crypto", "BTC", "USD"), "BTCUSDT": ("crypto", "BTC", "USDT"), "US500": ("other", None, None), "USDHUF": ("forex", "USD", "HUF"), "DOGEUSD": ("crypto", "DOGE", "USD")}


def test_symbols(spark):
    rows = spark.createDataFrame([(s,) for s in SYMBOLS], "raw string")
    assert {r[0]: r[1] for r in rows.select("raw", text.canonical_symbol(F.col("raw"))).collect()} == SYMBOLS
    rows = spark.createDataFrame([(s,) for s in CLASSES], "symbol string").select("symbol", text.classified(F.col("symbol")).alias("c")).select("symbol", "c.*")
    assert {r[0]: tuple(r)[1:] for r in rows.collect()} == CLASSES
