"""Streams with keyed state against their batch answers: state at the end, timers, replays, failing rows."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import outcomes
from tidemark.plans import streams
from tidemark.sources import stores
from tidemark.sources.shared import fresh_folder
from tidemark.streaming import record, resolve, stale

START = datetime(2024, 1, 1)
HOURS = lambda k: START + timedelta(hours=k)
LEVELS = "decision_id string, symbol string, event_time timestamp, side int, entry double, stop double, target double"
# The fourth bar touches both levels of decision 4; 5 never touches; 6 begins later; 7 is a short one.
HIGHS, LOWS = [1.0, 1.05, 1.25, 1.0, 1.0, 1.0, 1.3], [1.0, 0.96, 0.99, 0.92, 1.0, 1.0, 0.7]
DECISIONS = [("1", 0, 1, 1.0, 0.9, 1.2), ("2", 0, 1, 1.0, 0.95, 1.5), ("3", 0, -1, 1.0, 1.2, 0.9), ("4", 0, 1, 1.0, 0.97, 1.02), ("5", 0, 1, 1.0, 0.1, 9.0), ("6", 5, 1, 1.0, 0.8, 1.2), ("7", 2, -1, 1.0, 1.5, 0.95)]


def bars_of(spark, highs=HIGHS, lows=LOWS):
    rows = [("X", HOURS(k), 1.0, h, l, 1.0, 1.0) for k, (h, l) in enumerate(zip(highs, lows))]
    return spark.createDataFrame(rows, "symbol string, event_time timestamp, open double, high double, low double, close double, volume double")


def decisions_of(spark):
    return spark.createDataFrame([(d, "X", HOURS(k), side, e, s, t) for d, k, side, e, s, t in DECISIONS], LEVELS)


def streamed(spark, bars, decisions, pieces, horizon=5, salts=3):
    before = resolve.with_rocksdb(spark)
    found = resolve.resolve(streams.replayed(spark, bars, "b", pieces), streams.replayed(spark, decisions, "d", pieces, like=bars), horizon, salts)
    name = fresh_folder(spark, "x")[-32:]
    run = found.writeStream.format("memory").queryName(f"t{name}").option("checkpointLocation", fresh_folder(spark, "s")).trigger(availableNow=True).start()
    run.awaitTermination()
    if before is None:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return {r["decision_id"]: (r["status"], r["r"], r["bars_to_touch"]) for r in spark.table(f"t{name}").collect()}, run.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_streamed_first_touch_equals_batch(spark):
    bars, decisions = bars_of(spark), decisions_of(spark)
    whole = {r["decision_id"]: r["status"] for r in outcomes.resolved(bars, decisions, 5).collect()}
    for pieces in (1, 3):
        closed, left = streamed(spark, bars, decisions, pieces)
        assert {d: v[0] for d, v in closed.items()} == {d: s for d, s in whole.items() if s != "open"}
        assert {d for d, s in whole.items() if s == "open"} == {"6"} and left == 1  # one bar touched both levels: it waits for its horizon
        assert closed["1"][1:] == (2.0, 2) or abs(closed["1"][1] - 2.0) < 1e-9 and closed["1"][2] == 2
        assert closed["4"] == ("abandoned", None, None) and whole["4"] == "abandoned"


def test_no_state_is_left_when_all_is_closed(spark):
    closed, left = streamed(spark, bars_of(spark, HIGHS + [1.0] * 6, LOWS + [1.0] * 6), decisions_of(spark), 4)
    assert len(closed) == len(DECISIONS) and left == 0


def silent(spark, hours, pieces):
    rows = spark.createDataFrame([(s, HOURS(h)) for s, hs in hours.items() for h in hs], "symbol string, event_time timestamp")
    before = resolve.with_rocksdb(spark)
    name = f"t{fresh_folder(spark, 'x')[-32:]}"
    stale.silences(streams.replayed(spark, rows, "h", pieces), 3600).writeStream.format("memory").queryName(name).option("checkpointLocation", fresh_folder(spark, "s")).trigger(availableNow=True).start().awaitTermination()
    if before is None:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return sorted((r["symbol"], (r["last_seen"] - START).total_seconds() / 3600, (r["stale_at"] - START).total_seconds() / 3600) for r in spark.table(name).collect())


def test_each_silence_is_reported_once(spark):
    hours = {"A": range(0, 24), "B": [0, 1, 8, 9], "C": [0, 4, 8, 12, 16, 20], "D": [3]}
    for pieces in (1, 4):
        assert silent(spark, hours, pieces) == [("B", 1, 5), ("B", 9, 13), ("D", 3, 7)]


def test_replayed_batches_add_nothing(spark):
    rows = spark.createDataFrame([("a", HOURS(k), float(k)) for k in range(6)], "account string, recorded_at timestamp, equity double")
    path = fresh_folder(spark, "equity")
    for number in (0, 1, 1, 0):
        stores.insert_absent(path, rows.where(F.hour("recorded_at") <= 3 + number), ["account", "recorded_at"], [], str(number))
    assert sorted(r["equity"] for r in stores.read(spark, path, rows).collect()) == [0.0, 1.0, 2.0, 3.0, 4.0]


def test_forward_batches_are_written_once(spark, sf):
    root = fresh_folder(spark, "forward")
    names = [f"S{k:02d}" for k in range(22)]
    rows = spark.range(22 * 90).select(F.element_at(F.array(*map(F.lit, names)), (F.col("id") % 22 + 1).cast("int")).alias("symbol"), F.timestamp_seconds(F.lit(1704067200) + F.floor(F.col("id") / 22) * 3600).alias("event_time"), (F.lit(100.0) + F.pmod(F.xxhash64("id"), F.lit(1000)) / 100).alias("close"))
    bars = stores.stored(rows.select("symbol", "event_time", F.col("close").alias("open"), (F.col("close") + 1).alias("high"), (F.col("close") - 1).alias("low"), "close", F.lit(1.0).alias("volume")), "bars")
    hour = F.floor((F.unix_timestamp("event_time") - 1704067200) / 3600)
    batches = [bars.where(hour < 84), bars.where((hour >= 84) & (hour < 87)), bars.where(hour >= 87)]
    for number in (0, 1, 1, 2, 2):
        record.record_forward(root, batches[number], number)
    kinds = "symbol string, event_time timestamp, arm string, side int, entry double, stop double, target double"
    got = spark.read.schema(kinds).parquet(f"{root}/journal").select("symbol", "event_time", "arm", "side", F.round("stop", 6).alias("stop"))
    from tidemark.operators import crosssection

    whole = record.both_arms(crosssection.tails(crosssection.stretches(bars))).select("symbol", "event_time", "arm", "side", F.round("stop", 6).alias("stop"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect())) and got.count() > 20


def test_failing_rows_are_set_aside(spark):
    rows = spark.createDataFrame([("a", "1"), ("a", "x"), ("b", None), (None, "2"), ("c", "3")], "symbol string, v string")
    swept = record.sweep(rows, {"number": F.expr("try_cast(v AS int)")}, "symbol")
    good, bad = swept.where("problem is null"), swept.where("problem is not null")
    found = {r["symbol"]: (r["done"], r["failed"], r["problem"], r["status"]) for r in record.key_status(good, bad, "symbol").collect()}
    assert found == {"a": (1, 1, "number", "partial"), "b": (0, 1, "number", "failed"), None: (0, 1, "symbol", "failed"), "c": (1, 0, None, "ok")}
