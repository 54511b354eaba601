"""Chunked source, resumable runs and stored tables: chunk rule, pushdown, retries, replays, checkpoints, untouched files."""

import glob
import os
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ingest_runs
from tidemark.plans import ingestion
from tidemark.sources import providers, stores

UTC = timezone.utc


def at(day, hour=0):
    return datetime(2024, 1, day, hour, tzinfo=UTC)


def hourly(spark, hours, symbol="X", close=1.0):
    rows = spark.range(hours).select(F.lit(symbol).alias("symbol"), F.timestamp_seconds(F.lit(int(at(1).timestamp())) + F.col("id") * 3600).alias("event_time"))
    return rows.withColumns({c: F.lit(close) for c in ("open", "high", "low", "close", "volume")})


def test_chunks_are_half_open_and_cover_the_window():
    found = list(providers.chunks(at(1), at(20, 5), 7))
    assert [(b - a).days for a, b in found] == [7, 7, 5] and found[0][0] == at(1) and found[-1][1] == at(20, 5)
    assert all(a[1] == b[0] for a, b in zip(found, found[1:])) and list(providers.chunks(at(2), at(2), 7)) == []
    assert len(list(providers.chunks(at(1), at(3), 0))) == 2


def test_capabilities_name_the_chunk():
    have = providers.Capabilities(timeframes=("H1",), max_days={"H1": 31}, history_start=at(1))
    assert have.chunk_days("H1", 5) == 31 and have.chunk_days("D1", 5) == 5
    assert have.as_dict()["history_start"] == "2024-01-01T00:00:00+00:00" and have.as_dict()["ticks"] is False


def test_unknown_provider_names_the_known_ones(spark):
    with pytest.raises(ValueError, match="archive"):
        providers.bar_source(spark, provider="nobody", timeframe="H1", start="2024-01-01", end="2024-01-02")


def test_partitions_follow_chunks_and_pushed_filters(spark, tmp_path):
    providers.write_archive(hourly(spark, 24 * 20).unionByName(hourly(spark, 24 * 20, "Y")), str(tmp_path), "H1")
    read = lambda: providers.bar_source(spark, root=str(tmp_path), timeframe="H1", start="2024-01-01 00:00:00", end="2024-01-21 00:00:00", max_days={"H1": 3})
    assert read().rdd.getNumPartitions() == 2 * 7
    some = read().where("symbol = 'X' and event_time >= timestamp '2024-01-05 00:00:00' and event_time < timestamp '2024-01-08 00:00:00'")
    assert some.rdd.getNumPartitions() == 1 and some.count() == 72
    assert read().where("event_time = timestamp '2024-01-05 00:00:00'").count() == 2
    assert read().where("symbol in ('Y', 'Z') and event_time <= timestamp '2024-01-01 01:00:00'").where("error is null").count() == 2
    assert read().where("event_time >= timestamp '2025-01-05 00:00:00'").count() == 0


class Flaky(providers.Provider):
    def __init__(self, failures, retry_after=None):
        self.failures, self.retry_after = failures, retry_after

    def fetch(self, symbol, timeframe, start, end):
        self.failures -= 1
        if self.failures >= 0:
            raise providers.ProviderError("busy", self.retry_after)
        return iter(())


def test_waits_grow_or_are_the_providers_own():
    chunk = providers.Chunk("X", at(1), at(2))
    for retry_after, want in ((None, [2.0, 4.0]), (7.0, [7.0, 7.0])):
        waits = []
        assert list(providers.fetched(Flaky(2, retry_after), chunk, "H1", 3, 2.0, waits.append)) == [] and waits == want
    row = list(providers.fetched(Flaky(99), chunk, "H1", 1, 0.0, lambda s: None))[0].to_pylist()[0]
    assert row["error"] == "busy" and row["attempts"] == 2 and row["event_time"] is None and row["symbol"] == "X"


def run(store, key, root, start="2024-01-01 00:00:00", end="2024-01-05 00:00:00", **more):
    seen = ingest_runs.ingest(store, key, "troubled", "H1", start, end, "2024-02-01 00:00:00", root=root, max_days={"H1": 1}, retries=1, backoff=0.0, **more)
    rows = store.runs().where(F.col("run") == key).collect()
    return seen, {r["symbol"]: (r["status"], r["fetched"], r["duplicates"], r["written"]) for r in rows}


def test_a_run_is_resumed_and_a_replay_writes_nothing(spark, tmp_path):
    root, store = str(tmp_path / "feed"), ingest_runs.Store(spark, str(tmp_path / "store"))
    providers.write_archive(hourly(spark, 48), root, "H1")
    assert run(store, "a", root, end="2024-01-03 00:00:00")[1] == {"X": ("SUCCEEDED", 48, 0, 48)}
    assert run(store, "a2", root, end="2024-01-03 00:00:00") == ({"fetched": 0, "failed_chunks": 0}, {})  # the same window is done
    assert run(store, "a", root, end="2024-01-03 00:00:00")[1] == {"X": ("SUCCEEDED", 48, 0, 48)}  # the same run again replaces its own files
    assert store.bars().count() == 48


def test_a_longer_window_reads_only_the_tail(spark, tmp_path):
    root, store = str(tmp_path / "feed"), ingest_runs.Store(spark, str(tmp_path / "store"))
    providers.write_archive(hourly(spark, 96), root, "H1")
    run(store, "a", root, end="2024-01-03 00:00:00")
    assert run(store, "b", root)[1] == {"X": ("SUCCEEDED", 49, 1, 48)}
    assert store.bars().count() == 96 and store.bars().agg(F.max("revision")).first()[0] == 1
    # A checkpoint never moves back, and a window read from its start again finds nothing new.
    assert run(store, "c", root, end="2024-01-02 12:00:00", resume=False)[1] == {"X": ("SUCCEEDED", 36, 36, 0)}
    assert store.checkpoints().first()["last_event_time"] == datetime(2024, 1, 4, 23)
    # A changed bar is a new revision.
    providers.write_archive(hourly(spark, 96, close=2.0), root, "H1")
    assert run(store, "d", root, start="2024-01-04 20:00:00")[1] == {"X": ("SUCCEEDED", 1, 0, 1)}
    assert store.bars().where("revision = 2 and close = 2.0").count() == 1


def test_what_fails_keeps_its_earlier_chunks(spark, tmp_path):
    root, store = str(tmp_path / "feed"), ingest_runs.Store(spark, str(tmp_path / "store"))
    providers.write_archive(hourly(spark, 96).unionByName(hourly(spark, 96, "Y")), root, "H1")
    seen, found = run(store, "a", root, fails={"X": "2024-01-03 00:00:00", "Y": "2024-01-01 00:00:00"})
    assert found == {"X": ("PARTIAL", 48, 0, 48), "Y": ("FAILED", 0, 0, 0)} and seen["failed_chunks"] == 6
    assert run(store, "b", root)[1] == {"X": ("SUCCEEDED", 49, 1, 48), "Y": ("SUCCEEDED", 96, 0, 96)}


def test_first_reads_go_deep_and_later_ones_refresh(spark, tmp_path):
    store = ingest_runs.Store(spark, str(tmp_path))
    rows = spark.createDataFrame([("X", datetime(2024, 1, 1)), ("Y", datetime(2024, 1, 30))], "symbol string, last_event_time timestamp")
    store.put("checkpoints", rows, "a")
    found = ingest_runs.plan_starts(store, ["X", "Y", "Z"], "M5", "2024-01-31 00:00:00")
    assert found == {"X": "2024-01-01 00:00:00", "Y": "2024-01-28 00:00:00", "Z": str(datetime(2024, 1, 31) - timedelta(days=55))}


def files_of(path, pattern):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/{pattern}/*.parquet")}


def test_recomputing_a_window_leaves_other_partitions_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = stores.with_day(hourly(spark, 96)).select("symbol", "event_time", "close", "day")
    stores.rewrite(rows, path, ["symbol", "day"])
    before = files_of(path, "symbol=X/day=2024-01-0[14]")
    inside = (F.col("event_time") >= F.lit("2024-01-02 06:00:00").cast("timestamp")) & (F.col("event_time") < F.lit("2024-01-04 00:00:00").cast("timestamp"))
    stores.replace_window(path, rows.where(inside & (F.dayofmonth("event_time") == 2)).withColumn("close", F.lit(9.0)), inside, ["symbol", "day"])
    assert files_of(path, "symbol=X/day=2024-01-0[14]") == before
    now = stores.read(spark, path, rows)
    assert now.count() == 72 and now.where("close = 9").count() == 18 and now.where("dayofmonth(event_time) = 3").count() == 0


def test_upsert_and_insert(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 1, 30)], "p string, k int, v int")
    path = str(tmp_path / "u")
    stores.upsert(path, rows, ["p", "k"], ["p"])
    before = files_of(path, "p=b")
    stores.upsert(path, spark.createDataFrame([("a", 2, 7), ("a", 2, 9), ("a", 3, 1)], rows.schema), ["p", "k"], ["p"], order="v")
    assert sorted(map(tuple, stores.read(spark, path, rows).collect())) == [("a", 1, 10), ("a", 2, 9), ("a", 3, 1), ("b", 1, 30)] and files_of(path, "p=b") == before
    path = str(tmp_path / "i")
    for batch in ("0", "1", "1", "0"):  # replayed batches
        stores.insert_absent(path, rows.where(F.col("k") <= int(batch) + 1), ["p", "k"], ["p"], batch)
        stores.insert_absent(path, rows.limit(0), ["p", "k"], ["p"], "2")
    assert spark.read.parquet(path).count() == 3


def test_periods_of_files(spark):
    frame = spark.createDataFrame([(datetime(2023, 12, 31, 23), datetime(2024, 2, 1)), (datetime(2024, 1, 1), datetime(2024, 1, 1))], "a timestamp, b timestamp")
    count = lambda t: [len(r[0]) for r in frame.select(providers.period_starts(t, F.col("a"), F.col("b"))).collect()]
    assert (count("M1"), count("H1"), count("D1")) == ([32, 0], [2, 0], [2, 0])


def test_planted_run_needs_both_tries(spark, sf):
    assert {r["attempts"] for r in ingestion.ingest_run(spark, sf).where("status = 'SUCCEEDED'").collect()} == {2}
