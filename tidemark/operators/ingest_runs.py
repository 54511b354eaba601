"""Ingestion runs: what a provider answered becomes new revisions, counters, a status and a checkpoint for each symbol.

A store is a folder with ``bars``, ``runs`` and ``checkpoints``, each appended
by run.  A run that is repeated under its name, because it was cut short, starts
from what other runs left and replaces its own files: nothing is stored twice or lost.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources import providers, stores
from .asof import newest
from .operations import revisions

VALUES = ("open", "high", "low", "close", "volume", "tick_volume")
STORED = "symbol string, event_time timestamp, open double, high double, low double, close double, volume double, tick_volume double, spread double, source_ref string, ingested_at timestamp, revision int, run string"
RUN = "symbol string, status string, fetched long, rejected long, duplicates long, written long, attempts int, error string, requested_start timestamp, requested_end timestamp, effective_start timestamp, window string, run string"
CHECKPOINT = "symbol string, last_event_time timestamp, run string"


def window_key(provider: str, timeframe: str, start: str, end: str) -> str:
    """What names a request of all symbols, whichever run makes it."""
    return hashlib.sha256(f"{provider}|{timeframe}|{start}|{end}".encode()).hexdigest()


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _table(self, name: str, schema: str) -> DataFrame:
        return stores.read(self.spark, f"{self.root}/{name}", self.spark.createDataFrame([], schema))

    def bars(self) -> DataFrame:
        return self._table("bars", STORED)

    def runs(self) -> DataFrame:
        return self._table("runs", RUN)

    def checkpoints(self, but: str | None = None) -> DataFrame:
        """The newest event time of each symbol, without what run ``but`` reached; a checkpoint never moves back."""
        rows = self._table("checkpoints", CHECKPOINT).where(F.lit(but).isNull() | (F.col("run") != but))
        return rows.groupBy("symbol").agg(F.max("last_event_time").alias("last_event_time"))

    def put(self, name: str, rows: DataFrame, run: str) -> None:
        stores.rewrite(rows.withColumn("run", F.lit(run)), f"{self.root}/{name}", ["run"])


def plan_starts(store: Store, symbols: list[str], timeframe: str, end: str) -> dict[str, str]:
    """First instant to ask of each symbol: its timeframe's depth on the first run, the last days or its checkpoint later, whichever is earlier."""
    last = {r["symbol"]: r["at"] for r in store.checkpoints().select("symbol", F.date_format("last_event_time", "yyyy-MM-dd HH:mm:ss").alias("at")).collect()}
    until = providers.moment(end)
    days = lambda n: (until - providers.timedelta(days=n)).isoformat(sep=" ", timespec="seconds")[:19]
    depth = providers.BACKFILL_DAYS.get(timeframe, providers.OTHER_BACKFILL_DAYS)
    return {s: min(last[s], days(providers.REFRESH_DAYS)) if s in last else days(depth) for s in symbols}


def ingest(store: Store, run: str, provider: str, timeframe: str, start: str, end: str, now: str, resume: bool = True, starts: dict[str, str] | None = None, **options) -> dict[str, int]:
    """Fetch a window through the chunked source and append what is new; returns the counters of the whole run.

    Symbols that a former run of the same window has brought to an end are not
    asked again.  With ``resume`` a symbol is read from its newest stored bar
    on, which is fetched again because providers revise it.  A chunk that fails
    ends its symbol there: earlier chunks are kept (PARTIAL), else it has FAILED.
    Bars without a time or with a price at or below zero are rejected, repeats
    and unchanged bars counted as duplicates.  One row a symbol comes to the
    driver, for the request.
    """
    spark = store.spark
    window = window_key(provider, timeframe, start, end)
    done = store.runs().where((F.col("window") == window) & (F.col("status") == "SUCCEEDED") & (F.col("run") != run))
    finished = {r["symbol"] for r in done.select("symbol").distinct().collect()}
    source = providers.open_provider(providers.adapter_name(provider), providers.as_options(options))
    symbols = [s for s in source.list_symbols() if s not in finished]
    first = dict(starts or {})
    if resume and starts is None:
        last = store.checkpoints(but=run).select("symbol", F.date_format("last_event_time", "yyyy-MM-dd HH:mm:ss").alias("at"))
        first = {r["symbol"]: max(start, r["at"]) for r in last.collect()}
    asked = spark.createDataFrame([(s, first.get(s, start)) for s in symbols], "symbol string, at string").select("symbol", F.col("at").cast("timestamp").alias("effective_start"))
    seen = Observation(f"ingest-{run}")
    rows = providers.bar_source(spark, provider=provider, timeframe=timeframe, start=min([start, *first.values()]) if starts else start, end=end, symbols=symbols, starts=first, **options)
    rows = rows.observe(seen, F.count_if(F.col("error").isNull()).alias("fetched"), F.count_if(F.col("error").isNotNull()).alias("failed_chunks"))
    rows = stores.stored(rows, "fetched")
    # A provider is asked in order of time: what lies behind a failed chunk was never reached.
    failed = rows.where("error is not null").groupBy("symbol").agg(F.min("chunk_start").alias("_cut"), F.min_by("error", "chunk_start").alias("error"), F.max("attempts").alias("_tries"))
    reached = rows.where("error is null").join(F.broadcast(failed.select("symbol", "_cut")), "symbol", "left").where("_cut is null or chunk_start < _cut")
    usable = F.col("event_time").isNotNull() & F.coalesce(F.least("open", "high", "low", "close") > 0, F.lit(False))
    counts = reached.groupBy("symbol").agg(F.count(F.lit(1)).alias("fetched"), F.count_if(~usable).alias("rejected"), F.max(F.when(usable, F.col("event_time"))).alias("last_event_time"), F.max("attempts").alias("attempts"))
    good = reached.where(usable).withColumn("arrival", F.struct("chunk_start", *[F.coalesce(c, F.lit(float("-inf"))) for c in (*VALUES, "spread")]))
    others = store.bars().where(F.col("run") != run)
    held = newest(others.where((F.col("event_time") >= F.lit(start).cast("timestamp")) & (F.col("event_time") < F.lit(end).cast("timestamp"))).select("symbol", "event_time", "revision", *VALUES), ["symbol", "event_time"], "revision")
    fresh = revisions(good.select("symbol", "event_time", *VALUES, "spread", "source_ref", "arrival"), held, values=VALUES).drop("arrival")
    store.put("bars", fresh.withColumn("ingested_at", F.lit(now).cast("timestamp")).select(*[c.split()[0] for c in STORED.split(", ")][:-1]), run)
    wrote = store.bars().where(F.col("run") == run).groupBy("symbol").agg(F.count(F.lit(1)).alias("written"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    status = asked.join(counts, "symbol", "left").join(wrote, "symbol", "left").join(failed, "symbol", "left").withColumn("written", zero("written"))
    named = F.when(F.col("error").isNull(), "SUCCEEDED").when(F.col("written") > 0, "PARTIAL").otherwise("FAILED")
    status = status.select("symbol", named.alias("status"), zero("fetched"), zero("rejected"), (F.coalesce("fetched", F.lit(0)) - F.coalesce("rejected", F.lit(0)) - F.col("written")).cast("long").alias("duplicates"), "written", F.greatest("attempts", "_tries").alias("attempts"), "error", F.lit(start).cast("timestamp").alias("requested_start"), F.lit(end).cast("timestamp").alias("requested_end"), "effective_start", F.lit(window).alias("window"))
    store.put("runs", status, run)
    store.put("checkpoints", counts.where("last_event_time is not null").select("symbol", "last_event_time"), run)
    return seen.get
