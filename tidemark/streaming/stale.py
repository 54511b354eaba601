"""Feeds that have fallen silent: a timer of each key fires when the watermark passes the last bar by too much."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STALE = "symbol string, last_seen timestamp, stale_at timestamp"


class Silence(StatefulProcessor):
    """Reports each silence once: from the gap itself where the next bar is at hand, else when the timer expires."""

    def __init__(self, patience_ms: int):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, reported boolean")

    def rows(self, symbol: str, last: list[int]) -> pd.DataFrame:
        seen = np.array(last, "int64")
        return pd.DataFrame({"symbol": np.array([symbol] * len(last), "object"), "last_seen": seen.astype("datetime64[ms]"), "stale_at": (seen + self.patience).astype("datetime64[ms]")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = np.unique(np.concatenate([frame["at"].to_numpy() for frame in rows]))
        at, reported = self.last.get() if self.last.exists() else (None, False)
        if at is not None:
            times = np.concatenate([[at], times[times > at]])
        silent = times[:-1][np.diff(times) > self.patience].tolist()
        if reported and silent and silent[0] == at:
            silent = silent[1:]
        if at is None or len(times) > 1:
            if at is not None and not reported:  # else it has none
                self.handle.deleteTimer(at + self.patience)
            self.last.update((int(times[-1]), False))
            self.handle.registerTimer(int(times[-1]) + self.patience)
        if silent:
            yield self.rows(key[0], silent)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, _ = self.last.get()
        self.last.update((at, True))
        yield self.rows(key[0], [at])

    def close(self) -> None:
        pass


def silences(bars: DataFrame, delta: int, stale_after: int = 3, lateness: str = "30 minutes") -> DataFrame:
    """(symbol, last_seen, stale_at) of a stream (symbol, event_time): no bar for ``stale_after`` bars beyond the last one's close.

    State is one row a symbol; a row that comes behind the newest of its symbol changes nothing.
    """
    timed = bars.select("symbol", "event_time").withWatermark("event_time", lateness).withColumn("at", F.unix_millis("event_time"))
    return timed.groupBy("symbol").transformWithStateInPandas(Silence((1 + stale_after) * delta * 1000), outputStructType=STALE, outputMode="append", timeMode="eventTime")
