"""Open decisions awaiting the first touch of their levels, as keyed state.

Bars and decisions are two streams, met in the state of a symbol: a map of its
open decisions.  A decision leaves the map when it is closed, so state holds
only what is open.  The decisions of one symbol are dealt over several keys,
each of which sees all of the symbol's bars: a symbol with very many decisions
is no single task's work.  Files arrive in time order; a decision arrives no
later than the bars that follow it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTCOME = "decision_id string, status string, r double, bars_to_touch long"
OPEN = "at long, side int, entry double, stop double, target double, seen int, spent boolean"
#: Keys that the decisions of one symbol are dealt over.
SALTS = 8
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocksdb(spark: SparkSession) -> str | None:
    """Keep state in RocksDB, which map state and timers need; returns the former setting."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, PROVIDER)
    return before


class FirstTouch(StatefulProcessor):
    """Closes a decision as win or loss at its first touch, or as abandoned when the horizon has passed.

    A bar that touches both levels decides nothing and ends the search; the
    decision stays open until its horizon has passed, as in the batch answer.
    """

    def __init__(self, horizon: int):
        self.horizon = horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", "decision_id string", OPEN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(rows))
        for d in given[given["decision_id"].notna()].to_dict("records"):
            self.open.updateValue((d["decision_id"],), (int(d["at"]), int(d["side"]), float(d["entry"]), float(d["stop"]), float(d["target"]), 0, False))
        bars = given[given["decision_id"].isna()].sort_values("at")
        times, high, low = (bars[c].to_numpy() for c in ("at", "high", "low"))
        closed = []
        for (ident,), (at, side, entry, stop, target, seen, spent) in list(self.open.iterator()) if len(bars) else ():
            first = int(np.searchsorted(times, at, "right"))
            last = min(len(times), first + self.horizon - seen)
            h, l = high[first:last], low[first:last]
            stopped, hit = (l <= stop, h >= target) if side > 0 else (h >= stop, l <= target)
            touched = np.flatnonzero(stopped | hit)
            if len(touched) and not spent:
                k = int(touched[0])
                if stopped[k] != hit[k]:
                    closed.append((ident, "loss" if stopped[k] else "win", -1.0 if stopped[k] else abs(target - entry) / abs(entry - stop), seen + k + 1))
                    self.open.removeKey((ident,))
                    continue
                spent = True
            seen += last - first
            if seen >= self.horizon:
                closed.append((ident, "abandoned", None, None))
                self.open.removeKey((ident,))
            elif last > first:
                self.open.updateValue((ident,), (at, side, entry, stop, target, seen, spent))
        yield pd.DataFrame(closed, columns=["decision_id", "status", "r", "bars_to_touch"]).astype({"r": "float64", "bars_to_touch": "Int64"})

    def close(self) -> None:
        pass


def resolve(bars: DataFrame, decisions: DataFrame, horizon: int = 120, salts: int = SALTS) -> DataFrame:
    """Closed decisions of a stream (decision_id, symbol, event_time, side, entry, stop, target) against a stream of bars."""
    none = lambda kind: F.lit(None).cast(kind)
    at = F.unix_micros("event_time").alias("at")
    asked = decisions.select("symbol", F.pmod(F.xxhash64("decision_id"), F.lit(salts)).cast("int").alias("salt"), F.col("decision_id").cast("string").alias("decision_id"), at, F.col("side").cast("int").alias("side"), "entry", "stop", "target", none("double").alias("high"), none("double").alias("low"))
    seen = bars.select("symbol", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), none("string").alias("decision_id"), at, none("int").alias("side"), *[none("double").alias(c) for c in ("entry", "stop", "target")], "high", "low")
    return asked.unionByName(seen).groupBy("symbol", "salt").transformWithStateInPandas(FirstTouch(horizon), outputStructType=OUTCOME, outputMode="append", timeMode="none")
