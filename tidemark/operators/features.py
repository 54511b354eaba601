"""The feature catalogue: column factories over one window.

Every feature reads one partition and order and differs only in its frame, so
any number of them costs one exchange and one sort.  Windows reach back a
bounded number of bars, so a symbol's history is cut into chunks that overlap by
as many.  A feature is null until ``lookback + 1`` bars exist.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.bars import by_chunk, chunked, own


@dataclass(frozen=True)
class Feature:
    name: str
    version: int
    lookback: int
    make: Callable[[Window], Column]


REGISTRY: dict[tuple[str, int], Feature] = {}


def feature(name: str, lookback: int, version: int = 1):
    """Register a factory; one name and version can be registered once."""

    def add(make: Callable[[Window], Column]):
        if (name, version) in REGISTRY:
            raise ValueError(f"feature {name} v{version} is already registered")
        REGISTRY[name, version] = Feature(name, version, lookback, make)
        return make

    return add


def _rows(w, before: int, after: int = 0):
    return w.rowsBetween(-before, after)


def _log_ratio(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), F.ln(a / b))


def with_steps(bars: DataFrame, w=None) -> DataFrame:
    """Bars with the previous close, log return and true range that several features share."""
    if w is None:
        return own(with_steps(chunked(bars, 1), by_chunk())).drop("_i")
    previous = F.lag("close").over(w)
    return (
        bars.withColumn("_prev", previous)
        .withColumn("_ret", _log_ratio(F.col("close"), F.col("_prev")))
        .withColumn("_tr", F.when(F.col("_prev").isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_prev")), F.abs(F.col("low") - F.col("_prev")))))
        .withColumn("_up", F.greatest(F.col("close") - F.col("_prev"), F.when(F.col("_prev").isNotNull(), 0.0)))
        .withColumn("_down", F.greatest(F.col("_prev") - F.col("close"), F.when(F.col("_prev").isNotNull(), 0.0)))
    )


@feature("return_1", 1)
def _return_1(w):
    return F.col("_ret")


@feature("return_5", 5)
def _return_5(w):
    return _log_ratio(F.col("close"), F.lag("close", 5).over(w))


@feature("sma_20", 19)
def _sma_20(w):
    return F.avg("close").over(_rows(w, 19))


@feature("ema_20", 59)
def _ema_20(w):
    """Exactly 60 closes: the mean of the oldest 20 seeds a recursion with alpha 2/21 over the other 40."""
    return F.aggregate(F.collect_list("close").over(_rows(w, 39)), F.avg("close").over(_rows(w, 59, -40)), lambda s, x: s + (x - s) * (2.0 / 21.0))


@feature("close_over_sma_20", 19)
def _close_over_sma(w):
    mean = F.avg("close").over(_rows(w, 19))
    return F.when(mean > 0, F.col("close") / mean)


@feature("atr_14", 14)
def _atr_14(w):
    return F.avg("_tr").over(_rows(w, 13))


@feature("atr_14_pct", 14)
def _atr_14_pct(w):
    return F.when(F.col("close") > 0, F.avg("_tr").over(_rows(w, 13)) / F.col("close"))


@feature("realized_vol_20", 20)
def _realized_vol(w):
    return F.when(F.count("_ret").over(_rows(w, 19)) >= 2, F.stddev_pop("_ret").over(_rows(w, 19)))


@feature("rsi_14", 14)
def _rsi(w):
    up, down = F.avg("_up").over(_rows(w, 13)), F.avg("_down").over(_rows(w, 13))
    return F.when(down == 0, F.when(up > 0, 100.0).otherwise(50.0)).otherwise(100.0 - 100.0 / (1.0 + F.try_divide(up, down)))


@feature("position_in_range_20", 19)
def _position(w):
    low, high = F.min("low").over(_rows(w, 19)), F.max("high").over(_rows(w, 19))
    return F.try_divide(F.col("close") - low, F.nullif(high - low, F.lit(0.0)))


@feature("bar_range_pct", 0)
def _range_pct(w):
    return F.when(F.col("close") > 0, (F.col("high") - F.col("low")) / F.col("close"))


@feature("body_ratio", 0)
def _body(w):
    return F.try_divide(F.abs(F.col("close") - F.col("open")), F.nullif(F.col("high") - F.col("low"), F.lit(0.0)))


def specs(names: list[str] | None = None) -> list[Feature]:
    return [f for f in REGISTRY.values() if names is None or f.name in names]


def compute(bars: DataFrame, names: list[str] | None = None, keep_steps: bool = False) -> DataFrame:
    """Bars with one column per feature; numbers that the bars carry stay."""
    picked, counted = specs(names), "_i" in bars.columns
    w = by_chunk()
    steps = with_steps(chunked(bars, 1 + max((f.lookback for f in picked), default=0)), w).withColumn("_n", F.col("_i"))
    out = own(steps.withColumns({f.name: F.when(F.col("_n") > f.lookback, f.make(w)) for f in picked}))
    out = out if counted else out.drop("_i")
    return out if keep_steps else out.drop("_prev", "_ret", "_tr", "_up", "_down", "_n")


def latest(bars: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Features of each symbol's newest bar."""
    newest = bars.groupBy("symbol").agg(F.max("event_time").alias("event_time"))
    return compute(bars, names).join(newest, ["symbol", "event_time"], "left_semi")


def materialise(bars: DataFrame, delta: int, names: list[str] | None = None, existing: DataFrame | None = None) -> DataFrame:
    """Tall values (symbol, event_time, name, feature_version, computed_at, value), without those in ``existing``.

    Recomputed values are appended as new vintages, so reads before a recompute keep their answer.
    """
    picked = specs(names)
    wide = compute(bars, names)
    cells = F.array(*[F.struct(F.lit(f.name).alias("name"), F.lit(f.version).alias("feature_version"), F.col(f.name).alias("value")) for f in picked])
    tall = wide.select("symbol", "event_time", F.timestamp_seconds(F.unix_timestamp("event_time") + delta).alias("computed_at"), F.explode(cells).alias("c")).select("symbol", "event_time", "c.name", "c.feature_version", "computed_at", "c.value").where("value is not null")
    if existing is None:
        return tall
    return tall.join(existing.select("symbol", "event_time", "name", "feature_version").distinct(), ["symbol", "event_time", "name", "feature_version"], "left_anti")


def catalogue(spark: SparkSession) -> DataFrame:
    """The registered features as rows."""
    return spark.createDataFrame([(f.name, f.version, f.lookback) for f in REGISTRY.values()], "name string, feature_version int, lookback int")
