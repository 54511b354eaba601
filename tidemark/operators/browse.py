"""Bounded reads for pages: findings, instruments, equity curves, and the scanner's row for each instrument."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def findings(rows: DataFrame, limit: int = 200, include_resolved: bool = False, **equal) -> DataFrame:
    """Findings by window, the unresolved ones unless asked; each of ``equal`` that is not None narrows its column."""
    for name, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    if not include_resolved:
        rows = rows.where("resolved_at is null")
    return rows.orderBy("window_start", *[c for c in ("symbol", "issue") if c in rows.columns]).limit(limit)


def instruments(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Active instruments by symbol, a page of them."""
    return rows.where("is_active").orderBy("symbol").offset(offset).limit(limit)


def equity_curve(samples: DataFrame, points: int = 500, key: str = "account") -> DataFrame:
    """The newest ``points`` samples of each account, with floating = equity - balance; readers list them oldest first."""
    w = Window.partitionBy(key).orderBy(F.desc("recorded_at"))
    rows = samples.withColumn("_age", F.row_number().over(w)).where(F.col("_age") <= points).drop("_age")
    return rows.withColumn("floating", F.round(F.col("equity") - F.col("balance"), 2))


def scanner(instruments_: DataFrame, freshness: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row per instrument (symbol, asset_class): age of its data, tendency, and the profiles that exist.

    ``profiles`` has (symbol, kind, as_of, tendency, autocorrelation), the latest of
    each kind.  What was not measured is null or an empty list, never a default.
    """
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    known = profiles.groupBy("symbol").agg(pick("volatility", "as_of").alias("volatility_snapshot"), pick("structure", "tendency").alias("tendency"), pick("structure", "autocorrelation").alias("autocorrelation"), F.array_sort(F.collect_set("kind")).alias("_kinds"))
    ages = freshness.select("symbol", F.col("age_seconds").alias("data_age_seconds"))
    out = instruments_.join(ages, "symbol", "left").join(known, "symbol", "left")
    return out.withColumn("profiles_available", F.coalesce("_kinds", F.array().cast("array<string>"))).drop("_kinds")
