"""Data-quality detectors over raw bars, findings and dataset scores.

Detectors read raw input, before any normalising, so that each of them can
fire.  All row-wise ones come from one pass: a bar makes an array of its
issues.  A finding is (symbol, issue, severity, window_start, window_end, affected_rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import calendars

# Penalty of a finding by severity, and thresholds of the statistical detectors.
SEVERITY_WEIGHT = {"info": 0, "warning": 1, "error": 4, "critical": 20}
PRICE_GAP_Z, RANGE_Z, VOLUME_Z, LEAST_ROWS = 8.0, 12.0, 10.0, 30
CONFLICT_TOLERANCE, STALE_AFTER_BARS, ELIGIBLE_SCORE = 0.002, 3, 0.80
FINDING = ["symbol", "issue", "severity", "window_start", "window_end", "affected_rows"]


def _issue(condition: Column, issue: str, severity: str) -> Column:
    return F.when(condition, F.struct(F.lit(issue).alias("issue"), F.lit(severity).alias("severity")))


def structure(bars: DataFrame) -> DataFrame:
    """Prices, relations, volume and spread that cannot be; a bar with a non-positive price has only that finding."""
    ok = F.least("open", "high", "low", "close") > 0
    spread = F.col("spread") if "spread" in bars.columns else F.lit(None).cast("double")
    issues = F.array(
        _issue(~ok, "non_positive_price", "critical"),
        _issue(ok & ((F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close"))), "invalid_ohlc_relation", "error"),
        _issue(ok & (F.col("high") < F.col("low")), "invalid_ohlc_relation", "critical"),
        _issue(ok & (F.col("volume") < 0), "abnormal_volume", "error"),
        _issue(ok & (spread < 0), "abnormal_spread", "error"),
        _issue(F.col("event_time").isNull(), "invalid_timestamp", "critical"),
    )
    return bars.select("symbol", "event_time", F.explode(F.array_compact(issues)).alias("i")).select("symbol", F.col("i.issue").alias("issue"), F.col("i.severity").alias("severity"), F.col("event_time").alias("window_start"), F.col("event_time").alias("window_end"), F.lit(1).cast("long").alias("affected_rows"))


def duplicates(bars: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Second and later bars of one time, in order of arrival."""
    w = Window.partitionBy("symbol", "event_time").orderBy(arrival)
    again = bars.withColumn("_k", F.row_number().over(w)).where("_k > 1")
    return again.select("symbol", F.lit("duplicate_bar").alias("issue"), F.lit("error").alias("severity"), F.col("event_time").alias("window_start"), F.col("event_time").alias("window_end"), F.lit(1).cast("long").alias("affected_rows"))


def disorder(bars: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Bars that arrived after a later one."""
    w = Window.partitionBy("symbol").orderBy(arrival)
    late = bars.withColumn("_before", F.lag("event_time").over(w)).where("event_time < _before")
    return late.select("symbol", F.lit("non_monotonic").alias("issue"), F.lit("warning").alias("severity"), F.col("event_time").alias("window_start"), F.col("event_time").alias("window_end"), F.lit(1).cast("long").alias("affected_rows"))


def misaligned(bars: DataFrame, step: int) -> DataFrame:
    """Bars off the epoch grid."""
    off = bars.where(F.pmod(F.unix_timestamp("event_time"), F.lit(step)) != 0)
    return off.select("symbol", F.lit("session_mismatch").alias("issue"), F.lit("warning").alias("severity"), F.col("event_time").alias("window_start"), F.col("event_time").alias("window_end"), F.lit(1).cast("long").alias("affected_rows"))


def gaps(bars: DataFrame, step: int) -> DataFrame:
    """Gaps by the distance to the previous bar; only information where they span a weekend day."""
    w = Window.partitionBy("symbol").orderBy("event_time")
    seconds = F.unix_timestamp("event_time") - F.unix_timestamp("_before")
    rows = bars.select("symbol", "event_time").distinct().withColumn("_before", F.lag("event_time").over(w)).withColumn("slots", F.floor(seconds / step)).where("slots > 1")
    days = F.sequence(F.to_date(F.timestamp_seconds(F.unix_timestamp("_before") + step)), F.to_date(F.timestamp_seconds(F.unix_timestamp("event_time") - step)))
    weekend = F.exists(days, lambda d: F.weekday(d) >= 5)
    return rows.select("symbol", F.lit("missing_candle").alias("issue"), F.when(weekend, "info").otherwise("warning").alias("severity"), F.timestamp_seconds(F.unix_timestamp("_before") + step).alias("window_start"), F.timestamp_seconds(F.unix_timestamp("event_time") - step).alias("window_end"), (F.col("slots") - 1).alias("affected_rows"))


def calendar_gaps(bars: DataFrame, step: int, hours, zone: str) -> DataFrame:
    """Runs of open slots without a bar."""
    return calendars.missing_runs(bars, step, hours, zone).select("symbol", F.lit("missing_candle").alias("issue"), F.lit("warning").alias("severity"), "window_start", "window_end", F.col("slots").alias("affected_rows"))


def off_hours(bars: DataFrame, hours, zone: str) -> DataFrame:
    """One finding per symbol that sums up its bars outside the hours."""
    out = bars.where(~calendars.within_hours(F.col("event_time"), hours, zone))
    return out.groupBy("symbol").agg(F.min("event_time").alias("window_start"), F.max("event_time").alias("window_end"), F.count(F.lit(1)).alias("affected_rows")).select("symbol", F.lit("session_mismatch").alias("issue"), F.lit("warning").alias("severity"), "window_start", "window_end", "affected_rows")


def outliers(bars: DataFrame) -> DataFrame:
    """Opening gaps, ranges and volumes far from their symbol's mean, in population deviations; needs 30 values."""
    w, whole = Window.partitionBy("symbol").orderBy("event_time"), Window.partitionBy("symbol")
    previous = F.lag("close").over(w)
    rows = bars.select("symbol", "event_time", F.when(previous > 0, (F.col("open") - previous) / previous).alias("gap"), (F.col("high") - F.col("low")).alias("range"), F.col("volume").alias("vol"))
    for c in ("gap", "range", "vol"):
        deviation = F.stddev_pop(c).over(whole)
        rows = rows.withColumn(f"z_{c}", F.when((F.count(c).over(whole) >= LEAST_ROWS) & (deviation > 0), (F.col(c) - F.avg(c).over(whole)) / deviation))
    issues = F.array(_issue(F.abs("z_gap") > PRICE_GAP_Z, "price_gap", "warning"), _issue(F.col("z_range") > RANGE_Z, "outlier", "warning"), _issue(F.col("z_vol") > VOLUME_Z, "abnormal_volume", "info"))
    return rows.select("symbol", "event_time", F.explode(F.array_compact(issues)).alias("i")).select("symbol", "i.issue", "i.severity", F.col("event_time").alias("window_start"), F.col("event_time").alias("window_end"), F.lit(1).cast("long").alias("affected_rows"))


def conflicts(bars: DataFrame, provider: str = "provider", tolerance: float = CONFLICT_TOLERANCE) -> DataFrame:
    """Closes that differ between providers, at the times all providers of a symbol share; no self-join."""
    total = bars.select("symbol", provider).distinct().groupBy("symbol").agg(F.count(F.lit(1)).alias("_all"))
    each = bars.groupBy("symbol", "event_time").agg(F.count_distinct(provider).alias("_k"), F.min("close").alias("low_close"), F.max("close").alias("high_close"))
    return each.join(total, "symbol").where((F.col("_k") == F.col("_all")) & (F.col("_all") > 1) & (F.col("low_close") > 0)).withColumn("divergence", (F.col("high_close") - F.col("low_close")) / F.col("low_close")).where(F.col("divergence") > tolerance).select("symbol", "event_time", "divergence")


def latest_findings(findings: DataFrame) -> DataFrame:
    """The last detected finding of each key."""
    keys = ["symbol", "issue", "window_start"]
    rest = [c for c in findings.columns if c not in keys]
    return findings.groupBy(*keys).agg(F.max_by(F.struct(*rest), "detected_at").alias("_b")).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def penalty() -> Column:
    weight = F.lit(0)
    for severity, w in SEVERITY_WEIGHT.items():
        weight = F.when(F.col("severity") == severity, w).otherwise(weight)
    return weight * F.col("affected_rows")


def scores(bars: DataFrame, findings: DataFrame) -> DataFrame:
    """Score and eligibility of each symbol's data: 1 - penalty / bars, between 0 and 1; 0 without bars."""
    stored = bars.groupBy("symbol").agg(F.count_distinct("event_time").alias("bars"), F.min("event_time").alias("first"), F.max("event_time").alias("last"))
    open_ = findings.groupBy("symbol").agg(F.sum(penalty()).alias("penalty"), F.count(F.lit(1)).alias("findings"), F.count_if(F.col("severity") == "critical").alias("blocking"))
    both = stored.join(open_, "symbol", "left").fillna(0, ["penalty", "findings", "blocking"])
    score = F.when(F.col("bars") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("penalty") / F.col("bars")))).otherwise(0.0)
    return both.withColumn("score", score).withColumn("is_training_eligible", (F.col("score") >= ELIGIBLE_SCORE) & (F.col("blocking") == 0) & (F.col("bars") > 0))


def batch_scores(rows: DataFrame, findings: DataFrame, *keys: str) -> DataFrame:
    """Score of each batch over the rows that were checked, repeats included; 0 for a batch whose rows are missing."""
    checked = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("checked"))
    found = findings.groupBy(*keys).agg(F.sum(penalty()).alias("penalty"))
    both = checked.join(found, list(keys), "full_outer").fillna(0, ["checked", "penalty"])
    return both.withColumn("score", F.when(F.col("checked") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("penalty") / F.col("checked")))).otherwise(0.0))
