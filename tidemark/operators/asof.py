"""Point-in-time reads: what was known at an instant, never later.

A bar is visible at ``as_of`` if it had closed and been ingested by then; of
its revisions the newest known one counts.  Knowledge is filtered before
ranking (filtering after would change the answer), and the ranking is an
aggregation with map-side combine rather than a window over all revisions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.bars import spans

BAR_KEYS = ("symbol", "event_time")


def instant(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp")


def newest(rows: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The last row of each key by ``order``."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*[F.col(k) if k in keys else F.col(f"_best.{k}").alias(k) for k in rows.columns])


def bars_asof(bars: DataFrame, as_of: str, delta: int, keys: Sequence[str] = BAR_KEYS, start: str | None = None) -> DataFrame:
    """Closed bars known at ``as_of``, newest revision of each (ties by latest ingestion)."""
    known = bars.where((F.col("event_time") <= F.timestamp_seconds(F.unix_timestamp(instant(as_of)) - delta)) & (F.col("ingested_at") <= instant(as_of)))
    if start is not None:
        known = known.where(F.col("event_time") >= instant(start))
    return newest(known, keys, "revision", "ingested_at")


def lookback(bars: DataFrame, n: int, least: int = 1, key: str = "symbol") -> DataFrame:
    """The newest ``n`` bars of each key; keys with fewer than ``least`` are left out as insufficient."""
    w = Window.partitionBy(key).orderBy(F.desc("event_time"))
    ranked = bars.withColumn("_age", F.row_number().over(w)).where(F.col("_age") <= n)
    return ranked.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key))).where(F.col("_n") >= least).drop("_n", "_age")


def no_lookahead(rows: DataFrame, as_of: str, delta: int) -> DataFrame:
    """Fail the job if a row could not have been known at ``as_of``."""
    ok = F.col("event_time") <= F.timestamp_seconds(F.unix_timestamp(instant(as_of)) - delta)
    return rows.where(F.coalesce(F.assert_true(ok, F.lit("a bar from after the cutoff")).cast("string"), F.lit("")) == "")


def freshness(bars: DataFrame, as_of: str, delta: int, stale_after: int = 3) -> DataFrame:
    """Age of each symbol's newest bar, from its close; stale beyond ``stale_after`` bars."""
    age = F.unix_timestamp(instant(as_of)) - (F.unix_timestamp(F.max("event_time")) + delta)
    return bars.groupBy("symbol").agg(F.max("event_time").alias("newest"), age.alias("age_seconds")).withColumn("stale", F.col("age_seconds") > stale_after * delta)


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, values: Sequence[str]) -> DataFrame:
    """Each left row with the newest right row of its key at or before its time.

    Union and a running ``last`` within spans of time: linear, no range join,
    and no key's history in one task.  What a span has from before it, the last
    right row of an earlier one, comes from a small table by key and span.  A
    right row at the same instant counts as known.
    """
    names = [c for c in left.columns if c not in (key, time)]
    kinds, right_kinds = dict(left.dtypes), dict(right.dtypes)
    a = left.select(key, time, F.lit(1).alias("_side"), *names, *[F.lit(None).cast(right_kinds[v]).alias(f"_r_{v}") for v in values], F.lit(None).cast("boolean").alias("_hit"))
    b = right.select(key, time, F.lit(0).alias("_side"), *[F.lit(None).cast(kinds[c]).alias(c) for c in names], *[F.col(v).alias(f"_r_{v}") for v in values], F.lit(True).alias("_hit"))
    both = a.unionByName(b).withColumn("_span", spans(time))
    row = F.when(F.col("_hit"), F.struct(*[F.col(f"_r_{v}").alias(v) for v in values]))
    by_span = both.groupBy(key, "_span").agg(F.max_by(row, F.when(F.col("_hit"), F.col(time))).alias("_l"))
    earlier = F.last("_l", ignorenulls=True).over(Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))
    carried = by_span.select(F.col(key).alias("_key"), F.col("_span").alias("_of"), earlier.alias("_carried"))
    w = Window.partitionBy(key, "_span").orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    met = both.join(carried, both[key].eqNullSafe(carried["_key"]) & (both["_span"] == carried["_of"]), "left")
    found = F.coalesce(F.last(row, ignorenulls=True).over(w), F.col("_carried"))
    return met.withColumn("_m", found).where("_side = 1").select(key, time, *names, *[F.col(f"_m.{v}").alias(v) for v in values])


def training_eligible(bars: DataFrame, datasets: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Bars of symbols that any dataset marks as fit for training."""
    return bars.join(datasets.where("is_training_eligible").select(*keys).distinct(), list(keys), "left_semi")


def features_asof(tall: DataFrame, as_of: str, delta: int) -> DataFrame:
    """The newest vintage of each tall feature value known at ``as_of``, one row per bar, columns ``name@version``."""
    known = tall.where((F.col("event_time") <= F.timestamp_seconds(F.unix_timestamp(instant(as_of)) - delta)) & (F.col("computed_at") <= instant(as_of)))
    best = newest(known, ["symbol", "event_time", "name", "feature_version"], "computed_at")
    return best.withColumn("_c", F.concat_ws("@", "name", "feature_version")).groupBy("symbol", "event_time").pivot("_c").agg(F.first("value"))


def matured(episodes: DataFrame, as_of: str, label: str | None = None, limit: int | None = None) -> DataFrame:
    """Episodes whose outcome was known at ``as_of``; the label filter comes before the limit."""
    known = episodes.where((F.col("outcome_ready_at") <= instant(as_of)) & (F.col("computed_at") <= instant(as_of)))
    if label is not None:
        known = known.where(F.array_contains("session_labels", label))
    return known if limit is None else known.orderBy(F.desc("event_time"), "symbol").limit(limit)
