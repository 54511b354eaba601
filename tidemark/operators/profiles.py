"""Behavioural profiles, market memory and correlation of symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.bars import by_time
from . import calendars, features

# Least bars of a profile and bucket, tendency band, cluster bound, memory horizons (days, least bars).
LEAST_BARS, LEAST_BUCKET, TENDENCY_BAND, CLUSTER_BOUND, LEAST_SHARED = 200, 30, 0.05, 0.7, 200
HORIZONS = {"short": (3, 20), "medium": (90, 100), "long": (1095, 250)}
MAX_BARS = 20_000
PERCENTS = (5, 25, 50, 75, 95)


def nearest_rank(column: str, prefix: str) -> list[Column]:
    """Percentiles that are values of the column (nearest rank)."""
    return [F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {column})").alias(f"{prefix}_p{p}") for p in PERCENTS]


def with_ranges(bars: DataFrame) -> DataFrame:
    return features.with_steps(bars).withColumn("range_pct", F.when(F.col("close") > 0, (F.col("high") - F.col("low")) / F.col("close"))).withColumn("abs_ret", F.abs("_ret"))


def volatility(bars: DataFrame) -> DataFrame:
    """Percentiles of range and absolute return, mean range and deviation of returns, for symbols of at least 200 bars."""
    out = with_ranges(bars).groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), *nearest_rank("range_pct", "range"), F.avg("range_pct").alias("range_mean"), F.stddev_pop("_ret").alias("return_stdev"), *nearest_rank("abs_ret", "abs_return"))
    return out.where(F.col("bars") >= LEAST_BARS)


def sessions(bars: DataFrame) -> DataFrame:
    """Bars, share, mean and median range of each session; sessions of fewer than 30 bars are left out, the busiest is marked."""
    total = Window.partitionBy("symbol")
    rows = with_ranges(bars).withColumn("total", F.count(F.lit(1)).over(total)).withColumn("session", F.explode(calendars.active_sessions(F.col("event_time"))))
    each = rows.groupBy("symbol", "session").agg(F.count(F.lit(1)).alias("bars"), (F.count(F.lit(1)) / F.max("total")).alias("share"), F.avg("range_pct").alias("mean_range"), F.median("range_pct").alias("median_range"), F.max("total").alias("total"))
    each = each.where((F.col("bars") >= LEAST_BUCKET) & (F.col("total") >= LEAST_BARS)).drop("total")
    return each.withColumn("busiest", F.row_number().over(total.orderBy(F.desc("mean_range"), "session")) == 1)


def clock(bars: DataFrame) -> DataFrame:
    """Mean range and count by UTC hour and by weekday (Monday 0), in one pass of grouping sets."""
    rows = with_ranges(bars).select("symbol", F.hour("event_time").alias("hour"), F.weekday("event_time").alias("weekday"), "range_pct")
    sets = rows.groupingSets([["symbol", "hour"], ["symbol", "weekday"]], "symbol", "hour", "weekday").agg(F.count(F.lit(1)).alias("bars"), F.avg("range_pct").alias("mean_range"))
    return sets.where(F.col("bars") >= LEAST_BUCKET)


def structure(bars: DataFrame) -> DataFrame:
    """Lag-1 autocorrelation of returns (products over their number, population variance), tendency, up-share, body and gap percentiles."""
    w, whole = by_time(), Window.partitionBy("symbol")
    rows = with_ranges(bars).withColumn("_mean", F.avg("_ret").over(whole)).withColumn("_next", F.lead("_ret").over(w))
    rows = rows.withColumn("_product", (F.col("_ret") - F.col("_mean")) * (F.col("_next") - F.col("_mean")))
    rows = rows.withColumn("body", F.try_divide(F.abs(F.col("close") - F.col("open")), F.nullif(F.col("high") - F.col("low"), F.lit(0.0)))).withColumn("gap", F.when(F.col("_prev") > 0, F.abs(F.col("open") - F.col("_prev")) / F.col("_prev")))
    out = rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"), F.try_divide(F.avg("_product"), F.nullif(F.var_pop("_ret"), F.lit(0.0))).alias("autocorrelation"), F.avg((F.col("_ret") > 0).cast("double")).alias("up_share"), *nearest_rank("body", "body"), *nearest_rank("gap", "gap")
    )
    tendency = F.when(F.col("autocorrelation") > TENDENCY_BAND, "trending").when(F.col("autocorrelation") < -TENDENCY_BAND, "mean_reverting").otherwise("neutral")
    return out.where(F.col("bars") >= LEAST_BARS).withColumn("tendency", tendency)


def liquidity(bars: DataFrame) -> DataFrame:
    """Percentiles of positive volumes; null below 200 of them."""
    out = bars.withColumn("_v", F.when(F.col("volume") > 0, F.col("volume"))).groupBy("symbol").agg(F.count("_v").alias("volumes"), F.avg("_v").alias("volume_mean"), *nearest_rank("_v", "volume"))
    return out.withColumns({c: F.when(F.col("volumes") >= LEAST_BARS, F.col(c)) for c in out.columns if c.startswith("volume_")})


def correlations(bars: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """Pearson correlation of log returns of each pair of symbols, over the times both have.

    Returns are taken per series before aligning.  One row per instant gathers
    the instant's symbols (their number is the universe's, not the history's),
    and pairs come from it as the sums that the correlation needs.
    """
    rows = features.with_steps(bars).where("_ret is not null").groupBy("event_time").agg(F.sort_array(F.collect_list(F.struct("symbol", F.col("_ret").alias("r")))).alias("all"))
    left = rows.select("all", F.posexplode("all").alias("i", "x"))
    both = left.select("x", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("y"))
    out = both.groupBy(F.col("x.symbol").alias("a"), F.col("y.symbol").alias("b")).agg(F.count(F.lit(1)).alias("shared"), F.when((F.stddev_pop("x.r") > 0) & (F.stddev_pop("y.r") > 0), F.corr("x.r", "y.r")).alias("r"))
    return out.where(F.col("shared") >= least)


def correlation_map(pairs: DataFrame, limit: int = 200) -> DataFrame:
    """The strongest pairs first, each once, with a cluster mark (a top-k report)."""
    key = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "shared", "r").where("r is not null").dropDuplicates(["a", "b"])
    return key.withColumn("clustered", F.abs("r") >= CLUSTER_BOUND).orderBy(F.desc(F.abs("r")), "a", "b").limit(limit)


def horizon_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, d * 86400, m) for n, (d, m) in HORIZONS.items()], "horizon string, seconds long, least_bars int")


def memory(bars: DataFrame, as_of: str) -> DataFrame:
    """What each horizon remembers at a cutoff: one aggregation for all symbols and horizons.

    ``bars`` are already as known then.  Three windows per bar are made by a
    three-row dimension, so a bar is read once.
    """
    now = F.unix_timestamp(F.lit(as_of).cast("timestamp"))
    rows = bars.join(F.broadcast(horizon_table(bars.sparkSession)), F.unix_timestamp("event_time") >= now - F.col("seconds"))
    part = Window.partitionBy("horizon", "symbol")
    w = part.orderBy("event_time")
    rows = rows.withColumn("_age", F.row_number().over(part.orderBy(F.desc("event_time")))).where(F.col("_age") <= MAX_BARS)
    sofar = w.rowsBetween(Window.unboundedPreceding, 0)
    previous = F.lag("close").over(w)
    rows = rows.withColumn("_ret", F.when((previous > 0) & (F.col("close") > 0), F.ln(F.col("close") / previous)))
    rows = rows.withColumn("_dd", F.try_divide(F.max("close").over(sofar) - F.col("close"), F.max("close").over(sofar))).withColumn("_ru", F.try_divide(F.col("close") - F.min("close").over(sofar), F.min("close").over(sofar)))
    out = rows.groupBy("symbol", "horizon").agg(
        F.count(F.lit(1)).alias("bars"), F.max("least_bars").alias("least_bars"), F.min("event_time").alias("window_start"), F.max("event_time").alias("window_end"), F.min_by("open", "event_time").alias("open"), F.max_by("close", "event_time").alias("close"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.stddev_pop("_ret").alias("realized_vol"), F.count("_ret").alias("_k"), F.max("_dd").alias("max_drawdown_pct"), F.max("_ru").alias("max_runup_pct"),
        (F.max(F.struct("high", "_age"))["_age"] - 1).alias("bars_since_high"), (-F.min(F.struct("low", (-F.col("_age")).alias("n")))["n"] - 1).alias("bars_since_low"),
    )
    net = F.when((F.col("open") > 0) & (F.col("close") > 0), F.ln(F.col("close") / F.col("open")))
    out = out.where(F.col("bars") >= F.col("least_bars")).withColumn("return_pct", net).withColumn("position_in_range", F.try_divide(F.col("close") - F.col("low"), F.nullif(F.col("high") - F.col("low"), F.lit(0.0))))
    out = out.withColumn("realized_vol", F.when(F.col("_k") > 1, F.col("realized_vol"))).withColumn("trend_strength", F.when(F.col("realized_vol") > 0, F.col("return_pct") / (F.col("realized_vol") * F.sqrt("_k"))))
    return out.withColumn("trend", trend_label(F.col("trend_strength"))).drop("_k", "least_bars")


def trend_label(strength: Column) -> Column:
    return F.when(strength >= 1.0, "up").when(strength <= -1.0, "down").when(strength.isNotNull(), "sideways")


def memory_agreement(snapshots: DataFrame) -> DataFrame:
    """Whether the directional horizons of a symbol agree; null with fewer than two."""
    directional = F.when(F.col("trend").isin("up", "down"), F.col("trend"))
    out = snapshots.groupBy("symbol").agg(F.count(directional).alias("directional"), F.count_distinct(directional).alias("_k"))
    return out.withColumn("agree", F.when(F.col("directional") >= 2, F.col("_k") == 1)).drop("_k")


def snapshot(facets: dict[str, DataFrame], as_of: str, computed_at: str) -> DataFrame:
    """All facets of the profiles at one cutoff as (symbol, kind, as_of, computed_at, metric, value); what a facet could not measure is left out."""
    out = None
    for kind, rows in facets.items():
        metrics = [c for c, t in rows.dtypes if c != "symbol" and t in ("double", "bigint", "int")]
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in metrics])).alias("c")
        each = rows.select("symbol", F.lit(kind).alias("kind"), F.lit(as_of).cast("timestamp").alias("as_of"), F.lit(computed_at).cast("timestamp").alias("computed_at"), cells).select("symbol", "kind", "as_of", "computed_at", "c.metric", "c.value").where("value is not null")
        out = each if out is None else out.unionByName(each)
    return out
