"""Cross-sectional ranking, and the rule against its control, clustered by instant."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.text import coin_side
from ..sources import stores
from ..sources.bars import by_chunk, chunked, numbered, own
from . import features, outcomes

# Windows, tails and geometry of the measured rule.
MEAN_WINDOW, ATR_WINDOW, TAIL_FRACTION, LEAST_SYMBOLS = 50, 14, 0.10, 20
MIN_HISTORY, STOP_MULTIPLE, TARGET_MULTIPLE, HORIZON = 80, 2.5, 1.0, 120


def stretches(bars: DataFrame, min_history: int = MIN_HISTORY) -> DataFrame:
    """Distance of each close from the mean of the previous 50, in average true ranges."""
    w = by_chunk()
    rows = features.with_steps(chunked(bars, MEAN_WINDOW + 1), w).withColumn("_n", F.col("_i")).withColumn("atr", F.when(F.count("_tr").over(w.rowsBetween(-13, 0)) == ATR_WINDOW, F.avg("_tr").over(w.rowsBetween(-13, 0))))
    mean = F.avg("close").over(w.rowsBetween(-MEAN_WINDOW, -1))
    rows = rows.withColumn("stretch", F.when((F.col("_n") > min_history) & (F.col("atr") > 0), (F.col("close") - mean) / F.col("atr")))
    return own(rows).where("stretch is not null").select("symbol", "event_time", "close", "atr", "stretch")


def tails(ranked: DataFrame, least: int = LEAST_SYMBOLS, fraction: float = TAIL_FRACTION) -> DataFrame:
    """Both tails of each instant with at least ``least`` symbols: the lowest are bought, the highest sold."""
    w = Window.partitionBy("event_time")
    rows = ranked.withColumn("considered", F.count(F.lit(1)).over(w)).where(F.col("considered") >= least)
    rows = rows.withColumn("place", F.row_number().over(w.orderBy("stretch", "symbol"))).withColumn("take", F.greatest(F.lit(1), F.floor(F.col("considered") * fraction)).cast("int"))
    side = F.when(F.col("place") <= F.col("take"), 1).when(F.col("place") > F.col("considered") - F.col("take"), -1)
    return rows.withColumn("side", side).where("side is not null").drop("take")


def arms(bars: DataFrame, seed: str = "control-v1", horizon: int = HORIZON, min_history: int = MIN_HISTORY) -> DataFrame:
    """Both arms of every pick: the rule's side and a hash coin's, same entry, distance and horizon.

    A side is resolved once, also where both arms take it, and handed to the arms that took it.
    Bars are derived and numbered once, and read from the shared folder by both windows and first touch.
    """
    bars = stores.stored(numbered(bars), "cross-section-bars")
    picks = tails(stretches(bars, min_history)).withColumn("coin", coin_side(seed, F.col("symbol"), F.col("event_time")))
    sides = F.explode(F.array_distinct(F.array("side", "coin"))).alias("taken")
    each = picks.select("symbol", "event_time", F.col("close").alias("entry"), "atr", F.col("side").alias("rule"), "coin", sides)
    stop, target = outcomes.levels(F.col("entry"), F.col("atr"), F.col("taken"), STOP_MULTIPLE, TARGET_MULTIPLE)
    touched = outcomes.first_touch(bars, each.withColumn("stop", stop).withColumn("target", target).withColumnRenamed("taken", "side").drop("atr"), horizon)
    arms_of = F.array_compact(F.array(F.when(F.col("rule") == F.col("side"), F.lit("rule")), F.when(F.col("coin") == F.col("side"), F.lit("control"))))
    return touched.withColumn("arm", F.explode(arms_of)).drop("rule", "coin")


def pairs(bars: DataFrame, **options) -> DataFrame:
    """One row per pick whose arms are both decided."""
    both = arms(bars, **options).groupBy("symbol", "event_time").agg(F.max(F.when(F.col("arm") == "rule", F.col("r"))).alias("rule_r"), F.max(F.when(F.col("arm") == "control", F.col("r"))).alias("control_r"))
    return both.withColumn("decided", F.col("rule_r").isNotNull() & F.col("control_r").isNotNull())


def measured(paired: DataFrame) -> DataFrame:
    """One row: instants, trades, both means, and the t of their difference by instant and by trade.

    One pass over the pairs: each instant gives its counts, sums and squares, which add up to both answers.
    """
    gap = F.when(F.col("decided"), F.col("rule_r") - F.col("control_r"))
    instant = paired.groupBy("event_time").agg(
        F.avg(F.when(F.col("decided"), F.col("rule_r"))).alias("rule"), F.avg(F.when(F.col("decided"), F.col("control_r"))).alias("control"), F.count(gap).alias("k"), F.count_if(~F.col("decided")).alias("open"), F.sum(gap).alias("s"), F.sum(gap * gap).alias("q")
    )
    difference = F.col("rule") - F.col("control")
    out = instant.agg(
        F.count("rule").alias("instants"), F.coalesce(F.sum("k"), F.lit(0)).alias("trades"), F.avg("rule").alias("rule_r"), F.avg("control").alias("control_r"), F.stddev_samp(difference).alias("spread_r"), stats.paired_t(difference).alias("t_statistic"),
        F.coalesce(F.sum("open"), F.lit(0)).alias("dropped_undecided"), F.sum("s").alias("_s"), F.sum("q").alias("_q"),
    )
    n = F.col("trades")
    variance = (F.col("_q") - F.col("_s") * F.col("_s") / n) / (n - 1)
    return out.withColumn("unclustered_t", F.when((n > 1) & (variance > 1e-18), F.col("_s") / n / F.sqrt(variance / n)).otherwise(0.0)).drop("_s", "_q")
