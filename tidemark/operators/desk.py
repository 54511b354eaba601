"""Sizes, costs, news windows and reports around decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import currencies
from ..sources.bars import TIMEFRAME_SECONDS

# Pips, the news window, and floors of the reports.
YEN_PIP, PIP = 0.01, 0.0001
NEWS_SECONDS, NEWS_IMPACTS = 300, ("High",)
LEAST_OBSERVED, LEAST_FOR_INSTANT, SNAPSHOT_BARS = 100, 20, 80


def pip_size(symbol: Column) -> Column:
    return F.when(F.endswith(F.upper(symbol), F.lit("JPY")), YEN_PIP).otherwise(PIP)


def pip_value(rows: DataFrame) -> DataFrame:
    """(symbol, lots, tick_value, tick_size) with the money one pip is worth; null where ticks or lots are not known."""
    known = (F.col("tick_value") > 0) & (F.col("tick_size") > 0) & (F.col("lots") > 0)
    per_lot = F.col("tick_value") * pip_size(F.col("symbol")) / F.col("tick_size")
    return rows.withColumn("pip_value_per_lot", F.when(known, per_lot)).withColumn("pip_value", F.when(known, per_lot * F.col("lots")))


def lot_size(rows: DataFrame) -> DataFrame:
    """Lots that put ``risk_percent`` of ``equity`` behind ``stop_distance``, down to the broker's step and never below its minimum.

    Columns tick_value, tick_size, volume_min and volume_step may be null; lots
    are null where ticks, stop, equity or risk are not positive, and 0 where
    the step or minimum leaves nothing to trade.
    """
    known = (F.least("tick_value", "tick_size", "stop_distance", "equity", "risk_percent") > 0) & F.col("tick_value").isNotNull() & F.col("tick_size").isNotNull()
    loss = F.col("stop_distance") / F.col("tick_size") * F.col("tick_value")
    exact = F.col("equity") * (F.col("risk_percent") / 100.0) / loss
    step = F.coalesce(F.nullif("volume_step", F.lit(0.0)), F.lit(0.01))
    rounded = F.round(F.floor(exact / step) * step, 8)
    enough = rounded >= F.coalesce(F.nullif("volume_min", F.lit(0.0)), step)
    out = rows.withColumn("lots_exact", F.when(known, exact)).withColumn("lots", F.when(known, F.when(enough, rounded).otherwise(0.0)))
    return out.withColumn("actual_risk", F.when(known, F.col("lots") * loss))


def cost_in_r(spread: Column, stop_distance: Column) -> Column:
    """The spread in units of the stop distance; null without a stop or for a negative spread."""
    return F.when((stop_distance > 0) & (spread >= 0), spread / stop_distance)


def news_blocked(decisions: DataFrame, releases: DataFrame, seconds: int = NEWS_SECONDS, impacts: Sequence[str] = NEWS_IMPACTS) -> DataFrame:
    """(decision_id, symbol, at) with ``blocked``: whether a release of one of its currencies is within ``seconds``.

    ``releases`` has (at, currency, impact); those without a time, which last
    all day, block nothing.  ``blocked`` is null for a symbol without two
    currencies: unknown is not quiet.  An equi-join on buckets of time, no range join.
    """
    clock = lambda c: F.unix_timestamp(c)
    near = F.sequence(F.floor((clock("at") - seconds) / seconds), F.floor((clock("at") + seconds) / seconds))
    asked = decisions.select("decision_id", clock("at").alias("t"), F.explode(currencies(F.col("symbol"))).alias("currency"), near.alias("near")).withColumn("bucket", F.explode("near"))
    told = releases.where(F.col("impact").isin(*impacts) & F.col("at").isNotNull()).select(F.upper("currency").alias("currency"), clock("at").alias("r"), F.floor(clock("at") / seconds).alias("bucket")).distinct()
    hit = asked.join(told, ["currency", "bucket"]).where(F.abs(F.col("t") - F.col("r")) <= seconds).select("decision_id").distinct().withColumn("_hit", F.lit(True))
    split = F.size(currencies(F.col("symbol"))) > 0
    return decisions.join(hit, "decision_id", "left").withColumn("blocked", F.when(split, F.coalesce("_hit", F.lit(False)))).drop("_hit")


def journal_counts(entries: DataFrame) -> DataFrame:
    """Entries by price source and arm: recorded, resolved, still open, first and last."""
    out = entries.groupBy("price_source", "arm").agg(F.count(F.lit(1)).alias("recorded"), F.count("closed_at").alias("resolved"), F.min("opened_at").alias("first_at"), F.max("opened_at").alias("last_at"))
    return out.withColumn("still_open", F.col("recorded") - F.col("resolved"))


def benchmarked(outcomes: DataFrame) -> DataFrame:
    """(name, decision_id, r), the strategy named ``strategy``: each baseline's total against the strategy's.

    A baseline over another number of decisions is not compared (``beaten`` null).
    """
    totals = outcomes.groupBy("name").agg(F.count(F.lit(1)).alias("decisions"), F.sum("r").alias("total_r"))
    own = totals.where("name = 'strategy'").select(F.col("decisions").alias("_n"), F.col("total_r").alias("strategy_r"))
    rows = totals.where("name <> 'strategy'").join(F.broadcast(own))  # one row
    return rows.withColumn("beaten", F.when(F.col("decisions") == F.col("_n"), F.col("strategy_r") > F.col("total_r"))).drop("_n")


def attainment(observations: DataFrame, target: float, key: str = "service") -> DataFrame:
    """Share of good observations by service, null below 100, and whether it reaches the target."""
    out = observations.groupBy(key).agg(F.count(F.lit(1)).alias("observed"), F.avg(F.col("good").cast("double")).alias("_share"))
    out = out.withColumn("attained", F.when(F.col("observed") >= LEAST_OBSERVED, F.col("_share"))).drop("_share")
    return out.withColumn("met", F.col("attained") >= target)


def modal_instant(bars: DataFrame, least: int = LEAST_FOR_INSTANT) -> DataFrame:
    """The newest instant that is the last bar of at least ``least`` symbols: (event_time, symbols), or no row."""
    last = bars.groupBy("symbol").agg(F.max("event_time").alias("event_time"))
    counts = last.groupBy("event_time").agg(F.count(F.lit(1)).alias("symbols")).where(F.col("symbols") >= least)
    return counts.agg(F.max("event_time").alias("event_time"), F.max_by("symbols", "event_time").alias("symbols")).where("event_time is not null")


def snapshot(bars: DataFrame, n: int = SNAPSHOT_BARS) -> DataFrame:
    """The last ``n`` bars of each symbol that has as many."""
    w = Window.partitionBy("symbol").orderBy(F.desc("event_time"))
    rows = bars.withColumn("age", F.row_number().over(w)).where(F.col("age") <= n)
    full = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n).select("symbol")
    return rows.join(full, "symbol", "left_semi")


def profiles_asof(profiles: DataFrame, as_of: str) -> DataFrame:
    """The newest profile of each symbol and kind that was measured and known at ``as_of``."""
    known = profiles.where((F.col("as_of") <= F.lit(as_of).cast("timestamp")) & (F.col("computed_at") <= F.lit(as_of).cast("timestamp")))
    rest = [c for c in profiles.columns if c not in ("symbol", "kind")]
    best = known.groupBy("symbol", "kind").agg(F.max_by(F.struct(*rest), F.struct("as_of", "computed_at")).alias("_b"))
    return best.select("symbol", "kind", *[F.col(f"_b.{c}").alias(c) for c in rest])


# Busy hours of the sessions in UTC, and the hour of Friday from which the weekend is ahead.
BUSY_HOURS = {"Sydney": (21, 6), "Tokyo": (0, 9), "London": (7, 16), "New York": (12, 21)}
WEEKEND_HOUR, DECISION_MINUTES = 16, 60


def busy_sessions(moment: Column) -> Column:
    """Names of the sessions that are busy at an instant in UTC; one that crosses midnight is open after its start or before its end."""
    at = F.unix_timestamp(moment) % 86400
    inside = lambda a, b: (at >= a * 3600) & (at < b * 3600) if a < b else (at >= a * 3600) | (at < b * 3600)
    return F.array_compact(F.array(*[F.when(inside(a, b), F.lit(name)) for name, (a, b) in BUSY_HOURS.items()]))


def weekend_ahead(moment: Column) -> Column:
    """Friday from the warning hour on, Saturday and Sunday, in UTC."""
    return (F.weekday(moment) > 4) | ((F.weekday(moment) == 4) & (F.hour(moment) >= WEEKEND_HOUR))


def volatility_figures(atr: Column, price: Column, pip: Column) -> Column:
    """The true range in price, in pips and in per cent of the price; null where it or the price is missing."""
    figures = F.struct(atr.alias("atr_price"), F.round(atr / pip, 1).alias("atr_pips"), F.round(atr / price * 100, 4).alias("atr_percent"))
    return F.when((atr > 0) & (price > 0), figures)


def open_risk_r(opened: Column, stop: Column, volume: Column, tick_size: Column, tick_value: Column, one_r: Column) -> Column:
    """What an open position still risks, in R; null, which is unknown and not none, without a stop or a price for a tick."""
    distance = F.abs(opened - stop)
    return F.when((tick_size > 0) & (one_r > 0) & (volume > 0) & (distance > 0), distance / tick_size * tick_value * volume / one_r)


def bar_minutes(timeframe: Column) -> Column:
    """Minutes of the bar a decision was taken on; an hour where its timeframe is not known."""
    names = F.create_map(*[F.lit(x) for name, seconds in TIMEFRAME_SECONDS.items() for x in (name, seconds // 60)])
    return F.coalesce(F.try_element_at(names, timeframe), F.lit(DECISION_MINUTES))
