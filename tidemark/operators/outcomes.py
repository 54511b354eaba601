"""Forward outcomes, episodes with a maturity gate, and first touch of stop or target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import stores
from ..sources.bars import by_chunk, chunked, numbered, own
from . import calendars, features


def forward(bars: DataFrame, horizon: int) -> DataFrame:
    """Extremes and return of the ``horizon`` bars after each; null where fewer exist.

    ``bars_to_max_*`` is the first bar of the extreme, 0 where price never went that way.
    """
    w = by_chunk()
    ahead = w.rowsBetween(1, horizon)
    rows = chunked(bars, after=horizon)
    top, bottom = F.max(F.struct(F.col("high").alias("v"), (-F.col("_i")).alias("i"))).over(ahead), F.min(F.struct(F.col("low").alias("v"), F.col("_i").alias("i"))).over(ahead)
    rows = rows.withColumn("_top", top).withColumn("_bottom", bottom).withColumn("_ahead", F.count(F.lit(1)).over(ahead)).withColumn("_exit", F.lead("close", horizon).over(w))
    full = (F.col("_ahead") == horizon) & (F.col("close") > 0)
    up, down = (F.col("_top.v") - F.col("close")) / F.col("close"), (F.col("_bottom.v") - F.col("close")) / F.col("close")
    return own(rows.withColumns({
        "max_up_pct": F.when(full, F.greatest(F.lit(0.0), up)), "max_down_pct": F.when(full, F.least(F.lit(0.0), down)), "forward_return_pct": F.when(full, (F.col("_exit") - F.col("close")) / F.col("close")),
        "bars_to_max_up": F.when(full, F.when(up > 0, -F.col("_top.i") - F.col("_i")).otherwise(0)), "bars_to_max_down": F.when(full, F.when(down < 0, F.col("_bottom.i") - F.col("_i")).otherwise(0)), "outcome_bars": F.col("_ahead"),
    })).drop("_i", "_top", "_bottom", "_ahead", "_exit")


def episodes(bars: DataFrame, delta: int, horizon: int, cutoff: str | None = None, step: int = 1, names: list[str] | None = None) -> DataFrame:
    """Matured episodes: features, sessions and the outcome of each bar.

    An episode is ready when its last forward bar has closed.  ``step`` thins on
    the epoch grid, so the choice does not move with the start of the read.
    """
    ready = F.timestamp_seconds(F.unix_timestamp("event_time") + delta * (horizon + 1))
    rows = forward(features.compute(numbered(bars), names), horizon).where("forward_return_pct is not null").withColumn("outcome_ready_at", ready).withColumn("computed_at", ready)
    if cutoff is not None:
        rows = rows.where(F.col("outcome_ready_at") <= F.lit(cutoff).cast("timestamp"))
    if step > 1:
        rows = rows.where(F.pmod(F.floor(F.unix_timestamp("event_time") / delta), F.lit(step)) == 0)
    return rows.withColumn("horizon_bars", F.lit(horizon)).withColumn("session_labels", calendars.active_sessions(F.col("event_time"))).withColumnRenamed("close", "entry_price")


def distribution(matured: DataFrame, *keys: str, least: int = 20) -> DataFrame:
    """Share of rising outcomes, median return and mean extremes; null below ``least`` episodes."""
    enough = F.count(F.lit(1)) >= least
    return matured.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("episodes"), F.when(enough, F.avg((F.col("forward_return_pct") > 0).cast("double"))).alias("positive_share"), F.when(enough, F.median("forward_return_pct")).alias("median_forward"),
        F.when(enough, F.avg("max_up_pct")).alias("mean_max_up"), F.when(enough, F.avg("max_down_pct")).alias("mean_max_down"),
    )


def first_touch(bars: DataFrame, decisions: DataFrame, horizon: int = 120, bucket: int | None = None) -> DataFrame:
    """What the bars after each decision did to it, in R.

    ``decisions`` has (symbol, event_time, side, entry, stop, target) and any
    other columns.  The first later bar that touches either level decides: the
    stop makes -1, the target its multiple; a bar that touches both leaves the
    decision undecided for good, and so does a horizon without a touch
    (``r`` null).  The range join is an equi-join on buckets of bar numbers: a
    decision meets the two buckets that hold its next ``horizon`` bars.
    """
    size = bucket or horizon
    key = list(decisions.columns)
    counted = stores.stored(numbered(bars).select("symbol", "event_time", "high", "low", "_i"), "numbered")  # read twice
    # Repeated decisions are resolved once and come back as often as they were given.
    once = decisions.groupBy(*key).agg(F.count(F.lit(1)).alias("_copies"))
    placed = once.join(counted.select("symbol", "event_time", F.col("_i").alias("_at")), ["symbol", "event_time"])
    spans = F.sequence(F.floor((F.col("_at") + 1) / size), F.floor((F.col("_at") + horizon) / size))
    spread = placed.withColumn("_b", F.explode(spans))
    later = counted.select("symbol", F.floor(F.col("_i") / size).alias("_b"), F.col("_i").alias("_j"), "high", "low")
    met = spread.join(later, ["symbol", "_b"], "left")
    long, ahead = F.col("side") > 0, (F.col("_j") > F.col("_at")) & (F.col("_j") <= F.col("_at") + horizon)
    stop = F.when(long, F.col("low") <= F.col("stop")).otherwise(F.col("high") >= F.col("stop"))
    target = F.when(long, F.col("high") >= F.col("target")).otherwise(F.col("low") <= F.col("target"))
    # Number and touches as one long: its least is kept in a hash map as bars are met, where a struct's would need them all sorted.
    code = lambda c: F.when(c, 1).when(~c, 0).otherwise(2)
    touch = F.col("_j") * 16 + code(stop) * 4 + code(target)
    found = met.groupBy(*key, "_at", "_copies").agg(F.min(F.when(ahead & (stop | target), touch)).alias("_m"))
    known = lambda at: F.when(F.shiftright("_m", at).bitwiseAND(3) < 2, F.shiftright("_m", at).bitwiseAND(3) == 1)
    found = found.withColumn("_f", F.struct(F.shiftright("_m", 4).alias("_j"), known(2).alias("_s"), known(0).alias("_t")))
    r = F.when(F.col("_f._s") & F.col("_f._t"), F.lit(None)).when(F.col("_f._s"), -1.0).when(F.col("_f._t"), F.abs(F.col("target") - F.col("entry")) / F.abs(F.col("entry") - F.col("stop")))
    each = found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return each.select(*key, r.cast("double").alias("r"), (F.col("_f._s") & F.col("_f._t")).alias("ambiguous"), (F.col("_f._j") - F.col("_at")).alias("bars_to_touch"))


def resolved(bars: DataFrame, decisions: DataFrame, horizon: int = 120) -> DataFrame:
    """Decisions with a status: win, loss, abandoned (ambiguous, or the horizon passed), open, or excluded (no level to score it by)."""
    rows = first_touch(bars, decisions, horizon)
    total = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("_all"))
    index = numbered(bars.select("symbol", "event_time")).join(total, "symbol").select("symbol", "event_time", (F.col("_all") - F.col("_i")).alias("bars_after"))
    scored = F.col("entry").isNotNull() & F.col("stop").isNotNull() & F.col("target").isNotNull()
    status = F.when(~scored, "excluded").when(F.col("r") > 0, "win").when(F.col("r") <= 0, "loss").when(F.col("bars_after") >= horizon, "abandoned").otherwise("open")
    return rows.join(index, ["symbol", "event_time"]).withColumn("status", status)


def levels(entry: Column, atr: Column, side: Column, stop_multiple: float, reward_multiple: float) -> tuple[Column, Column]:
    """Stop and target at multiples of the true range."""
    distance = atr * stop_multiple
    return entry - distance * side, entry + distance * reward_multiple * side
