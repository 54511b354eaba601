"""Exposure, headroom, concentration, authorisation, account rules, reconciliation and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Risk limits in R, cluster bound, and hard and soft account limits.
TOTAL_R, CURRENCY_R, CLUSTER_R, INSTRUMENT_R, CLUSTER_BOUND = 6.0, 3.0, 3.0, 2.0, 0.7
HARD = {"trade_r": 1.0, "daily_loss_r": 3.0, "drawdown": 0.10, "positions": 10, "margin": 0.50, "data_age_bars": 3.0}
SOFT = {"target_r": 1.0, "drawdown": 0.05, "daily_loss_r": 1.5, "free_margin": 0.30}
DAY_SHIFT_SECONDS, DAY_OPEN_WINDOW_SECONDS = 2 * 3600, 600
# Legal moves of an order; no answer in time is unknown, which leads back to the live states.
ORDER_MOVES = {
    "draft": ("submitted", "cancelled"),
    "submitted": ("accepted", "rejected", "partially_filled", "filled", "unknown"),
    "accepted": ("partially_filled", "filled", "cancelled", "rejected", "unknown"),
    "partially_filled": ("filled", "cancelled", "unknown"),
    "unknown": ("accepted", "partially_filled", "filled", "cancelled", "rejected"),
}
FIRST_STATE = "draft"


def currency_exposure(positions: DataFrame, *keys: str) -> DataFrame:
    """Net signed risk by currency of (symbol, side, risk_r, base, quote): long is +base and -quote."""
    signed = F.col("side") * F.col("risk_r")
    legs = F.array(F.struct(F.col("base").alias("currency"), signed.alias("r")), F.struct(F.col("quote").alias("currency"), (-signed).alias("r")))
    return positions.select(*keys, F.explode(legs).alias("l")).where("l.currency is not null").groupBy(*keys, F.col("l.currency").alias("currency")).agg(F.sum("l.r").alias("exposure"))


def headroom(candidates: DataFrame, positions: DataFrame, correlations: DataFrame, key: str = "account", bound: float = CLUSTER_BOUND) -> DataFrame:
    """What each candidate (key, symbol, side, risk_r, base, quote) may still add to its book.

    The least of the total, instrument, cluster and both currencies' headroom;
    of equal ones the first in that order limits.  Positions whose correlation
    with the candidate is ``bound`` or more are its cluster; an unmeasured
    correlation is reported as unknown, not as none.
    """
    total = positions.groupBy(key).agg(F.sum("risk_r").alias("total_r"))
    own = positions.groupBy(key, "symbol").agg(F.sum("risk_r").alias("instrument_r"))
    exposure = currency_exposure(positions, key)
    ids = [key, "symbol"]
    other = positions.select(key, F.col("symbol").alias("other"), F.col("risk_r").alias("other_r"))
    met = candidates.select(*ids).distinct().join(other, key).where("symbol <> other")
    both = correlations.select(F.col("a").alias("symbol"), F.col("b").alias("other"), "r").unionByName(correlations.select(F.col("b").alias("symbol"), F.col("a").alias("other"), "r"))
    cluster = met.join(both, ["symbol", "other"], "left").groupBy(*ids).agg(F.sum(F.when(F.abs("r") >= bound, F.col("other_r"))).alias("cluster_r"), F.count_distinct(F.when(F.col("r").isNull(), F.col("other"))).alias("unknown"))
    rows = candidates.join(total, key, "left").join(own, ids, "left").join(cluster, ids, "left")
    for leg, sign in (("base", 1), ("quote", -1)):
        rows = rows.join(exposure.select(key, F.col("currency").alias(leg), F.col("exposure").alias(f"_{leg}")), [key, leg], "left")
        here = F.coalesce(f"_{leg}", F.lit(0.0))
        same = F.when((here > 0) == (sign * F.col("side") > 0), F.abs(here)).otherwise(0.0)
        rows = rows.withColumn(f"_{leg}_room", F.when(F.col(leg).isNotNull(), CURRENCY_R - same))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    rooms = [("total", TOTAL_R - zero("total_r")), ("instrument", INSTRUMENT_R - zero("instrument_r")), ("cluster", CLUSTER_R - zero("cluster_r")), ("base_currency", F.col("_base_room")), ("quote_currency", F.col("_quote_room"))]
    named = F.filter(F.array(*[F.struct(r.cast("double").alias("room"), F.lit(k).alias("order"), F.lit(n).alias("name")) for k, (n, r) in enumerate(rooms)]), lambda x: x["room"].isNotNull())
    rows = rows.withColumn("_min", F.array_min(named)).withColumn("headroom_r", F.greatest(F.lit(0.0), F.col("_min.room"))).withColumn("limited_by", F.col("_min.name"))
    rows = rows.withColumn("allowed_r", F.least("risk_r", "headroom_r")).withColumn("unknown", F.coalesce("unknown", F.lit(0)))
    verdict = F.when((F.col("risk_r") <= 0) | (F.col("allowed_r") <= 0), "block").when(F.col("allowed_r") < F.col("risk_r"), "reduce").otherwise("approve")
    return rows.withColumn("verdict", verdict).drop("_base", "_quote", "_base_room", "_quote_room", "_min")


def concentration(positions: DataFrame, *keys: str, correlation: float = 0.0) -> DataFrame:
    """Herfindahl index, effective positions, largest share, and the loss at equal correlation."""
    r = F.abs("risk_r")
    out = positions.groupBy(*keys).agg(F.count(F.lit(1)).alias("positions"), F.sum(r).alias("total_r"), F.sum(r * r).alias("_sq"), F.max(r).alias("_max"))
    share = F.try_divide(F.col("_sq"), F.nullif(F.col("total_r") * F.col("total_r"), F.lit(0.0)))
    return out.withColumn("herfindahl", share).withColumn("effective_positions", F.try_divide(F.lit(1.0), F.col("herfindahl"))).withColumn("largest_share", F.try_divide(F.col("_max"), F.nullif(F.col("total_r"), F.lit(0.0)))).withColumn("correlated_loss_r", F.sqrt((1 - correlation) * F.col("_sq") + correlation * F.col("total_r") * F.col("total_r"))).drop("_sq", "_max")


def authorise(requests: DataFrame) -> DataFrame:
    """Permitted risk of each request: any hard breach blocks, then soft limits reduce, one factor each.

    Columns: requested_r, equity, peak_equity, daily_pnl_r, open_positions,
    used_margin, free_margin, data_age_bars (null: unknown, a breach),
    eligible, calibrated, correlation_unknown, safe_mode, headroom_r (null: not measured).
    """
    drawdown = F.when(F.col("peak_equity") > 0, F.greatest(F.lit(0.0), (F.col("peak_equity") - F.col("equity")) / F.col("peak_equity"))).otherwise(0.0)
    total = F.col("used_margin") + F.col("free_margin")
    rows = requests.withColumn("drawdown", drawdown).withColumn("margin", F.when(total > 0, F.col("used_margin") / total).otherwise(0.0))
    tests = {
        "safe_mode": F.col("safe_mode"), "not_positive": F.col("requested_r") <= 0, "per_trade": F.col("requested_r") > HARD["trade_r"], "drawdown": F.col("drawdown") >= HARD["drawdown"], "daily_loss": F.col("daily_pnl_r") <= -HARD["daily_loss_r"],
        "positions": F.col("open_positions") >= HARD["positions"], "margin": F.col("margin") >= HARD["margin"], "equity": F.col("equity") <= 0, "freshness": F.coalesce(F.col("data_age_bars") > HARD["data_age_bars"], F.lit(True)),
    }
    rows = rows.withColumn("breaches", F.array_compact(F.array(*[F.when(t, n) for n, t in tests.items()])))
    cut = lambda when, f: F.when(when, f).otherwise(1.0)
    factor = cut(F.col("drawdown") >= SOFT["drawdown"], 0.5) * cut(F.col("daily_pnl_r") <= -SOFT["daily_loss_r"], 0.5) * cut(~F.col("calibrated"), 0.5) * cut(~F.col("eligible"), 0.5) * cut(F.col("correlation_unknown"), 0.75) * cut(1 - F.col("margin") < SOFT["free_margin"], 0.5)
    soft = F.least("requested_r", F.lit(SOFT["target_r"])) * factor
    permitted = F.greatest(F.lit(0.0), F.least(soft, F.coalesce("headroom_r", soft)))
    rows = rows.withColumn("permitted_r", F.when(F.size("breaches") > 0, 0.0).otherwise(permitted))
    return rows.withColumn("verdict", F.when(F.col("permitted_r") <= 0, "block").when(F.col("permitted_r") >= F.col("requested_r"), "approve").otherwise("reduce"))


def trading_day(moment: Column) -> Column:
    """The accounting day, which begins two hours before midnight UTC."""
    return F.to_date(F.timestamp_seconds(F.unix_timestamp(moment) + DAY_SHIFT_SECONDS))


def equity_peaks(samples: DataFrame) -> DataFrame:
    """Peak equity, and the peak of the balances at the days' openings.

    A day counts if its first sample is within ten minutes of its opening; an account's first day always counts.
    """
    day = trading_day(F.col("recorded_at"))
    peak = samples.groupBy("account").agg(F.max("equity").alias("peak_equity"))
    first = samples.withColumn("day", day).groupBy("account", "day").agg(F.min("recorded_at").alias("_t"), F.min_by("balance", "recorded_at").alias("_b"))
    late = F.pmod(F.unix_timestamp("_t") + DAY_SHIFT_SECONDS, F.lit(86400))
    first = first.withColumn("_first", F.min("day").over(Window.partitionBy("account"))).where((late <= DAY_OPEN_WINDOW_SECONDS) | (F.col("day") == F.col("_first")))
    return peak.join(first.groupBy("account").agg(F.max("_b").alias("peak_day_open_balance"), F.count(F.lit(1)).alias("days")), "account", "left")


def consistency(profits: DataFrame, least_days: int = 3) -> DataFrame:
    """The best day's share of an account's profit, with at least three days and a profit in all."""
    days = profits.groupBy("account", "day").agg(F.sum("profit").alias("profit"))
    out = days.groupBy("account").agg(F.count(F.lit(1)).alias("days"), F.sum("profit").alias("total"), F.max(F.struct("profit", "day")).alias("_b"))
    return out.withColumn("best_day", F.col("_b.day")).withColumn("best_share", F.when((F.col("days") >= least_days) & (F.col("total") > 0), F.col("_b.profit") / F.col("total"))).drop("_b")


def reconcile(broker: DataFrame, expected: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Broker positions against expected ones by (symbol, side): orphan, missing, drifted, unprotected or matched."""
    a = broker.select("symbol", "side", F.col("size").alias("broker_size"), F.col("stop").alias("broker_stop"))
    b = expected.select("symbol", "side", F.col("size").alias("expected_size"))
    status = F.when(F.col("expected_size").isNull(), "orphan").when(F.col("broker_size").isNull(), "missing").when(F.abs(F.col("broker_size") - F.col("expected_size")) > tolerance, "drifted").when(F.col("broker_stop").isNull(), "unprotected").otherwise("matched")
    return a.join(b, ["symbol", "side"], "full_outer").withColumn("status", status)


def illegal_moves(orders: DataFrame) -> DataFrame:
    """Moves of (order_id, at, state) that the order state machine does not allow."""
    w = Window.partitionBy("order_id").orderBy("at")
    moved = orders.withColumn("before", F.lag("state").over(w))
    legal = F.lit(False)
    for state, nexts in ORDER_MOVES.items():
        legal = legal | ((F.col("before") == state) & F.col("state").isin(*nexts))
    return moved.where(F.when(F.col("before").isNull(), F.col("state") != FIRST_STATE).otherwise(~legal))


SKIPS = ("kill_switch", "disabled", "not_permitted", "ceiling")


def _permits_all() -> Column:
    return F.coalesce(F.size("permitted"), F.lit(0)) < 1


def route(intents: DataFrame, accounts: DataFrame) -> DataFrame:
    """The accounts that may act on each intent (intent, symbol, risk_r), and those whose ceiling is below its risk.

    ``accounts`` has (account, killed, enabled, permitted, max_risk_r); an empty
    or null list permits every symbol, and a null switch counts as engaged.
    Accounts that are switched off or don't permit the symbol have no rows here:
    ``routing`` counts them.  An equi-join on symbols; accounts that permit all
    get the distinct symbols asked for.
    """
    live = accounts.where(~F.coalesce("killed", F.lit(True)) & F.coalesce("enabled", F.lit(False)))
    asked = intents.agg(F.coalesce(F.collect_set("symbol"), F.array()).alias("_asked"))  # one row: the distinct symbols
    listed = live.join(F.broadcast(asked)).select("account", "max_risk_r", F.explode(F.when(_permits_all(), F.col("_asked")).otherwise(F.array_distinct("permitted"))).alias("symbol"))
    return intents.join(listed, "symbol").select("intent", "account", F.when(F.col("risk_r") > F.col("max_risk_r"), SKIPS[3]).alias("skipped"))


def routing(intents: DataFrame, accounts: DataFrame) -> DataFrame:
    """How many accounts take each intent and how many skip it for which reason, without a row for each pair.

    Accounts are counted by permitted symbol and ceiling (those that permit all
    under no symbol), intents meet the counts of their symbol: one row for
    each ceiling that occurs there.
    """
    book = accounts.select(F.coalesce("killed", F.lit(True)).alias("killed"), F.coalesce("enabled", F.lit(False)).alias("enabled"), "permitted", "max_risk_r")
    live = book.where("not killed and enabled")
    totals = book.agg(F.count_if("killed").alias("kill_switch"), F.count_if(F.expr("not killed and not enabled")).alias("disabled"), F.count_if(F.expr("not killed and enabled")).alias("_live"))
    named = live.where(~_permits_all()).select("max_risk_r", F.explode(F.array_distinct("permitted")).alias("symbol")).groupBy("symbol", "max_risk_r").agg(F.count(F.lit(1)).alias("_n"))
    free = live.where(_permits_all()).groupBy("max_risk_r").agg(F.count(F.lit(1)).alias("_n"))
    asked = intents.select("symbol", "risk_r").distinct()
    # The ceilings of accounts that permit all, as one row.
    spread = free.agg(F.coalesce(F.collect_list(F.struct("max_risk_r", "_n")), F.array()).alias("_free"))
    sums = lambda pick: F.aggregate(F.filter("_free", pick), F.lit(0).cast("long"), lambda a, x: a + x["_n"])
    own = asked.join(named, "symbol", "left").groupBy("symbol", "risk_r").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_own"), F.coalesce(F.sum(F.when(F.col("risk_r") > F.col("max_risk_r"), F.col("_n"))), F.lit(0)).alias("_over"))
    own = own.join(F.broadcast(spread)).join(F.broadcast(totals))  # one row each
    over = F.col("_over") + sums(lambda x: F.col("risk_r") > x["max_risk_r"])
    own = own.withColumn("ceiling", over).withColumn("_may", F.col("_own") + sums(lambda x: F.lit(True)))
    counts = own.select("symbol", "risk_r", "kill_switch", "disabled", (F.col("_live") - F.col("_may")).alias("not_permitted"), "ceiling", (F.col("_may") - F.col("ceiling")).alias("routed"))
    return intents.join(counts, ["symbol", "risk_r"]).select("intent", "routed", *SKIPS)


# Layers that must have approved an order, seconds after which an authorisation is stale, and seconds it may lie ahead.
APPROVALS, MOST_AGE_SECONDS, MOST_SKEW_SECONDS = ("risk", "portfolio", "challenge", "stress"), 5, 1


def preflight(intents: DataFrame, now: Column) -> DataFrame:
    """Every check of an order, with all that fail; one failure blocks it.

    Columns: enabled, killed, require_auth, approvals (map of layer to a struct
    of approved and at), authorised_at, risk_r, max_risk_r, submitted_as (the
    id of a former submission, null if it is known that there was none).
    A null switch, approval or time fails its check.
    """
    age = lambda at: F.unix_timestamp(now) - F.unix_timestamp(at)
    given = {a: F.try_element_at("approvals", F.lit(a)) for a in APPROVALS}
    at = age(F.col("authorised_at"))
    checks = {"execution_enabled": F.col("enabled"), "kill_switch_clear": ~F.col("killed"), "auth_required": F.col("require_auth")}
    checks |= {f"approved_by_{a}": g["approved"] for a, g in given.items()}
    checks |= {"authorisation_not_future_dated": at >= -MOST_SKEW_SECONDS, "authorisation_fresh": at <= MOST_AGE_SECONDS}
    checks |= {f"{a}_approval_fresh": g.isNull() | (age(g["at"]) <= MOST_AGE_SECONDS) for a, g in given.items()}
    checks |= {"size_within_ceiling": F.col("risk_r") <= F.col("max_risk_r"), "not_a_duplicate": F.col("submitted_as").isNull()}
    blocks = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in checks.items()]))
    return intents.withColumn("blocks", blocks).withColumn("cleared", F.size("blocks") == 0)
