"""Stress scenarios: what a losing run and the open book would cost an account, and the size that would survive it."""

from __future__ import annotations

from math import ceil, log, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats

# Scenarios (losses times, hit rate less, correlation shock, chance of the losing run), floors and limits.
SCENARIOS = {"base": (1.0, 0.0, 0.0, 0.5), "adverse": (1.25, -0.05, 0.30, 0.5), "stress": (1.5, -0.10, 0.60, 0.05), "extreme": (2.0, -0.20, 1.0, 0.05)}
TYPICAL_P, SEVERE_P, LEAST_TRADES, HORIZON, SURVIVABLE_MARGIN, LEAST_RUIN = 0.5, 0.05, 30, 20, 0.99, 1e-12
RUIN_WARNING, DRAWDOWN_WARNING, DAILY_WARNING, MOST_SHARE, CEILING, DAILY_LIMIT_R = 0.01, 0.10, 0.20, 0.5, 0.10, 3.0


def run_probability(win: Column, length: Column, trades: int) -> Column:
    """Chance of at least ``length`` losses in a row within ``trades``: 0 where they don't fit, null for a length below 1.

    The chance of no such run within n trades is that within n - 1, less that
    of a first run ending at n: a win, then ``length`` losses, and no run before.
    """
    loss = 1 - win
    ends = F.pow(loss, length)
    start = F.concat(F.array_repeat(F.lit(1.0), length.cast("int")), F.array(1 - ends))  # no run within 0 .. length trades
    more = F.when(length < trades, F.sequence(length + 1, F.lit(trades))).otherwise(F.array().cast("array<int>"))
    free = F.aggregate(more, start, lambda a, n: F.concat(a, F.array(F.element_at(a, -1) - win * ends * F.element_at(a, (n - length).cast("int")))), lambda a: F.element_at(a, -1))
    return F.when(length < 1, None).when(length > trades, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - free)))


def longest_run(win: Column, trades: int, chance: float) -> Column:
    """The longest losing run that has at least this chance within ``trades``; bisected, since longer runs are rarer."""
    start = F.struct(F.lit(0).alias("lo"), F.lit(trades + 1).alias("hi"))

    def halve(s, _):
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        holds = (s["hi"] - s["lo"] > 1) & (run_probability(win, F.greatest(F.lit(1), middle), trades) >= chance)
        return F.struct(F.when(holds, middle).otherwise(s["lo"]).alias("lo"), F.when(holds | (s["hi"] - s["lo"] <= 1), s["hi"]).otherwise(middle).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(ceil(log2(trades + 1)))), start, halve, lambda s: s["lo"])
    return F.when(win <= 0, F.lit(trades)).otherwise(found)


def daily_loss(win: Column, average_win: Column, average_loss: Column, trades: Column, limit: float) -> Column:
    """Chance that a day's trades lose the limit or more on balance."""
    start = F.struct(F.lit(1.0).alias("ways"), F.lit(0.0).alias("total"))

    def add(s, losses):
        wins = trades - losses
        hit = wins * average_win - losses * average_loss <= -limit
        chance = s["ways"] * F.pow(win, wins) * F.pow(1 - win, losses)
        return F.struct((s["ways"] * wins / (losses + 1)).cast("double").alias("ways"), (s["total"] + F.when(hit, chance).otherwise(0.0)).alias("total"))

    usable = (trades > 0) & (average_win > 0) & (average_loss > 0) & win.between(0, 1)
    return F.when(usable, F.least(F.lit(1.0), F.aggregate(F.sequence(F.lit(0), trades), start, add, lambda s: s["total"])))


def ruin(win: Column, payoff: Column, risk: Column, average_loss: Column, calibrated: Column, trades: Column, left: Column) -> Column:
    """(state, probability) of ever losing the share ``left``: refused, certain, negligible or measured; powers in log space."""
    refused = ~calibrated | (trades < LEAST_TRADES) | win.isNull() | ~F.coalesce(payoff > 0, F.lit(False)) | ~F.coalesce(average_loss > 0, F.lit(False)) | ~((risk > 0) & (risk <= 1)) | ~((left > 0) & (left <= 1)) | (win >= 1)
    units = F.try_divide(left, risk * average_loss)
    power = units * F.log(stats.ruin_root(win, payoff))
    state = F.when(F.coalesce(refused, F.lit(True)), "refused").when(win * payoff - (1 - win) <= 0, "certain").when(power < log(LEAST_RUIN), "negligible").otherwise("measured")
    return F.struct(state.alias("state"), F.when(state == "certain", 1.0).when(state == "measured", F.least(F.lit(1.0), F.exp(power))).alias("probability"))


def evaluate(accounts: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Every scenario for every account; one narrow pass, the scenarios are an array of constants.

    ``accounts`` has (account, trades, wins, average_win_r, average_loss_r,
    calibrated, r_value_pct, current_drawdown_pct, open_risks, correlation,
    trades_per_day).  ``open_risks`` is null if the book was not supplied, an
    entry null if it was not measured; ``correlation`` is the mean of all pairs,
    null if one is missing.  An answer that could not be computed is a
    reduction, never an approval; only a measured breach blocks.
    """
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), *[F.lit(x).alias(k) for k, x in zip(("_times", "_less", "_shock", "_chance"), v)]) for n, v in SCENARIOS.items()]))
    c = F.col
    rows = accounts.withColumn("_s", each).select(*accounts.columns, "_s.*")
    held = F.size("open_risks")
    rows = rows.withColumn("_known", c("open_risks").isNotNull() & ~F.exists(F.coalesce("open_risks", F.array().cast("array<double>")), lambda r: r.isNull()))
    risks = F.transform(F.when(c("_known"), c("open_risks")), lambda r: F.abs(r))
    total = lambda f: F.aggregate(risks, F.lit(0.0), lambda a, r: a + f(r))
    rows = rows.withColumns({"_gross": total(lambda r: r), "_squares": total(lambda r: r * r), "_top": F.array_max(risks)})
    measured = (held >= 2) & c("correlation").between(-1, 1)
    rho = F.when(F.coalesce(measured, F.lit(False)), F.greatest(F.lit(0.0), c("correlation")) + c("_shock") * (1 - F.greatest(F.lit(0.0), c("correlation")))).otherwise(1.0)
    rows = rows.withColumn("open_loss_r", F.round(c("_gross") * c("_times"), 6)).withColumn("correlated_loss_r", F.round(F.sqrt((1 - rho) * c("_squares") + rho * c("_gross") * c("_gross")) * c("_times"), 6))
    remaining = F.lit(CEILING) - c("current_drawdown_pct")
    win = F.when(c("trades") >= LEAST_TRADES, c("wins") / c("trades"))
    invalid = ~F.coalesce((c("r_value_pct") > 0) & (c("r_value_pct") <= 1) & (c("current_drawdown_pct") >= 0) & (c("current_drawdown_pct") < 1), F.lit(False))
    rows = rows.withColumns({"_remaining": remaining, "_win": win, "_reason": F.when(invalid, "inputs").when(win.isNull(), "trades").when(c("average_loss_r").isNull(), "average_loss")})
    ok = c("_reason").isNull()
    rows = rows.withColumn("available", ok).withColumn("assumed_win_rate", F.when(ok, F.least(F.lit(1.0), F.greatest(F.lit(0.0), c("_win") + c("_less"))))).withColumn("assumed_loss_r", F.when(ok, c("average_loss_r") * c("_times")))
    rows = rows.withColumns({"typical_streak": F.when(ok, longest_run(c("assumed_win_rate"), horizon, TYPICAL_P)), "severe_streak": F.when(ok, longest_run(c("assumed_win_rate"), horizon, SEVERE_P))})
    rows = rows.withColumn("streak_r", F.when(c("_chance") == TYPICAL_P, c("typical_streak")).otherwise(c("severe_streak")) * c("assumed_loss_r"))
    rows = rows.withColumn("projected_r", c("streak_r") + c("open_loss_r")).withColumn("projected_pct", c("projected_r") * c("r_value_pct"))
    alone = F.when(c("streak_r") * c("r_value_pct") >= c("_remaining"), False)
    rows = rows.withColumn("survives", F.when(c("open_loss_r").isNull(), alone).otherwise(c("projected_pct") < c("_remaining")))
    room = c("_remaining") / c("r_value_pct") - F.coalesce("open_loss_r", F.lit(0.0))
    needed = F.least(F.lit(horizon + 1), F.ceil(room / c("assumed_loss_r"))).cast("int")
    rows = rows.withColumn("_floor", F.when(ok, F.when(room <= 0, 1.0).otherwise(run_probability(c("assumed_win_rate"), needed, horizon))))
    rows = rows.withColumn("drawdown_probability", F.when(c("_known"), c("_floor"))).withColumn("daily_loss_probability", F.when(ok, daily_loss(c("assumed_win_rate"), c("average_win_r"), c("assumed_loss_r"), c("trades_per_day"), DAILY_LIMIT_R)))
    rows = rows.withColumn("ruin", F.when(ok, ruin(c("assumed_win_rate"), c("average_win_r") / c("assumed_loss_r"), c("r_value_pct"), c("assumed_loss_r"), c("calibrated"), c("trades"), 1 - c("current_drawdown_pct"))))
    spare = c("_remaining") - c("open_loss_r") * c("r_value_pct")
    size = stats.floor_to(spare * SURVIVABLE_MARGIN / c("streak_r"), 6)
    asked = F.coalesce(~c("survives"), F.lit(False)) & c("open_loss_r").isNotNull() & (c("streak_r") > 0)
    rows = rows.withColumn("survivable_pct", F.when(asked & (spare > 0) & (size > 0), size))
    flags = lambda named: F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in named.items()]))
    breaches = {"ceiling": ~invalid & (c("_remaining") <= 0), "open_book": ~invalid & (c("_remaining") > 0) & (c("open_loss_r") * c("r_value_pct") >= c("_remaining")), "projection": ~c("survives") & (c("_remaining") > 0)}
    warnings = {
        "correlation": (held >= 2) & ~F.coalesce(measured, F.lit(False)), "book": ~c("_known"), "concentration": c("_top") / F.nullif(c("_gross"), F.lit(0.0)) > MOST_SHARE, "expectancy": ok & (c("average_win_r") / c("average_loss_r") * c("_win") <= 1 - c("_win")), "drawdown": c("_floor") >= DRAWDOWN_WARNING,
        "daily_unknown": ok & (c("trades_per_day").isNull() | c("average_win_r").isNull()), "daily": c("daily_loss_probability") >= DAILY_WARNING, "ruin": (c("ruin.state") == "measured") & (c("ruin.probability") >= RUIN_WARNING), "no_size": asked & c("survivable_pct").isNull(),
    }
    rows = rows.withColumn("breaches", flags(breaches)).withColumn("warnings", flags(warnings))
    verdict = F.when(F.size("breaches") > 0, "block").when(~ok | (F.size("warnings") > 0) | c("survives").isNull(), "reduce").otherwise("approve")
    return rows.withColumn("verdict", verdict).withColumnRenamed("_reason", "refused").select("account", "scenario", "verdict", "available", "refused", "assumed_win_rate", "assumed_loss_r", "typical_streak", "severe_streak", "streak_r", "open_loss_r", "correlated_loss_r", "projected_r", "projected_pct", "survives", "survivable_pct", "drawdown_probability", "daily_loss_probability", F.col("ruin.state").alias("ruin_state"), F.col("ruin.probability").alias("ruin_probability"), "breaches", "warnings")


def report(evaluated: DataFrame) -> DataFrame:
    """The worst verdict of each account, and cleared: every scenario ran, is known to survive and breaches nothing."""
    rank = F.when(F.col("verdict") == "block", 2).when(F.col("verdict") == "reduce", 1).otherwise(0)
    clear = F.col("available") & F.coalesce("survives", F.lit(False)) & (F.size("breaches") == 0)
    out = evaluated.groupBy("account").agg(F.max(rank).alias("_r"), F.every(clear).alias("cleared"), F.min("survivable_pct").alias("survivable_pct"))
    return out.select("account", F.element_at(F.array(F.lit("approve"), F.lit("reduce"), F.lit("block")), F.col("_r") + 1).alias("verdict"), "cleared", "survivable_pct")
