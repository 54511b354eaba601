"""Rules of funded accounts: drawdown floors, gates, targets and consistency, each day of each account.

A rule is a struct (imposed, value): not imposed, imposed with a value, or
imposed with a null value, which nobody entered.  What is unknown blocks; it
never passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import money

# Shares of an allowance and of a leverage cap that warn, room kept for slippage, days that consistency needs.
SPENT_WARNING, LEVERAGE_WARNING, SLIPPAGE_ROOM, CONSISTENCY_DAYS = 0.75, 0.75, 0.9, 3
RULES = ("daily_drawdown", "total_drawdown", "leverage", "positions", "news", "weekend", "least_days", "most_days", "target", "day_share")


def rule(value: Column | None, imposed: Column | None = None) -> Column:
    return F.struct((F.lit(True) if imposed is None else imposed).alias("imposed"), (F.lit(None) if value is None else value).cast("double").alias("value"))


def with_history(days: DataFrame) -> DataFrame:
    """Account days with what came before each: days traded, peaks on either basis, and the profit history's total, best day and length.

    One row an account and day; running maxima and sums are what a trailing anchor needs.
    """
    so_far = Window.partitionBy("account").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("account").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return days.withColumns({
        "days_traded": F.count(F.lit(1)).over(so_far).cast("int"), "peak_balance": F.coalesce(F.max("balance").over(before), F.col("starting_balance")), "peak_equity": F.coalesce(F.max("equity").over(before), F.col("starting_balance")),
        "profit_total": F.sum("profit").over(so_far), "profit_best": F.max("profit").over(so_far),
    })


def check(states: DataFrame) -> DataFrame:
    """The verdict on each state.

    Columns: account, day, starting_balance, balance, equity, day_balance,
    day_equity (at the day's opening), days_traded, peak_balance, peak_equity,
    profit_total, profit_best, open_positions, leverage, in_news_window,
    weekend_ahead, currency_per_r, proposed_r, basis (balance or equity),
    allowance_basis (starting, current or null), trailing (null: not
    entered) and a struct of each of ``RULES``.
    """
    c = F.col
    yes = lambda x: F.coalesce(x, F.lit(False))
    imposed, value = lambda n: c(f"{n}.imposed"), lambda n: c(f"{n}.value")
    by_equity = c("basis") == "equity"
    refused = c("starting_balance") <= 0
    rows = states.withColumn("_ref", F.when(by_equity, c("equity")).otherwise(c("balance")))
    ref = c("_ref")
    # A peak below the value of now is stale; the higher one is the stricter.
    peak = F.when(by_equity, c("peak_equity")).otherwise(c("peak_balance"))
    rows = rows.withColumn("_peak", F.greatest(peak, ref)).withColumn("_day", F.when(by_equity, c("day_equity")).otherwise(c("day_balance")))
    start = c("starting_balance")
    anchor = F.when(c("trailing"), c("_peak")).when(~c("trailing"), start).otherwise(F.greatest(c("_peak"), start))
    base = F.when(c("allowance_basis") == "starting", start).when(c("allowance_basis") == "current", F.coalesce(ref, start)).otherwise(F.least(start, ref))
    rows = rows.withColumn("_anchor", anchor).withColumn("_base", base)
    for name, at in (("daily", c("_day")), ("total", c("_anchor"))):
        pct = F.when(imposed(f"{name}_drawdown"), value(f"{name}_drawdown"))
        measurable = imposed(f"{name}_drawdown") & pct.isNotNull() & ref.isNotNull() & at.isNotNull()
        allowance = F.when(measurable, money(pct * c("_base")))
        rows = rows.withColumn(f"{name}_floor", F.when(measurable, money(at - allowance))).withColumn(f"_{name}_spent", (at - ref) / F.when(allowance > 0, allowance))
        rows = rows.withColumn(f"{name}_room", F.when(c(f"{name}_floor").isNotNull(), F.greatest(F.lit(0.0), ref - c(f"{name}_floor")))).withColumn(f"_{name}_broken", yes(ref < c(f"{name}_floor"))).withColumn(f"_{name}_open", imposed(f"{name}_drawdown") & c(f"{name}_floor").isNull())
    capped = lambda n: imposed(n) & value(n).isNotNull()
    flags = lambda named: F.array_compact(F.array(*[F.when(yes(t), F.lit(n)) for n, t in named.items()]))
    target_met = F.when(capped("target") & c("balance").isNotNull(), money(c("balance")) >= money(start * (1 + value("target"))))
    judged = (c("days_traded") >= CONSISTENCY_DAYS) & (c("profit_total") > 0)
    consistent = F.when(capped("day_share") & judged, c("profit_best") / c("profit_total") <= value("day_share"))
    rows = rows.withColumn("breaches", flags({
        "daily": c("_daily_broken"), "total": c("_total_broken"), "leverage": capped("leverage") & (c("leverage_now") > value("leverage")), "positions": capped("positions") & (c("open_positions") > value("positions")), "days": capped("most_days") & (c("days_traded") > value("most_days")),
    })).withColumn("gates", flags({
        "daily_unmeasured": c("_daily_open"), "total_unmeasured": c("_total_open"), "leverage_unmeasured": capped("leverage") & c("leverage_now").isNull(), "leverage_cap": capped("leverage") & (c("leverage_now") == value("leverage")), "position_cap": capped("positions") & (c("open_positions") == value("positions")),
        "news": capped("news") & F.coalesce(c("in_news_window"), F.lit(True)), "weekend": capped("weekend") & F.coalesce(c("weekend_ahead"), F.lit(True)),
    })).withColumn("warnings", flags({
        "daily_spent": ~c("_daily_broken") & (c("_daily_spent") >= SPENT_WARNING), "total_spent": ~c("_total_broken") & (c("_total_spent") >= SPENT_WARNING), "leverage_near": capped("leverage") & (c("leverage_now") < value("leverage")) & (c("leverage_now") >= LEVERAGE_WARNING * value("leverage")),
        "weekend_close": capped("weekend") & (c("weekend_ahead")) & (c("open_positions") > 0), "last_day": capped("most_days") & (c("days_traded") == value("most_days")), "target_met": target_met, "inconsistent": ~consistent,
    })).withColumn("unchecked", flags({n: imposed(n) & value(n).isNull() for n in RULES if n != "target"}))
    short = capped("least_days") & (c("days_traded") < value("least_days"))
    passed = yes(target_met) & ~yes(short) & (~capped("day_share") | yes(consistent))
    rows = rows.withColumn("status", F.when(refused, "in_progress").when(F.size("breaches") > 0, "failed").when(passed, "passed").otherwise("in_progress"))
    none = ~imposed("daily_drawdown") & ~imposed("total_drawdown")
    priced = yes(c("currency_per_r") > 0)
    left = ref - c("proposed_r") * c("currency_per_r")
    breaks = yes(left < c("daily_floor")) | yes(left < c("total_floor"))
    survivable = F.when(c("proposed_r").isNull() | (c("proposed_r") <= 0), None).when(none, True).when(~priced | ref.isNull(), None).when(breaks, False).when(c("_daily_open") | c("_total_open"), None).otherwise(True)
    room = F.least("daily_room", "total_room")
    measurable = ~(c("_daily_open") | c("_total_open") | (room.isNotNull() & ~priced))
    rows = rows.withColumn("survivable", F.when(~refused, survivable)).withColumn("_cap", F.when(measurable, room * SLIPPAGE_ROOM / c("currency_per_r")))
    asked = c("proposed_r")
    shut = refused | (F.size("breaches") > 0) | (F.size("gates") > 0) | ~measurable
    verdict = F.when(shut, "block").when(asked.isNull(), "approve").when((asked <= 0) | c("survivable").isNull(), "block").when(~c("survivable"), F.when(yes(c("_cap") > 0), "reduce").otherwise("block"))
    verdict = verdict.when(c("_cap").isNull(), "approve").when(c("_cap") <= 0, "block").when(c("_cap") < asked, "reduce").otherwise("approve")
    rows = rows.withColumn("verdict", verdict).withColumn("allowed", c("verdict") != "block").withColumn("most_additional_r", F.when(c("verdict") == "block", 0.0).otherwise(c("_cap")))
    void = lambda name: F.when(refused, F.array().cast("array<string>")).otherwise(c(name)).alias(name)
    blank = lambda name: F.when(~refused, c(name)).alias(name)
    return rows.select("account", "day", "status", "allowed", "verdict", "most_additional_r", blank("daily_floor"), blank("total_floor"), blank("daily_room"), blank("total_room"), "survivable", void("breaches"), void("gates"), void("warnings"), void("unchecked"))
