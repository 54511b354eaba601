"""Regime, analysts, weighted verdict, challenges, strategies and expected value, as staged columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats

# Margins, weights of the analysts and their adjustment by regime, and bounds of the verdict.
REGIME_MARGIN = 0.15
BASE_WEIGHTS = {"trend": 1.0, "structure": 0.6, "momentum": 0.6, "regime": 1.0, "history": 1.2, "volatility": 0.0, "session": 0.0, "data_quality": 0.0}
REGIME_WEIGHTS = {
    "range": {"trend": 0.5, "momentum": 1.2, "structure": 1.2},
    "trend_up": {"trend": 1.3, "momentum": 0.8},
    "trend_down": {"trend": 1.3, "momentum": 0.8},
    "high_volatility": {"history": 0.7, "structure": 0.7},
    "breakout": {"structure": 1.3, "trend": 1.2},
    "reversal": {"trend": 0.6, "history": 1.3},
}
MAX_DISAGREEMENT, LEAST_CONVICTION, NEUTRAL_BAND = 0.55, 0.20, 0.15
LEAST_REWARD_RISK, LEAST_EV_R = 0.5, 0.05
CONCERNS_TO_REDUCE, ABSTENTIONS_OF_THIN_EVIDENCE = 2, 3


def _one(x: Column) -> Column:
    return F.least(F.lit(1.0), x)


def _clip(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def regime_scores() -> Column:
    """Array of (regime, score) readings of a state row.

    A state has atr_14_pct, position_in_range_20, rsi_14, close_over_sma_20, the
    symbol's own range_p25 and range_p75, and short_strength, short_trend, medium_trend.
    """
    atr, p25, p75, position = F.col("atr_14_pct"), F.col("range_p25"), F.col("range_p75"), F.col("position_in_range_20")
    strength = F.abs("short_strength")
    reading = lambda when, regime, score: F.when(when, F.struct(F.lit(regime).alias("regime"), score.cast("double").alias("score")))
    tail = (position >= 0.95) | (position <= 0.05)
    mid = position.between(0.35, 0.65)
    expanding = F.coalesce(atr >= p75, F.lit(False))
    hot = (F.col("rsi_14") >= 70) & (F.col("close_over_sma_20") > 1)
    cold = (F.col("rsi_14") <= 30) & (F.col("close_over_sma_20") < 1)
    up = _one(_one(strength / 3.0) + F.when(hot, 0.1).otherwise(0.0))
    down = _one(_one(strength / 3.0) + F.when(cold, 0.1).otherwise(0.0))
    return F.array_compact(F.array(
        reading(atr >= p75, "high_volatility", _one(0.5 + (atr - p75) / F.greatest(p75, F.lit(1e-9)))),
        reading((atr <= p25) & ~(atr >= p75), "low_volatility", _one(0.5 + (p25 - atr) / F.greatest(p25, F.lit(1e-9)))),
        reading(F.col("short_trend") == "up", "trend_up", up),
        reading(F.col("short_trend") == "down", "trend_down", down),
        reading(F.col("short_trend") == "sideways", "range", _one(1.0 - strength)),
        reading(mid, "range", 0.4 + (1 - F.abs(position - 0.5) * 4) * 0.2),
        reading(tail & expanding, "breakout", F.lit(0.7)),
        reading(tail & ~expanding, "range", F.lit(0.35)),
        reading(F.col("short_trend").isin("up", "down") & F.col("medium_trend").isin("up", "down") & (F.col("short_trend") != F.col("medium_trend")), "reversal", F.lit(0.5)),
    ))


def regimes(states: DataFrame) -> DataFrame:
    """States with ``regime`` and ``regime_confidence``: the best reading must lead the next by 0.15, else it is uncertain.

    All within the row: readings of one regime merge to their maximum, then the two best are compared.
    """
    known = F.col("atr_14_pct").isNotNull() & F.col("position_in_range_20").isNotNull()
    merged = F.transform(F.array_distinct(F.transform("_r", lambda x: x["regime"])), lambda g: F.struct(F.array_max(F.transform(F.filter("_r", lambda x: x["regime"] == g), lambda x: x["score"])).alias("score"), g.alias("regime")))
    rows = states.withColumn("_r", F.when(known, regime_scores()).otherwise(F.array().cast("array<struct<regime:string,score:double>>"))).withColumn("_m", F.sort_array(merged, asc=False))
    first, second = F.try_element_at("_m", F.lit(1)), F.coalesce(F.try_element_at("_m", F.lit(2))["score"], F.lit(0.0))
    margin = first["score"] - second
    return rows.withColumn("regime_margin", margin).withColumn("regime", F.when(margin >= REGIME_MARGIN, first["regime"]).otherwise("uncertain")).withColumn("regime_confidence", F.when(margin >= REGIME_MARGIN, _one(margin * 2)).otherwise(0.0)).drop("_r", "_m")


def _opinion(name: str, available: Column, score: Column, confidence: Column, *codes: Column) -> Column:
    said = F.coalesce(available, F.lit(False))
    return F.struct(F.lit(name).alias("analyst"), (~said).alias("abstained"), F.when(said, _clip(score)).cast("double").alias("score"), F.when(said, confidence).cast("double").alias("confidence"), F.when(said, F.array_compact(F.array(*codes))).alias("codes"))


def opinions() -> Column:
    """The eight analysts' opinions of a state row with its regime.

    Besides the regime's inputs a state has sessions (array), is_open, history_share,
    history_count, history_stdev, history_median, eligible and stale; a null makes its analyst abstain.
    """
    strength, position, rsi = F.col("short_strength"), F.col("position_in_range_20"), F.col("rsi_14")
    base = _one(F.abs(strength) / 3.0)
    medium = F.col("medium_trend").isin("up", "down")
    conflict = medium & (F.col("medium_trend") != F.col("short_trend")) & F.col("short_trend").isin("up", "down")
    confidence = F.when(conflict, base * 0.5).when(medium, _one(base * 1.2)).otherwise(base)
    share = (F.col("history_share") - 0.5) * 2
    wide = (F.abs(share) > 0) & (F.col("history_stdev") > F.abs(F.coalesce("history_median", F.lit(0.0))) * 3)
    settled = _one(F.col("history_count") / 100.0)
    live = F.exists("sessions", lambda s: s != "off")
    trend = F.when(F.col("regime") == "trend_up", 0.6).when(F.col("regime") == "trend_down", -0.6).otherwise(0.0)
    return F.array(
        _opinion("trend", strength.isNotNull(), strength / 3.0, confidence, F.concat(F.lit("trend_"), F.col("short_trend")), F.when(conflict, "horizon_conflict").when(medium, "horizon_aligned")),
        _opinion("structure", position.isNotNull(), (position - 0.5) * 2, _one(F.abs((position - 0.5) * 2)), F.when(position > 0.65, "range_high").when(position < 0.35, "range_low").otherwise("mid_range")),
        _opinion("momentum", rsi.isNotNull(), (rsi - 50) / 50, _one(F.abs((rsi - 50) / 50) * 1.5), F.when(rsi >= 70, "overbought").when(rsi <= 30, "oversold").otherwise("momentum_neutral")),
        _opinion("volatility", F.col("atr_14_pct").isNotNull(), F.lit(0.0), F.lit(0.4), F.lit("volatility_measured"), F.when(F.col("atr_14_pct") >= F.col("range_p75"), "volatility_expanded").when(F.col("atr_14_pct") <= F.col("range_p25"), "volatility_compressed")),
        _opinion("session", F.col("sessions").isNotNull(), F.lit(0.0), F.when(live, 0.6).otherwise(0.2), F.when(F.col("is_open"), "market_open").otherwise("market_closed"), F.when(~live, "thin_liquidity")),
        _opinion("regime", F.col("regime") != "uncertain", trend, F.col("regime_confidence"), F.concat(F.lit("regime_"), F.col("regime"))),
        _opinion("history", F.col("history_share").isNotNull(), share, F.when(wide, settled * 0.5).otherwise(settled), F.when(share > 0, "history_bullish").otherwise("history_bearish"), F.when(wide, "history_disagrees")),
        _opinion("data_quality", F.col("eligible").isNotNull(), F.lit(0.0), F.when(F.col("stale"), 0.0).when(~F.col("eligible"), 0.3).otherwise(1.0), F.when(~F.col("eligible"), "data_not_training_eligible"), F.when(F.col("stale"), "stale_data"), F.when(F.col("eligible") & ~F.coalesce("stale", F.lit(False)), "data_ok")),
    )


def weight(analyst: Column, regime: Column) -> Column:
    """An analyst's weight in a regime."""
    out = F.lit(0.0)
    for name, base in BASE_WEIGHTS.items():
        factor = F.lit(1.0)
        for r, adjust in REGIME_WEIGHTS.items():
            if name in adjust:
                factor = F.when(regime == r, adjust[name]).otherwise(factor)
        out = F.when(analyst == name, base * factor).otherwise(out)
    return out


def verdicts(states: DataFrame) -> DataFrame:
    """States with opinions, conviction, disagreement and a decision; all within the row."""
    rows = states.withColumn("opinions", opinions()).withColumn("_v", F.filter("opinions", lambda o: ~o["abstained"] & (weight(o["analyst"], F.col("regime")) > 0)))
    w = lambda o: weight(o["analyst"], F.col("regime")) * F.greatest(o["confidence"], F.lit(0.0))
    total = lambda f: F.aggregate(F.transform("_v", f), F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumn("_w", total(w)).withColumn("conviction", F.when(F.col("_w") > 0, total(lambda o: w(o) * o["score"]) / F.col("_w")).otherwise(0.0))
    rows = rows.withColumn("_d", F.transform(F.filter("_v", lambda o: F.abs(o["score"]) >= NEUTRAL_BAND), lambda o: o["score"])).withColumn("_dm", F.aggregate("_d", F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size("_d"), F.lit(0)))
    spread = F.sqrt(F.aggregate("_d", F.lit(0.0), lambda a, x: a + (x - F.col("_dm")) * (x - F.col("_dm"))) / F.size("_d"))
    rows = rows.withColumn("disagreement", F.when(F.size("_d") > 1, spread).otherwise(0.0)).withColumn("abstained", F.size(F.filter("opinions", lambda o: o["abstained"])))
    reason = F.when(F.size("_v") == 0, "no_reading").when(F.col("disagreement") > MAX_DISAGREEMENT, "disagreement").when(F.abs("conviction") < LEAST_CONVICTION, "conviction")
    rows = rows.withColumn("suppressed", reason)
    return rows.withColumn("decision", F.when(reason.isNotNull(), "wait").when(F.col("conviction") > 0, "buy").otherwise("sell")).drop("_v", "_w", "_d", "_dm")


def challenges(judged: DataFrame) -> DataFrame:
    """Verdicts with the reasons against them and clear, reduce (two concerns) or block."""
    said = lambda analyst, code: F.exists("opinions", lambda o: (o["analyst"] == analyst) & F.array_contains(F.coalesce(o["codes"], F.array().cast("array<string>")), code))
    history = lambda f: F.exists("opinions", lambda o: (o["analyst"] == "history") & f(o))
    blocking = F.array_compact(F.array(F.when(said("data_quality", "stale_data"), "stale_data"), F.when(said("session", "market_closed"), "market_closed"), F.when(history(lambda o: ~o["abstained"] & (o["score"] * F.col("conviction") < 0)), "history_contradicts")))
    concerns = F.array_compact(F.array(
        F.when(said("data_quality", "data_not_training_eligible"), "poor_data_quality"), F.when(said("session", "thin_liquidity"), "thin_liquidity"), F.when(said("volatility", "volatility_expanded"), "volatility_expanded"),
        F.when(F.col("disagreement") > MAX_DISAGREEMENT * 0.7, "council_split"), F.when(history(lambda o: o["abstained"]), "no_historical_support"), F.when((F.col("decision") == "buy") & said("momentum", "overbought"), "buying_overbought"),
        F.when((F.col("decision") == "sell") & said("momentum", "oversold"), "selling_oversold"), F.when(F.col("abstained") >= ABSTENTIONS_OF_THIN_EVIDENCE, "thin_evidence"),
    ))
    rows = judged.withColumn("blocking", blocking).withColumn("concerns", concerns)
    return rows.withColumn("challenge", F.when(F.size("blocking") > 0, "block").when(F.size("concerns") >= CONCERNS_TO_REDUCE, "reduce").otherwise("clear")).withColumn("final_conviction", F.when(F.col("challenge") == "reduce", F.col("conviction") * 0.5).otherwise(F.col("conviction")))


def proposals(challenged: DataFrame) -> DataFrame:
    """Challenged verdicts with what is proposed: the decision, or wait with every reason for it.

    A suppressed verdict and each blocking challenge are reasons; the conviction
    of a decision is halved where the challenges say reduce, and 0 for a wait.
    """
    reasons = F.concat(F.array_compact(F.array("suppressed")), "blocking")
    rows = challenged.withColumn("wait_reasons", reasons)
    go = F.size("wait_reasons") == 0
    return rows.withColumn("proposed", F.when(go, F.col("decision")).otherwise("wait")).withColumn("proposed_conviction", F.when(go, F.abs("final_conviction")).otherwise(0.0))


def strategies(states: DataFrame) -> DataFrame:
    """One row per strategy of each state that suits its regime, fired or not."""
    rsi, over, position, regime = F.col("rsi_14"), F.col("close_over_sma_20"), F.col("position_in_range_20"), F.col("regime")
    pullback = F.when(regime == "trend_up", (over > 1) & rsi.between(40, 60)).when(regime == "trend_down", (over < 1) & rsi.between(40, 60))
    fade = F.when(regime == "range", ((position >= 0.85) & (rsi >= 65)) | ((position <= 0.15) & (rsi <= 35)))
    breakout = F.when(regime == "breakout", position.isNotNull() & F.coalesce(F.col("short_trend").isin("up", "down"), F.lit(False)))
    aside = F.when(regime.isin("high_volatility", "uncertain"), F.lit(True))
    setup = lambda name, fired, direction: F.when(fired.isNotNull(), F.struct(F.lit(name).alias("strategy"), fired.alias("fired"), F.when(fired, direction).otherwise("wait").alias("direction")))
    all_ = F.array_compact(F.array(
        setup("trend_pullback", pullback, F.when(regime == "trend_up", "buy").otherwise("sell")), setup("range_fade", fade, F.when(position >= 0.85, "sell").otherwise("buy")),
        setup("breakout_continuation", breakout, F.when(position >= 0.5, "buy").otherwise("sell")), setup("volatility_stand_aside", aside, F.lit("wait")),
    ))
    return states.withColumn("_s", F.explode(all_)).select(*states.columns, "_s.strategy", "_s.fired", "_s.direction")


def expected_value(trades: DataFrame) -> DataFrame:
    """Trades (entry, stop, target, side, probability, costs) with expected value in price and R, and a verdict.

    Levels on the wrong side, or no probability, leave the values null and the verdict ``unavailable``.
    """
    risk, reward = (F.col("entry") - F.col("stop")) * F.col("side"), (F.col("target") - F.col("entry")) * F.col("side")
    rows = trades.withColumn("risk", risk).withColumn("reward", reward).withColumn("_ok", (F.col("entry") > 0) & (F.col("risk") > 0) & (F.col("reward") > 0) & F.col("probability").isNotNull())
    value = F.col("probability") * F.col("reward") - (1 - F.col("probability")) * F.col("risk") - F.col("costs")
    rows = rows.withColumn("reward_risk", F.when(F.col("_ok"), F.col("reward") / F.col("risk"))).withColumn("expected_value", F.when(F.col("_ok"), value))
    rows = rows.withColumn("expected_r", F.when(F.col("_ok"), F.col("expected_value") / F.col("risk"))).withColumn("breakeven", F.when(F.col("_ok"), stats.breakeven_probability(F.col("reward"), F.col("risk"), F.col("costs"))))
    verdict = F.when(~F.coalesce("_ok", F.lit(False)), "unavailable").when((F.col("reward_risk") < LEAST_REWARD_RISK) | (F.col("expected_r") < LEAST_EV_R), "wait").otherwise("trade")
    return rows.withColumn("verdict", verdict).drop("_ok")


def first_failure(stages: dict[str, Column]) -> Column:
    """The first stage that does not hold, in order; ``intent`` if all do."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in stages.items()], F.lit("intent"))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
