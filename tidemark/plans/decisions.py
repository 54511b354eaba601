"""Queries over profiles, similarity, cross-sections, measurement, risk and operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import asof, calendars, crosssection, features, learning, neighbours, operations, outcomes, profiles, risk, scoring
from ..sources import bars as B
from ..sources import stores
from .registry import AS_OF, BARS_A, BARS_B, BARS_C, BITEMPORAL, KNOWN, ORACLES, W, frame, query, rounded, steps
from .series import _OUTCOME, A, H, _session_sql, feature_sql, known


def _disc(column: str, prefix: str) -> str:
    return ", ".join(f"round(list_sort(list({column}) FILTER (WHERE {column} IS NOT NULL))[CAST(ceil({p / 100} * count({column})) AS BIGINT)], 6) AS {prefix}_p{p}" for p in profiles.PERCENTS)


def _names(prefix: str) -> list[str]:
    return [f"{prefix}_p{p}" for p in profiles.PERCENTS]


_RANGES = f"{steps('a')}, rg AS (SELECT *, CASE WHEN close > 0 THEN (high - low) / close END AS range_pct, abs(ret) AS abs_ret FROM st)"


@query(f"WITH {BARS_A}, {_RANGES} SELECT symbol, count(*) AS bars, {_disc('range_pct', 'range')}, round(avg(range_pct), 6) AS range_mean, round(stddev_pop(ret), 6) AS return_stdev, {_disc('abs_ret', 'abs_return')} FROM rg GROUP BY symbol HAVING count(*) >= 200")
def profile_volatility(spark, sf_dir):
    return rounded(profiles.volatility(A(spark, sf_dir)), *_names("range"), "range_mean", "return_stdev", *_names("abs_return"))


@query(f"""WITH {BARS_A}, {_RANGES}, t AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS total, {_session_sql('event_time')} AS l FROM rg), u AS (SELECT symbol, range_pct, total, unnest(CASE WHEN len(l) = 0 THEN ['off'] ELSE l END) AS session FROM t),
g AS (SELECT symbol, session, count(*) AS bars, count(*) / max(total) AS share, avg(range_pct) AS mean_range, median(range_pct) AS median_range FROM u WHERE total >= 200 GROUP BY 1, 2 HAVING count(*) >= 30)
SELECT symbol, session, bars, round(share, 6) AS share, round(mean_range, 6) AS mean_range, round(median_range, 6) AS median_range, row_number() OVER (PARTITION BY symbol ORDER BY mean_range DESC, session) = 1 AS busiest FROM g""")
def profile_session(spark, sf_dir):
    return rounded(profiles.sessions(A(spark, sf_dir)), "share", "mean_range", "median_range")


@query(f"WITH {BARS_A}, {_RANGES} SELECT symbol, CAST(hour(event_time) AS INTEGER) AS hour, CAST(isodow(event_time) - 1 AS INTEGER) AS weekday, count(*) AS bars, round(avg(range_pct), 6) AS mean_range FROM rg GROUP BY GROUPING SETS ((symbol, hour(event_time)), (symbol, isodow(event_time) - 1)) HAVING count(*) >= 30")
def profile_clock(spark, sf_dir):
    return rounded(profiles.clock(A(spark, sf_dir)), "mean_range")


@query(f"""WITH {BARS_A}, {_RANGES}, m AS (SELECT *, avg(ret) OVER (PARTITION BY symbol) AS mu, lead(ret) OVER {W} AS nx, abs(close - open) / nullif(high - low, 0) AS body, CASE WHEN prev > 0 THEN abs(open - prev) / prev END AS gap FROM rg),
g AS (SELECT symbol, count(*) AS bars, avg((ret - mu) * (nx - mu)) / nullif(var_pop(ret), 0) AS ac, avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0.0 END) AS up_share, {_disc('body', 'body')}, {_disc('gap', 'gap')} FROM m GROUP BY symbol HAVING count(*) >= 200)
SELECT symbol, bars, round(ac, 6) AS autocorrelation, round(up_share, 6) AS up_share, {', '.join(_names('body') + _names('gap'))}, CASE WHEN ac > 0.05 THEN 'trending' WHEN ac < -0.05 THEN 'mean_reverting' ELSE 'neutral' END AS tendency FROM g""")
def profile_structure(spark, sf_dir):
    return rounded(profiles.structure(A(spark, sf_dir)), "autocorrelation", "up_share", *_names("body"), *_names("gap"))


@query(f"WITH {BARS_A}, v AS (SELECT symbol, CASE WHEN volume > 0 THEN volume END AS v FROM a) SELECT symbol, count(v) AS volumes, round(avg(v), 6) AS volume_mean, {_disc('v', 'volume')} FROM v GROUP BY symbol HAVING count(v) >= 200")
def profile_liquidity(spark, sf_dir):
    return rounded(profiles.liquidity(A(spark, sf_dir)).where("volumes >= 200"), "volume_mean", *_names("volume"))


_CORR = f"{steps('c')}, cp AS (SELECT x.symbol AS a, y.symbol AS b, count(*) AS shared, CASE WHEN stddev_pop(x.ret) > 0 AND stddev_pop(y.ret) > 0 THEN corr(x.ret, y.ret) END AS r FROM st x JOIN st y ON x.event_time = y.event_time AND x.symbol < y.symbol WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 200)"


@query(f"WITH {BARS_C}, {_CORR} SELECT a, b, shared, round(r, 6) AS r FROM cp")
def correlation_pairs(spark, sf_dir):
    return rounded(profiles.correlations(B.weekly_nation_bars(spark, sf_dir)), "r")


@query(f"WITH {BARS_C}, {_CORR} SELECT a, b, shared, round(r, 6) AS r, abs(r) >= 0.7 AS clustered FROM cp WHERE r IS NOT NULL ORDER BY abs(r) DESC, a, b LIMIT 200")
def correlation_map(spark, sf_dir):
    return rounded(profiles.correlation_map(profiles.correlations(B.weekly_nation_bars(spark, sf_dir))), "r")


_MEMORY = f"""hz(horizon, days, least_bars) AS (VALUES ('short', 3, 20), ('medium', 90, 100), ('long', 1095, 250)),
mr AS (SELECT horizon, least_bars, k.*, row_number() OVER (PARTITION BY horizon, symbol ORDER BY event_time DESC) AS age FROM k, hz WHERE epoch(event_time) >= epoch(TIMESTAMP '{AS_OF}') - days * 86400),
mw AS (SELECT *, lag(close) OVER v AS prev, max(close) OVER v AS peak, min(close) OVER v AS trough FROM mr WHERE age <= 20000 WINDOW v AS (PARTITION BY horizon, symbol ORDER BY event_time ROWS UNBOUNDED PRECEDING)),
mx AS (SELECT *, CASE WHEN prev > 0 AND close > 0 THEN ln(close / prev) END AS ret FROM mw),
mg AS (SELECT symbol, horizon, count(*) AS bars, min(event_time) AS window_start, max(event_time) AS window_end, min_by(open, event_time) AS open, max_by(close, event_time) AS close, max(high) AS high, min(low) AS low, CASE WHEN count(ret) > 1 THEN stddev_pop(ret) END AS realized_vol, count(ret) AS kk,
 max((peak - close) / peak) AS max_drawdown_pct, max((close - trough) / trough) AS max_runup_pct, max_by(age, ROW(high, age)) - 1 AS bars_since_high, min_by(age, ROW(low, -age)) - 1 AS bars_since_low FROM mx GROUP BY 1, 2 HAVING count(*) >= max(least_bars)),
ms AS (SELECT *, ln(close / open) AS return_pct, (close - low) / nullif(high - low, 0) AS position_in_range, CASE WHEN realized_vol > 0 THEN ln(close / open) / (realized_vol * sqrt(kk)) END AS trend_strength FROM mg),
mm AS (SELECT *, CASE WHEN trend_strength >= 1 THEN 'up' WHEN trend_strength <= -1 THEN 'down' WHEN trend_strength IS NOT NULL THEN 'sideways' END AS trend FROM ms)"""
_MEMORY_ROUND = ["open", "close", "high", "low", "realized_vol", "max_drawdown_pct", "max_runup_pct", "return_pct", "position_in_range", "trend_strength"]


@query(f"WITH {BARS_A}, {BITEMPORAL}, {KNOWN}, {_MEMORY} SELECT symbol, horizon, bars, window_start, window_end, {', '.join(f'round({c}, 6) AS {c}' for c in _MEMORY_ROUND)}, CAST(bars_since_high AS BIGINT) AS bars_since_high, CAST(bars_since_low AS BIGINT) AS bars_since_low, trend FROM mm")
def memory_horizons(spark, sf_dir):
    out = profiles.memory(known(spark, sf_dir), AS_OF)
    return rounded(out.withColumns({c: F.col(c).cast("long") for c in ("bars_since_high", "bars_since_low")}), *_MEMORY_ROUND)


@query(f"WITH {BARS_A}, {BITEMPORAL}, {KNOWN}, {_MEMORY} SELECT symbol, count(*) FILTER (WHERE trend IN ('up', 'down')) AS directional, CASE WHEN count(*) FILTER (WHERE trend IN ('up', 'down')) >= 2 THEN count(DISTINCT CASE WHEN trend IN ('up', 'down') THEN trend END) = 1 END AS agree FROM mm GROUP BY symbol")
def memory_agreement(spark, sf_dir):
    return profiles.memory_agreement(profiles.memory(known(spark, sf_dir), AS_OF))


KNN = ["rsi_14", "atr_14_pct", "position_in_range_20", "body_ratio"]


def _episodes(spark, sf_dir):
    return outcomes.episodes(A(spark, sf_dir), B.HOUR, H, cutoff=AS_OF, names=KNN).withColumn("id", F.concat_ws("@", "symbol", F.unix_timestamp("event_time")))


_EPISODES = f"{steps('a')}, fs AS (SELECT symbol, event_time, {feature_sql(KNN, 15)} FROM st), {_OUTCOME}, ep AS (SELECT oc.*, fs.* EXCLUDE (symbol, event_time), concat_ws('@', oc.symbol, CAST(epoch(oc.event_time) AS BIGINT)) AS id FROM oc JOIN fs USING (symbol, event_time) WHERE outcome_ready_at <= TIMESTAMP '{AS_OF}')"
_SCALE = ("tl AS (" + " UNION ALL ".join(f"SELECT '{n}' AS name, {n} AS v FROM ep WHERE {n} IS NOT NULL" for n in KNN) + """), rk AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY name) AS n FROM tl),
sc AS (SELECT name, max(n) AS n, median(v) AS center, max(CASE WHEN i = n // 4 THEN v END) AS q1, max(CASE WHEN i = 3 * n // 4 THEN v END) AS q3 FROM rk GROUP BY name)""")


@query(f"WITH {BARS_A}, {_EPISODES}, {_SCALE} SELECT name, n, round(center, 6) AS center, round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS spread FROM sc WHERE n >= 20 AND q3 > q1")
def robust_scaler(spark, sf_dir):
    return rounded(neighbours.scaler(neighbours.tall(_episodes(spark, sf_dir), ["id"], KNN)), "center", "q1", "q3", "spread")


def _neighbours(spark, sf_dir):
    library = stores.stored(_episodes(spark, sf_dir).select("id", "symbol", "event_time", "forward_return_pct", *KNN), "episodes")  # scales and neighbours read it
    scales = neighbours.scaler(neighbours.tall(library, ["id"], KNN))
    ready = neighbours.scaled(library, scales, KNN)
    asked = neighbours.scaled(features.latest(known(spark, sf_dir), KNN).select(F.col("symbol").alias("query_id"), *KNN), scales, KNN)
    return neighbours.nearest(asked, ready, KNN)


#: A feature with under 20 values, or whose quartiles agree, has no scale and counts in no distance.
_Z = ", ".join(f"({n} - (SELECT center FROM sc WHERE name = '{n}' AND n >= 20 AND q3 > q1)) / (SELECT q3 - q1 FROM sc WHERE name = '{n}' AND n >= 20 AND q3 > q1) AS {n}" for n in KNN)
_NEAR = f"""qs0 AS (SELECT *, lag(close) OVER {W} AS prev, row_number() OVER {W} AS n FROM k), qst AS (SELECT *, CASE WHEN prev > 0 AND close > 0 THEN ln(close / prev) END AS ret, CASE WHEN prev IS NOT NULL THEN greatest(high - low, abs(high - prev), abs(low - prev)) END AS tr,
 CASE WHEN prev IS NOT NULL THEN greatest(close - prev, 0) END AS up, CASE WHEN prev IS NOT NULL THEN greatest(prev - close, 0) END AS down FROM qs0), qf AS (SELECT symbol, event_time, {feature_sql(KNN, 15)} FROM qst), ql AS (SELECT * FROM qf QUALIFY event_time = max(event_time) OVER (PARTITION BY symbol)),
lz AS (SELECT id, symbol, event_time, forward_return_pct, {_Z} FROM ep), qz AS (SELECT symbol AS query_id, {_Z} FROM ql),
pr AS (SELECT query_id, id, forward_return_pct, {' + '.join(f'CASE WHEN lz.{n} IS NOT NULL AND qz.{n} IS NOT NULL THEN 1 ELSE 0 END' for n in KNN)} AS shared, {' + '.join(f'coalesce((lz.{n} - qz.{n}) ** 2, 0)' for n in KNN)} AS sq FROM lz, qz),
ne AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS place FROM (SELECT *, sqrt(sq / shared) AS distance FROM pr WHERE shared >= 1) WHERE distance <= 2.0 QUALIFY place <= 50)"""


@query(f"WITH {BARS_A}, {BITEMPORAL}, {KNOWN}, {_EPISODES}, {_SCALE}, {_NEAR} SELECT query_id, place, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS similarity FROM ne")
def knn_similar(spark, sf_dir):
    return rounded(_neighbours(spark, sf_dir).select("query_id", F.col("place").cast("long").alias("place"), "distance", "similarity"), "distance", "similarity")


@query(f"WITH {BARS_A}, {BITEMPORAL}, {KNOWN}, {_EPISODES}, {_SCALE}, {_NEAR} SELECT query_id, count(*) AS matches, round(min(distance), 6) AS closest, round(max(distance), 6) AS farthest FROM ne GROUP BY query_id")
def knn_uncertainty(spark, sf_dir):
    return rounded(neighbours.uncertainty(_neighbours(spark, sf_dir)).select("query_id", "matches", "closest", "farthest"), "closest", "farthest")


STATE = ["atr_14_pct", "position_in_range_20", "close_over_sma_20", "rsi_14"]


def states(spark, sf_dir):
    """World state of each symbol at the cutoff: every block joined onto one row per symbol, null where unavailable."""
    seen = known(spark, sf_dir)
    memory = profiles.memory(seen, AS_OF)
    horizon = lambda h: memory.where(F.col("horizon") == h).select("symbol", F.col("trend_strength").alias(f"{h}_strength"), F.col("trend").alias(f"{h}_trend"))
    volatility = profiles.volatility(seen).select("symbol", F.col("range_p25"), F.col("range_p75"))
    fresh = asof.freshness(seen, AS_OF, B.HOUR).select("symbol", "stale")
    built = outcomes.episodes(A(spark, sf_dir), B.HOUR, H, cutoff=AS_OF, names=[])
    past = built.groupBy("symbol").agg(F.count(F.lit(1)).cast("double").alias("history_count"), F.avg((F.col("forward_return_pct") > 0).cast("double")).alias("history_share"), F.stddev_pop("forward_return_pct").alias("history_stdev"), F.median("forward_return_pct").alias("history_median"))
    rows = features.latest(seen, STATE).select("symbol", "event_time", *STATE)
    for block in (horizon("short"), horizon("medium"), volatility, fresh, past):
        rows = rows.join(block, "symbol", "left")
    now = asof.instant(AS_OF)
    counts = B.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("symbol")).agg((F.count(F.lit(1)) % 2 == 0).alias("eligible"))
    # Symbols up to p keep currency hours, the others trade all the time.
    hours = F.when(F.col("symbol") < "p", calendars.within_hours(now, *calendars.FX_HOURS)).otherwise(calendars.within_hours(now, *calendars.CRYPTO_HOURS))
    return rows.join(counts, "symbol", "left").withColumn("sessions", calendars.active_sessions(now)).withColumn("is_open", hours)


_STATE = f"""{_MEMORY}, zs0 AS (SELECT *, lag(close) OVER {W} AS prev, row_number() OVER {W} AS n FROM k), zst AS (SELECT *, CASE WHEN prev > 0 AND close > 0 THEN ln(close / prev) END AS ret, CASE WHEN prev IS NOT NULL THEN greatest(high - low, abs(high - prev), abs(low - prev)) END AS tr,
 CASE WHEN prev IS NOT NULL THEN greatest(close - prev, 0) END AS up, CASE WHEN prev IS NOT NULL THEN greatest(prev - close, 0) END AS down FROM zs0), zf AS (SELECT symbol, event_time, {feature_sql(STATE, 15)} FROM zst), zl AS (SELECT * FROM zf QUALIFY event_time = max(event_time) OVER (PARTITION BY symbol)),
zv AS (SELECT symbol, list_sort(list((high - low) / close))[CAST(ceil(0.25 * count(*)) AS BIGINT)] AS p25, list_sort(list((high - low) / close))[CAST(ceil(0.75 * count(*)) AS BIGINT)] AS p75 FROM k GROUP BY symbol HAVING count(*) >= 200),
zz AS (SELECT zl.*, p25, p75, s.trend_strength AS ss, s.trend AS stt, m.trend AS mt FROM zl LEFT JOIN zv USING (symbol) LEFT JOIN (SELECT * FROM mm WHERE horizon = 'short') s USING (symbol) LEFT JOIN (SELECT * FROM mm WHERE horizon = 'medium') m USING (symbol)),
zr AS (SELECT symbol, 'high_volatility' AS regime, least(1.0, 0.5 + (atr_14_pct - p75) / greatest(p75, 1e-9)) AS score FROM zz WHERE atr_14_pct >= p75 UNION ALL SELECT symbol, 'low_volatility', least(1.0, 0.5 + (p25 - atr_14_pct) / greatest(p25, 1e-9)) FROM zz WHERE atr_14_pct <= p25 AND NOT atr_14_pct >= p75
 UNION ALL SELECT symbol, 'trend_up', least(1.0, least(1.0, abs(ss) / 3) + CASE WHEN rsi_14 >= 70 AND close_over_sma_20 > 1 THEN 0.1 ELSE 0 END) FROM zz WHERE stt = 'up' UNION ALL SELECT symbol, 'trend_down', least(1.0, least(1.0, abs(ss) / 3) + CASE WHEN rsi_14 <= 30 AND close_over_sma_20 < 1 THEN 0.1 ELSE 0 END) FROM zz WHERE stt = 'down'
 UNION ALL SELECT symbol, 'range', least(1.0, 1 - abs(ss)) FROM zz WHERE stt = 'sideways' UNION ALL SELECT symbol, 'range', 0.4 + (1 - abs(position_in_range_20 - 0.5) * 4) * 0.2 FROM zz WHERE position_in_range_20 BETWEEN 0.35 AND 0.65
 UNION ALL SELECT symbol, CASE WHEN coalesce(atr_14_pct >= p75, false) THEN 'breakout' ELSE 'range' END, CASE WHEN coalesce(atr_14_pct >= p75, false) THEN 0.7 ELSE 0.35 END FROM zz WHERE position_in_range_20 >= 0.95 OR position_in_range_20 <= 0.05 UNION ALL SELECT symbol, 'reversal', 0.5 FROM zz WHERE stt IN ('up', 'down') AND mt IN ('up', 'down') AND stt <> mt),
zm AS (SELECT symbol, regime, max(score) AS score FROM zr GROUP BY 1, 2), zk AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, regime DESC) AS k, lead(score) OVER (PARTITION BY symbol ORDER BY score DESC, regime DESC) AS nx FROM zm),
zg AS (SELECT zz.*, score - coalesce(nx, 0) AS margin, CASE WHEN score - coalesce(nx, 0) >= 0.15 THEN zk.regime ELSE 'uncertain' END AS regime, CASE WHEN score - coalesce(nx, 0) >= 0.15 THEN least(1.0, 2 * (score - coalesce(nx, 0))) ELSE 0.0 END AS confidence FROM zz LEFT JOIN (SELECT * FROM zk WHERE k = 1) zk USING (symbol))"""


@query(f"WITH {BARS_A}, {BITEMPORAL}, {KNOWN}, {_STATE} SELECT symbol, regime, round(margin, 6) AS regime_margin, round(confidence, 6) AS regime_confidence FROM zg")
def regime_classify(spark, sf_dir):
    return rounded(scoring.regimes(states(spark, sf_dir)).select("symbol", "regime", "regime_margin", "regime_confidence"), "regime_margin", "regime_confidence")


_STRATEGY = """SELECT symbol, 'trend_pullback' AS strategy, (CASE WHEN regime = 'trend_up' THEN close_over_sma_20 > 1 ELSE close_over_sma_20 < 1 END) AND rsi_14 BETWEEN 40 AND 60 AS fired, CASE WHEN (CASE WHEN regime = 'trend_up' THEN close_over_sma_20 > 1 ELSE close_over_sma_20 < 1 END) AND rsi_14 BETWEEN 40 AND 60 THEN CASE WHEN regime = 'trend_up' THEN 'buy' ELSE 'sell' END ELSE 'wait' END AS direction FROM zg WHERE regime IN ('trend_up', 'trend_down')
UNION ALL SELECT symbol, 'range_fade', (position_in_range_20 >= 0.85 AND rsi_14 >= 65) OR (position_in_range_20 <= 0.15 AND rsi_14 <= 35), CASE WHEN position_in_range_20 >= 0.85 AND rsi_14 >= 65 THEN 'sell' WHEN position_in_range_20 <= 0.15 AND rsi_14 <= 35 THEN 'buy' ELSE 'wait' END FROM zg WHERE regime = 'range'
UNION ALL SELECT symbol, 'breakout_continuation', coalesce(stt IN ('up', 'down'), false), CASE WHEN coalesce(stt IN ('up', 'down'), false) THEN CASE WHEN position_in_range_20 >= 0.5 THEN 'buy' ELSE 'sell' END ELSE 'wait' END FROM zg WHERE regime = 'breakout'
UNION ALL SELECT symbol, 'volatility_stand_aside', true, 'wait' FROM zg WHERE regime IN ('high_volatility', 'uncertain')"""


@query(f"WITH {BARS_A}, {BITEMPORAL}, {KNOWN}, {_STATE} {_STRATEGY}")
def strategy_signals(spark, sf_dir):
    return scoring.strategies(scoring.regimes(states(spark, sf_dir))).select("symbol", "strategy", "fired", "direction")


_WEIGHT = """CASE analyst WHEN 'trend' THEN 1.0 * CASE regime WHEN 'range' THEN 0.5 WHEN 'trend_up' THEN 1.3 WHEN 'trend_down' THEN 1.3 WHEN 'breakout' THEN 1.2 WHEN 'reversal' THEN 0.6 ELSE 1.0 END WHEN 'structure' THEN 0.6 * CASE regime WHEN 'range' THEN 1.2 WHEN 'high_volatility' THEN 0.7 WHEN 'breakout' THEN 1.3 ELSE 1.0 END
 WHEN 'momentum' THEN 0.6 * CASE regime WHEN 'range' THEN 1.2 WHEN 'trend_up' THEN 0.8 WHEN 'trend_down' THEN 0.8 ELSE 1.0 END WHEN 'regime' THEN 1.0 WHEN 'history' THEN 1.2 * CASE regime WHEN 'high_volatility' THEN 0.7 WHEN 'reversal' THEN 1.3 ELSE 1.0 END ELSE 0.0 END"""
_NOW = f"TIMESTAMP '{AS_OF}'"
_COUNCIL = f"""{BARS_A}, {BITEMPORAL}, {KNOWN}, {_STATE}, {_OUTCOME},
zh AS (SELECT symbol, count(*) AS hc, avg(CASE WHEN forward_return_pct > 0 THEN 1.0 ELSE 0.0 END) AS hs, stddev_pop(forward_return_pct) AS hd, median(forward_return_pct) AS hm FROM oc WHERE outcome_ready_at <= {_NOW} GROUP BY 1),
cs AS (SELECT zg.*, hc, (hs - 0.5) * 2 AS share, abs((hs - 0.5) * 2) > 0 AND hd > abs(coalesce(hm, 0)) * 3 AS wide, least(1.0, hc / 100.0) AS settled, stale, eligible, CASE WHEN symbol < 'p' THEN false ELSE true END AS is_open, len({_session_sql(_NOW)}) > 0 AS live, mt IN ('up', 'down') AS medium, mt IN ('up', 'down') AND stt IN ('up', 'down') AND mt <> stt AS conflict,
 least(1.0, abs(ss) / 3) AS base, position_in_range_20 AS pos, rsi_14 AS rsi, atr_14_pct AS atr FROM zg LEFT JOIN zh USING (symbol) LEFT JOIN (SELECT symbol, epoch({_NOW}) - epoch(max(event_time)) - 3600 > 10800 AS stale FROM k GROUP BY 1) USING (symbol) LEFT JOIN (SELECT event_type AS symbol, count(*) % 2 = 0 AS eligible FROM events GROUP BY 1) USING (symbol)),
ov AS (SELECT symbol, regime, 'trend' AS analyst, ss IS NOT NULL AS said, ss / 3 AS score, CASE WHEN conflict THEN base * 0.5 WHEN medium THEN least(1.0, base * 1.2) ELSE base END AS confidence, [concat('trend_', stt), CASE WHEN conflict THEN 'horizon_conflict' WHEN medium THEN 'horizon_aligned' END] AS codes FROM cs
 UNION ALL SELECT symbol, regime, 'structure', pos IS NOT NULL, (pos - 0.5) * 2, least(1.0, abs((pos - 0.5) * 2)), [CASE WHEN pos > 0.65 THEN 'range_high' WHEN pos < 0.35 THEN 'range_low' ELSE 'mid_range' END] FROM cs
 UNION ALL SELECT symbol, regime, 'momentum', rsi IS NOT NULL, (rsi - 50) / 50, least(1.0, abs((rsi - 50) / 50) * 1.5), [CASE WHEN rsi >= 70 THEN 'overbought' WHEN rsi <= 30 THEN 'oversold' ELSE 'momentum_neutral' END] FROM cs
 UNION ALL SELECT symbol, regime, 'volatility', atr IS NOT NULL, 0.0, 0.4, ['volatility_measured', CASE WHEN atr >= p75 THEN 'volatility_expanded' WHEN atr <= p25 THEN 'volatility_compressed' END] FROM cs
 UNION ALL SELECT symbol, regime, 'session', true, 0.0, CASE WHEN live THEN 0.6 ELSE 0.2 END, [CASE WHEN is_open THEN 'market_open' ELSE 'market_closed' END, CASE WHEN NOT live THEN 'thin_liquidity' END] FROM cs
 UNION ALL SELECT symbol, regime, 'regime', regime <> 'uncertain', CASE regime WHEN 'trend_up' THEN 0.6 WHEN 'trend_down' THEN -0.6 ELSE 0.0 END, confidence, [concat('regime_', regime)] FROM cs
 UNION ALL SELECT symbol, regime, 'history', share IS NOT NULL, share, CASE WHEN wide THEN settled * 0.5 ELSE settled END, [CASE WHEN share > 0 THEN 'history_bullish' ELSE 'history_bearish' END, CASE WHEN wide THEN 'history_disagrees' END] FROM cs
 UNION ALL SELECT symbol, regime, 'data_quality', eligible IS NOT NULL, 0.0, CASE WHEN stale THEN 0.0 WHEN NOT eligible THEN 0.3 ELSE 1.0 END, [CASE WHEN NOT eligible THEN 'data_not_training_eligible' END, CASE WHEN stale THEN 'stale_data' END, CASE WHEN eligible AND NOT coalesce(stale, false) THEN 'data_ok' END] FROM cs),
vo AS (SELECT symbol, regime, analyst, NOT said AS abstained, CASE WHEN said THEN greatest(-1.0, least(1.0, CAST(score AS DOUBLE))) END AS score, CASE WHEN said THEN CAST(confidence AS DOUBLE) END AS confidence, CASE WHEN said THEN list_filter(codes, lambda x: x IS NOT NULL) ELSE [] END AS codes, {_WEIGHT} AS w FROM ov),
vd AS (SELECT symbol, coalesce(sum(w * greatest(confidence, 0) * score) FILTER (WHERE NOT abstained AND w > 0) / nullif(sum(w * greatest(confidence, 0)) FILTER (WHERE NOT abstained AND w > 0), 0), 0.0) AS conviction, CASE WHEN count(*) FILTER (WHERE NOT abstained AND w > 0 AND abs(score) >= 0.15) > 1 THEN stddev_pop(score) FILTER (WHERE NOT abstained AND w > 0 AND abs(score) >= 0.15) ELSE 0.0 END AS disagreement,
 count(*) FILTER (WHERE abstained) AS abstained, count(*) FILTER (WHERE NOT abstained AND w > 0) AS voters, max(score) FILTER (WHERE analyst = 'history') AS hist, flatten(list(codes)) AS said FROM vo GROUP BY symbol),
ve AS (SELECT *, CASE WHEN voters = 0 THEN 'no_reading' WHEN disagreement > 0.55 THEN 'disagreement' WHEN abs(conviction) < 0.20 THEN 'conviction' END AS suppressed FROM vd),
vf AS (SELECT *, CASE WHEN suppressed IS NOT NULL THEN 'wait' WHEN conviction > 0 THEN 'buy' ELSE 'sell' END AS decision FROM ve),
vg AS (SELECT *, list_filter([CASE WHEN list_contains(said, 'stale_data') THEN 'stale_data' END, CASE WHEN list_contains(said, 'market_closed') THEN 'market_closed' END, CASE WHEN hist * conviction < 0 THEN 'history_contradicts' END], lambda x: x IS NOT NULL) AS blocking,
 list_filter([CASE WHEN list_contains(said, 'data_not_training_eligible') THEN 'poor_data_quality' END, CASE WHEN list_contains(said, 'thin_liquidity') THEN 'thin_liquidity' END, CASE WHEN list_contains(said, 'volatility_expanded') THEN 'volatility_expanded' END, CASE WHEN disagreement > 0.55 * 0.7 THEN 'council_split' END, CASE WHEN hist IS NULL THEN 'no_historical_support' END,
  CASE WHEN decision = 'buy' AND list_contains(said, 'overbought') THEN 'buying_overbought' END, CASE WHEN decision = 'sell' AND list_contains(said, 'oversold') THEN 'selling_oversold' END, CASE WHEN abstained >= 3 THEN 'thin_evidence' END], lambda x: x IS NOT NULL) AS concerns FROM vf)"""


@query(f"WITH {_COUNCIL} SELECT symbol, analyst, abstained, round(score, 6) AS score, round(confidence, 6) AS confidence, array_to_string(codes, ',') AS codes FROM vo")
def council_votes(spark, sf_dir):
    rows = scoring.regimes(states(spark, sf_dir)).withColumn("o", F.explode(scoring.opinions()))
    return rounded(rows.select("symbol", "o.analyst", "o.abstained", "o.score", "o.confidence", F.concat_ws(",", "o.codes").alias("codes")), "score", "confidence")


@query(f"WITH {_COUNCIL} SELECT symbol, round(conviction, 6) AS conviction, round(disagreement, 6) AS disagreement, CAST(abstained AS INTEGER) AS abstained, suppressed, decision FROM vf")
def weighted_verdict(spark, sf_dir):
    return rounded(scoring.verdicts(scoring.regimes(states(spark, sf_dir))).select("symbol", "conviction", "disagreement", "abstained", "suppressed", "decision"), "conviction", "disagreement")


@query(f"WITH {_COUNCIL}, vh AS (SELECT *, CASE WHEN len(blocking) > 0 THEN 'block' WHEN len(concerns) >= 2 THEN 'reduce' ELSE 'clear' END AS challenge FROM vg) SELECT symbol, array_to_string(blocking, ',') AS blocking, array_to_string(concerns, ',') AS concerns, challenge, round(CASE WHEN challenge = 'reduce' THEN conviction * 0.5 ELSE conviction END, 6) AS final_conviction FROM vh")
def adversarial_flags(spark, sf_dir):
    rows = scoring.challenges(scoring.verdicts(scoring.regimes(states(spark, sf_dir))))
    return rounded(rows.select("symbol", F.concat_ws(",", "blocking").alias("blocking"), F.concat_ws(",", "concerns").alias("concerns"), "challenge", "final_conviction"), "final_conviction")


@query(f"""WITH {_COUNCIL}, vp AS (SELECT *, list_filter(list_prepend(suppressed, blocking), lambda x: x IS NOT NULL) AS reasons FROM vg) SELECT symbol, CASE WHEN len(reasons) = 0 THEN decision ELSE 'wait' END AS proposed, round(CASE WHEN len(reasons) = 0 THEN abs(conviction) * CASE WHEN len(concerns) >= 2 THEN 0.5 ELSE 1.0 END ELSE 0.0 END, 6) AS proposed_conviction, array_to_string(reasons, ',') AS wait_reasons FROM vp""")
def proposals(spark, sf_dir):
    rows = scoring.proposals(scoring.challenges(scoring.verdicts(scoring.regimes(states(spark, sf_dir)))))
    return rounded(rows.select("symbol", "proposed", "proposed_conviction", F.array_join("wait_reasons", ",").alias("wait_reasons")), "proposed_conviction")


_FACETS = {"volatility": ("profile_volatility", [*_names("range"), "range_mean", "return_stdev", *_names("abs_return")]), "structure": ("profile_structure", ["autocorrelation", "up_share", *_names("body"), *_names("gap")]), "liquidity": ("profile_liquidity", [*_names("volume"), "volume_mean"])}
_SNAPSHOT = " UNION ALL ".join(f"SELECT symbol, '{kind}' AS kind, metric, value FROM (UNPIVOT (SELECT symbol, {', '.join(f'CAST({m} AS DOUBLE) AS {m}' for m in metrics)} FROM ({ORACLES[name]})) ON {', '.join(metrics)} INTO NAME metric VALUE value)" for kind, (name, metrics) in _FACETS.items())


@query(_SNAPSHOT)
def profile_snapshot(spark, sf_dir):
    """The facets of every symbol's profile as stored at one cutoff."""
    bars = stores.stored(A(spark, sf_dir), "profile-bars")
    facets = {"volatility": profiles.volatility(bars), "structure": profiles.structure(bars), "liquidity": profiles.liquidity(bars)}
    keep = {kind: [c for c in metrics] for kind, (_, metrics) in _FACETS.items()}
    out = profiles.snapshot({kind: rows.select("symbol", *keep[kind]) for kind, rows in facets.items()}, AS_OF, AS_OF)
    return rounded(out.select("symbol", "kind", "metric", "value"), "value")


_STRETCH = f"{steps('b')}, sx AS (SELECT symbol, event_time, close, CASE WHEN count(tr) OVER {frame(13)} = 14 THEN avg(tr) OVER {frame(13)} END AS atr, avg(close) OVER {frame(50, -1)} AS mu, n FROM st), sr AS (SELECT symbol, event_time, close, atr, (close - mu) / atr AS stretch FROM sx WHERE n > 80 AND atr > 0)"
_TAILS = "tk AS (SELECT *, count(*) OVER (PARTITION BY event_time) AS considered, row_number() OVER (PARTITION BY event_time ORDER BY stretch, symbol) AS place FROM sr), tt AS (SELECT *, greatest(1, CAST(floor(considered * 0.10) AS BIGINT)) AS take FROM tk WHERE considered >= 20), tp AS (SELECT *, CASE WHEN place <= take THEN 1 WHEN place > considered - take THEN -1 END AS side FROM tt WHERE place <= take OR place > considered - take)"


@query(f"WITH {BARS_B}, {_STRETCH}, {_TAILS} SELECT symbol, event_time, round(stretch, 6) AS stretch, considered, CAST(place AS BIGINT) AS place, CAST(side AS INTEGER) AS side FROM tp")
def cross_section_tails(spark, sf_dir):
    rows = crosssection.tails(crosssection.stretches(B.weekly_supplier_bars(spark, sf_dir)))
    return rounded(rows.select("symbol", "event_time", "stretch", "considered", F.col("place").cast("long").alias("place"), "side"), "stretch")


_COIN = "CASE WHEN substr(sha256(concat('control-v1:', symbol, ':', strftime(event_time, '%Y-%m-%dT%H:%M:%S'), '+00:00')), 2, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') THEN 1 ELSE -1 END"
_ARMS = f"""pk AS (SELECT symbol, event_time, close AS entry, atr, side, {_COIN} AS coin FROM tp), ar AS (SELECT symbol, event_time, entry, atr, 'rule' AS arm, side FROM pk UNION ALL SELECT symbol, event_time, entry, atr, 'control', coin FROM pk),
lv AS (SELECT *, entry - atr * 2.5 * side AS stop, entry + atr * 2.5 * 1.0 * side AS target FROM ar), nb AS (SELECT symbol, event_time, high, low, row_number() OVER {W} AS i FROM b), pl AS (SELECT lv.*, nb.i FROM lv JOIN nb USING (symbol, event_time)),
mt AS (SELECT pl.symbol, pl.event_time, pl.arm, nb.i AS j, CASE WHEN side > 0 THEN low <= stop ELSE high >= stop END AS hs, CASE WHEN side > 0 THEN high >= target ELSE low <= target END AS ht FROM pl JOIN nb ON pl.symbol = nb.symbol AND nb.i > pl.i AND nb.i <= pl.i + 120),
ft AS (SELECT symbol, event_time, arm, min(j) AS j, arg_min(hs, j) AS hs, arg_min(ht, j) AS ht FROM mt WHERE hs OR ht GROUP BY 1, 2, 3),
rs AS (SELECT pl.symbol, pl.event_time, pl.arm, pl.side, CASE WHEN hs AND ht THEN NULL WHEN hs THEN -1.0 WHEN ht THEN abs(target - entry) / abs(entry - stop) END AS r, coalesce(hs AND ht, NULL) AS ambiguous, ft.j - pl.i AS bars_to_touch FROM pl LEFT JOIN ft USING (symbol, event_time, arm)),
pd AS (SELECT symbol, event_time, max(CASE WHEN arm = 'rule' THEN r END) AS rule_r, max(CASE WHEN arm = 'control' THEN r END) AS control_r FROM rs GROUP BY 1, 2)"""


@query(f"WITH {BARS_B}, {_STRETCH}, {_TAILS}, {_ARMS} SELECT symbol, event_time, arm, CAST(side AS INTEGER) AS side, round(r, 6) AS r, ambiguous, CAST(bars_to_touch AS BIGINT) AS bars_to_touch FROM rs")
def first_touch_outcome(spark, sf_dir):
    rows = crosssection.arms(B.weekly_supplier_bars(spark, sf_dir))
    return rounded(rows.select("symbol", "event_time", "arm", "side", "r", "ambiguous", F.col("bars_to_touch").cast("long").alias("bars_to_touch")), "r")


@query(f"WITH {BARS_B}, {_STRETCH}, {_TAILS}, {_ARMS} SELECT symbol, event_time, round(rule_r, 6) AS rule_r, round(control_r, 6) AS control_r FROM pd WHERE rule_r IS NOT NULL AND control_r IS NOT NULL")
def rule_vs_control(spark, sf_dir):
    return rounded(crosssection.pairs(B.weekly_supplier_bars(spark, sf_dir)).where("decided").select("symbol", "event_time", "rule_r", "control_r"), "rule_r", "control_r")


@query(f"""WITH {BARS_B}, {_STRETCH}, {_TAILS}, {_ARMS}, gd AS (SELECT * FROM pd WHERE rule_r IS NOT NULL AND control_r IS NOT NULL), iv AS (SELECT event_time, avg(rule_r) AS rl, avg(control_r) AS ct, count(*) AS k FROM gd GROUP BY 1)
SELECT count(*) AS instants, CAST(coalesce(sum(k), 0) AS BIGINT) AS trades, round(avg(rl), 6) AS rule_r, round(avg(ct), 6) AS control_r, round(stddev_samp(rl - ct), 6) AS spread_r, round(CASE WHEN count(*) > 1 AND stddev_samp(rl - ct) > 0 THEN avg(rl - ct) / (stddev_samp(rl - ct) / sqrt(count(*))) ELSE 0.0 END, 6) AS t_statistic,
 (SELECT round(CASE WHEN count(*) > 1 AND stddev_samp(rule_r - control_r) > 0 THEN avg(rule_r - control_r) / (stddev_samp(rule_r - control_r) / sqrt(count(*))) ELSE 0.0 END, 6) FROM gd) AS unclustered_t, (SELECT count(*) FROM pd WHERE rule_r IS NULL OR control_r IS NULL) AS dropped_undecided FROM iv""")
def paired_t_clustered(spark, sf_dir):
    return rounded(crosssection.measured(crosssection.pairs(B.weekly_supplier_bars(spark, sf_dir))), "rule_r", "control_r", "spread_r", "t_statistic", "unclustered_t")


# A score for each labelled document: its length on a logarithmic scale, between 0 and 1.
_SCORED = "fc AS (SELECT l.doc_id, d.lang AS source, least(1.0, ln(1.0 + n_chars) / 10.0) AS score, quality = 1 AS outcome FROM labels l JOIN documents d USING (doc_id))"


def forecasts(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("source"), F.least(F.lit(1.0), F.ln(1.0 + F.col("n_chars")) / 10.0).alias("score"))
    return B.table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", "source", "score", (F.col("quality") == 1).alias("outcome"))


_BINS = "bk AS (SELECT CAST(least(floor(score * 10), 9) AS INTEGER) AS bucket, count(*) AS n, avg(score) AS mean_score, avg(CASE WHEN outcome THEN 1.0 ELSE 0.0 END) AS observed FROM fc GROUP BY 1 HAVING count(*) >= 10)"


@query(f"WITH {_SCORED}, {_BINS} SELECT bucket, n, round(mean_score, 6) AS mean_score, round(observed, 6) AS observed FROM bk")
def calibration_buckets(spark, sf_dir):
    return rounded(learning.reliability(forecasts(spark, sf_dir)), "mean_score", "observed")


@query(f"WITH {_SCORED}, {_BINS}, wh AS (SELECT count(*) AS n, avg((score - CASE WHEN outcome THEN 1.0 ELSE 0.0 END) ** 2) AS brier, avg(CASE WHEN outcome THEN 1.0 ELSE 0.0 END) AS base_rate FROM fc) SELECT n, CASE WHEN n >= 100 THEN round(brier, 6) END AS brier, CASE WHEN n >= 100 THEN round(base_rate, 6) END AS base_rate, CASE WHEN n >= 100 THEN (SELECT round(sum(n * abs(mean_score - observed)) / sum(n), 6) FROM bk) END AS calibration_error, CASE WHEN n >= 100 THEN round(base_rate * (1 - base_rate), 6) END AS baseline, CASE WHEN n >= 100 THEN CASE WHEN base_rate * (1 - base_rate) > 0 THEN round(1 - brier / (base_rate * (1 - base_rate)), 6) ELSE 0.0 END END AS skill FROM wh")
def brier_skill(spark, sf_dir):
    return rounded(learning.brier(forecasts(spark, sf_dir)), "brier", "base_rate", "calibration_error", "baseline", "skill")


@query(f"WITH {_SCORED}, {_BINS} SELECT doc_id, CAST(least(floor(score * 10), 9) AS INTEGER) AS bucket, round(observed, 6) AS probability FROM fc LEFT JOIN bk ON bk.bucket = CAST(least(floor(score * 10), 9) AS INTEGER)")
def score_to_probability(spark, sf_dir):
    rows = forecasts(spark, sf_dir)
    return rounded(learning.to_probability(rows, learning.reliability(rows)).select("doc_id", "bucket", "probability"), "probability")


@query(f"""WITH {BARS_A}, {steps('a')}, fe AS (SELECT symbol, event_time, close, CASE WHEN n > 14 THEN avg(tr) OVER {frame(13)} END AS atr, CASE WHEN n > 14 THEN avg(up) OVER {frame(13)} END AS u, CASE WHEN n > 14 THEN avg(down) OVER {frame(13)} END AS d FROM st),
tr0 AS (SELECT symbol, event_time, close AS entry, atr * 1.5 AS risk, atr * 3.0 AS reward, u / nullif(u + d, 0) AS p, 0.01 * atr AS costs FROM fe WHERE atr > 0)
SELECT symbol, event_time, round(reward / risk, 6) AS reward_risk, round((p * reward - (1 - p) * risk - costs) / risk, 6) AS expected_r, round((risk + costs) / (reward + risk), 6) AS breakeven, CASE WHEN p IS NULL THEN 'unavailable' WHEN reward / risk < 0.5 OR (p * reward - (1 - p) * risk - costs) / risk < 0.05 THEN 'wait' ELSE 'trade' END AS verdict FROM tr0 WHERE p IS NOT NULL""")
def expected_value(spark, sf_dir):
    w = B.by_time()
    rows = features.compute(A(spark, sf_dir), ["atr_14"], keep_steps=True).where("true").withColumn("_u", F.avg("_up").over(w.rowsBetween(-13, 0))).withColumn("_d", F.avg("_down").over(w.rowsBetween(-13, 0)))
    rows = rows.withColumn("probability", F.try_divide(F.col("_u"), F.nullif(F.col("_u") + F.col("_d"), F.lit(0.0)))).where("atr_14 > 0 and probability is not null")
    trades = rows.select("symbol", "event_time", F.col("close").alias("entry"), (F.col("close") - 1.5 * F.col("atr_14")).alias("stop"), (F.col("close") + 3.0 * F.col("atr_14")).alias("target"), F.lit(1).alias("side"), "probability", (0.01 * F.col("atr_14")).alias("costs"))
    return rounded(scoring.expected_value(trades).select("symbol", "event_time", "reward_risk", "expected_r", "breakeven", "verdict"), "reward_risk", "expected_r", "breakeven")


@query(f"""WITH {BARS_A}, {steps('a')}, h AS (SELECT symbol, ret, event_time >= TIMESTAMP '2024-01-16 00:00:00' AS recent FROM st WHERE ret IS NOT NULL), g AS (SELECT symbol, count(*) FILTER (WHERE NOT recent) AS reference_n, count(*) FILTER (WHERE recent) AS recent_n, avg(ret) FILTER (WHERE NOT recent) AS m0, avg(ret) FILTER (WHERE recent) AS m1, var_pop(ret) FILTER (WHERE NOT recent) AS v0, var_pop(ret) FILTER (WHERE recent) AS v1 FROM h GROUP BY 1),
z AS (SELECT *, CASE WHEN least(reference_n, recent_n) >= 50 AND sqrt(v0 / reference_n + v1 / recent_n) > 0 THEN (m1 - m0) / sqrt(v0 / reference_n + v1 / recent_n) END AS z FROM g) SELECT symbol, reference_n, recent_n, round(m0, 6) AS reference_mean, round(m1, 6) AS recent_mean, round(z, 6) AS z, CASE WHEN z IS NULL THEN 'unavailable' WHEN z <= -3 THEN 'broken' WHEN z <= -2 THEN 'shifted' ELSE 'stable' END AS verdict FROM z""")
def concept_drift_z(spark, sf_dir):
    rows = features.with_steps(A(spark, sf_dir)).where("_ret is not null").select("symbol", F.col("_ret").alias("r"), (F.col("event_time") >= F.lit("2024-01-16").cast("timestamp")).alias("recent"))
    return rounded(learning.concept_drift(rows, "symbol"), "reference_mean", "recent_mean", "z")


_EVEN = "CASE WHEN (q * n / 10.0) - floor(q * n / 10.0) = 0.5 THEN 2 * round(q * n / 20.0) ELSE round(q * n / 10.0) END"


@query(f"""WITH {BARS_A}, h AS (SELECT symbol, close AS v, event_time >= TIMESTAMP '2024-01-16 00:00:00' AS recent FROM a), rf AS (SELECT symbol, v, row_number() OVER (PARTITION BY symbol ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM h WHERE NOT recent),
qs AS (SELECT unnest(range(1, 10)) AS q), ed AS (SELECT rf.symbol, list(v ORDER BY q) AS edges FROM rf, qs WHERE i = least(n - 1, CAST({_EVEN} AS BIGINT)) GROUP BY rf.symbol), bn AS (SELECT h.symbol, recent, len(list_filter(edges, lambda e: v > e)) AS bin, edges FROM h JOIN ed USING (symbol)),
ct AS (SELECT symbol, count(*) FILTER (WHERE NOT recent) AS rn, count(*) FILTER (WHERE recent) AS mn, max(len(list_distinct(edges))) AS k FROM bn GROUP BY 1), fu AS (SELECT ct.*, b AS bin FROM ct, (SELECT unnest(range(0, 10)) AS b)),
sh AS (SELECT fu.symbol, fu.bin, max(rn) AS rn, max(mn) AS mn, max(k) AS k, greatest(count(*) FILTER (WHERE NOT recent) / max(rn), 1e-6) AS e, greatest(count(*) FILTER (WHERE recent) / max(mn), 1e-6) AS r FROM fu LEFT JOIN bn USING (symbol, bin) GROUP BY 1, 2),
ps AS (SELECT symbol, max(rn) AS reference_n, max(mn) AS recent_n, max(k) AS k, sum((r - e) * ln(r / e)) AS psi FROM sh GROUP BY 1) SELECT symbol, reference_n, recent_n, CASE WHEN least(reference_n, recent_n) >= 50 AND k = 9 THEN round(psi, 6) END AS psi, CASE WHEN NOT (least(reference_n, recent_n) >= 50 AND k = 9) THEN 'unavailable' WHEN psi >= 0.25 THEN 'broken' WHEN psi >= 0.1 THEN 'shifted' ELSE 'stable' END AS verdict FROM ps""")
def psi_drift(spark, sf_dir):
    rows = A(spark, sf_dir).withColumn("recent", F.col("event_time") >= F.lit("2024-01-16").cast("timestamp"))
    return rounded(learning.psi(rows.where("not recent"), rows.where("recent"), "symbol", "close"), "psi")


_ACK = lambda c, x: "(" + "(" * (len(c) - 1) + f"{c[0]!r}" + "".join(f" * {x} + {k!r})" for k in c[1:]) + ")"


@query(f"""WITH {BARS_C}, {steps('c')}, g AS (SELECT symbol AS strategy, count(ret) AS trials, count(*) FILTER (WHERE ret IS NULL) AS unresolved, count(*) FILTER (WHERE ret > 0) AS wins, avg(ret) AS expectancy_r, avg(CASE WHEN ret > 0 THEN ret END) AS average_win_r, avg(CASE WHEN ret <= 0 THEN ret END) AS average_loss_r FROM st GROUP BY 1),
c1 AS (SELECT *, count(*) OVER () AS comparisons, sqrt(-2 * ln(0.05 / count(*) OVER () / 2)) AS q FROM g), z AS (SELECT *, abs({_ACK(stats.ACKLAM_C, 'q')} / {_ACK((*stats.ACKLAM_D, 1.0), 'q')}) AS z, wins / trials AS p FROM c1),
w AS (SELECT *, (p + z * z / (2 * trials)) / (1 + z * z / trials) AS ce, z * sqrt(p * (1 - p) / trials + z * z / (4.0 * trials * trials)) / (1 + z * z / trials) AS sp, 1 / (1 + average_win_r / abs(nullif(average_loss_r, 0))) AS req FROM z)
SELECT strategy, trials, unresolved, wins, round(expectancy_r, 6) AS expectancy_r, comparisons, round(p, 6) AS hit_rate, round(greatest(0, ce - sp), 6) AS hit_low, round(least(1, ce + sp), 6) AS hit_high, round(req, 6) AS required_hit_rate, CASE WHEN trials < 50 OR req IS NULL THEN 'insufficient' WHEN ce - sp > req THEN 'edge' WHEN ce + sp < req THEN 'negative' ELSE 'inconclusive' END AS verdict FROM w""")
def scorecard_wilson(spark, sf_dir):
    trials = features.with_steps(B.weekly_nation_bars(spark, sf_dir)).select(F.col("symbol").alias("strategy"), F.col("_ret").alias("r"))
    return rounded(learning.scorecards(trials).drop("average_win_r", "average_loss_r"), "expectancy_r", "hit_rate", "hit_low", "hit_high", "required_hit_rate")


_FOLDS = f"""sm AS (SELECT symbol, CAST(epoch(event_time) AS BIGINT) AS sample_id, event_time, outcome_ready_at, row_number() OVER (PARTITION BY symbol ORDER BY event_time) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM oc),
ow AS (SELECT *, CASE WHEN i < 60 THEN -1 ELSE least((i - 60) // ((n - 60) // 4), 3) END AS own FROM sm WHERE n >= 140), bg AS (SELECT symbol, own AS fold, min(event_time) AS test_start FROM ow WHERE own >= 0 GROUP BY 1, 2),
fd AS (SELECT ow.symbol, sample_id, fold, CASE WHEN own = fold THEN 'test' WHEN outcome_ready_at >= test_start THEN 'purge' WHEN event_time >= test_start - INTERVAL 6 HOUR THEN 'embargo' ELSE 'train' END AS role FROM ow JOIN bg ON ow.symbol = bg.symbol AND own <= fold)"""


def _folds(spark, sf_dir):
    samples = outcomes.episodes(A(spark, sf_dir), B.HOUR, H, names=[]).select("symbol", F.unix_timestamp("event_time").alias("sample_id"), "event_time", "outcome_ready_at")
    return learning.walk_forward(samples, 4, 60, 6 * B.HOUR)


@query(f"WITH {BARS_A}, {_OUTCOME}, {_FOLDS} SELECT symbol, CAST(fold AS INTEGER) AS fold, role, count(*) AS samples, CAST(sum(sample_id) AS BIGINT) AS checksum FROM fd GROUP BY 1, 2, 3")
def walk_forward_folds(spark, sf_dir):
    return _folds(spark, sf_dir).groupBy("symbol", "fold", "role").agg(F.count(F.lit(1)).alias("samples"), F.sum("sample_id").alias("checksum"))


# Every 50th sample is planted as training data of every later fold, whenever it matured, and every 70th as both roles.
@query(f"""WITH {BARS_A}, {_OUTCOME}, {_FOLDS}, bad AS (SELECT fd.symbol, fd.fold, fd.sample_id, CASE WHEN (sample_id // 3600) % 50 = 0 AND role <> 'test' THEN 'train' ELSE role END AS role FROM fd UNION ALL SELECT symbol, fold, sample_id, 'train' FROM fd WHERE role = 'test' AND (sample_id // 3600) % 70 = 0),
lt AS (SELECT bad.symbol, bad.fold, bad.sample_id FROM bad JOIN bg ON bad.symbol = bg.symbol AND bad.fold = bg.fold JOIN sm ON sm.symbol = bad.symbol AND sm.sample_id = bad.sample_id WHERE role = 'train' AND outcome_ready_at >= test_start),
bo AS (SELECT symbol, fold, sample_id FROM bad WHERE role IN ('train', 'test') GROUP BY 1, 2, 3 HAVING count(DISTINCT role) > 1)
SELECT symbol, CAST(fold AS INTEGER) AS fold, count(*) AS leaks FROM (SELECT * FROM lt UNION ALL SELECT * FROM bo) GROUP BY 1, 2""")
def leakage_check(spark, sf_dir):
    folds = _folds(spark, sf_dir)
    hour = F.floor(F.col("sample_id") / B.HOUR)
    planted = folds.withColumn("role", F.when((hour % 50 == 0) & (F.col("role") != "test"), "train").otherwise(F.col("role")))
    both = folds.where((F.col("role") == "test") & (hour % 70 == 0)).withColumn("role", F.lit("train"))
    return learning.leaks(planted.unionByName(both)).groupBy("symbol", "fold").agg(F.count(F.lit(1)).alias("leaks"))


@query(f"WITH {BARS_A}, {_OUTCOME}, {_FOLDS} SELECT count(*) AS leaks FROM fd JOIN bg USING (symbol, fold) JOIN sm USING (symbol, sample_id) WHERE role = 'train' AND outcome_ready_at >= test_start")
def folds_without_leaks(spark, sf_dir):
    return learning.leaks(_folds(spark, sf_dir)).agg(F.count(F.lit(1)).alias("leaks"))


@query("""WITH s AS (SELECT o_orderpriority AS pair, o_orderkey AS decision_id, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_totalprice > 150000 AS INTEGER) END AS a, CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_totalprice > 120000 AS INTEGER) END AS b FROM orders), g AS (SELECT pair, count(a) AS na, count(b) AS nb, sum(a) / count(a) AS pa, sum(b) / count(b) AS pb, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS k FROM s GROUP BY 1),
e AS (SELECT *, sqrt(pa * (1 - pa) / na + pb * (1 - pb) / nb) AS er FROM g) SELECT pair, na AS champion_n, nb AS challenger_n, round(k / greatest(na, nb), 6) AS overlap, round(pb - pa, 6) AS margin, round(er, 6) AS error, CASE WHEN least(na, nb) < 60 THEN 'too_few' WHEN k / greatest(na, nb) < 0.8 THEN 'overlap' WHEN pb - pa <= 2 * er THEN 'similar' ELSE 'promote' END AS verdict FROM e""")
def champion_challenger(spark, sf_dir):
    orders = B.table(spark, sf_dir, "orders")
    one = lambda model, mod, least: orders.where(F.col("o_orderkey") % mod != 0).select(F.col("o_orderpriority").alias("pair"), F.lit(model).alias("model"), F.col("o_orderkey").alias("decision_id"), (F.col("o_totalprice") > least).alias("hit"))
    return rounded(learning.compared(one("champion", 11, 150000).unionByName(one("challenger", 13, 120000))), "overlap", "margin", "error")


_POSITIONS = "ps AS (SELECT o_custkey // 10 AS account, o_orderkey, concat('N', CAST(c_nationkey AS VARCHAR)) AS symbol, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS side, o_totalprice / 400000.0 AS risk_r, concat('C', CAST(c_nationkey % 7 AS VARCHAR)) AS base, concat('C', CAST(c_nationkey % 5 + 7 AS VARCHAR)) AS quote FROM orders JOIN customer ON o_custkey = c_custkey)"


def positions(spark, sf_dir):
    rows = B.table(spark, sf_dir, "orders").join(B.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    name = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    return rows.select(F.floor(F.col("o_custkey") / 10).cast("long").alias("account"), "o_orderkey", name("N", F.col("c_nationkey")).alias("symbol"), F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1).alias("side"), (F.col("o_totalprice") / 400000.0).alias("risk_r"), name("C", F.col("c_nationkey") % 7).alias("base"), name("C", F.col("c_nationkey") % 5 + 7).alias("quote"))


@query(f"WITH {_POSITIONS} SELECT currency, round(sum(x), 4) AS exposure FROM (SELECT base AS currency, side * risk_r AS x FROM ps UNION ALL SELECT quote, -side * risk_r FROM ps) GROUP BY 1")
def currency_exposure(spark, sf_dir):
    return rounded(risk.currency_exposure(positions(spark, sf_dir)), "exposure", places=4)


#: Nations' weekly prices hardly move together: a bound that makes clusters of them.
BOUND = 0.05


@query(f"""WITH {BARS_C}, {_CORR}, {_POSITIONS}, op AS (SELECT * FROM ps WHERE o_orderkey % 3 <> 0), cd AS (SELECT * FROM ps WHERE o_orderkey % 3 = 0), tot AS (SELECT account, sum(risk_r) AS t FROM op GROUP BY 1), ins AS (SELECT account, symbol, sum(risk_r) AS t FROM op GROUP BY 1, 2),
ex AS (SELECT account, currency, sum(x) AS e FROM (SELECT account, base AS currency, side * risk_r AS x FROM op UNION ALL SELECT account, quote, -side * risk_r FROM op) GROUP BY 1, 2),
bo AS (SELECT a, b, r FROM cp UNION ALL SELECT b, a, r FROM cp), ds AS (SELECT DISTINCT account, symbol FROM cd),
cl AS (SELECT ds.account, ds.symbol, sum(CASE WHEN abs(r) >= {BOUND} THEN op.risk_r END) AS t, count(DISTINCT CASE WHEN r IS NULL THEN op.symbol END) AS unknown FROM ds JOIN op ON op.account = ds.account AND op.symbol <> ds.symbol LEFT JOIN bo ON bo.a = ds.symbol AND bo.b = op.symbol GROUP BY 1, 2),
j AS (SELECT cd.*, 6.0 - coalesce(tot.t, 0) AS r1, 2.0 - coalesce(ins.t, 0) AS r2, 3.0 - coalesce(cl.t, 0) AS r3, coalesce(cl.unknown, 0) AS unknown, 3.0 - CASE WHEN (coalesce(b.e, 0) > 0) = (cd.side > 0) THEN abs(coalesce(b.e, 0)) ELSE 0 END AS r4, 3.0 - CASE WHEN (coalesce(q.e, 0) > 0) = (-cd.side > 0) THEN abs(coalesce(q.e, 0)) ELSE 0 END AS r5
 FROM cd LEFT JOIN tot ON cd.account = tot.account LEFT JOIN ins ON cd.account = ins.account AND cd.symbol = ins.symbol LEFT JOIN cl ON cd.account = cl.account AND cd.symbol = cl.symbol LEFT JOIN ex b ON cd.account = b.account AND cd.base = b.currency LEFT JOIN ex q ON cd.account = q.account AND cd.quote = q.currency),
h AS (SELECT *, greatest(0.0, least(r1, r2, r3, r4, r5)) AS hr FROM j) SELECT account, o_orderkey, unknown, round(hr, 6) AS headroom_r, round(least(risk_r, hr), 6) AS allowed_r, CASE WHEN least(risk_r, hr) <= 0 THEN 'block' WHEN least(risk_r, hr) < risk_r THEN 'reduce' ELSE 'approve' END AS verdict FROM h""")
def portfolio_headroom(spark, sf_dir):
    rows = positions(spark, sf_dir)
    measured = profiles.correlations(B.weekly_nation_bars(spark, sf_dir)).where("r is not null")
    out = risk.headroom(rows.where("o_orderkey % 3 = 0"), rows.where("o_orderkey % 3 <> 0"), measured, bound=BOUND)
    return rounded(out.select("account", "o_orderkey", "unknown", "headroom_r", "allowed_r", "verdict"), "headroom_r", "allowed_r")


@query(f"WITH {_POSITIONS} SELECT account, count(*) AS positions, round(sum(risk_r), 9) AS total_r, round(sum(risk_r * risk_r) / sum(risk_r) ** 2, 9) AS herfindahl, round(sum(risk_r) ** 2 / sum(risk_r * risk_r), 9) AS effective_positions, round(max(risk_r) / sum(risk_r), 9) AS largest_share, round(sqrt(0.7 * sum(risk_r * risk_r) + 0.3 * sum(risk_r) ** 2), 9) AS correlated_loss_r FROM ps GROUP BY account")
def concentration(spark, sf_dir):
    return rounded(risk.concentration(positions(spark, sf_dir), "account", correlation=0.3), "total_r", "herfindahl", "effective_positions", "largest_share", "correlated_loss_r", places=9)


_REQUESTS = "rq AS (SELECT c_custkey, 0.25 + c_custkey % 4 * 0.25 AS requested_r, c_acctbal AS equity, 1000.0 + abs(c_acctbal) * (1 + c_custkey % 5 * 0.03) AS peak, CAST(c_custkey % 9 - 5 AS DOUBLE) * 0.8 AS pnl, c_custkey % 12 AS pos, CAST(c_custkey % 60 AS DOUBLE) AS um, 100.0 - c_custkey % 60 AS fm, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(c_custkey % 5 AS DOUBLE) END AS age, c_custkey % 3 <> 0 AS eligible, c_custkey % 2 = 0 AS calibrated, c_custkey % 7 = 0 AS unk, c_custkey % 101 = 0 AS safe, CASE WHEN c_custkey % 6 = 0 THEN 0.3 END AS hr FROM customer)"
_AUTHORISED = """rd AS (SELECT *, CASE WHEN peak > 0 THEN greatest(0.0, (peak - equity) / peak) ELSE 0 END AS dd, um / (um + fm) AS mg FROM rq), rb AS (SELECT *, safe OR requested_r <= 0 OR requested_r > 1.0 OR dd >= 0.10 OR pnl <= -3.0 OR pos >= 10 OR mg >= 0.5 OR equity <= 0 OR coalesce(age > 3, true) AS breach,
 least(requested_r, 1.0) * CASE WHEN dd >= 0.05 THEN 0.5 ELSE 1 END * CASE WHEN pnl <= -1.5 THEN 0.5 ELSE 1 END * CASE WHEN NOT calibrated THEN 0.5 ELSE 1 END * CASE WHEN NOT eligible THEN 0.5 ELSE 1 END * CASE WHEN unk THEN 0.75 ELSE 1 END * CASE WHEN 1 - mg < 0.3 THEN 0.5 ELSE 1 END AS soft FROM rd),
au AS (SELECT *, CASE WHEN breach THEN 0.0 ELSE greatest(0.0, least(soft, coalesce(hr, soft))) END AS permitted_r FROM rb)"""


def authorised(spark, sf_dir):
    c = F.col("c_custkey")
    rows = B.table(spark, sf_dir, "customer").select(
        "c_custkey", (0.25 + c % 4 * 0.25).alias("requested_r"), F.col("c_acctbal").alias("equity"), (1000.0 + F.abs("c_acctbal") * (1 + c % 5 * 0.03)).alias("peak_equity"), ((c % 9 - 5).cast("double") * 0.8).alias("daily_pnl_r"), (c % 12).alias("open_positions"),
        (c % 60).cast("double").alias("used_margin"), (100.0 - c % 60).alias("free_margin"), F.when(c % 17 != 0, (c % 5).cast("double")).alias("data_age_bars"), (c % 3 != 0).alias("eligible"), (c % 2 == 0).alias("calibrated"), (c % 7 == 0).alias("correlation_unknown"), (c % 101 == 0).alias("safe_mode"), F.when(c % 6 == 0, 0.3).alias("headroom_r"),
    )
    return risk.authorise(rows)


@query(f"WITH {_REQUESTS}, {_AUTHORISED} SELECT c_custkey, round(CAST(permitted_r AS DOUBLE), 6) AS permitted_r, CASE WHEN permitted_r <= 0 THEN 'block' WHEN permitted_r >= requested_r THEN 'approve' ELSE 'reduce' END AS verdict FROM au")
def risk_authorise(spark, sf_dir):
    return rounded(authorised(spark, sf_dir).select("c_custkey", "permitted_r", "verdict"), "permitted_r")


@query(f"WITH {_REQUESTS}, {_AUTHORISED} SELECT CASE WHEN NOT coalesce(age <= 3, false) THEN 'freshness' WHEN dd >= 0.10 THEN 'drawdown' WHEN mg >= 0.5 THEN 'margin' WHEN permitted_r <= 0 THEN 'risk' ELSE 'intent' END AS stopped_at, count(*) AS decisions FROM au GROUP BY 1")
def stage_attrition(spark, sf_dir):
    stages = {"freshness": F.col("data_age_bars") <= 3, "drawdown": F.col("drawdown") < 0.10, "margin": F.col("margin") < 0.5, "risk": F.col("permitted_r") > 0}
    return operations.attrition(authorised(spark, sf_dir).withColumn("stopped_at", scoring.first_failure(stages)))


_EQUITY = "eq AS (SELECT user_id AS account, ts AS recorded_at, value + user_id % 10 AS equity, value AS balance FROM events)"


@query(f"""WITH {_EQUITY}, pk AS (SELECT account, max(equity) AS peak_equity FROM eq GROUP BY 1), d AS (SELECT account, CAST(recorded_at + INTERVAL 2 HOUR AS DATE) AS day, min(recorded_at) AS t, min_by(balance, recorded_at) AS b FROM eq GROUP BY 1, 2), f AS (SELECT *, min(day) OVER (PARTITION BY account) AS fd FROM d),
g AS (SELECT account, max(b) AS peak_day_open_balance, count(*) AS days FROM f WHERE (CAST(floor(epoch(t)) AS BIGINT) + 7200) % 86400 <= 600 OR day = fd GROUP BY 1) SELECT pk.account, round(peak_equity, 6) AS peak_equity, round(peak_day_open_balance, 6) AS peak_day_open_balance, days FROM pk LEFT JOIN g USING (account)""")
def equity_peaks(spark, sf_dir):
    samples = B.table(spark, sf_dir, "events").select(F.col("user_id").alias("account"), F.col("ts").cast("timestamp").alias("recorded_at"), (F.col("value") + F.col("user_id") % 10).alias("equity"), F.col("value").alias("balance"))
    return rounded(risk.equity_peaks(samples), "peak_equity", "peak_day_open_balance")


@query("WITH d AS (SELECT user_id AS account, CAST(ts AS DATE) AS day, sum(value - 40) AS profit FROM events GROUP BY 1, 2), g AS (SELECT account, count(*) AS days, sum(profit) AS total, max(profit) AS best, max_by(day, ROW(profit, day)) AS best_day FROM d GROUP BY 1) SELECT account, days, round(total, 4) AS total, best_day, CASE WHEN days >= 3 AND total > 0 THEN round(best / total, 4) END AS best_share FROM g")
def consistency_share(spark, sf_dir):
    profits = B.table(spark, sf_dir, "events").select(F.col("user_id").alias("account"), F.to_date("ts").alias("day"), (F.col("value") - 40).alias("profit"))
    return rounded(risk.consistency(profits), "total", "best_share", places=4)


@query("""WITH br AS (SELECT l_suppkey AS symbol, l_returnflag AS side, round(sum(l_quantity), 2) AS size, CASE WHEN l_suppkey % 9 <> 0 THEN 1.0 END AS stop FROM lineitem WHERE l_suppkey % 5 <> 0 GROUP BY 1, 2), ex AS (SELECT l_suppkey AS symbol, l_returnflag AS side, round(sum(l_quantity), 2) + CASE WHEN l_suppkey % 4 = 0 THEN 1 ELSE 0 END AS size FROM lineitem WHERE l_suppkey % 7 <> 0 GROUP BY 1, 2)
SELECT symbol, side, br.size AS broker_size, ex.size AS expected_size, CASE WHEN ex.size IS NULL THEN 'orphan' WHEN br.size IS NULL THEN 'missing' WHEN abs(br.size - ex.size) > 1e-9 THEN 'drifted' WHEN stop IS NULL THEN 'unprotected' ELSE 'matched' END AS status FROM br FULL JOIN ex USING (symbol, side)""")
def position_reconcile(spark, sf_dir):
    each = B.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("symbol"), F.col("l_returnflag").alias("side")).agg(F.round(F.sum("l_quantity"), 2).alias("size"))
    broker = each.where("symbol % 5 <> 0").withColumn("stop", F.when(F.col("symbol") % 9 != 0, 1.0))
    expected = each.where("symbol % 7 <> 0").withColumn("size", F.col("size") + F.when(F.col("symbol") % 4 == 0, 1).otherwise(0))
    return risk.reconcile(broker, expected).select("symbol", "side", "broker_size", "expected_size", "status")


@query("WITH d AS (SELECT l_returnflag AS symbol, l_extendedprice * (0.05 - l_discount) AS profit FROM lineitem) SELECT symbol, round(sum(profit), 2) AS net, count(*) AS trades, count(*) FILTER (WHERE profit > 0) AS wins, CASE WHEN count(*) >= 5 THEN round(count(*) FILTER (WHERE profit > 0) / count(*), 6) END AS hit_rate FROM d GROUP BY ROLLUP (symbol)")
def pnl_rollup(spark, sf_dir):
    deals = B.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("symbol"), (F.col("l_extendedprice") * (0.05 - F.col("l_discount"))).alias("profit"))
    return rounded(rounded(operations.pnl(deals), "net", places=2), "hit_rate")


@query(f"""WITH {BARS_A.replace("a AS (", "a0 AS (", 1)}, a AS (SELECT * REPLACE (CASE WHEN symbol = 'click' THEN 1.0 ELSE close END AS close) FROM a0), sh AS (SELECT symbol, event_time + INTERVAL 3 HOUR AS t, CASE WHEN symbol = 'click' THEN 1.0 ELSE close * 1.0001 END AS close FROM a), lg AS (SELECT unnest(range(-12, 15)) AS lag), e AS (SELECT sh.symbol, lag, count(*) AS overlap, avg(abs(sh.close - a.close)) AS distance FROM sh, lg JOIN a ON a.symbol = sh.symbol AND a.event_time = sh.t - to_hours(CAST(lag AS INTEGER)) GROUP BY 1, 2 HAVING count(*) >= 100),
k AS (SELECT *, row_number() OVER v AS k, lead(distance) OVER v AS nx FROM e WINDOW v AS (PARTITION BY symbol ORDER BY distance, abs(lag), lag)), c AS (SELECT *, CASE WHEN nx IS NULL THEN true WHEN distance <= 0 THEN nx > 0 ELSE nx / distance >= 1.15 END AS certain FROM k WHERE k = 1)
SELECT symbol, CASE WHEN certain THEN CAST(lag AS INTEGER) END AS lag, overlap, round(distance, 6) AS distance, certain FROM c""")
def clock_offset_align(spark, sf_dir):
    flat = F.col("symbol") == "click"  # a series that fits at every lag
    bars = A(spark, sf_dir).withColumn("close", F.when(flat, 1.0).otherwise(F.col("close")))
    broker = bars.select("symbol", F.timestamp_seconds(F.unix_timestamp("event_time") + 3 * B.HOUR).alias("event_time"), F.when(flat, 1.0).otherwise(F.col("close") * 1.0001).alias("close"))
    return rounded(operations.clock_offset(bars, broker, B.HOUR), "distance")


@query(f"""WITH {BARS_A}, i AS (SELECT *, CAST(epoch(event_time) AS BIGINT) // 3600 AS h FROM a), old AS (SELECT symbol, event_time, open, high, low, close, volume, CASE WHEN h % 13 = 0 THEN 3 ELSE 1 END AS revision FROM i WHERE h % 10 <> 0), nw AS (SELECT symbol, event_time, open, high, low, CASE WHEN h % 6 = 0 THEN close + 0.5 ELSE close END AS close, volume FROM i)
SELECT nw.symbol, nw.event_time, round(nw.close, 6) AS close, CAST(coalesce(revision, 0) + 1 AS INTEGER) AS revision FROM nw LEFT JOIN old USING (symbol, event_time) WHERE revision IS NULL OR abs(nw.close - old.close) > 1e-9""")
def revision_diff(spark, sf_dir):
    rows = A(spark, sf_dir).withColumn("h", F.floor(F.unix_timestamp("event_time") / 3600))
    stored = rows.where("h % 10 <> 0").withColumn("revision", F.when(F.col("h") % 13 == 0, 3).otherwise(1)).drop("h")
    incoming = rows.withColumn("close", F.when(F.col("h") % 6 == 0, F.col("close") + 0.5).otherwise(F.col("close"))).withColumn("arrival", F.lit(0))
    again = incoming.withColumn("close", F.col("close") * 2).withColumn("arrival", F.lit(1))
    return rounded(operations.revisions(incoming.unionByName(again).drop("h"), stored).select("symbol", "event_time", "close", "revision"), "close")


_RUNLOG = "rl AS (SELECT user_id AS instrument, event_id, value AS seconds, 1 + CAST(value AS BIGINT) % 3 AS attempts, CASE WHEN user_id % 8 = 0 THEN 0 ELSE 5 END AS rows_written, ts AS started_at FROM events)"


def run_log(spark, sf_dir):
    return B.table(spark, sf_dir, "events").select(F.col("user_id").alias("instrument"), "event_id", F.col("value").alias("seconds"), (1 + F.rint("value").cast("long") % 3).alias("attempts"), F.when(F.col("user_id") % 8 == 0, 0).otherwise(5).alias("rows_written"), F.col("ts").cast("timestamp").alias("started_at"))


@query(f"WITH {_RUNLOG} SELECT instrument, count(*) AS runs, CAST(sum(attempts) AS BIGINT) AS attempts, CAST(sum(attempts) - count(*) AS BIGINT) AS extra FROM rl GROUP BY 1 HAVING sum(attempts) > count(*)")
def retry_waste(spark, sf_dir):
    return operations.retry_waste(run_log(spark, sf_dir))


@query(f"WITH {_RUNLOG}, m AS (SELECT instrument, median(seconds) AS median_seconds FROM rl GROUP BY 1 HAVING count(*) >= 12) SELECT instrument, event_id, round(seconds, 6) AS seconds, round(median_seconds, 6) AS median_seconds FROM rl JOIN m USING (instrument) WHERE seconds > 3 * median_seconds")
def slow_runs(spark, sf_dir):
    return rounded(operations.slow_runs(run_log(spark, sf_dir)).select("instrument", "event_id", "seconds", "median_seconds"), "seconds", "median_seconds")


@query(f"WITH {_RUNLOG} SELECT instrument, count(*) AS runs FROM rl WHERE started_at >= TIMESTAMP '{AS_OF}' - INTERVAL 3 DAY GROUP BY 1 HAVING count(*) >= 12 AND sum(rows_written) = 0")
def empty_work(spark, sf_dir):
    return operations.empty_work(run_log(spark, sf_dir), AS_OF)


@query(f"WITH {BARS_A} SELECT symbol, count(*) AS bars FROM (SELECT CASE WHEN hour(event_time) IN (3, 9) THEN concat(symbol, '-thin') ELSE symbol END AS symbol, event_time + INTERVAL 1 HOUR AS ingested_at FROM a) WHERE ingested_at >= TIMESTAMP '{AS_OF}' - INTERVAL 3 DAY AND ingested_at < TIMESTAMP '{AS_OF}' GROUP BY 1 HAVING count(*) < 10")
def thin_coverage(spark, sf_dir):
    """Symbols with next to no bars in the last three days; two hours of each day are a symbol of their own."""
    seen = B.bitemporal(A(spark, sf_dir)).where("revision = 1").where(F.col("ingested_at") < F.lit(AS_OF).cast("timestamp"))
    thin = F.when(F.hour("event_time").isin(3, 9), F.concat("symbol", F.lit("-thin"))).otherwise(F.col("symbol"))
    return operations.thin_coverage(seen.withColumn("symbol", thin), AS_OF)


@query("""WITH e AS (SELECT event_type AS component, ts AS seen_at, CASE event_id % 4 WHEN 0 THEN 'info' WHEN 1 THEN 'warning' WHEN 2 THEN 'serious' ELSE 'critical' END AS severity, CASE WHEN event_id % 2 = 0 THEN 'failed after #' ELSE 'user # timed out' END AS text FROM events)
SELECT concat(component, ':', substr(sha256(concat(component, '|', text)), 1, 24)) AS fingerprint, count(*) AS occurrences, min(seen_at) AS first_seen, max(seen_at) AS last_seen, min(component) AS component, CASE max(CASE severity WHEN 'info' THEN 0 WHEN 'warning' THEN 1 WHEN 'serious' THEN 2 ELSE 3 END) WHEN 0 THEN 'info' WHEN 1 THEN 'warning' WHEN 2 THEN 'serious' ELSE 'critical' END AS severity FROM e GROUP BY 1 HAVING count(*) >= 5""")
def incident_fold(spark, sf_dir):
    n = F.col("event_id")
    message = F.when(n % 2 == 0, F.concat(F.lit("Failed  after "), (n + 1000).cast("string"), F.lit("ms"))).otherwise(F.concat(F.lit("User "), (n + 5000).cast("string"), F.lit(" timed out")))
    severity = F.element_at(F.array(*[F.lit(s) for s in operations.SEVERITY_RANK]), (n % 4 + 1).cast("int"))
    events = B.table(spark, sf_dir, "events").select(F.col("event_type").alias("component"), F.col("ts").cast("timestamp").alias("at"), severity.alias("severity"), message.alias("message"))
    return operations.recurring(operations.incidents(events))


# Each entry carries the hash of the entry before it; payloads of every 97th are changed after hashing, links of every 89th cut.
@query("""WITH RECURSIVE n AS (SELECT user_id AS stream, event_id AS seq, event_type AS payload, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
c AS (SELECT stream, seq, i, '' AS previous_hash, sha256(concat('', '|', payload)) AS entry_hash FROM n WHERE i = 1 UNION ALL SELECT n.stream, n.seq, n.i, c.entry_hash, sha256(concat(c.entry_hash, '|', n.payload)) FROM c JOIN n ON n.stream = c.stream AND n.i = c.i + 1)
SELECT stream, seq, (seq % 97 = 0) AS changed, (seq % 89 = 0) AS cut FROM c WHERE seq % 97 = 0 OR seq % 89 = 0""")
def audit_chain_verify(spark, sf_dir):
    events = B.table(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("seq"), F.col("event_type").alias("payload"))
    one = F.sort_array(F.collect_list(F.struct("seq", "payload")))  # test input only: a chain is made entry by entry
    link = lambda done, e: F.concat(done, F.array(F.struct(e["seq"].alias("seq"), e["payload"].alias("payload"), F.coalesce(F.try_element_at(done, F.lit(-1))["entry_hash"], F.lit("")).alias("previous_hash"), operations.entry_hash(F.coalesce(F.try_element_at(done, F.lit(-1))["entry_hash"], F.lit("")), e["payload"]).alias("entry_hash"))))
    none = F.array().cast("array<struct<seq: bigint, payload: string, previous_hash: string, entry_hash: string>>")
    log = events.groupBy("stream").agg(one.alias("e")).select("stream", F.explode(F.aggregate("e", none, link)).alias("l")).select("stream", "l.*")
    bad = log.withColumn("payload", F.when(F.col("seq") % 97 == 0, F.concat("payload", F.lit("!"))).otherwise(F.col("payload"))).withColumn("previous_hash", F.when(F.col("seq") % 89 == 0, "cut").otherwise(F.col("previous_hash")))
    return operations.audit_breaks(bad).select("stream", "seq", (F.col("seq") % 97 == 0).alias("changed"), (F.col("previous_hash") == "cut").alias("cut"))


@query("""WITH RECURSIVE g AS (SELECT w / 100.0 AS win, CAST(r AS DOUBLE) AS reward FROM (SELECT unnest(range(30, 71, 5)) AS w), (SELECT unnest([1.0, 1.5, 2.0, 3.0]) AS r)),
b AS (SELECT win, reward, 0.0::DOUBLE AS lo, (1 - 1e-9)::DOUBLE AS hi, 0 AS k FROM g UNION ALL SELECT win, reward, CASE WHEN win * pow((lo + hi) / 2, 1 + reward) - (lo + hi) / 2 + (1 - win) > 0 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN win * pow((lo + hi) / 2, 1 + reward) - (lo + hi) / 2 + (1 - win) > 0 THEN hi ELSE (lo + hi) / 2 END, k + 1 FROM b WHERE k < 100),
z AS (SELECT win, reward, CASE WHEN win * reward - (1 - win) > 1e-12 THEN (lo + hi) / 2 ELSE 1.0 END AS root FROM b WHERE k = 100) SELECT CAST(win AS DOUBLE) AS win, reward, round(root, 6) AS root, round(pow(root, 20), 6) AS ruin_after_20r FROM z""")
def risk_of_ruin(spark, sf_dir):
    grid = spark.range(30, 71, 5).select((F.col("id") / 100).alias("win")).join(F.broadcast(spark.createDataFrame([(1.0,), (1.5,), (2.0,), (3.0,)], "reward double")))
    return rounded(grid.withColumn("root", stats.ruin_root(F.col("win"), F.col("reward"))).withColumn("ruin_after_20r", F.pow("root", F.lit(20.0))), "root", "ruin_after_20r")


@query("""WITH RECURSIVE g AS (SELECT l / 100.0 AS loss, CAST(t AS INTEGER) AS trades, k FROM (SELECT unnest(range(30, 71, 10)) AS l), (SELECT unnest([20, 60, 100]) AS t), (SELECT unnest([3, 5, 8]) AS k)),
d AS (SELECT CAST(loss AS DOUBLE) AS loss, trades, k, 0 AS step, list_transform(range(k), lambda i: CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS run, 0.0::DOUBLE AS hit FROM g
 UNION ALL SELECT loss, trades, k, step + 1, list_prepend(list_sum(run) * (1 - loss), list_transform(run[1:k - 1], lambda x: x * loss)), hit + run[k] * loss FROM d WHERE step < trades),
e AS (SELECT loss, trades, k, hit FROM d WHERE step = trades)
SELECT loss, trades, round(max(CASE WHEN k = 3 THEN hit END), 6) AS streak_3, round(max(CASE WHEN k = 5 THEN hit END), 6) AS streak_5, round(max(CASE WHEN k = 8 THEN hit END), 6) AS streak_8,
 round(1 - pow(1 - loss, 10) - 10 * loss * pow(1 - loss, 9) - 45 * pow(loss, 2) * pow(1 - loss, 8), 6) AS three_of_ten FROM e GROUP BY loss, trades""")
def streak_probability(spark, sf_dir):
    grid = spark.range(30, 71, 10).select((F.col("id") / 100).alias("loss")).join(F.broadcast(spark.range(20, 101, 40).select(F.col("id").cast("int").alias("trades"))))
    return rounded(grid.withColumns({f"streak_{k}": stats.streak_probability(F.col("loss"), F.col("trades"), k) for k in (3, 5, 8)}).withColumn("three_of_ten", stats.binomial_tail(F.col("loss"), 10, 3)), "streak_3", "streak_5", "streak_8", "three_of_ten")
