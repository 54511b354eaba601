"""Queries over bars: point-in-time reads, windows, features, quality, sessions, episodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, calendars, features, outcomes, quality
from ..sources import bars as B
from .registry import AS_OF, BARS_A, BARS_C, BITEMPORAL, KNOWN, W, frame, query, rounded, steps

A = B.hourly_event_bars
OHLC = ("open", "high", "low", "close")
_R = "round({0}, 6) AS {0}"
_ohlc = ", ".join(_R.format(c) for c in OHLC)


def known(spark, sf_dir):
    return asof.bars_asof(B.bitemporal(A(spark, sf_dir)), AS_OF, B.HOUR)


@query(f"WITH {BARS_A}, {BITEMPORAL}, {KNOWN} SELECT symbol, event_time, {_ohlc}, volume, CAST(revision AS INTEGER) AS revision FROM k")
def asof_latest_revision(spark, sf_dir):
    return rounded(known(spark, sf_dir).drop("ingested_at"), *OHLC)


@query(f"WITH {BARS_A}, {BITEMPORAL}, {KNOWN} SELECT symbol, event_time, round(close, 6) AS close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY event_time DESC) AS age, count(*) OVER (PARTITION BY symbol) AS n FROM k) WHERE age <= 24 AND n >= 20")
def asof_lookback_n(spark, sf_dir):
    return rounded(asof.lookback(asof.no_lookahead(known(spark, sf_dir), AS_OF, B.HOUR), 24, 20).select("symbol", "event_time", "close"), "close")


@query(f"WITH {BARS_A}, {BITEMPORAL}, {KNOWN} SELECT symbol, max(event_time) AS newest, CAST(epoch(TIMESTAMP '{AS_OF}') - epoch(max(event_time)) - 3600 AS BIGINT) AS age_seconds, epoch(TIMESTAMP '{AS_OF}') - epoch(max(event_time)) - 3600 > 10800 AS stale FROM k GROUP BY symbol")
def freshness_by_symbol(spark, sf_dir):
    return asof.freshness(known(spark, sf_dir), AS_OF, B.HOUR)


@query("""WITH l AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view')
SELECT l.user_id, l.ts, l.event_id, r.value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def asof_join_last_event(spark, sf_dir):
    events = B.table(spark, sf_dir, "events")
    left = events.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    return asof.asof_join(left, events.where("event_type = 'view'").select("user_id", "ts", "value"), "user_id", "ts", ["value"])


@query(f"WITH {BARS_A} SELECT symbol, event_time, {_ohlc}, volume FROM a")
def ohlcv_tumbling(spark, sf_dir):
    return rounded(A(spark, sf_dir), *OHLC)


@query("""SELECT event_type AS symbol, w AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, unnest(generate_series(date_trunc('hour', ts) - INTERVAL 3 HOUR, date_trunc('hour', ts), INTERVAL 1 HOUR)) AS w FROM events) GROUP BY 1, 2""")
def ohlcv_sliding(spark, sf_dir):
    events = B.table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return events.groupBy(F.col("event_type").alias("symbol"), F.window("at", "4 hours", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select("symbol", F.col("w.start").alias("window_start"), "n", "total")


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS events FROM s GROUP BY user_id, k""")
def session_windows(spark, sf_dir):
    events = B.table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return events.groupBy("user_id", F.session_window("at", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("events")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


_seed = (1 - 2 / 21) ** 40
_EMA_SQL = " + ".join([f"{_seed!r} * avg(close) OVER {frame(59, -40)}", *[f"{(2 / 21) * (1 - 2 / 21) ** k!r} * lag(close, {k}) OVER {W}" for k in range(40)]])
#: Each feature's SQL over the steps CTE, and the bars it needs before its own.
FEATURE_SQL = {
    "return_1": ("ret", 1),
    "return_5": (f"CASE WHEN close > 0 AND lag(close, 5) OVER {W} > 0 THEN ln(close / lag(close, 5) OVER {W}) END", 5),
    "sma_20": (f"avg(close) OVER {frame(19)}", 19),
    "ema_20": (_EMA_SQL, 59),
    "close_over_sma_20": (f"CASE WHEN avg(close) OVER {frame(19)} > 0 THEN close / avg(close) OVER {frame(19)} END", 19),
    "atr_14": (f"avg(tr) OVER {frame(13)}", 14),
    "atr_14_pct": (f"CASE WHEN close > 0 THEN avg(tr) OVER {frame(13)} / close END", 14),
    "realized_vol_20": (f"CASE WHEN count(ret) OVER {frame(19)} >= 2 THEN stddev_pop(ret) OVER {frame(19)} END", 20),
    "rsi_14": (f"CASE WHEN avg(down) OVER {frame(13)} = 0 THEN CASE WHEN avg(up) OVER {frame(13)} > 0 THEN 100.0 ELSE 50.0 END ELSE 100.0 - 100.0 / (1.0 + avg(up) OVER {frame(13)} / nullif(avg(down) OVER {frame(13)}, 0)) END", 14),
    "position_in_range_20": (f"(close - min(low) OVER {frame(19)}) / nullif(max(high) OVER {frame(19)} - min(low) OVER {frame(19)}, 0)", 19),
    "bar_range_pct": ("CASE WHEN close > 0 THEN (high - low) / close END", 0),
    "body_ratio": ("abs(close - open) / nullif(high - low, 0)", 0),
}


def feature_sql(names, places=6) -> str:
    return ", ".join(f"round(CAST(CASE WHEN n > {FEATURE_SQL[f][1]} THEN {FEATURE_SQL[f][0]} END AS DOUBLE), {places}) AS {f}" for f in names)


def _feature_query(name: str, names: list[str]):
    def run(spark, sf_dir):
        return rounded(features.compute(A(spark, sf_dir), names).select("symbol", "event_time", *names), *names)

    run.__name__ = name
    query(f"WITH {BARS_A}, {steps('a')} SELECT symbol, event_time, {feature_sql(names)} FROM st")(run)


for _name, _features in {
    "feature_returns": ["return_1", "return_5"], "feature_sma": ["sma_20", "close_over_sma_20"], "feature_ema": ["ema_20"], "feature_atr": ["atr_14", "atr_14_pct"],
    "feature_vol": ["realized_vol_20"], "feature_rsi": ["rsi_14"], "feature_range_pos": ["position_in_range_20"], "feature_candle": ["bar_range_pct", "body_ratio"],
}.items():
    _feature_query(_name, _features)
ALL = list(FEATURE_SQL)


@query(f"WITH {BARS_A}, {BITEMPORAL}, {KNOWN}, {steps('k')}, f AS (SELECT symbol, event_time, {feature_sql(ALL)} FROM st) SELECT * FROM f QUALIFY event_time = max(event_time) OVER (PARTITION BY symbol)")
def features_asof(spark, sf_dir):
    return rounded(features.latest(known(spark, sf_dir)).select("symbol", "event_time", *ALL), *ALL)


@query(f"WITH {BARS_A}, {steps('a')}, f AS (SELECT symbol, event_time, {feature_sql(['sma_20', 'rsi_14', 'atr_14'])} FROM st), u AS (UNPIVOT f ON sma_20, rsi_14, atr_14 INTO NAME name VALUE value) SELECT symbol, event_time, name, CAST(1 AS INTEGER) AS feature_version, event_time + INTERVAL 1 HOUR AS computed_at, value FROM u")
def features_tall(spark, sf_dir):
    return rounded(features.materialise(A(spark, sf_dir), B.HOUR, ["sma_20", "rsi_14", "atr_14"]), "value")


@query(f"WITH {BARS_A}, {steps('a')} SELECT symbol, event_time, {feature_sql(['sma_20'])[:-len(' AS sma_20')]} AS \"sma_20@1\", {feature_sql(['rsi_14'])[:-len(' AS rsi_14')]} AS \"rsi_14@1\" FROM st QUALIFY event_time <= TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR AND n > 14")
def features_pivot_asof(spark, sf_dir):
    tall = features.materialise(A(spark, sf_dir), B.HOUR, ["sma_20", "rsi_14"])
    wide = asof.features_asof(tall, AS_OF, B.HOUR)
    return wide.select("symbol", "event_time", F.round(F.col("`sma_20@1`"), 6).alias("sma_20@1"), F.round(F.col("`rsi_14@1`"), 6).alias("rsi_14@1"))


@query("SELECT name, CAST(feature_version AS INTEGER) AS feature_version, CAST(lookback AS INTEGER) AS lookback FROM (VALUES " + ", ".join(f"('{f}', 1, {v[1]})" for f, v in FEATURE_SQL.items()) + ") t(name, feature_version, lookback)")
def feature_catalogue(spark, sf_dir):
    return features.catalogue(spark)


# Defects are planted by hour number, the same in both engines.
_DEFECTS = """d AS (SELECT symbol, CASE WHEN h % 41 = 0 THEN event_time + INTERVAL 1 SECOND ELSE event_time END AS event_time, CASE WHEN h % 53 = 0 THEN -1.0 ELSE open END AS open, high, CASE WHEN h % 29 = 0 THEN high + 1 ELSE low END AS low, close,
  CASE WHEN h % 37 = 0 THEN -volume ELSE volume END AS volume, CASE WHEN h % 31 = 0 THEN h * 2 - 5 ELSE h * 2 END AS arrival FROM (SELECT *, CAST(epoch(event_time) AS BIGINT) // 3600 AS h FROM a) WHERE h % 100 NOT IN (7, 8, 9)),
dd AS (SELECT * FROM d UNION ALL SELECT symbol, event_time, open, high, low, close, volume, arrival + 1 FROM d WHERE (CAST(epoch(event_time) AS BIGINT) // 3600) % 61 = 0)"""


def defective(spark, sf_dir):
    h = F.floor(F.unix_timestamp("event_time") / 3600)
    rows = A(spark, sf_dir).withColumn("h", h).where(~(F.col("h") % 100).isin(7, 8, 9))
    rows = rows.withColumns({
        "event_time": F.when(F.col("h") % 41 == 0, F.timestamp_seconds(F.unix_timestamp("event_time") + 1)).otherwise(F.col("event_time")), "open": F.when(F.col("h") % 53 == 0, -1.0).otherwise(F.col("open")),
        "low": F.when(F.col("h") % 29 == 0, F.col("high") + 1).otherwise(F.col("low")), "volume": F.when(F.col("h") % 37 == 0, -F.col("volume")).otherwise(F.col("volume")), "arrival": F.when(F.col("h") % 31 == 0, F.col("h") * 2 - 5).otherwise(F.col("h") * 2),
    })
    again = rows.where("h % 61 = 0").withColumn("arrival", F.col("arrival") + 1)
    return rows.unionByName(again).drop("h")


_FIND = "symbol, '{issue}' AS issue, '{severity}' AS severity, event_time AS window_start, event_time AS window_end, CAST(1 AS BIGINT) AS affected_rows"


def _find(issue, severity):
    return _FIND.format(issue=issue, severity=severity)


_OK = "least(open, high, low, close) > 0"
_STRUCTURE = f"""SELECT {_find('non_positive_price', 'critical')} FROM dd WHERE NOT {_OK} UNION ALL SELECT {_find('invalid_ohlc_relation', 'error')} FROM dd WHERE {_OK} AND (high < greatest(open, close) OR low > least(open, close))
UNION ALL SELECT {_find('invalid_ohlc_relation', 'critical')} FROM dd WHERE {_OK} AND high < low UNION ALL SELECT {_find('abnormal_volume', 'error')} FROM dd WHERE {_OK} AND volume < 0"""


@query(f"WITH {BARS_A}, {_DEFECTS} {_STRUCTURE}")
def dq_structure(spark, sf_dir):
    return quality.structure(defective(spark, sf_dir))


@query(f"WITH {BARS_A}, {_DEFECTS} SELECT {_find('duplicate_bar', 'error')} FROM (SELECT *, row_number() OVER (PARTITION BY symbol, event_time ORDER BY arrival) AS k FROM dd) WHERE k > 1 UNION ALL SELECT {_find('non_monotonic', 'warning')} FROM (SELECT *, lag(event_time) OVER (PARTITION BY symbol ORDER BY arrival) AS p FROM dd) WHERE event_time < p")
def dq_duplicates(spark, sf_dir):
    rows = defective(spark, sf_dir)
    return quality.duplicates(rows).unionByName(quality.disorder(rows))


@query(f"WITH {BARS_A}, {_DEFECTS} SELECT {_find('session_mismatch', 'warning')} FROM dd WHERE CAST(epoch(event_time) AS BIGINT) % 3600 <> 0")
def dq_alignment(spark, sf_dir):
    return quality.misaligned(defective(spark, sf_dir), B.HOUR)


@query(f"""WITH {BARS_A}, {_DEFECTS}, g AS (SELECT DISTINCT symbol, event_time FROM dd), p AS (SELECT *, lag(event_time) OVER {W} AS p FROM g), q AS (SELECT *, CAST(floor((epoch(event_time) - epoch(p)) / 3600) AS BIGINT) AS slots FROM p)
SELECT symbol, 'missing_candle' AS issue, CASE WHEN len(list_filter(generate_series(date_trunc('day', p + INTERVAL 1 HOUR), date_trunc('day', event_time - INTERVAL 1 HOUR), INTERVAL 1 DAY), lambda x: isodow(x) >= 6)) > 0 THEN 'info' ELSE 'warning' END AS severity,
p + INTERVAL 1 HOUR AS window_start, event_time - INTERVAL 1 HOUR AS window_end, slots - 1 AS affected_rows FROM q WHERE slots > 1""")
def dq_gaps_naive(spark, sf_dir):
    return quality.gaps(defective(spark, sf_dir), B.HOUR)


_NY = "timezone('America/New_York', timezone('UTC', {0}))"
_FX_OPEN = lambda t: (lambda n: f"(isodow({n}) BETWEEN 1 AND 4 OR (isodow({n}) = 7 AND hour({n}) >= 17) OR (isodow({n}) = 5 AND hour({n}) < 17))")(_NY.format(t))
_RUNS = f"""bd AS (SELECT symbol, min(event_time) AS f, max(event_time) AS l FROM a GROUP BY symbol), sl AS (SELECT symbol, unnest(generate_series(f, l, INTERVAL 1 HOUR)) AS event_time FROM bd), op AS (SELECT symbol, event_time, row_number() OVER {W} AS slot FROM sl WHERE {_FX_OPEN('event_time')}),
gn AS (SELECT op.*, slot - row_number() OVER (PARTITION BY op.symbol ORDER BY op.event_time) AS island FROM op ANTI JOIN a ON op.symbol = a.symbol AND op.event_time = a.event_time)"""


@query(f"WITH {BARS_A}, {_RUNS} SELECT symbol, 'missing_candle' AS issue, 'warning' AS severity, min(event_time) AS window_start, max(event_time) AS window_end, count(*) AS affected_rows FROM gn GROUP BY symbol, island")
def dq_gaps_calendar(spark, sf_dir):
    return quality.calendar_gaps(A(spark, sf_dir), B.HOUR, *calendars.FX_HOURS)


@query(f"WITH {BARS_A} SELECT symbol, 'session_mismatch' AS issue, 'warning' AS severity, min(event_time) AS window_start, max(event_time) AS window_end, count(*) AS affected_rows FROM a WHERE NOT {_FX_OPEN('event_time')} GROUP BY symbol")
def dq_off_hours(spark, sf_dir):
    return quality.off_hours(A(spark, sf_dir), *calendars.FX_HOURS)


@query(f"""WITH {BARS_C}, g AS (SELECT symbol, event_time, CASE WHEN lag(close) OVER {W} > 0 THEN (open - lag(close) OVER {W}) / lag(close) OVER {W} END AS gap, high - low AS rg, volume AS vol FROM c),
z AS (SELECT symbol, event_time, CASE WHEN count(gap) OVER p >= 30 AND stddev_pop(gap) OVER p > 0 THEN (gap - avg(gap) OVER p) / stddev_pop(gap) OVER p END AS zg, CASE WHEN count(rg) OVER p >= 30 AND stddev_pop(rg) OVER p > 0 THEN (rg - avg(rg) OVER p) / stddev_pop(rg) OVER p END AS zr,
 CASE WHEN count(vol) OVER p >= 30 AND stddev_pop(vol) OVER p > 0 THEN (vol - avg(vol) OVER p) / stddev_pop(vol) OVER p END AS zv FROM g WINDOW p AS (PARTITION BY symbol))
SELECT {_find('price_gap', 'warning')} FROM z WHERE abs(zg) > 8 UNION ALL SELECT {_find('outlier', 'warning')} FROM z WHERE zr > 12 UNION ALL SELECT {_find('abnormal_volume', 'info')} FROM z WHERE zv > 10""")
def dq_zscore(spark, sf_dir):
    return quality.outliers(B.weekly_nation_bars(spark, sf_dir))


@query(f"""WITH {BARS_A}, two AS (SELECT symbol, event_time, 'one' AS provider, close FROM a UNION ALL SELECT symbol, event_time, 'two', CASE WHEN (CAST(epoch(event_time) AS BIGINT) // 3600) % 29 = 0 THEN close * 1.003 ELSE close END FROM a WHERE (CAST(epoch(event_time) AS BIGINT) // 3600) % 7 <> 0),
e AS (SELECT symbol, event_time, count(DISTINCT provider) AS k, min(close) AS lo, max(close) AS hi FROM two GROUP BY 1, 2) SELECT symbol, event_time, round((hi - lo) / lo, 6) AS divergence FROM e WHERE k = 2 AND lo > 0 AND (hi - lo) / lo > 0.002""")
def dq_conflicts(spark, sf_dir):
    h = F.floor(F.unix_timestamp("event_time") / 3600)
    one = A(spark, sf_dir).select("symbol", "event_time", "close")
    two = one.where(h % 7 != 0).withColumn("close", F.when(h % 29 == 0, F.col("close") * 1.003).otherwise(F.col("close")))
    return rounded(quality.conflicts(one.withColumn("provider", F.lit("one")).unionByName(two.withColumn("provider", F.lit("two")))), "divergence")


@query(f"""WITH {BARS_A}, {_DEFECTS}, fi AS ({_STRUCTURE}), p AS (SELECT symbol, sum(affected_rows * CASE severity WHEN 'critical' THEN 20 WHEN 'error' THEN 4 WHEN 'warning' THEN 1 ELSE 0 END) AS penalty, count(*) AS findings, count(*) FILTER (WHERE severity = 'critical') AS blocking FROM fi GROUP BY symbol),
b AS (SELECT symbol, count(DISTINCT event_time) AS bars, min(event_time) AS first, max(event_time) AS last FROM dd GROUP BY symbol), j AS (SELECT b.*, CAST(coalesce(penalty, 0) AS BIGINT) AS penalty, coalesce(findings, 0) AS findings, coalesce(blocking, 0) AS blocking FROM b LEFT JOIN p USING (symbol))
SELECT *, round(greatest(0.0, least(1.0, 1 - CAST(penalty AS DOUBLE) / bars)), 6) AS score, greatest(0.0, least(1.0, 1 - CAST(penalty AS DOUBLE) / bars)) >= 0.8 AND blocking = 0 AS is_training_eligible FROM j""")
def dq_score(spark, sf_dir):
    rows = defective(spark, sf_dir)
    return rounded(quality.scores(rows, quality.structure(rows)), "score")


@query(f"""WITH {BARS_A}, {_DEFECTS}, fi AS ({_STRUCTURE}), p AS (SELECT symbol, sum(affected_rows * CASE severity WHEN 'critical' THEN 20 WHEN 'error' THEN 4 WHEN 'warning' THEN 1 ELSE 0 END) AS penalty FROM fi GROUP BY symbol), c AS (SELECT symbol, count(*) AS checked FROM dd GROUP BY symbol)
SELECT symbol, checked, CAST(coalesce(penalty, 0) AS BIGINT) AS penalty, round(greatest(0.0, least(1.0, 1 - CAST(coalesce(penalty, 0) AS DOUBLE) / checked)), 6) AS score FROM c LEFT JOIN p USING (symbol)""")
def dq_batch_score(spark, sf_dir):
    rows = defective(spark, sf_dir)
    return rounded(quality.batch_scores(rows, quality.structure(rows), "symbol"), "score")


def _session_sql(t: str) -> str:
    parts = []
    for name, (zone, opens, closes) in calendars.SESSIONS.items():
        local = f"timezone('{zone}', timezone('UTC', {t}))"
        parts.append(f"CASE WHEN isodow({local}) < 6 AND hour({local}) BETWEEN {opens} AND {closes - 1} THEN '{name}' END")
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


@query(f"WITH {BARS_A}, s AS (SELECT symbol, event_time, {_session_sql('event_time')} AS l FROM a), u AS (SELECT symbol, unnest(CASE WHEN len(l) = 0 THEN ['off'] ELSE l END) AS session FROM s) SELECT symbol, session, count(*) AS bars FROM u GROUP BY 1, 2")
def sessions_active(spark, sf_dir):
    return A(spark, sf_dir).select("symbol", F.explode(calendars.active_sessions(F.col("event_time"))).alias("session")).groupBy("symbol", "session").agg(F.count(F.lit(1)).alias("bars"))


@query(f"WITH {BARS_A}, bd AS (SELECT symbol, min(event_time) AS f, max(event_time) AS l FROM a GROUP BY symbol), sl AS (SELECT symbol, unnest(generate_series(f, l, INTERVAL 1 HOUR)) AS event_time FROM bd) SELECT symbol, event_time FROM sl WHERE {_FX_OPEN('event_time')}")
def market_open_grid(spark, sf_dir):
    bounds = A(spark, sf_dir).groupBy("symbol").agg(F.min("event_time").alias("first"), F.max("event_time").alias("last"))
    return calendars.grid(bounds, B.HOUR, *calendars.FX_HOURS)


H = 12
_OUTCOME = f"""o0 AS (SELECT *, row_number() OVER {W} AS i, count(*) OVER {frame(-1, H)} AS ahead, max(high) OVER {frame(-1, H)} AS hi, min(low) OVER {frame(-1, H)} AS lo, lead(close, {H}) OVER {W} AS ex,
 list(high) OVER {frame(-1, H)} AS hs, list(low) OVER {frame(-1, H)} AS ls FROM a),
oc AS (SELECT symbol, event_time, close AS entry_price, greatest(0.0, (hi - close) / close) AS max_up_pct, least(0.0, (lo - close) / close) AS max_down_pct, (ex - close) / close AS forward_return_pct,
 CASE WHEN hi > close THEN list_position(hs, hi) ELSE 0 END AS bars_to_max_up, CASE WHEN lo < close THEN list_position(ls, lo) ELSE 0 END AS bars_to_max_down, event_time + INTERVAL {H + 1} HOUR AS outcome_ready_at FROM o0 WHERE ahead = {H} AND close > 0)"""
_EP = ["max_up_pct", "max_down_pct", "forward_return_pct"]


@query(f"WITH {BARS_A}, {_OUTCOME} SELECT symbol, event_time, {', '.join(_R.format(c) for c in _EP)}, CAST(bars_to_max_up AS BIGINT) AS bars_to_max_up, CAST(bars_to_max_down AS BIGINT) AS bars_to_max_down FROM oc")
def episodes_forward_outcome(spark, sf_dir):
    rows = outcomes.forward(A(spark, sf_dir), H).where("forward_return_pct is not null")
    return rounded(rows.select("symbol", "event_time", *_EP, F.col("bars_to_max_up").cast("long"), F.col("bars_to_max_down").cast("long")), *_EP)


@query(f"WITH {BARS_A}, {_OUTCOME} SELECT symbol, event_time, round(forward_return_pct, 6) AS forward_return_pct FROM oc WHERE outcome_ready_at <= TIMESTAMP '{AS_OF}' AND (CAST(epoch(event_time) AS BIGINT) // 3600) % 4 = 0 AND list_contains({_session_sql('event_time')}, 'london')")
def episodes_matured(spark, sf_dir):
    built = outcomes.episodes(A(spark, sf_dir), B.HOUR, H, step=4, names=[])
    return rounded(asof.matured(built, AS_OF, "london").select("symbol", "event_time", "forward_return_pct"), "forward_return_pct")


@query(f"WITH {BARS_A}, {_OUTCOME} SELECT symbol, count(*) AS episodes, round(avg(CASE WHEN forward_return_pct > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive_share, round(median(forward_return_pct), 6) AS median_forward, round(avg(max_up_pct), 6) AS mean_max_up, round(avg(max_down_pct), 6) AS mean_max_down FROM oc GROUP BY symbol HAVING count(*) >= 20")
def outcome_distribution(spark, sf_dir):
    rows = outcomes.forward(A(spark, sf_dir), H).where("forward_return_pct is not null")
    return rounded(outcomes.distribution(rows, "symbol").where("episodes >= 20"), "positive_share", "median_forward", "mean_max_up", "mean_max_down")


@query(f"WITH {BARS_A}, {_OUTCOME} SELECT symbol, count(*) AS stored, min(event_time) AS first, max(event_time) AS last, count(*) FILTER (WHERE outcome_ready_at <= TIMESTAMP '{AS_OF}') AS matured FROM oc GROUP BY symbol")
def episode_coverage(spark, sf_dir):
    rows = outcomes.episodes(A(spark, sf_dir), B.HOUR, H, names=[])
    return rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("stored"), F.min("event_time").alias("first"), F.max("event_time").alias("last"), F.count_if(F.col("outcome_ready_at") <= asof.instant(AS_OF)).alias("matured"))
