"""Queries over claims, forecasts, calculators and bounded reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, browse, desk, evidence, profiles
from ..sources import bars as B
from .registry import AS_OF, BARS_A, BITEMPORAL, KNOWN, W, query, rounded, steps
from .series import A, known

_CLAIMS = """cl AS (SELECT c_nationkey AS claim, count(*) AS trials, avg(CASE WHEN o_totalprice > 130000 + c_nationkey * 1000 THEN 1.0 ELSE 0.0 END) AS hit_rate, avg(CASE WHEN o_totalprice > 150000 THEN 1.0 ELSE 0.0 END) AS control_hit_rate, avg((o_totalprice - 130000) / 100000) AS expectancy_r, avg((o_totalprice - 150000) / 100000) AS control_expectancy_r,
 c_nationkey % 4 * 0.11 AS cost_r, 1 + c_nationkey % 6 AS comparisons, CASE WHEN c_nationkey % 5 = 0 THEN 2.5 END AS measured_z, c_nationkey % 3 <> 0 AS pre_registered, DATE '1996-01-01' AS registered_on, CASE WHEN c_nationkey % 7 = 0 THEN DATE '1996-01-01' ELSE CAST(max(o_orderdate) AS DATE) END AS data_ends FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey),
cz AS (SELECT *, hit_rate - control_hit_rate AS edge, coalesce(measured_z, (hit_rate - control_hit_rate) / nullif(sqrt((hit_rate * (1 - hit_rate) + control_hit_rate * (1 - control_hit_rate)) / trials), 0), 0.0) AS z, CASE WHEN comparisons <= 1 THEN 1.96 ELSE 1.96 * sqrt(1 + ln(comparisons)) END AS required_z, expectancy_r - control_expectancy_r - cost_r AS net_r FROM cl)"""


@query(f"""WITH {_CLAIMS} SELECT claim, round(edge, 6) AS edge, round(z, 6) AS z, round(required_z, 6) AS required_z, round(net_r, 6) AS net_r, array_to_string(list_filter([CASE WHEN NOT pre_registered THEN 'registered' END, CASE WHEN edge <= 0 THEN 'control' END, CASE WHEN z < required_z THEN 'significance' END, CASE WHEN net_r <= 0 THEN 'costs' END, CASE WHEN data_ends <= registered_on THEN 'forward' END], lambda x: x IS NOT NULL), ',') AS failures,
 pre_registered AND edge > 0 AND z >= required_z AND net_r > 0 AND data_ends > registered_on AS proven FROM cz""")
def evidence_gate(spark, sf_dir):
    n, price = F.col("n"), F.col("o_totalprice")
    rows = B.table(spark, sf_dir, "orders").join(B.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n")), F.col("o_custkey") == F.col("c_custkey"))
    share = lambda hit: F.avg(hit.cast("double"))
    claims = rows.groupBy("n").agg(F.count(F.lit(1)).alias("trials"), share(price > 130000 + n * 1000).alias("hit_rate"), share(price > 150000).alias("control_hit_rate"), F.avg((price - 130000) / 100000).alias("expectancy_r"), F.avg((price - 150000) / 100000).alias("control_expectancy_r"), F.max("o_orderdate").cast("date").alias("_last"))
    day = F.lit("1996-01-01").cast("date")
    claims = claims.withColumns({"cost_r": n % 4 * 0.11, "comparisons": 1 + n % 6, "measured_z": F.when(n % 5 == 0, 2.5), "pre_registered": n % 3 != 0, "registered_on": day, "data_ends": F.when(n % 7 == 0, day).otherwise(F.col("_last"))})
    out = evidence.gate(claims).select(F.col("n").alias("claim"), "edge", "z", "required_z", "net_r", F.array_join("failures", ",").alias("failures"), "proven")
    return rounded(out, "edge", "z", "required_z", "net_r")


_NEEDED = f"CAST(ceil((({evidence.CONFIDENCE_Z} + {evidence.POWER_Z}) * ({evidence.EDGE_R} * sqrt({evidence.EDGE_INSTANTS}) / {evidence.EDGE_T}) / edge) ** 2) AS BIGINT)"


@query(f"""WITH m AS (SELECT o_custkey AS rule, count(DISTINCT o_orderdate) AS instants, count(*) AS decisions, CASE WHEN date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) > 0 THEN count(DISTINCT o_orderdate) / (date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) / 7.0) END AS instants_per_week, o_custkey % 2 = 0 AS wide FROM orders GROUP BY o_custkey),
n AS (SELECT *, CASE WHEN wide THEN 0.0212 ELSE 0.05 END AS edge FROM m), k AS (SELECT *, {_NEEDED} AS needed FROM n)
SELECT rule, instants, decisions, needed, round(least(1.0, instants / needed), 6) AS fraction, CAST(instants // 120 AS BIGINT) AS independent_blocks, DATE '1999-01-01' + CAST(floor(greatest(0, needed - instants) / nullif(instants_per_week, 0) * 7) AS INTEGER) AS answerable_on FROM k""")
def readiness_dates(spark, sf_dir):
    """When each customer's orders, taken for instants of a forward test, could answer its question."""
    days = F.datediff(F.max("o_orderdate"), F.min("o_orderdate"))
    rows = B.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("rule")).agg(F.count_distinct("o_orderdate").alias("instants"), F.count(F.lit(1)).alias("decisions"), days.alias("_days"))
    rows = rows.withColumn("instants_per_week", F.when(F.col("_days") > 0, F.col("instants") / (F.col("_days") / 7.0)))
    edge = F.when(F.col("rule") % 2 == 0, 0.0212).otherwise(0.05)
    return rounded(evidence.readiness(rows, F.lit("1999-01-01").cast("date"), edge).select("rule", "instants", "decisions", "needed", "fraction", "independent_blocks", "answerable_on"), "fraction")


@query("""WITH e AS (SELECT o_orderkey AS entry, CASE o_orderkey % 5 WHEN 0 THEN 'abandoned' WHEN 1 THEN 'breakeven' WHEN 2 THEN 'loss' ELSE 'win' END AS outcome, CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 100) / 100.0 END::DOUBLE AS p FROM orders), r AS (SELECT *, CASE WHEN outcome = 'abandoned' THEN 'never_taken' WHEN outcome = 'breakeven' THEN 'scratch' WHEN p IS NULL THEN 'no_probability' END AS reason, CASE WHEN outcome = 'win' THEN 1.0 ELSE 0.0 END AS y FROM e)
SELECT entry, reason, CASE WHEN reason IS NULL THEN round(y - p, 6) END AS surprise, CASE WHEN reason IS NULL THEN round((p - y) ** 2, 6) END AS brier FROM r""")
def prediction_checks(spark, sf_dir):
    k = F.col("o_orderkey")
    outcome = F.when(k % 5 == 0, "abandoned").when(k % 5 == 1, "breakeven").when(k % 5 == 2, "loss").otherwise("win")
    entries = B.table(spark, sf_dir, "orders").select(k.alias("entry"), outcome.alias("outcome"), F.when(k % 7 != 0, k % 100 / 100).alias("probability"))
    return evidence.prediction_check(entries).select("entry", "reason", "surprise", "brier")


@query("SELECT event_id, event_type AS symbol, ts AS window_start FROM events WHERE event_type = 'view' AND event_id % 3 <> 0 AND event_id % 2 = 1 ORDER BY ts, event_id LIMIT 200")
def findings_browse(spark, sf_dir):
    """Open errors of one symbol by window, a page of 200; the event's number stands for the issue's name."""
    n = F.col("event_id")
    rows = B.table(spark, sf_dir, "events").select(n.alias("issue"), F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("window_start"), F.when(n % 2 == 1, "error").otherwise("info").alias("severity"), F.when(n % 3 == 0, F.col("ts")).alias("resolved_at"))
    return browse.findings(rows, symbol="view", severity="error", timeframe=None).select(F.col("issue").alias("event_id"), "symbol", "window_start")


@query("SELECT concat('P', lpad(CAST(p_partkey AS VARCHAR), 7, '0')) AS symbol FROM part WHERE p_partkey % 4 <> 0 ORDER BY 1 LIMIT 25 OFFSET 50")
def instruments_page(spark, sf_dir):
    k = F.col("p_partkey")
    rows = B.table(spark, sf_dir, "part").select(F.concat(F.lit("P"), F.lpad(k.cast("string"), 7, "0")).alias("symbol"), (k % 4 != 0).alias("is_active"))
    return browse.instruments(rows, 25, 50).select("symbol")


@query("""WITH s AS (SELECT o_custkey AS account, CAST(o_orderdate AS TIMESTAMP) + to_seconds(o_orderkey) AS recorded_at, round(o_totalprice, 2) AS equity, round(o_totalprice - (o_orderkey % 9 - 4) * 10, 2) AS balance FROM orders)
SELECT account, recorded_at, equity, round(equity - balance, 2) AS floating FROM s QUALIFY row_number() OVER (PARTITION BY account ORDER BY recorded_at DESC) <= 5""")
def equity_curves(spark, sf_dir):
    k = F.col("o_orderkey")
    at = F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + k)
    rows = B.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("account"), at.alias("recorded_at"), F.round("o_totalprice", 2).alias("equity"), F.round(F.col("o_totalprice") - (k % 9 - 4) * 10, 2).alias("balance"))
    return browse.equity_curve(rows, 5).select("account", "recorded_at", "equity", "floating")


@query(f"""WITH {BARS_A}, {BITEMPORAL}, {KNOWN}, {steps('k')}, m AS (SELECT *, avg(ret) OVER (PARTITION BY symbol) AS mu, lead(ret) OVER {W} AS nx FROM st), g AS (SELECT symbol, count(*) AS bars, avg((ret - mu) * (nx - mu)) / nullif(var_pop(ret), 0) AS ac FROM m GROUP BY symbol HAVING count(*) >= 200),
i AS (SELECT DISTINCT event_type AS symbol FROM events UNION ALL SELECT 'idle'), f AS (SELECT symbol, CAST(epoch(TIMESTAMP '{AS_OF}') - epoch(max(event_time)) - 3600 AS BIGINT) AS age FROM k GROUP BY 1)
SELECT symbol, age AS data_age_seconds, CASE WHEN ac > 0.05 THEN 'trending' WHEN ac < -0.05 THEN 'mean_reverting' WHEN bars IS NOT NULL THEN 'neutral' END AS tendency, round(ac, 6) AS autocorrelation, CASE WHEN bars IS NULL THEN '' ELSE 'structure,volatility' END AS profiles_available FROM i LEFT JOIN f USING (symbol) LEFT JOIN g USING (symbol)""")
def scanner_rows(spark, sf_dir):
    """Data age and profiles of every instrument; one that has no bars stays, with nothing measured."""
    seen = known(spark, sf_dir)
    names = B.table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol")).distinct().unionByName(spark.range(1).select(F.lit("idle").alias("symbol")))
    as_of = F.lit(AS_OF).cast("timestamp")
    structure = profiles.structure(seen).select("symbol", F.lit("structure").alias("kind"), as_of.alias("as_of"), "tendency", "autocorrelation")
    volatility = profiles.volatility(seen).select("symbol", F.lit("volatility").alias("kind"), as_of.alias("as_of"), F.lit(None).cast("string").alias("tendency"), F.lit(None).cast("double").alias("autocorrelation"))
    out = browse.scanner(names, asof.freshness(seen, AS_OF, B.HOUR), structure.unionByName(volatility))
    return rounded(out.select("symbol", "data_age_seconds", "tendency", "autocorrelation", F.array_join("profiles_available", ",").alias("profiles_available")), "autocorrelation")


@query(f"""WITH {BARS_A}, {steps('a')}, v AS (SELECT symbol, event_time, close, CASE WHEN count(tr) OVER (PARTITION BY symbol ORDER BY event_time ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) = 14 THEN avg(tr) OVER (PARTITION BY symbol ORDER BY event_time ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) END AS atr FROM st),
h AS (SELECT *, hour(event_time) AS hr, isodow(event_time) AS wd FROM v)
SELECT symbol, event_time, round(CASE WHEN atr > 0 AND close > 0 THEN atr / CASE WHEN symbol = 'view' THEN 0.01 ELSE 0.0001 END END, 1) AS atr_pips, round(CASE WHEN atr > 0 AND close > 0 THEN atr / close * 100 END, 4) AS atr_percent,
 array_to_string(list_filter([CASE WHEN hr >= 21 OR hr < 6 THEN 'Sydney' END, CASE WHEN hr < 9 THEN 'Tokyo' END, CASE WHEN hr >= 7 AND hr < 16 THEN 'London' END, CASE WHEN hr >= 12 AND hr < 21 THEN 'New York' END], lambda x: x IS NOT NULL), ',') AS busy, wd > 5 OR (wd = 5 AND hr >= 16) AS weekend_ahead,
 round(CASE WHEN hr % 5 <> 0 AND atr > 0 THEN 2 * atr / 0.25 * 0.5 * (1 + hr % 3) / 100 END, 6) AS open_r, CASE hr % 4 WHEN 0 THEN 5 WHEN 1 THEN 60 WHEN 2 THEN 1440 ELSE 60 END AS bar_minutes FROM h""")
def desk_figures(spark, sf_dir):
    """The calculators on every bar: volatility three ways, busy sessions, the weekend, open risk, minutes of a decision's bar."""
    from ..operators import features

    rows = features.compute(A(spark, sf_dir), ["atr_14"])
    hour, atr = F.hour("event_time"), F.col("atr_14")
    pip = desk.pip_size(F.when(F.col("symbol") == "view", "USDJPY").otherwise("EURUSD"))
    volatility = desk.volatility_figures(atr, F.col("close"), pip)
    stop = F.when(hour % 5 != 0, F.col("close") - 2 * atr).otherwise(F.col("close"))
    frame = F.when(hour % 4 == 0, "M5").when(hour % 4 == 1, "H1").when(hour % 4 == 2, "D1")
    out = rows.select("symbol", "event_time", volatility.alias("v"), F.array_join(desk.busy_sessions(F.col("event_time")), ",").alias("busy"), desk.weekend_ahead(F.col("event_time")).alias("weekend_ahead"), desk.open_risk_r(F.col("close"), stop, 1.0 + hour % 3, F.lit(0.25), F.lit(0.5), F.lit(100.0)).alias("open_r"), desk.bar_minutes(frame).alias("bar_minutes"))
    return rounded(out.select("symbol", "event_time", "v.atr_pips", "v.atr_percent", "busy", "weekend_ahead", "open_r", "bar_minutes"), "open_r")
