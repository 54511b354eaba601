"""Queries over symbols, files, sizes, news, reports, calendars with holidays and scalar statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats, text
from ..operators import asof, calendars, desk, learning, operations, outcomes, quality, risk
from ..sources import bars as B
from ..sources import files
from ..sources.shared import fresh_folder
from .registry import BARS_A, BARS_C, W, query, rounded
from .series import A

# Raw broker symbols from events: two currency codes, decorated in one of ten ways.
_MARKS = ["", ".m", "-ECN", "_micro", "m", "#", ".PRO.raw", "/x", ".cent", "Z"]
_LIST = "[" + ", ".join(f"'{c}'" for c in text.CURRENCIES) + "]"
_RAW = f"""rw AS (SELECT DISTINCT concat({_LIST}[event_id % {len(text.CURRENCIES)} + 1], {_LIST}[(event_id * 7 + 3) % {len(text.CURRENCIES)} + 1], [{', '.join(f"'{m}'" for m in _MARKS)}][event_id % 10 + 1]) AS raw FROM events)"""


def raw_symbols(spark, sf_dir):
    n, k = F.col("event_id"), len(text.CURRENCIES)
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    return B.table(spark, sf_dir, "events").select(F.concat(pick(text.CURRENCIES, n % k), pick(text.CURRENCIES, (n * 7 + 3) % k), pick(_MARKS, n % 10)).alias("raw")).distinct()


_SUFFIX = f"[{''.join(sorted(text.SEPARATORS.replace('-', '')))}-]?({'|'.join(text.SUFFIXES)})$"
_CLEAN = "regexp_replace({0}, '[^A-Z0-9]', '', 'g')"
_CANONICAL = f"""{_RAW}, pe AS (SELECT raw, upper(trim(raw)) AS up, upper(trim(raw)) AS cand, {_CLEAN.format('upper(trim(raw))')} AS bare, false AS done FROM rw
 UNION ALL SELECT raw, up, CASE WHEN stop THEN cand ELSE shorter END, bare, stop OR n = 6 FROM (SELECT *, shorter = cand OR n < 6 AS stop FROM (SELECT *, length({_CLEAN.format('shorter')}) AS n FROM (SELECT *, regexp_replace(cand, '{_SUFFIX}', '') AS shorter FROM pe WHERE NOT done)))),
ca AS (SELECT raw, CASE WHEN length(bare) = 6 AND bare = up THEN bare ELSE coalesce(nullif({_CLEAN.format('cand')}, ''), bare) END AS symbol FROM pe WHERE done)"""


@query(f"WITH RECURSIVE {_CANONICAL} SELECT raw, symbol FROM ca")
def canonical_symbols(spark, sf_dir):
    return raw_symbols(spark, sf_dir).select("raw", text.canonical_symbol(F.col("raw")).alias("symbol"))


_IN = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
_PAIR = f"length(symbol) = 6 AND substr(symbol, 4, 3) IN {_IN(text.CURRENCIES)} AND substr(symbol, 1, 3) IN "
_COIN_PREFIX = " ".join(f"WHEN symbol LIKE '{c}%' AND substr(symbol, {len(c) + 1}) IN {_IN([*text.CURRENCIES, *text.DOLLAR_COINS])} THEN '{c}'" for c in text.COINS)
_SHAPES = """sp AS (SELECT DISTINCT concat(['XAU', 'XAG', 'BTC', 'DOGE', 'EUR', 'USD', 'US5', 'ABC'][event_id % 8 + 1], ['USD', 'HUF', 'USDT', '00', 'INR'][event_id % 5 + 1]) AS symbol FROM events)"""


@query(f"""WITH {_SHAPES}, cl AS (SELECT symbol, CASE WHEN {_PAIR}{_IN(text.METALS)} THEN 'metal' WHEN {_PAIR}{_IN(text.COINS)} THEN 'crypto' WHEN {_PAIR}{_IN(text.CURRENCIES)} THEN 'forex' END AS pc, CASE {_COIN_PREFIX} END AS coin FROM sp)
SELECT symbol, coalesce(pc, CASE WHEN coin IS NOT NULL THEN 'crypto' ELSE 'other' END) AS asset_class, CASE WHEN pc IS NOT NULL THEN substr(symbol, 1, 3) ELSE coin END AS base, CASE WHEN pc IS NOT NULL THEN substr(symbol, 4, 3) WHEN coin IS NOT NULL THEN substr(symbol, length(coin) + 1) END AS quote FROM cl""")
def asset_classes(spark, sf_dir):
    n = F.col("event_id")
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    shapes = B.table(spark, sf_dir, "events").select(F.concat(pick(["XAU", "XAG", "BTC", "DOGE", "EUR", "USD", "US5", "ABC"]), pick(["USD", "HUF", "USDT", "00", "INR"])).alias("symbol")).distinct()
    return shapes.select("symbol", text.classified(F.col("symbol")).alias("c")).select("symbol", "c.*")


_MESSAGE = """CASE event_id % 5 WHEN 0 THEN concat('Failed  after ', event_id, 'ms at ', strftime(ts, '%Y-%m-%d %H:%M:%S'), 'Z') WHEN 1 THEN concat('User ', event_id + 5000, ' timed out') WHEN 2 THEN concat('node abc', event_id % 7 + 1000, ' lost')
 WHEN 3 THEN concat(chr(9), ' Job 0f8fad5b-d9cb-469f-a165-7086728', 10000 + event_id % 90000, ' ended ') ELSE concat('code ', event_id % 4, ' port ', 8000 + event_id % 9) END"""


@query(f"""WITH m AS (SELECT event_type AS source, {_MESSAGE} AS message FROM events), k AS (SELECT source, regexp_replace(regexp_replace(lower(regexp_replace(message, '^\\s+|\\s+$', '', 'g')), '{text.VOLATILE}', '#', 'g'), '\\s+', ' ', 'g') AS bones FROM m)
SELECT concat(source, ':', substr(sha256(concat(source, '|', bones)), 1, 24)) AS fingerprint, count(*) AS occurrences FROM k GROUP BY 1""")
def fingerprints(spark, sf_dir):
    n, s = F.col("event_id"), lambda x: x.cast("string")
    kinds = [
        F.concat(F.lit("Failed  after "), s(n), F.lit("ms at "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("Z")), F.concat(F.lit("User "), s(n + 5000), F.lit(" timed out")),
        F.concat(F.lit("node abc"), s(n % 7 + 1000), F.lit(" lost")), F.concat(F.lit("\t Job 0f8fad5b-d9cb-469f-a165-7086728"), s(10000 + n % 90000), F.lit(" ended ")), F.concat(F.lit("code "), s(n % 4), F.lit(" port "), s(8000 + n % 9)),
    ]
    message = F.element_at(F.array(*kinds), (n % 5 + 1).cast("int"))
    rows = B.table(spark, sf_dir, "events").select(text.fingerprint(F.col("event_type"), message).alias("fingerprint"))
    return rows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("occurrences"))


@query(f"""WITH {BARS_A} SELECT symbol, event_time, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, CASE WHEN CAST(epoch(event_time) AS BIGINT) // 3600 % 5 = 0 THEN NULL ELSE volume END AS volume, CASE WHEN symbol < 'p' THEN volume * 3 END AS tick_volume, CASE WHEN symbol < 'p' THEN 0.5::DOUBLE END AS spread, concat('csv:', symbol, ':H1') AS source_ref
FROM a WHERE event_time >= TIMESTAMP '2024-01-05 00:00:00' AND event_time < TIMESTAMP '2024-01-20 00:00:00'""")
def csv_bars(spark, sf_dir):
    """Every symbol as a CSV file; those before p have the optional columns, the others lack them."""
    root, rows = fresh_folder(spark, "csv"), A(spark, sf_dir)
    hour = F.floor(F.unix_timestamp("event_time") / B.HOUR)
    rows = rows.withColumn("volume", F.when(hour % 5 == 0, None).otherwise(F.col("volume"))).withColumn("tick_volume", F.col("volume") * 3)
    whole = A(spark, sf_dir).select("symbol", "event_time", (F.col("volume") * 3).alias("tick_volume"))
    rows = rows.drop("tick_volume").join(whole, ["symbol", "event_time"]).withColumn("time", F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    for symbol in [r["symbol"] for r in rows.select("symbol").distinct().collect()]:  # one folder a symbol, as a provider delivers them
        optional = ("tick_volume", F.lit(0.5).alias("spread")) if symbol < "p" else ()
        rows.where(F.col("symbol") == symbol).select("time", "open", "high", "low", "close", "volume", *optional).write.option("header", True).csv(f"{root}/{symbol}/H1.csv")
    return rounded(files.csv_bars(spark, root, "H1", "2024-01-05 00:00:00", "2024-01-20 00:00:00"), "open", "high", "low", "close")


def _word(column):
    return F.lpad(F.hex(column.cast("long")), 8, "0")


def _single(count):
    """The bits of a whole number below 2**24 as a 32-bit float, in hexadecimal."""
    power = F.floor(F.log2(count)).cast("int")
    fraction = ((count / F.pow(F.lit(2.0), power) - 1) * 2**23).cast("long")
    return _word(F.when(count > 0, (power.cast("long") + 127) * (1 << 23) + fraction).otherwise(0))


@query(f"WITH {BARS_A} SELECT symbol, event_time, CAST(round(open * 1000) AS BIGINT) / 1000.0 AS open, CAST(round(high * 1000) AS BIGINT) / 1000.0 AS high, CAST(round(low * 1000) AS BIGINT) / 1000.0 AS low, CAST(round(close * 1000) AS BIGINT) / 1000.0 AS close, volume FROM a WHERE round(open * 1000) <> 0")
def binary_candles(spark, sf_dir):
    raw = lambda c: F.round(F.col(c) * 1000)
    day = F.date_trunc("day", "event_time")
    second = F.unix_timestamp("event_time") - F.unix_timestamp(day)
    record = F.concat(_word(second), _word(raw("open")), _word(raw("close")), _word(raw("low")), _word(raw("high")), _single(F.col("volume")))
    records = A(spark, sf_dir).select("symbol", day.alias("period_start"), F.struct(second.alias("s"), record.alias("r")).alias("e"))
    blobs = records.groupBy("symbol", "period_start").agg(F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list("e")), lambda e: e["r"]), "")).alias("content"))  # at most 24 a day
    return files.candles(blobs.withColumn("scale", F.lit(1000.0)))


@query("SELECT event_id, ts AS event_time, CAST(round(value * 100) AS BIGINT) / 100.0 + 0.02 AS ask, CAST(round(value * 100) AS BIGINT) / 100.0 AS bid, CAST(event_id % 50 AS DOUBLE) AS ask_volume, CAST(event_id % 7 AS DOUBLE) AS bid_volume FROM (SELECT event_id, date_trunc('hour', ts) + to_milliseconds(CAST(event_id % 1000 AS BIGINT)) AS ts, value FROM events)")
def binary_ticks(spark, sf_dir):
    n, bid = F.col("event_id"), F.round(F.col("value") * 100)
    record = F.concat(_word(n % 1000), _word(bid + 2), _word(bid), _single((n % 50).cast("double")), _single((n % 7).cast("double")))
    blobs = B.table(spark, sf_dir, "events").select(n.alias("symbol"), F.date_trunc("hour", "ts").cast("timestamp").alias("period_start"), F.lit(100.0).alias("scale"), F.unhex(record).alias("content"))
    return files.ticks(blobs).withColumnRenamed("symbol", "event_id").withColumns({c: F.round(c, 6) for c in ("ask", "bid")})


_SCALE_SQL = "CASE " + " ".join(f"WHEN abs(raw / {s:.1f} - ref) / ref <= 0.25 THEN {s!r}::DOUBLE" for s in files.SCALES) + " END"


@query(f"WITH r AS (SELECT p_partkey, p_retailprice AS ref, CAST(round(p_retailprice * [100000, 1000, 100, 10000, 1000000, 7][p_partkey % 6 + 1]) AS BIGINT) AS raw FROM part) SELECT p_partkey, raw, {_SCALE_SQL} AS scale FROM r")
def price_scales(spark, sf_dir):
    n = F.col("p_partkey")
    factor = F.element_at(F.array(*map(F.lit, (100000, 1000, 100, 10000, 1000000, 7))), (n % 6 + 1).cast("int"))
    rows = B.table(spark, sf_dir, "part").select("p_partkey", F.round(F.col("p_retailprice") * factor).cast("long").alias("raw"), F.col("p_retailprice").alias("ref"))
    return rows.select("p_partkey", "raw", files.price_scale(F.col("raw"), F.col("ref")).alias("scale"))


_SIZES = "sz AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'USDJPY' ELSE 'EURUSD' END AS symbol, c_acctbal AS equity, 0.5 + c_custkey % 4 * 0.5 AS risk, 0.001 * (c_custkey % 9) AS stop, CASE WHEN c_custkey % 11 <> 0 THEN 1.0 END AS tv, 0.00001 AS ts, CASE WHEN c_custkey % 5 = 0 THEN 0.1 END AS vmin, CASE WHEN c_custkey % 7 = 0 THEN 0.05 END AS vstep, c_custkey % 6 * 0.5 AS lots FROM customer)"


def _sizes(spark, sf_dir):
    n = F.col("c_custkey")
    return B.table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(n % 3 == 0, "USDJPY").otherwise("EURUSD").alias("symbol"), F.col("c_acctbal").alias("equity"), (0.5 + n % 4 * 0.5).alias("risk_percent"), (0.001 * (n % 9)).alias("stop_distance"), F.when(n % 11 != 0, 1.0).alias("tick_value"), F.lit(0.00001).alias("tick_size"),
        F.when(n % 5 == 0, 0.1).alias("volume_min"), F.when(n % 7 == 0, 0.05).alias("volume_step"), (n % 6 * 0.5).alias("lots"),
    )


_STEP = "coalesce(nullif(vstep, 0), 0.01)"


@query(f"""WITH {_SIZES}, e AS (SELECT *, tv > 0 AND stop > 0 AND equity > 0 AS ok, stop / ts * tv AS loss, equity * (risk / 100.0) / (stop / ts * tv) AS exact FROM sz), f AS (SELECT *, round(floor(CAST(exact AS DOUBLE) / CAST({_STEP} AS DOUBLE)) * CAST({_STEP} AS DOUBLE), 8) AS rd FROM e)
SELECT c_custkey, CASE WHEN ok THEN round(CAST(exact AS DOUBLE), 6) END AS lots_exact, CASE WHEN ok THEN CASE WHEN rd >= coalesce(vmin, {_STEP}) THEN round(rd, 6) ELSE 0.0 END END AS lots FROM f""")
def lot_sizes(spark, sf_dir):
    return rounded(desk.lot_size(_sizes(spark, sf_dir).drop("lots")).select("c_custkey", "lots_exact", "lots"), "lots_exact", "lots")


@query(f"""WITH {_SIZES} SELECT c_custkey, CASE WHEN tv > 0 AND lots > 0 THEN round(CAST(tv * CASE WHEN symbol = 'USDJPY' THEN 0.01 ELSE 0.0001 END / ts * lots AS DOUBLE), 6) END AS pip_value, CASE WHEN stop > 0 THEN round(CAST(0.0002 / stop AS DOUBLE), 6) END AS cost_r FROM sz""")
def pip_values(spark, sf_dir):
    rows = desk.pip_value(_sizes(spark, sf_dir)).withColumn("cost_r", desk.cost_in_r(F.lit(0.0002), F.col("stop_distance")))
    return rounded(rows.select("c_custkey", "pip_value", "cost_r"), "pip_value", "cost_r")


_NEWS = """nd AS (SELECT event_id AS decision_id, ts AS at, CASE event_id % 4 WHEN 0 THEN 'EURUSD' WHEN 1 THEN 'GBPJPY' WHEN 2 THEN 'XAUUSD' ELSE 'US5' END AS symbol FROM events),
nr AS (SELECT CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate + to_seconds(CAST(o_orderkey * 7919 % 86400 AS BIGINT)) + INTERVAL 3 YEAR END AS at, ['usd', 'EUR', 'JPY', 'CHF'][o_orderkey % 4 + 1] AS currency, CASE WHEN o_orderkey % 3 = 0 THEN 'Low' ELSE 'High' END AS impact FROM orders)"""


@query(f"""WITH {_NEWS}, h AS (SELECT DISTINCT nd.decision_id FROM nd JOIN nr ON nr.impact = 'High' AND abs(epoch(date_trunc('second', nr.at)) - epoch(date_trunc('second', nd.at))) <= 300 AND upper(nr.currency) IN (substr(nd.symbol, 1, 3), substr(nd.symbol, 4, 3)) WHERE length(nd.symbol) = 6)
SELECT nd.decision_id, CASE WHEN length(nd.symbol) = 6 THEN h.decision_id IS NOT NULL END AS blocked FROM nd LEFT JOIN h USING (decision_id)""")
def news_overlap(spark, sf_dir):
    n, o = F.col("event_id"), F.col("o_orderkey")
    symbol = F.element_at(F.array(*map(F.lit, ("EURUSD", "GBPJPY", "XAUUSD", "US5"))), (n % 4 + 1).cast("int"))
    decisions = B.table(spark, sf_dir, "events").select(n.alias("decision_id"), F.col("ts").cast("timestamp").alias("at"), symbol.alias("symbol"))
    moment = F.add_months("o_orderdate", 36).cast("timestamp")
    at = F.when(o % 9 != 0, F.timestamp_seconds(F.unix_timestamp(moment) + o * 7919 % 86400))
    releases = B.table(spark, sf_dir, "orders").select(at.alias("at"), F.element_at(F.array(*map(F.lit, ("usd", "EUR", "JPY", "CHF"))), (o % 4 + 1).cast("int")).alias("currency"), F.when(o % 3 == 0, "Low").otherwise("High").alias("impact"))
    return desk.news_blocked(decisions, releases).select("decision_id", "blocked")


@query("SELECT o_orderpriority AS price_source, o_orderstatus AS arm, count(*) AS recorded, count(CASE WHEN o_orderkey % 4 <> 0 THEN 1 END) AS resolved, count(*) - count(CASE WHEN o_orderkey % 4 <> 0 THEN 1 END) AS still_open, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at FROM orders GROUP BY 1, 2")
def journal_counts(spark, sf_dir):
    at = F.col("o_orderdate").cast("timestamp")
    entries = B.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("price_source"), F.col("o_orderstatus").alias("arm"), at.alias("opened_at"), F.when(F.col("o_orderkey") % 4 != 0, at).alias("closed_at"))
    return desk.journal_counts(entries)


@query("""WITH t AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'strategy' WHEN o_orderkey % 3 = 1 THEN 'hold' ELSE 'coin' END AS name, o_orderkey // 3 AS d, o_totalprice FROM orders), g AS (SELECT name, count(*) AS decisions, sum(o_totalprice) AS r FROM t GROUP BY 1), s AS (SELECT decisions AS n, r AS sr FROM g WHERE name = 'strategy')
SELECT name, decisions, round(r, 2) AS total_r, round(sr, 2) AS strategy_r, CASE WHEN decisions = n THEN sr > r END AS beaten FROM g, s WHERE name <> 'strategy'""")
def benchmark_baselines(spark, sf_dir):
    o = F.col("o_orderkey")
    name = F.element_at(F.array(F.lit("strategy"), F.lit("hold"), F.lit("coin")), (o % 3 + 1).cast("int"))
    rows = B.table(spark, sf_dir, "orders").select(name.alias("name"), F.floor(o / 3).alias("decision_id"), F.col("o_totalprice").alias("r"))
    return rounded(desk.benchmarked(rows), "total_r", "strategy_r", places=2)


@query("WITH g AS (SELECT user_id AS service, count(*) AS observed, avg(CASE WHEN value < 60 THEN 1.0 ELSE 0.0 END) AS s FROM events GROUP BY 1) SELECT service, observed, CASE WHEN observed >= 100 THEN round(s, 6) END AS attained, CASE WHEN observed >= 100 THEN s >= 0.7 END AS met FROM g")
def slo_attainment(spark, sf_dir):
    rows = B.table(spark, sf_dir, "events").select(F.col("user_id").alias("service"), (F.col("value") < 60).alias("good"))
    return rounded(desk.attainment(rows, 0.7), "attained")


@query(f"WITH {BARS_C}, l AS (SELECT symbol, max(event_time) AS t FROM c WHERE symbol <> 'N3' OR event_time < TIMESTAMP '1997-01-01' GROUP BY 1), k AS (SELECT t AS event_time, count(*) AS symbols FROM l GROUP BY 1 HAVING count(*) >= 5) SELECT * FROM k ORDER BY event_time DESC LIMIT 1")
def modal_instant(spark, sf_dir):
    rows = B.weekly_nation_bars(spark, sf_dir).where("symbol <> 'N3' or event_time < timestamp '1997-01-01'")
    return desk.modal_instant(rows, 5)


@query(f"WITH {BARS_C}, r AS (SELECT symbol, event_time, close, row_number() OVER (PARTITION BY symbol ORDER BY event_time DESC) AS age, count(*) OVER (PARTITION BY symbol) AS n FROM c) SELECT symbol, event_time, round(close, 6) AS close, CAST(age AS INTEGER) AS age FROM r WHERE age <= 80 AND n >= 80")
def last_bars_snapshot(spark, sf_dir):
    return rounded(desk.snapshot(B.weekly_nation_bars(spark, sf_dir)).select("symbol", "event_time", "close", "age"), "close")


@query("""WITH p AS (SELECT event_type AS symbol, CASE WHEN event_id % 2 = 0 THEN 'clock' ELSE 'volatility' END AS kind, ts AS as_of, ts + to_hours(CAST(event_id % 30 AS BIGINT)) AS computed_at, event_id FROM events)
SELECT symbol, kind, event_id FROM (SELECT *, row_number() OVER (PARTITION BY symbol, kind ORDER BY as_of DESC, computed_at DESC) AS k FROM p WHERE as_of <= TIMESTAMP '2024-01-20 00:00:00' AND computed_at <= TIMESTAMP '2024-01-20 00:00:00') WHERE k = 1""")
def profiles_known(spark, sf_dir):
    n, at = F.col("event_id"), F.col("ts").cast("timestamp")
    rows = B.table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.when(n % 2 == 0, "clock").otherwise("volatility").alias("kind"), at.alias("as_of"), F.timestamp_millis(F.unix_millis(at) + (n % 30) * 3_600_000).alias("computed_at"), "event_id")
    return desk.profiles_asof(rows, "2024-01-20 00:00:00").select("symbol", "kind", "event_id")


@query("""WITH f AS (SELECT event_type AS symbol, ['gap', 'outlier'][event_id % 2 + 1] AS issue, date_trunc('day', ts) AS window_start, event_id, ts FROM events) SELECT symbol, issue, window_start, max_by(event_id, ts) AS event_id FROM f GROUP BY 1, 2, 3""")
def findings_latest(spark, sf_dir):
    n = F.col("event_id")
    rows = B.table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.when(n % 2 == 0, "gap").otherwise("outlier").alias("issue"), F.date_trunc("day", "ts").cast("timestamp").alias("window_start"), F.col("ts").cast("timestamp").alias("detected_at"), "event_id")
    return quality.latest_findings(rows).select("symbol", "issue", "window_start", "event_id")


@query(f"WITH {BARS_A} SELECT symbol, count(*) AS bars FROM a WHERE symbol IN (SELECT event_type FROM events GROUP BY 1 HAVING count(*) % 2 = 0) GROUP BY 1")
def training_bars(spark, sf_dir):
    datasets = B.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("symbol")).agg((F.count(F.lit(1)) % 2 == 0).alias("is_training_eligible"))
    return asof.training_eligible(A(spark, sf_dir), datasets).groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"))


@query(f"WITH {BARS_A}, d AS (SELECT CASE WHEN h % 23 = 0 THEN NULL ELSE event_time END AS t, CASE WHEN h % 19 = 0 THEN 0.0 ELSE low END AS low, open, high, close FROM (SELECT *, CAST(epoch(event_time) AS BIGINT) // 3600 AS h FROM a)) SELECT count(*) AS fetched, count(*) FILTER (WHERE t IS NULL OR NOT least(open, high, low, close) > 0) AS rejected FROM d")
def ingest_counts(spark, sf_dir):
    h = F.floor(F.unix_timestamp("event_time") / B.HOUR)
    rows = A(spark, sf_dir).withColumn("h", h).withColumn("event_time", F.when(F.col("h") % 23 != 0, F.col("event_time"))).withColumn("low", F.when(F.col("h") % 19 == 0, 0.0).otherwise(F.col("low")))
    return operations.normalised(rows)[1]


_NY = "timezone('America/New_York', timezone('UTC', event_time))"
_SECOND = f"(hour({_NY}) * 3600 + minute({_NY}) * 60)"
_FX_OPEN = f"(isodow({_NY}) BETWEEN 1 AND 4 OR (isodow({_NY}) = 7 AND hour({_NY}) >= 17) OR (isodow({_NY}) = 5 AND hour({_NY}) < 17))"


@query(f"""WITH {BARS_A}, x AS (SELECT symbol, event_time, {_FX_OPEN} AS o, CAST({_NY} AS DATE) AS d, {_SECOND} AS s FROM a)
SELECT symbol, event_time, o AND NOT CASE WHEN d = DATE '2024-01-15' AND symbol = 'click' THEN s < 36000 WHEN d = DATE '2024-01-15' THEN true WHEN d = DATE '2024-01-18' THEN s >= 46800 ELSE false END AS is_open FROM x""")
def holiday_hours(spark, sf_dir):
    rows = [(None, "2024-01-15", "closed", None, None), ("click", "2024-01-15", "late_open", 36000, None), (None, "2024-01-18", "early_close", None, 46800)]
    holidays = spark.createDataFrame(rows, "symbol string, day string, kind string, opens_at int, closes_at int").select("symbol", F.to_date("day").alias("holiday_date"), "kind", "opens_at", "closes_at")
    return calendars.is_open(A(spark, sf_dir), *calendars.FX_HOURS, holidays=holidays).select("symbol", "event_time", "is_open")


@query(f"""WITH q AS (SELECT DISTINCT date_trunc('hour', ts) AS asked_at FROM events WHERE event_id % 10 = 0), p AS (SELECT asked_at, unnest(range(1, 1345)) AS k FROM q), g AS (SELECT asked_at, asked_at + to_minutes(15 * k) AS event_time FROM p), o AS (SELECT asked_at, event_time, {_FX_OPEN} AS o FROM g), n AS (SELECT event_time AS asked_at, {_FX_OPEN} AS now FROM (SELECT asked_at AS event_time FROM q))
SELECT asked_at, CASE WHEN NOT max(now) THEN min(CASE WHEN o THEN event_time END) END AS next_open, CASE WHEN max(now) THEN min(CASE WHEN NOT o THEN event_time END) END AS next_close FROM o JOIN n USING (asked_at) GROUP BY asked_at""")
def next_sessions(spark, sf_dir):
    asked = B.table(spark, sf_dir, "events").where("event_id % 10 = 0").select(F.date_trunc("hour", "ts").cast("timestamp").alias("asked_at")).distinct()
    return calendars.next_open_close(asked, *calendars.FX_HOURS, time="asked_at")


@query("""WITH r AS (SELECT event_type AS kind, CAST(DATE '2024-02-15' - CAST(ts AS DATE) AS INTEGER) AS age, user_id % 3 = 0 AS protected FROM events), p AS (SELECT event_type AS kind, 20 + length(event_type) AS keep FROM events GROUP BY 1)
SELECT kind, count(*) FILTER (WHERE age > keep) AS eligible, count(*) FILTER (WHERE age > keep AND protected) AS held, count(*) FILTER (WHERE age > keep AND NOT protected) AS removable FROM r JOIN p USING (kind) GROUP BY 1""")
def retention_policy(spark, sf_dir):
    rows = B.table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("at"), (F.col("user_id") % 3 == 0).alias("protected"))
    policy = rows.select("kind").distinct().withColumn("keep_days", 20 + F.length("kind"))
    return operations.retention(rows, policy, "2024-02-15 00:00:00")


@query("WITH a AS (SELECT o_orderkey AS decision_id, o_orderstatus AS before FROM orders WHERE o_orderkey % 13 <> 0), b AS (SELECT o_orderkey AS decision_id, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS after FROM orders WHERE o_orderkey % 17 <> 0) SELECT decision_id, before, after FROM a FULL JOIN b USING (decision_id) WHERE before IS DISTINCT FROM after")
def replayed_decisions(spark, sf_dir):
    o = F.col("o_orderkey")
    orders = B.table(spark, sf_dir, "orders").select(o.alias("decision_id"), F.col("o_orderstatus").alias("stopped_at"))
    after = orders.where("decision_id % 17 <> 0").withColumn("stopped_at", F.when(F.col("decision_id") % 10 == 0, "X").otherwise(F.col("stopped_at")))
    return operations.replay_changes(orders.where("decision_id % 13 <> 0"), after)


# The moves as the rules state them, for the checking SQL alone.
_MOVES = """('draft', 'submitted'), ('draft', 'cancelled'), ('submitted', 'accepted'), ('submitted', 'rejected'), ('submitted', 'partially_filled'), ('submitted', 'filled'), ('submitted', 'unknown'), ('accepted', 'partially_filled'), ('accepted', 'filled'), ('accepted', 'cancelled'), ('accepted', 'rejected'), ('accepted', 'unknown'),
 ('partially_filled', 'filled'), ('partially_filled', 'cancelled'), ('partially_filled', 'unknown'), ('unknown', 'accepted'), ('unknown', 'partially_filled'), ('unknown', 'filled'), ('unknown', 'cancelled'), ('unknown', 'rejected')"""
_STATES = ("draft", "submitted", "unknown", "accepted", "partially_filled", "filled", "cancelled", "rejected")


@query(f"""WITH o AS (SELECT user_id AS order_id, event_id, {list(_STATES)}[CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 + CASE WHEN event_id % 5 = 0 THEN event_id % 7 ELSE 0 END AS BIGINT) % 8 + 1] AS state FROM events), m AS (SELECT *, lag(state) OVER (PARTITION BY order_id ORDER BY event_id) AS b FROM o)
SELECT order_id, event_id, b AS before, state FROM m WHERE CASE WHEN b IS NULL THEN state <> 'draft' ELSE (b, state) NOT IN ({_MOVES}) END""")
def illegal_order_moves(spark, sf_dir):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1 + F.when(F.col("event_id") % 5 == 0, F.col("event_id") % 7).otherwise(0)
    orders = B.table(spark, sf_dir, "events").select(F.col("user_id").alias("order_id"), "event_id", F.element_at(F.array(*map(F.lit, _STATES)), (place % 8 + 1).cast("int")).alias("state"))
    return risk.illegal_moves(orders.withColumnRenamed("event_id", "at")).select("order_id", F.col("at").alias("event_id"), "before", "state")


@query("""WITH i AS (SELECT o_orderkey AS intent, o_custkey % 25 AS symbol, 0.5 + o_orderkey % 3 * 0.5 AS risk_r FROM orders), a AS (SELECT c_custkey AS account, c_custkey % 11 = 0 AS killed, c_custkey % 7 <> 0 AS enabled, CASE WHEN c_custkey % 5 > 0 THEN [c_nationkey, (c_nationkey + 1) % 25] ELSE [] END AS permitted, 0.5 + c_custkey % 4 * 0.5 AS top FROM customer),
k AS (SELECT DISTINCT symbol, risk_r FROM i), n AS (SELECT symbol, risk_r, CASE WHEN killed THEN 'kill_switch' WHEN NOT enabled THEN 'disabled' WHEN len(permitted) > 0 AND NOT list_contains(permitted, symbol) THEN 'not_permitted' WHEN risk_r > top THEN 'ceiling' ELSE 'routed' END AS reason FROM k, a),
c AS (SELECT symbol, risk_r, count(*) FILTER (reason = 'routed') AS routed, count(*) FILTER (reason = 'kill_switch') AS kill_switch, count(*) FILTER (reason = 'disabled') AS disabled, count(*) FILTER (reason = 'not_permitted') AS not_permitted, count(*) FILTER (reason = 'ceiling') AS ceiling FROM n GROUP BY 1, 2)
SELECT intent, routed, kill_switch, disabled, not_permitted, ceiling FROM i JOIN c USING (symbol, risk_r)""")
def routed_intents(spark, sf_dir):
    """For every order as an intent: how many customers as accounts take it, and how many skip it for which reason."""
    o, c, n = F.col("o_orderkey"), F.col("c_custkey"), F.col("c_nationkey").cast("long")
    intents = B.table(spark, sf_dir, "orders").select(o.alias("intent"), (F.col("o_custkey") % 25).cast("long").alias("symbol"), (0.5 + o % 3 * 0.5).alias("risk_r"))
    listed = F.when(c % 5 > 0, F.array(n, (n + 1) % 25)).otherwise(F.array().cast("array<bigint>"))
    accounts = B.table(spark, sf_dir, "customer").select(c.alias("account"), (c % 11 == 0).alias("killed"), (c % 7 != 0).alias("enabled"), listed.alias("permitted"), (0.5 + c % 4 * 0.5).alias("max_risk_r"))
    return risk.routing(intents, accounts)


@query("""WITH g AS (SELECT p_brand, avg(p_retailprice - 1000) AS m, stddev_samp(p_retailprice) AS s, count(*) AS n FROM part GROUP BY 1), t AS (SELECT *, m / (s / sqrt(n)) AS t FROM g WHERE n > 1 AND s > 0)
SELECT p_brand, round(abs(m) * sqrt(n) / abs(nullif(t, 0)), 6) AS spread, CAST(ceil(((1.959963984540054 + 0.8416212335729143) * s / m) ** 2) AS BIGINT) AS needed, floor(m * 100) / 100 AS floored, round_even(s, 2) AS money FROM t""")
def scalar_statistics(spark, sf_dir):
    g = B.table(spark, sf_dir, "part").groupBy("p_brand").agg(F.avg(F.col("p_retailprice") - 1000).alias("m"), F.stddev_samp("p_retailprice").alias("s"), F.count(F.lit(1)).alias("n")).where("n > 1 and s > 0")
    t = F.col("m") / (F.col("s") / F.sqrt("n"))
    return g.select("p_brand", F.round(stats.spread_from_t(F.col("m"), t, F.col("n")), 6).alias("spread"), stats.sample_size(F.col("m"), F.col("s")).cast("long").alias("needed"), stats.floor_to(F.col("m"), 2).alias("floored"), stats.money(F.col("s")).alias("money"))


@query(f"""WITH {BARS_A}, nb AS (SELECT *, row_number() OVER {W} AS i, count(*) OVER (PARTITION BY symbol) AS n FROM a), d AS (SELECT symbol, event_time, i, n, close AS entry, CASE WHEN i % 13 <> 0 THEN close * 0.7 END AS stop, close * 1.5 AS target FROM nb WHERE i % 7 = 0),
m AS (SELECT d.symbol, d.event_time, nb.i AS j, nb.low <= stop AS hs, nb.high >= target AS ht FROM d JOIN nb ON d.symbol = nb.symbol AND nb.i > d.i AND nb.i <= d.i + 24), f AS (SELECT symbol, event_time, min(j) AS j, arg_min(hs, j) AS hs, arg_min(ht, j) AS ht FROM m WHERE hs OR ht GROUP BY 1, 2)
SELECT d.symbol, d.event_time, CASE WHEN stop IS NULL THEN 'excluded' WHEN hs AND ht THEN CASE WHEN n - d.i >= 24 THEN 'abandoned' ELSE 'open' END WHEN hs THEN 'loss' WHEN ht THEN 'win' WHEN n - d.i >= 24 THEN 'abandoned' ELSE 'open' END AS status FROM d LEFT JOIN f USING (symbol, event_time)""")
def resolved_decisions(spark, sf_dir):
    from pyspark.sql import Window

    bars = A(spark, sf_dir)
    own = bars.withColumn("i", F.row_number().over(Window.partitionBy("symbol").orderBy("event_time"))).where("i % 7 = 0")
    decisions = own.select("symbol", "event_time", F.lit(1).alias("side"), F.col("close").alias("entry"), F.when(F.col("i") % 13 != 0, F.col("close") * 0.7).alias("stop"), (F.col("close") * 1.5).alias("target"))
    return outcomes.resolved(bars, decisions, 24).select("symbol", "event_time", "status")


@query("""WITH a AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'rule' ELSE 'control' END AS arm, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice - 150000 END AS r FROM orders), g AS (SELECT count(r) FILTER (WHERE arm = 'rule') AS rule_n, count(*) FILTER (WHERE arm = 'rule' AND r > 0) AS rule_hits, count(r) FILTER (WHERE arm = 'control') AS control_n, count(*) FILTER (WHERE arm = 'control' AND r > 0) AS control_hits FROM a),
e AS (SELECT *, (rule_hits + control_hits) / (rule_n + control_n) AS p FROM g) SELECT rule_n, rule_hits, control_n, control_hits, round(rule_hits / rule_n - control_hits / control_n, 6) AS edge, round((rule_hits / rule_n - control_hits / control_n) / sqrt(p * (1 - p) * (1.0 / rule_n + 1.0 / control_n)), 6) AS z FROM e""")
def arm_comparison(spark, sf_dir):
    o = F.col("o_orderkey")
    arms = B.table(spark, sf_dir, "orders").select(F.when(o % 2 == 0, "rule").otherwise("control").alias("arm"), F.when(o % 5 != 0, F.col("o_totalprice") - 150000).alias("r"))
    return rounded(learning.comparison(arms), "edge", "z")
