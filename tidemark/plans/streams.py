"""Queries that run as streams and must equal their batch SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources import bars as B
from ..sources import stores
from ..sources.shared import fresh_folder
from ..streaming import ingest, record, resolve, stale
from .decisions import _ARMS, _STRETCH, _TAILS
from .registry import BARS_A, BARS_B, W, query, rounded
from .series import A


@query(f"WITH {BARS_A} SELECT symbol, event_time, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM a")
def stream_ingest(spark, sf_dir):
    return rounded(ingest.streamed_bars(spark, sf_dir), "open", "high", "low", "close")


#: Rows of one file of a replayed stream, about.
FILE_ROWS = 1 << 19


def replayed(spark, rows, name: str, pieces: int, time: str = "event_time", like=None, file_rows: int = FILE_ROWS):
    """``rows`` as a stream of one piece a batch, in ``pieces`` of equal spans of time, the earliest first; the spans are those of ``like`` where it is given.

    All pieces have the same number of files, which grows with the rows, so that no task writes or reads a whole piece.
    """
    rows = stores.stored(rows, f"{name}-rows")
    lo, hi = (rows if like is None else like).agg(F.min(F.unix_timestamp(time)), F.max(F.unix_timestamp(time))).first()
    folder, size = fresh_folder(spark, name), max(1, -(-(((hi or 0) - (lo or 0)) + 1) // pieces))
    piece = F.floor((F.unix_timestamp(time) - F.lit(lo or 0)) / size)
    files = max(1, -(-rows.count() // (pieces * file_rows)))
    for k in range(pieces):  # one after another: the file source takes them by age
        rows.where(piece == k).repartition(files).write.mode("append").parquet(folder)
        while len(spark.read.schema(rows.schema).parquet(folder).inputFiles()) < (k + 1) * files:  # a piece of few rows fills fewer
            rows.limit(0).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)


HORIZON = 24


def planted_decisions(bars):
    own = bars.withColumn("i", F.row_number().over(Window.partitionBy("symbol").orderBy("event_time"))).where("i % 7 = 0")
    ident = F.concat_ws("@", "symbol", F.unix_timestamp("event_time"))
    return own.select(ident.alias("decision_id"), "symbol", "event_time", F.lit(1).alias("side"), F.col("close").alias("entry"), (F.col("close") * 0.7).alias("stop"), (F.col("close") * 1.5).alias("target"))


@query(f"""WITH {BARS_A}, nb AS (SELECT *, row_number() OVER {W} AS i, count(*) OVER (PARTITION BY symbol) AS n FROM a), d AS (SELECT symbol, event_time, i, n, close AS entry, close * 0.7 AS stop, close * 1.5 AS target FROM nb WHERE i % 7 = 0),
m AS (SELECT d.symbol, d.event_time, nb.i - d.i AS j, nb.low <= stop AS hs, nb.high >= target AS ht, (target - entry) / (entry - stop) AS reward FROM d JOIN nb ON d.symbol = nb.symbol AND nb.i > d.i AND nb.i <= d.i + {HORIZON}), f AS (SELECT symbol, event_time, min(j) AS j, arg_min(hs, j) AS hs, arg_min(ht, j) AS ht, max(reward) AS reward FROM m WHERE hs OR ht GROUP BY 1, 2),
s AS (SELECT d.symbol, d.event_time, CASE WHEN hs <> ht AND hs THEN 'loss' WHEN hs <> ht AND ht THEN 'win' WHEN n - d.i >= {HORIZON} THEN 'abandoned' ELSE 'open' END AS status, j, reward FROM d LEFT JOIN f USING (symbol, event_time))
SELECT symbol, event_time, status, round(CASE status WHEN 'loss' THEN -1.0 WHEN 'win' THEN reward END, 6) AS r, CASE WHEN status IN ('win', 'loss') THEN j END AS bars_to_touch FROM s""")
def stream_resolve(spark, sf_dir):
    """Decisions resolved by a stream of bars; those still open at its end stay open."""
    bars = stores.stored(A(spark, sf_dir), "bars")
    decisions = stores.stored(planted_decisions(bars), "decisions")
    before = resolve.with_rocksdb(spark)
    path = fresh_folder(spark, "closed")
    closed = resolve.resolve(replayed(spark, bars, "bar-files", 4), replayed(spark, decisions, "decision-files", 4, like=bars), HORIZON)
    record.run(closed, lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}"), fresh_folder(spark, "resolve-state"))
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    found = spark.read.schema(resolve.OUTCOME).option("basePath", path).parquet(f"{path}/batch=*")
    out = decisions.join(found, "decision_id", "left").withColumn("status", F.coalesce("status", F.lit("open")))
    return rounded(out.select("symbol", "event_time", "status", "r", "bars_to_touch"), "r")


@query("""WITH h AS (SELECT DISTINCT concat('U', user_id) AS symbol, date_trunc('hour', ts) AS t FROM events), g AS (SELECT *, lead(t) OVER (PARTITION BY symbol ORDER BY t) AS n, max(t) OVER () AS m FROM h)
SELECT symbol, t AS last_seen, t + INTERVAL 4 HOUR AS stale_at FROM g WHERE n - t > INTERVAL 4 HOUR OR n IS NULL AND t + INTERVAL 4 HOUR < m - INTERVAL 30 MINUTE""")
def stream_stale(spark, sf_dir):
    """Hours of silence of each user beyond three bars after the last one's close."""
    hours = B.table(spark, sf_dir, "events").select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"), F.date_trunc("hour", "ts").cast("timestamp").alias("event_time")).distinct()
    before = resolve.with_rocksdb(spark)
    path = fresh_folder(spark, "silences")
    found = stale.silences(replayed(spark, hours, "hour-files", 4), B.HOUR)
    record.run(found, lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}"), fresh_folder(spark, "stale-state"))
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(stale.STALE).option("basePath", path).parquet(f"{path}/batch=*").select("symbol", "last_seen", "stale_at")


@query("SELECT o_custkey AS account, CAST(o_orderdate AS TIMESTAMP) + to_seconds(o_orderkey) AS recorded_at, round(o_totalprice, 6) AS equity FROM orders")
def equity_inserted(spark, sf_dir):
    """Equity samples of a stream that delivers a part of them again; each is stored once."""
    at = F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey"))
    rows = B.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("account"), at.alias("recorded_at"), F.col("o_totalprice").alias("equity"))
    again = rows.unionByName(rows.where("account % 3 = 0"))
    path = fresh_folder(spark, "equity")
    record.insert_samples(replayed(spark, again, "sample-files", 3, "recorded_at"), path, fresh_folder(spark, "equity-state"))
    return rounded(stores.read(spark, path, rows), "equity")


@query(f"WITH {BARS_B}, {_STRETCH}, {_TAILS}, {_ARMS} SELECT symbol, event_time, arm, CAST(side AS INTEGER) AS side, round(entry, 6) AS entry, round(stop, 6) AS stop, round(target, 6) AS target FROM lv")
def forward_recorded(spark, sf_dir):
    """Both arms of every cross-section, written as its bars arrive."""
    root = fresh_folder(spark, "forward")
    stream = replayed(spark, B.weekly_supplier_bars(spark, sf_dir), "forward-files", 3)
    record.run(stream, lambda batch, n: record.record_forward(root, batch, n), fresh_folder(spark, "forward-state"))
    kinds = "symbol string, event_time timestamp, arm string, side int, entry double, stop double, target double"
    return rounded(spark.read.schema(kinds).parquet(f"{root}/journal").drop("batch"), "entry", "stop", "target")



@query("""WITH p AS (SELECT event_type AS symbol, CASE WHEN event_id % 11 = 0 THEN 'body' WHEN event_id % 13 = 0 THEN 'at' WHEN event_id % 17 = 0 THEN 'px' WHEN value = 0 THEN 'unit' END AS problem FROM events),
w AS (SELECT symbol, problem, count(*) AS n FROM p WHERE problem IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY n DESC, problem) = 1)
SELECT p.symbol, count(*) FILTER (WHERE p.problem IS NULL) AS done, count(p.problem) AS failed, max(w.problem) AS problem, CASE WHEN count(p.problem) = 0 THEN 'ok' WHEN count(p.problem) < count(*) THEN 'partial' ELSE 'failed' END AS status FROM p LEFT JOIN w USING (symbol) GROUP BY 1""")
def isolated_sweep(spark, sf_dir):
    """Payloads of which some are no JSON, have no time or no price: each key's rows go on without them."""
    n, at, px = F.col("event_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("value").cast("string")
    good = F.concat(F.lit('{"at":"'), at, F.lit('","px":'))
    body = F.when(n % 11 == 0, "{broken").when(n % 13 == 0, F.concat(F.lit('{"at":"soon","px":'), px, F.lit("}"))).when(n % 17 == 0, F.concat(F.lit('{"at":"'), at, F.lit('","px":"high"}'))).otherwise(F.concat(good, px, F.lit("}")))
    rows = B.table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("event_time"), body.alias("payload"))
    parsed = F.try_parse_json("payload")
    values = {"body": F.when(parsed.isNotNull(), F.lit(True)), "at": F.try_to_timestamp(F.try_variant_get(parsed, "$.at", "string")), "px": F.try_variant_get(parsed, "$.px", "double"), "unit": F.try_divide(F.lit(1.0), F.try_variant_get(parsed, "$.px", "double"))}
    root = fresh_folder(spark, "sweep")
    record.isolate(replayed(spark, rows, "payload-files", 2), values, "symbol", root, fresh_folder(spark, "sweep-state"))
    return record.key_status(spark.read.parquet(f"{root}/good"), spark.read.parquet(f"{root}/bad"), "symbol")
