"""Registration of queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

AS_OF = "2024-01-20 00:00:00"

# Common table expressions of the three bar derivations, for the checking SQL.
BARS_A = """a AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS event_time, min_by(value, event_id) AS open, max(value) AS high, min(value) AS low,
  max_by(value, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2)"""
BARS_B = """b AS (SELECT symbol, event_time, max(CASE WHEN rf = 1 THEN px END) AS open, max(px) AS high, min(px) AS low, max(CASE WHEN rl = 1 THEN px END) AS close, sum(q) AS volume FROM
  (SELECT *, row_number() OVER (PARTITION BY symbol, event_time ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, px) AS rf,
     row_number() OVER (PARTITION BY symbol, event_time ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, px DESC) AS rl FROM
    (SELECT concat('S', CAST(l_suppkey AS VARCHAR)) AS symbol, date_trunc('week', l_shipdate) AS event_time, l_extendedprice / l_quantity AS px, l_quantity AS q, l_shipdate, l_orderkey, l_linenumber, l_partkey FROM lineitem))
  GROUP BY symbol, event_time)"""
BARS_C = """c AS (SELECT concat('N', CAST(c_nationkey AS VARCHAR)) AS symbol, date_trunc('week', o_orderdate) AS event_time, min_by(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
  min(o_totalprice) AS low, max_by(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""
BITEMPORAL = """bt AS (SELECT symbol, event_time, open, high, low, close, volume, 1 AS revision, event_time + INTERVAL 1 HOUR AS ingested_at FROM a
  UNION ALL SELECT symbol, event_time, open, greatest(high, close * 1.01), low, close * 1.01, volume, 2, event_time + INTERVAL 48 HOUR FROM a WHERE (CAST(epoch(event_time) AS BIGINT) // 3600) % 17 = 0)"""
KNOWN = f"""k AS (SELECT symbol, event_time, open, high, low, close, volume, revision, ingested_at FROM (SELECT *, row_number() OVER (PARTITION BY symbol, event_time ORDER BY revision DESC, ingested_at DESC) AS rn FROM bt
  WHERE event_time <= TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR AND ingested_at <= TIMESTAMP '{AS_OF}') WHERE rn = 1)"""
W = "(PARTITION BY symbol ORDER BY event_time)"


def frame(before: int, after: int = 0) -> str:
    end = "CURRENT ROW" if after == 0 else f"{abs(after)} {'FOLLOWING' if after > 0 else 'PRECEDING'}"
    start = f"{abs(before)} {'PRECEDING' if before > 0 else 'FOLLOWING'}"
    return f"(PARTITION BY symbol ORDER BY event_time ROWS BETWEEN {start} AND {end})"


def steps(source: str) -> str:
    """Bars with previous close, log return, true range, gains and losses."""
    return f"""s0 AS (SELECT *, lag(close) OVER {W} AS prev, row_number() OVER {W} AS n FROM {source}),
st AS (SELECT *, CASE WHEN prev > 0 AND close > 0 THEN ln(close / prev) END AS ret, CASE WHEN prev IS NOT NULL THEN greatest(high - low, abs(high - prev), abs(low - prev)) END AS tr,
  CASE WHEN prev IS NOT NULL THEN greatest(close - prev, 0) END AS up, CASE WHEN prev IS NOT NULL THEN greatest(prev - close, 0) END AS down FROM s0)"""


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """Doubles rounded once, at the end, so that summation order cannot show."""
    return df.withColumns({c: F.round(F.col(c), places) for c in columns})
