"""Run logs, incidents, the audit chain, clock alignment, retention and profit roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fingerprint

# Floors of the operational reports.
LEAST_RUNS, SLOW_FACTOR, LEAST_TRADES, LEAST_OVERLAP, LAG_MARGIN, WINDOW_DAYS, LEAST_BARS = 12, 3.0, 5, 100, 1.15, 3, 10
SEVERITY_RANK = {"info": 0, "warning": 1, "serious": 2, "critical": 3}


def retry_waste(runs: DataFrame) -> DataFrame:
    """Instruments whose runs needed more attempts than there were runs."""
    out = runs.groupBy("instrument").agg(F.count(F.lit(1)).alias("runs"), F.sum("attempts").alias("attempts"))
    return out.where("attempts > runs").withColumn("extra", F.col("attempts") - F.col("runs"))


def slow_runs(runs: DataFrame) -> DataFrame:
    """Runs beyond three times their instrument's median duration, where at least 12 ran."""
    typical = runs.groupBy("instrument").agg(F.count(F.lit(1)).alias("_n"), F.median("seconds").alias("median_seconds")).where(F.col("_n") >= LEAST_RUNS).drop("_n")
    return runs.join(typical, "instrument").where(F.col("seconds") > SLOW_FACTOR * F.col("median_seconds"))


def recent(rows: DataFrame, now: str | Column, time: str) -> DataFrame:
    """Rows of the last three days before ``now``."""
    now = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    return rows.where(F.col(time) >= F.timestamp_seconds(F.unix_timestamp(now) - WINDOW_DAYS * 86400))


def empty_work(runs: DataFrame, now: str | Column, least: int = LEAST_RUNS) -> DataFrame:
    """Instruments whose runs of the last three days, at least 12, wrote nothing."""
    out = recent(runs, now, "started_at").groupBy("instrument").agg(F.count(F.lit(1)).alias("runs"), F.sum("rows_written").alias("written"))
    return out.where((F.col("runs") >= least) & (F.coalesce("written", F.lit(0)) <= 0)).drop("written")


def thin_coverage(bars: DataFrame, now: str | Column, least: int = LEAST_BARS) -> DataFrame:
    """Symbols that are still collected but had fewer than ten bars in the last three days."""
    return recent(bars, now, "ingested_at").groupBy("symbol").agg(F.count(F.lit(1)).alias("bars")).where(F.col("bars") < least)


def severity_rank(severity: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, rank in SEVERITY_RANK.items():
        out = F.when(severity == name, rank).otherwise(out)
    return out


def incidents(events: DataFrame) -> DataFrame:
    """(component, message, severity, at) folded by fingerprint: count, first and last seen, worst severity."""
    keyed = events.withColumn("fingerprint", fingerprint(F.col("component"), F.col("message")))
    out = keyed.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("occurrences"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.max(severity_rank(F.col("severity"))).alias("_s"), F.min("component").alias("component"))
    names = F.create_map(*[F.lit(x) for name, rank in SEVERITY_RANK.items() for x in (rank, name)])
    return out.withColumn("severity", names[F.col("_s")]).drop("_s")


def recurring(folded: DataFrame, least: int = 5) -> DataFrame:
    return folded.where(F.col("occurrences") >= least)


def entry_hash(*payload: Column) -> Column:
    return F.sha2(F.concat_ws("|", *payload), 256)


def audit_breaks(log: DataFrame, key: str = "stream") -> DataFrame:
    """Entries of (key, seq, payload, previous_hash, entry_hash) whose hash or link is wrong."""
    w = Window.partitionBy(key).orderBy("seq")
    rows = log.withColumn("_before", F.lag("entry_hash").over(w))
    broken = (F.col("entry_hash") != entry_hash(F.col("previous_hash"), F.col("payload"))) | ~F.col("previous_hash").eqNullSafe(F.coalesce("_before", F.lit("")))
    return rows.where(broken).drop("_before")


def clock_offset(public: DataFrame, broker: DataFrame, step: int, lags: range = range(-12, 15), least: int = LEAST_OVERLAP) -> DataFrame:
    """The shift in steps by which a broker's clock leads: the least mean distance of closes over 27 lags.

    A lag needs 100 shared bars.  The only one with so many is certain; else the
    best must beat the next by 15 per cent, and where both fit perfectly (a
    flat series) nothing is known.  An uncertain lag is null.
    """
    lag = F.explode(F.array(*[F.lit(k) for k in lags]))
    shifted = broker.select("symbol", F.col("event_time").alias("_t"), F.col("close").alias("broker_close"), lag.alias("lag")).withColumn("event_time", F.timestamp_seconds(F.unix_timestamp("_t") - F.col("lag") * step))
    each = shifted.join(public.select("symbol", "event_time", "close"), ["symbol", "event_time"]).groupBy("symbol", "lag").agg(F.count(F.lit(1)).alias("overlap"), F.avg(F.abs(F.col("broker_close") - F.col("close"))).alias("distance")).where(F.col("overlap") >= least)
    w = Window.partitionBy("symbol").orderBy("distance", F.abs("lag"), "lag")
    best = each.withColumn("_k", F.row_number().over(w)).withColumn("_next", F.lead("distance").over(w)).where("_k = 1")
    certain = F.when(F.col("_next").isNull(), True).when(F.col("distance") <= 0, F.col("_next") > 0).otherwise(F.col("_next") / F.col("distance") >= LAG_MARGIN)
    return best.select("symbol", F.when(certain, F.col("lag")).alias("lag"), "overlap", "distance", certain.alias("certain"))


def revisions(incoming: DataFrame, stored: DataFrame, keys=("symbol", "event_time"), values=("open", "high", "low", "close", "volume"), tolerance: float = 1e-9) -> DataFrame:
    """New revisions to append: in-batch repeats keep the first, unchanged bars are left out, changed ones count up.

    ``stored`` has the newest revision of each key.  A spread-only change is no revision.
    """
    rest = [c for c in incoming.columns if c not in keys]
    first = incoming.groupBy(*keys).agg(F.min_by(F.struct(*rest), "arrival").alias("_b")).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])
    old = stored.select(*keys, F.col("revision").alias("_rev"), *[F.col(v).alias(f"_{v}") for v in values])
    changed = F.lit(False)
    for v in values:
        a, b = F.col(v), F.col(f"_{v}")
        changed = changed | (a.isNull() != b.isNull()) | F.coalesce(F.abs(a - b) > tolerance, F.lit(False))
    joined = first.join(old, list(keys), "left")
    return joined.where(F.col("_rev").isNull() | changed).withColumn("revision", F.coalesce("_rev", F.lit(0)) + 1).select(*keys, *[c for c in rest if c != "revision"], "revision")


def normalised(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable bars, counts): bars without a time or with a price at or below zero are rejected and counted."""
    ok = F.col("event_time").isNotNull() & F.coalesce(F.least("open", "high", "low", "close") > 0, F.lit(False))
    return bars.where(ok), bars.agg(F.count(F.lit(1)).alias("fetched"), F.count_if(~ok).alias("rejected"))


def pnl(deals: DataFrame) -> DataFrame:
    """Net, trades, wins and hit rate by symbol (null below five trades), and the total as the null symbol."""
    out = deals.rollup("symbol").agg(F.sum("profit").alias("net"), F.count(F.lit(1)).alias("trades"), F.count_if(F.col("profit") > 0).alias("wins"))
    return out.withColumn("hit_rate", F.when(F.col("trades") >= LEAST_TRADES, F.col("wins") / F.col("trades")))


def retention(rows: DataFrame, policy: DataFrame, now: str) -> DataFrame:
    """Rows per kind that are older than their policy allows, those protected, and those removable."""
    age = F.datediff(F.lit(now).cast("timestamp"), F.col("at"))
    met = rows.join(policy, "kind").withColumn("_old", age > F.col("keep_days"))
    return met.groupBy("kind").agg(F.count_if(F.col("_old")).alias("eligible"), F.count_if(F.col("_old") & F.col("protected")).alias("held"), F.count_if(F.col("_old") & ~F.col("protected")).alias("removable"))


def attrition(traces: DataFrame) -> DataFrame:
    return traces.groupBy("stopped_at").agg(F.count(F.lit(1)).alias("decisions"))


def replay_changes(before: DataFrame, after: DataFrame, key: str = "decision_id") -> DataFrame:
    """Decisions whose outcome differs between two traces, or that only one has."""
    a, b = before.select(key, F.col("stopped_at").alias("before")), after.select(key, F.col("stopped_at").alias("after"))
    return a.join(b, key, "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))
