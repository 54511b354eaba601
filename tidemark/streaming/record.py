"""Streams that write tables once: equity samples if absent, forward decisions of both arms, and sweeps that set failing rows aside."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import coin_side
from ..operators import crosssection, outcomes
from ..operators.asof import lookback
from ..sources import stores

#: Bars of each symbol that the next cross-section needs from before it.
CONTEXT_BARS = crosssection.MIN_HISTORY + crosssection.MEAN_WINDOW + 1


def run(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand all input at hand to ``write``, batch by batch."""
    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def insert_samples(samples: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("account", "recorded_at"), lateness: str = "1 day") -> None:
    """Insert samples whose key is not stored yet.

    Repeats within the watermark's reach are dropped from bounded state;
    older ones, and a replayed batch, by the keyed anti-join with what is stored.
    """
    once = samples.withWatermark("recorded_at", lateness).dropDuplicatesWithinWatermark(list(keys))
    run(once, lambda batch, number: stores.insert_absent(path, batch, list(keys), [], str(number)), checkpoint)


def both_arms(picks: DataFrame, seed: str = "control-v1") -> DataFrame:
    """Entry and levels of the rule's side and the coin's for each pick."""
    each = picks.withColumn("control", coin_side(seed, F.col("symbol"), F.col("event_time")))
    arm = F.explode(F.array(F.struct(F.lit("rule").alias("arm"), F.col("side").alias("taken")), F.struct(F.lit("control").alias("arm"), F.col("control").alias("taken"))))
    rows = each.withColumn("_a", arm).select("symbol", "event_time", "_a.arm", F.col("_a.taken").cast("int").alias("side"), F.col("close").alias("entry"), "atr")
    stop, target = outcomes.levels(F.col("entry"), F.col("atr"), F.col("side"), crosssection.STOP_MULTIPLE, crosssection.TARGET_MULTIPLE)
    return rows.withColumn("stop", stop).withColumn("target", target).drop("atr")


def record_forward(root: str, batch: DataFrame, number: int) -> None:
    """Rank the cross-sections of a batch's instants and write both arms of each pick once.

    ``context`` has the newest bars of each symbol after each batch, so that a
    batch reads the one before it, not all history.  A repeated batch finds
    the same context and replaces its own files.
    """
    spark = batch.sparkSession
    own = stores.stored(batch.dropDuplicates(["symbol", "event_time"]).withColumn("context_of", F.lit(number)), "forward-batch")
    before = stores.read(spark, f"{root}/context", own).where(F.col("context_of") == number - 1)
    bars = before.drop("context_of").withColumn("_new", F.lit(False)).unionByName(own.drop("context_of").withColumn("_new", F.lit(True)))
    bars = stores.stored(bars.groupBy("symbol", "event_time").agg(*[F.max_by(c, "_new").alias(c) for c in ("open", "high", "low", "close", "volume")], F.max("_new").alias("_new")), "forward-bars")
    first = own.agg(F.min("event_time")).first()[0]
    picks = crosssection.tails(crosssection.stretches(bars.drop("_new"))).where(F.col("event_time") >= F.lit(first))
    stores.insert_absent(f"{root}/journal", both_arms(picks).drop("_new"), ["symbol", "event_time", "arm"], [], str(number))
    newest = lookback(bars.drop("_new"), CONTEXT_BARS)
    stores.rewrite(newest.withColumn("context_of", F.lit(number)), f"{root}/context", ["context_of"])


def sweep(rows: DataFrame, values: dict[str, Column], key: str) -> DataFrame:
    """Rows with ``values`` and ``problem``: the first of them that comes out null.  Values are ``try_`` expressions, so that no row ends the job."""
    out = rows.withColumns(values)
    problem = F.lit(None).cast("string")
    for name in reversed(values):
        problem = F.when(F.col(name).isNull(), name).otherwise(problem)
    return out.withColumn("problem", F.when(F.col(key).isNull(), key).otherwise(problem))


def isolate(stream: DataFrame, values: dict[str, Column], key: str, root: str, checkpoint: str) -> None:
    """Write good rows to ``root/good``, bad ones with their problem to ``root/bad``, batch by batch; a replayed batch replaces its files."""

    def write(batch: DataFrame, number: int) -> None:
        swept = stores.stored(sweep(batch, values, key), "swept").withColumn("batch", F.lit(number))
        stores.rewrite(swept.where("problem is null").drop("problem"), f"{root}/good", ["batch"])
        stores.rewrite(swept.where("problem is not null"), f"{root}/bad", ["batch"])

    run(stream, write, checkpoint)


def key_status(good: DataFrame, bad: DataFrame, key: str) -> DataFrame:
    """Per key: rows that went through and that did not, its commonest problem (the first by name of equals), and ok, partial or failed."""
    fine = good.groupBy(key).agg(F.count(F.lit(1)).alias("done"))
    each = bad.groupBy(key, "problem").agg(F.count(F.lit(1)).alias("_n"))
    worst = each.groupBy(key).agg(F.sum("_n").alias("failed"), F.min(F.struct(-F.col("_n"), F.col("problem").alias("problem"))).alias("_w")).select(F.col(key).alias("_k"), "failed", F.col("_w.problem").alias("problem"))
    met = fine.join(worst, F.col(key).eqNullSafe(F.col("_k")), "full_outer")
    done, failed = F.coalesce("done", F.lit(0)), F.coalesce("failed", F.lit(0))
    status = F.when(failed == 0, "ok").when(done > 0, "partial").otherwise("failed")
    return met.select(F.coalesce(key, "_k").alias(key), done.alias("done"), failed.alias("failed"), "problem", status.alias("status"))
