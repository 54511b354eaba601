"""Values at given ranks of large groups, without one task or one sort for a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import fresh_folder


def at_ranks(rows: DataFrame, key: str, value: str, wanted: Column) -> DataFrame:
    """(key, rank, value): the ``rank``-th smallest value (from 0) of each key, for the ranks in ``wanted``.

    ``wanted`` is an array of longs over the column ``n``, the key's number of
    values.  Values are dealt out by ranges of (key, value), so a key's values are
    sorted in as many tasks as they need; a small table of counts by key and
    range tells where each range begins.  Null values count as none.
    """
    spark = rows.sparkSession
    folder = fresh_folder(spark, "ranges")
    some = rows.select(F.col(key).alias("k"), F.col(value).alias("v")).where("v is not null")
    # Written, since ranges are drawn from a sample: counts and ranks must see the same ones.
    some.repartitionByRange("k", "v").select("k", "v", F.spark_partition_id().alias("part")).write.parquet(folder)
    dealt = spark.read.schema("k %s, v %s, part int" % tuple(t for _, t in some.dtypes)).parquet(folder)
    counts = dealt.groupBy("k", "part").agg(F.count(F.lit(1)).alias("c"))
    by_key = Window.partitionBy("k")
    begins = counts.select("k", "part", F.sum("c").over(by_key).alias("n"), (F.sum("c").over(by_key.orderBy("part")) - F.col("c")).alias("begin"), "c")
    asked = begins.withColumn("rank", F.explode(F.array_distinct(wanted))).where((F.col("rank") >= F.col("begin")) & (F.col("rank") < F.col("begin") + F.col("c")))
    placed = dealt.withColumn("i", F.row_number().over(Window.partitionBy("k", "part").orderBy("v")) - 1)
    found = asked.select("k", "part", "rank", (F.col("rank") - F.col("begin")).alias("i")).join(placed, ["k", "part", "i"])
    return found.select(F.col("k").alias(key), "rank", F.col("v").alias(value))
