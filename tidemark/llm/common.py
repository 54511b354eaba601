"""Shared-folder tables, input cleaning, hot-group splitting and connected components."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only a local session, whose executors are the driver's own threads, gets a
    folder of its own where the setting is absent; on a cluster that is an error.
    """
    found = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-shared-")
        spark.conf.set(CHECKPOINT_KEY, found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of rows that Spark hands to Python at once.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Have Spark hand rows to Python in batches bounded by bytes, so that long texts don't add up; a tighter setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(key, str(8 * BATCH_BYTES)))
    if not now or not 0 < int(now[1]) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def texts(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """Only the key columns and the text, null texts as empty: extra columns cannot clash."""
    small_batches(docs.sparkSession)
    return docs.select(*[docs[c] for c in keep], F.coalesce(docs[text], F.lit("")).alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_file(path: str) -> str:
    """Where a tokenizer's file is on this machine: a bare name is one of the public tokenizers."""
    if os.path.basename(path) != path:
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string")) % modulus


def in_blocks(members: DataFrame, key: str, ident: str, block: int) -> DataFrame:
    """Deal groups out as pairs of blocks, so that no group meets in one task.

    A group of n rows becomes ceil(n / block) blocks; each row goes to every
    pair of blocks (``lo`` <= ``hi``) that holds its own (``own``).  A task that has
    one (key, lo, hi) compares ``lo`` rows with ``hi`` rows; a group that fits
    in one block is the single pair (0, 0).  Sizes come from a partial
    aggregation and no row is dropped, whatever the size of the group.
    """
    size = members.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    blocks = F.ceil(F.col("_n") / block).cast("int")
    own = F.pmod(F.xxhash64(ident), F.col("_blocks")).cast("int")
    dealt = members.join(size, key).withColumn("_blocks", blocks).withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    return dealt.withColumn("_other", other).withColumn("lo", F.least("own", "_other")).withColumn("hi", F.greatest("own", "_other")).drop("_n", "_blocks", "_other")


#: A key with more than this share of all rows is hot, so at most 1 / share keys are; its rows are dealt over so many tasks.
HOT_SHARE, SALTS = 1 / 1024, 64


def hot_keys(counted: DataFrame, key: str, n: str) -> DataFrame:
    """Of (key, n) rows, the at most 1 / ``HOT_SHARE`` keys that hold more than ``HOT_SHARE`` of the sum of all n."""
    total = counted.agg(F.sum(n)).first()[0] or 0
    return counted.where(F.col(n) > total * HOT_SHARE).select(key)


def spread_join(rows: DataFrame, side: DataFrame, key: str, hot: DataFrame, by: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``side`` (one row a key); the rows of a hot key are dealt out by ``by`` and meet copies of its side row.

    ``hot`` is broadcast: it comes from ``hot_keys``, which bounds its size.
    """
    hot = F.broadcast(hot.select(F.col(key).alias("_hot")))
    salt = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(0).cast("int")
    dealt = rows.join(hot, rows[key] == F.col("_hot"), "left").withColumn("_salt", salt).drop("_hot")
    copies = F.explode(F.sequence(F.lit(0), F.when(F.col("_hot").isNotNull(), SALTS - 1).otherwise(0)))
    beside = side.join(hot, side[key] == F.col("_hot"), "left").withColumn("_salt", copies).drop("_hot")
    return dealt.join(beside, [key, "_salt"], how).drop("_salt")


def _stars(edges: DataFrame) -> bool:
    """Whether every id with a link (u, v) has no other one, and its v has none."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("up")), F.struct(F.col("v").alias("id"), F.lit(0).alias("up")))))
    each = ends.groupBy("id").agg(F.sum("up").alias("n"), F.min("up").alias("least"))
    return not each.agg(F.count_if((F.col("n") > 1) | (F.col("n") == 1) & (F.col("least") == 0))).first()[0]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of links (a, b): rows (id, component), the smallest id reachable.

    Alternating large-star and small-star rounds, as many as it takes until the
    links are stars; each is two aggregations and two joins, written to the
    shared folder.  Nothing is gathered on the driver but the number of ids that
    are no part of a star.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    for _ in range(max_rounds):
        if _stars(edges):
            break
        both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = stored(small, "links")
    else:
        raise RuntimeError("components did not settle")
    # Settled links are stars: every u points at the smallest id of its component.
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
