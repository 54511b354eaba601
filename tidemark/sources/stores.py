"""Stored tables in shared folders: recomputed windows, upserts and inserts that touch only the partitions they change.

A table is a folder of Parquet files by partition columns.  Partitions are
rewritten with ``partitionOverwriteMode=dynamic``; what stays of them is first
written elsewhere, since a table can't be read and overwritten at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh_folder


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table at ``path``; before its first write, no rows of ``like``'s columns."""
    return spark.read.schema(like.schema).parquet(path).select(*like.columns) if exists(spark, path) else like.limit(0)


def rewrite(rows: DataFrame, path: str, parts: Sequence[str]) -> None:
    """Replace the partitions that ``rows`` have; all others keep their files."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def with_day(rows: DataFrame, time: str = "event_time") -> DataFrame:
    return rows.withColumn("day", F.to_date(time))


def _touched(old: DataFrame, new: DataFrame, parts: Sequence[str]) -> DataFrame:
    return old.join(new.select(*parts).distinct(), list(parts), "left_semi")


def replace_window(path: str, new: DataFrame, window: Column, parts: Sequence[str]) -> None:
    """Delete the rows that ``window`` holds for and put ``new`` in their place.

    Rows of the same partitions outside the window stay, as do rows for which
    ``window`` is null.  Folders of partitions that lose all their rows are deleted.
    """
    spark = new.sparkSession
    new = stored(new, "window-new")
    old = read(spark, path, new).select(*new.columns)
    changed = old.where(window).select(*parts).distinct().unionByName(new.select(*parts).distinct()).distinct()
    kept = old.join(changed, list(parts), "left_semi").where(~F.coalesce(window, F.lit(False)))
    result = stored(kept.unionByName(new), "window-result")
    gone = stored(changed.join(result.select(*parts).distinct(), list(parts), "left_anti"), "window-gone")
    rewrite(result, path, parts)
    for row in gone.toLocalIterator():  # partitions of the window that nothing is left of: their folders
        folder = spark._jvm.org.apache.hadoop.fs.Path(path + "".join(f"/{p}={row[p]}" for p in parts))
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def upsert(path: str, new: DataFrame, keys: Sequence[str], parts: Sequence[str], order: str | None = None) -> None:
    """Put ``new`` in place of stored rows with its keys; of repeated keys in ``new`` the last by ``order`` counts."""
    spark = new.sparkSession
    if order is not None:
        rest = [c for c in new.columns if c not in keys]
        best = new.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_b"))
        new = best.select(*[F.col(c) if c in keys else F.col(f"_b.{c}").alias(c) for c in new.columns])
    else:
        new = new.dropDuplicates(list(keys))
    new = stored(new, "upsert-new")
    old = read(spark, path, new).select(*new.columns)
    kept = _touched(old, new, parts).join(new.select(*keys), list(keys), "left_anti")
    rewrite(stored(kept.select(*new.columns).unionByName(new), "upsert-result"), path, parts)


def insert_absent(path: str, new: DataFrame, keys: Sequence[str], parts: Sequence[str], batch: str) -> None:
    """Append rows whose keys are not stored, as the files of ``batch``; the same batch again replaces its own files.

    The batch is the first partition column, so a replay finds what it wrote before and writes it anew.
    """
    spark = new.sparkSession
    new = new.dropDuplicates(list(keys)).withColumn("batch", F.lit(batch))
    old = read(spark, path, new).where(F.col("batch") != batch)
    fresh = new.join(old.select(*keys), list(keys), "left_anti").select(*new.columns)
    rewrite(stored(fresh, "insert-new"), path, ["batch", *parts])
