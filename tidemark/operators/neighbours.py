"""Robust-scaled nearest neighbours of feature vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ranks

# Least rows of a scale, the farthest neighbour, the default number of neighbours.
LEAST_SCALE, MAX_DISTANCE, K = 20, 2.0, 50
#: Queries that one pass takes; bounds what is broadcast.
MAX_QUERIES = 100_000


def tall(rows: DataFrame, ident: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(ident, name, value) of the non-null features."""
    cells = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names])
    return rows.select(*ident, F.explode(cells).alias("c")).select(*ident, "c.name", "c.value").where("value is not null")


def scaler(values: DataFrame, least: int = LEAST_SCALE) -> DataFrame:
    """Median and quartile distance of each feature, quartiles as the n/4-th and 3n/4-th ordered values.

    Only the four ranks needed are picked, by ranges of values: no feature is sorted in one task.
    """
    n = F.col("n")
    quarter = lambda k: F.floor(k * n / 4).cast("long")
    middle = F.array(F.floor((n - 1) / 2).cast("long"), F.floor(n / 2).cast("long"))
    picked = ranks.at_ranks(values, "name", "value", F.concat(middle, F.array(quarter(1), quarter(3))))
    sizes = values.groupBy("name").agg(F.count("value").alias("n")).where(F.col("n") >= least)
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("value")))
    out = picked.join(sizes, "name").groupBy("name", "n").agg(((at(middle[0]) + at(middle[1])) / 2).alias("center"), at(quarter(1)).alias("q1"), at(quarter(3)).alias("q3"))
    return out.withColumn("spread", F.col("q3") - F.col("q1")).where(F.col("spread") > 0)


def scaled(rows: DataFrame, scales: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows with their features scaled; features without a scale become null.

    The scales are one row per feature, so they are pivoted to a single row and broadcast.
    """
    one = scales.groupBy().pivot("name", list(names)).agg(F.first("center").alias("center"), F.first("spread").alias("spread"))
    return rows.join(F.broadcast(one)).withColumns({n: F.try_divide(F.col(n) - F.col(f"{n}_center"), F.col(f"{n}_spread")) for n in names}).drop(*[f"{n}_{s}" for n in names for s in ("center", "spread")])


def nearest(queries: DataFrame, library: DataFrame, names: Sequence[str], k: int = K, farthest: float = MAX_DISTANCE, least_shared: int = 1) -> DataFrame:
    """The ``k`` nearest library rows of each query (query_id against id), root mean square over shared features.

    A stated query set against all rows: at most ``MAX_QUERIES`` queries are
    broadcast (more fail the job), the distance is one expression, and only the
    ``k`` best of each query survive the partial top-k before the shuffle.
    """
    both = [F.col(f"q_{n}").isNotNull() & F.col(n).isNotNull() for n in names]
    shared = sum((F.when(b, 1).otherwise(0) for b in both), F.lit(0))
    square = sum((F.when(b, F.pow(F.col(f"q_{n}") - F.col(n), 2)).otherwise(0.0) for b, n in zip(both, names, strict=True)), F.lit(0.0))
    asked = queries.select("query_id", *[F.col(n).alias(f"q_{n}") for n in names])
    few = F.assert_true(F.count(F.lit(1)).over(Window.partitionBy()) <= MAX_QUERIES, F.lit("too many queries for one pass"))
    asked = asked.limit(MAX_QUERIES + 1).withColumn("_few", few).where("_few is null").drop("_few")
    pairs = library.join(F.broadcast(asked)).withColumn("shared", shared).where(F.col("shared") >= least_shared).withColumn("distance", F.sqrt(square / F.col("shared"))).where(F.col("distance") <= farthest)
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return pairs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).withColumn("similarity", 1 / (1 + F.col("distance")))


def uncertainty(matches: DataFrame, outcome: str = "forward_return_pct") -> DataFrame:
    """Outcome and spread of each query's matches."""
    return matches.groupBy("query_id").agg(F.count(F.lit(1)).alias("matches"), F.avg((F.col(outcome) > 0).cast("double")).alias("positive_share"), F.median(outcome).alias("median_outcome"), F.stddev_pop(outcome).alias("outcome_stdev"), F.min("distance").alias("closest"), F.max("distance").alias("farthest"))
