"""Calibration, drift, scorecards, walk-forward folds, model comparison and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from . import ranks

# Sample floors, bins and bounds.
BUCKETS, LEAST_BUCKET, LEAST_FORECASTS = 10, 10, 100
DRIFT_BINS, LEAST_DRIFT, SHIFTED, BROKEN, EPSILON = 10, 50, 0.1, 0.25, 1e-6
LEAST_TRIALS, LEAST_EVALUATED, LEAST_OVERLAP, SIGMAS, LEAST_TEST = 50, 60, 0.8, 2.0, 20


def bucket(score: Column) -> Column:
    """Ten equal bins of [0, 1], the last closed."""
    return F.least(F.floor(score * BUCKETS), F.lit(BUCKETS - 1)).cast("int")


def reliability(forecasts: DataFrame, *keys: str) -> DataFrame:
    """(keys, bucket, n, mean_score, observed) of bins with at least ten forecasts (score, outcome)."""
    out = forecasts.groupBy(*keys, bucket(F.col("score")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.avg(F.col("outcome").cast("double")).alias("observed"))
    return out.where(F.col("n") >= LEAST_BUCKET)


def brier(forecasts: DataFrame, *keys: str) -> DataFrame:
    """Brier score, base-rate baseline, skill and expected calibration error.

    Below 100 forecasts only their number is reported, all measures are null.
    Where the base rate leaves nothing to beat, the skill is 0.
    """
    y = F.col("outcome").cast("double")
    whole = forecasts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("score") - y) * (F.col("score") - y)).alias("brier"), F.avg(y).alias("base_rate"))
    bins = reliability(forecasts, *keys)
    error = bins.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("observed"))) / F.sum("n")).alias("calibration_error"))
    rows = (whole.join(error, list(keys), "left") if keys else whole.join(F.broadcast(error))).withColumn("baseline", F.col("base_rate") * (1 - F.col("base_rate")))
    enough = F.col("n") >= LEAST_FORECASTS
    rows = rows.withColumn("skill", F.when(F.col("baseline") > 0, 1 - F.col("brier") / F.col("baseline")).otherwise(0.0))
    return rows.withColumns({c: F.when(enough, F.col(c)) for c in ("brier", "base_rate", "baseline", "skill", "calibration_error")})


def to_probability(scores: DataFrame, bins: DataFrame) -> DataFrame:
    """Scores with the observed rate of their bin; null where the bin was too thin."""
    return scores.withColumn("bucket", bucket(F.col("score"))).join(bins.select("bucket", F.col("observed").alias("probability")), "bucket", "left")


def psi(reference: DataFrame, recent: DataFrame, key: str, value: str, bins: int = DRIFT_BINS) -> DataFrame:
    """Population stability of ``value`` by key, bins by the reference's ordered values.

    Edges are picked by rank through ranges of values; no value list is gathered and no key is sorted in one task.
    """
    ref, new = (d.select(key, F.col(value).alias("v")).where("v is not null and not isnan(v) and abs(v) < double('infinity')") for d in (reference, recent))
    size = F.col("n")
    wanted = F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda q: F.least(size - 1, F.bround(q * size / bins).cast("long")))
    picked = ranks.at_ranks(ref, key, "v", wanted).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("_at"))  # at most bins - 1
    sizes = ref.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    edges = picked.join(sizes, key).withColumn("_w", wanted).select(key, F.transform("_w", lambda r: F.try_element_at(F.col("_at"), r)).alias("edges"))
    place = lambda d: d.join(edges, key).withColumn("bin", F.size(F.filter("edges", lambda e: F.col("v") > e))).groupBy(key, "bin").agg(F.count(F.lit(1)).alias("c"))
    both = place(ref).withColumnRenamed("c", "r").join(place(new).withColumnRenamed("c", "m"), [key, "bin"], "full_outer")
    n = ref.groupBy(key).agg(F.count(F.lit(1)).alias("reference_n")).join(new.groupBy(key).agg(F.count(F.lit(1)).alias("recent_n")), key)
    full = n.join(edges, key).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).join(both, [key, "bin"], "left")
    share = lambda c, total: F.greatest(F.coalesce(F.col(c), F.lit(0)) / F.col(total), F.lit(EPSILON))
    e, r = share("r", "reference_n"), share("m", "recent_n")
    out = full.groupBy(key).agg(F.max("reference_n").alias("reference_n"), F.max("recent_n").alias("recent_n"), F.max(F.size(F.array_distinct("edges"))).alias("_k"), F.sum((r - e) * F.ln(r / e)).alias("psi"))
    ok = (F.least("reference_n", "recent_n") >= LEAST_DRIFT) & (F.col("_k") == bins - 1)
    return out.withColumn("psi", F.when(ok, F.col("psi"))).withColumn("verdict", F.when(~ok, "unavailable").when(F.col("psi") >= BROKEN, "broken").when(F.col("psi") >= SHIFTED, "shifted").otherwise("stable")).drop("_k")


def concept_drift(outcomes: DataFrame, key: str, r: str = "r", recent: str = "recent") -> DataFrame:
    """Standardised change of the mean outcome; only a fall is flagged."""
    side = lambda when: F.when(when, F.col(r))
    old, new = side(~F.col(recent)), side(F.col(recent))
    out = outcomes.groupBy(key).agg(F.count(old).alias("reference_n"), F.count(new).alias("recent_n"), F.avg(old).alias("reference_mean"), F.avg(new).alias("recent_mean"), F.var_pop(old).alias("_a"), F.var_pop(new).alias("_b"))
    error = F.sqrt(F.try_divide(F.col("_a"), F.col("reference_n")) + F.try_divide(F.col("_b"), F.col("recent_n")))
    ok = (F.least("reference_n", "recent_n") >= LEAST_DRIFT) & (error > 0)
    out = out.withColumn("z", F.when(ok, (F.col("recent_mean") - F.col("reference_mean")) / error))
    return out.withColumn("verdict", F.when(F.col("z").isNull(), "unavailable").when(F.col("z") <= -3, "broken").when(F.col("z") <= -2, "shifted").otherwise("stable")).drop("_a", "_b")


def scorecards(trials: DataFrame, key: str = "strategy", r: str = "r") -> DataFrame:
    """Hit rate with its Wilson bounds, widened for the number of strategies, expectancy and a verdict."""
    out = trials.groupBy(key).agg(
        F.count(r).alias("trials"), F.count_if(F.col(r).isNull()).alias("unresolved"), F.count_if(F.col(r) > 0).alias("wins"), F.avg(r).alias("expectancy_r"),
        F.avg(F.when(F.col(r) > 0, F.col(r))).alias("average_win_r"), F.avg(F.when(F.col(r) <= 0, F.col(r))).alias("average_loss_r"),
    ).withColumn("comparisons", F.count(F.lit(1)).over(Window.partitionBy()))
    low, high = stats.wilson(F.col("wins"), F.col("trials"), stats.bonferroni_z(F.col("comparisons")))
    rows = out.withColumn("hit_rate", F.try_divide("wins", "trials")).withColumn("hit_low", low).withColumn("hit_high", high)
    required = stats.breakeven_hit_rate(F.try_divide(F.col("average_win_r"), F.abs(F.nullif(F.col("average_loss_r"), F.lit(0.0)))))
    rows = rows.withColumn("required_hit_rate", required)
    verdict = F.when((F.col("trials") < LEAST_TRIALS) | F.col("required_hit_rate").isNull(), "insufficient").when(F.col("hit_low") > F.col("required_hit_rate"), "edge").when(F.col("hit_high") < F.col("required_hit_rate"), "negative").otherwise("inconclusive")
    return rows.withColumn("verdict", verdict)


def walk_forward(samples: DataFrame, folds: int, least_train: int, embargo_seconds: int = 0, key: str = "symbol", least_test: int = LEAST_TEST) -> DataFrame:
    """(key, sample_id, fold, role): train, test, purge or embargo for each fold.

    The first ``least_train`` samples only train; the rest is split evenly and the last fold takes the remainder.
    Training samples whose outcome was not known when the test began are purged.  A key that can't
    give every fold ``least_test`` samples has no folds.
    """
    w = Window.partitionBy(key)
    rows = samples.withColumn("_i", F.row_number().over(w.orderBy("event_time", "sample_id")) - 1).withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") >= least_train + folds * least_test)
    size = F.floor((F.col("_n") - least_train) / folds)
    own = F.when(F.col("_i") < least_train, -1).otherwise(F.least(F.floor((F.col("_i") - least_train) / size), F.lit(folds - 1)))
    rows = rows.withColumn("_own", own.cast("int"))
    begins = rows.where("_own >= 0").groupBy(key, F.col("_own").alias("fold")).agg(F.min("event_time").alias("test_start"))
    both = rows.join(begins, key).where(F.col("_own") <= F.col("fold"))
    early = F.unix_timestamp("test_start")
    role = F.when(F.col("_own") == F.col("fold"), "test").when(F.col("outcome_ready_at") >= F.col("test_start"), "purge").when(F.unix_timestamp("event_time") >= early - embargo_seconds, "embargo").otherwise("train")
    return both.withColumn("role", role).select(key, "sample_id", "event_time", "outcome_ready_at", "fold", "test_start", "role")


def leaks(folds: DataFrame, key: str = "symbol") -> DataFrame:
    """Training rows of a fold that are also tested in it or matured after its test began: must be none."""
    late = folds.where("role = 'train' and outcome_ready_at >= test_start").select(key, "fold", "sample_id")
    both = folds.where("role in ('train', 'test')").groupBy(key, "fold", "sample_id").agg(F.count_distinct("role").alias("_k")).where("_k > 1").drop("_k")
    return late.unionByName(both)


def compared(scored: DataFrame) -> DataFrame:
    """Champion against challenger over (pair, model, decision_id, hit): overlap, margin, error and whether to promote.

    The overlap comes from one aggregation by decision, without a self-join.
    """
    each = scored.groupBy("pair", "decision_id").agg(F.max(F.when(F.col("model") == "champion", F.col("hit").cast("int"))).alias("a"), F.max(F.when(F.col("model") == "challenger", F.col("hit").cast("int"))).alias("b"))
    out = each.groupBy("pair").agg(F.count("a").alias("champion_n"), F.count("b").alias("challenger_n"), F.sum("a").alias("_ha"), F.sum("b").alias("_hb"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("_both"))
    rows = out.withColumn("overlap", F.try_divide(F.col("_both"), F.greatest("champion_n", "challenger_n"))).withColumn("margin", F.try_divide("_hb", "challenger_n") - F.try_divide("_ha", "champion_n"))
    rows = rows.withColumn("error", stats.hit_rate_error(F.col("_ha"), F.col("champion_n"), F.col("_hb"), F.col("challenger_n")))
    verdict = F.when(F.least("champion_n", "challenger_n") < LEAST_EVALUATED, "too_few").when(F.col("overlap") < LEAST_OVERLAP, "overlap").when(F.col("error").isNull(), "no_error").when(F.col("margin") <= SIGMAS * F.col("error"), "similar").otherwise("promote")
    return rows.withColumn("verdict", verdict).drop("_ha", "_hb", "_both")


def comparison(arms: DataFrame) -> DataFrame:
    """Hit rates of (arm, r) for rule and control, their difference and its z."""
    n = lambda a, c=None: F.count_if((F.col("arm") == a) & (F.col("r").isNotNull() if c is None else c))
    out = arms.agg(n("rule").alias("rule_n"), n("rule", F.col("r") > 0).alias("rule_hits"), n("control").alias("control_n"), n("control", F.col("r") > 0).alias("control_hits"))
    p = (F.col("rule_hits") + F.col("control_hits")) / F.nullif(F.col("rule_n") + F.col("control_n"), F.lit(0))
    error = F.sqrt(p * (1 - p) * (F.try_divide(F.lit(1.0), F.col("rule_n")) + F.try_divide(F.lit(1.0), F.col("control_n"))))
    rows = out.withColumn("edge", F.try_divide("rule_hits", "rule_n") - F.try_divide("control_hits", "control_n"))
    return rows.withColumn("z", F.when(error > 0, F.col("edge") / error))
