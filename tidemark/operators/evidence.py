"""Whether a claim is proven, when it can be, and what each forecast was worth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats

# The significance of one comparison, and the historical edge, t and instants that size the forward sample.
PLAIN_Z, HORIZON_BARS = 1.96, 120
EDGE_R, EDGE_T, EDGE_INSTANTS, CONFIDENCE_Z, POWER_Z = 0.0212, 3.69, 11_414, 1.96, 0.84


def required_z(comparisons: Column) -> Column:
    """The z that a claim needs when it is the best of so many."""
    return F.when(comparisons <= 1, F.lit(PLAIN_Z)).otherwise(PLAIN_Z * F.sqrt(1 + F.ln(comparisons)))


def gate(claims: DataFrame) -> DataFrame:
    """Claims with every requirement that they fail; proven if they fail none.

    Columns: trials, hit_rate, control_hit_rate, expectancy_r,
    control_expectancy_r, cost_r, comparisons, measured_z (null: taken from the
    two rates), pre_registered, registered_on, data_ends.
    """
    c = F.col
    variance = (c("hit_rate") * (1 - c("hit_rate")) + c("control_hit_rate") * (1 - c("control_hit_rate"))) / F.nullif(c("trials"), F.lit(0))
    plain = F.coalesce(F.try_divide(c("hit_rate") - c("control_hit_rate"), F.sqrt(F.nullif(variance, F.lit(0.0)))), F.lit(0.0))
    rows = claims.withColumns({"edge": c("hit_rate") - c("control_hit_rate"), "z": F.coalesce("measured_z", plain), "required_z": required_z(c("comparisons")), "net_r": c("expectancy_r") - c("control_expectancy_r") - c("cost_r")})
    tests = {"registered": c("pre_registered"), "control": c("edge") > 0, "significance": c("z") >= c("required_z"), "costs": c("net_r") > 0, "forward": c("data_ends") > c("registered_on")}
    failures = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in tests.items()]))
    return rows.withColumn("failures", failures).withColumn("proven", F.size("failures") == 0)


def readiness(measured: DataFrame, today: Column, edge: float | Column = EDGE_R, horizon: int = HORIZON_BARS) -> DataFrame:
    """Rows (instants, decisions, instants_per_week) with the instants needed, the share reached, the blocks that share no bar, and the day when the question can be answered.

    No date without an observed rate; no number without an edge to size it for.
    """
    edge = F.lit(edge) if isinstance(edge, float) else edge
    spread = stats.spread_from_t(F.lit(EDGE_R), F.lit(EDGE_T), F.lit(EDGE_INSTANTS))
    needed = F.when(edge > 0, stats.sample_size(edge, spread, CONFIDENCE_Z, POWER_Z).cast("long"))
    rows = measured.withColumn("needed", needed).withColumn("fraction", F.least(F.lit(1.0), F.try_divide(F.col("instants"), F.col("needed")))).withColumn("independent_blocks", F.floor(F.col("instants") / horizon).cast("long"))
    weeks = F.greatest(F.lit(0), F.col("needed") - F.col("instants")) / F.when(F.col("instants_per_week") > 0, F.col("instants_per_week"))
    return rows.withColumn("answerable_on", F.date_add(today, F.floor(weeks * 7).cast("int")))


def prediction_check(entries: DataFrame) -> DataFrame:
    """Closed entries (outcome, probability) with surprise and Brier score, or the reason why there are none."""
    reason = F.when(F.col("outcome") == "abandoned", "never_taken").when(F.col("outcome") == "breakeven", "scratch").when(F.col("probability").isNull(), "no_probability")
    realised = F.when(F.col("outcome") == "win", 1.0).otherwise(0.0)
    rows = entries.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return rows.withColumns({"surprise": F.when(ok, F.round(realised - F.col("probability"), 6)), "brier": F.when(ok, F.round(F.pow(F.col("probability") - realised, 2), 6))})
