"""The decision journal: rates of what was decided, each published only where its sample is large enough and about the journal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Entries that a rate needs, and the share of the journal that its sample must cover.
LEAST_ENTRIES, LEAST_COVERAGE = 20, 0.5


def opened(entries: DataFrame, payload: str = "after") -> DataFrame:
    """Entries with outcome, r_multiple and invalidation_triggered from a semi-structured payload; what can't be read is null, not an error.

    A payload that is null or no JSON is an entry still open.
    """
    after = F.try_parse_json(payload)
    get = lambda path, kind: F.try_variant_get(after, path, kind)
    return entries.withColumns({"closed": after.isNotNull() & ~F.is_variant_null(after), "outcome": F.lower(get("$.outcome", "string")), "r_multiple": get("$.r_multiple", "double"), "invalidation_triggered": get("$.invalidation_triggered", "boolean")})


def summarise(entries: DataFrame, *keys: str) -> DataFrame:
    """Counts and gated rates of opened entries, by ``keys``.

    The win rate needs 20 decided entries, the average R 20 recorded ones that
    cover half of those that reached the market, the share of triggered
    invalidations 20 assessed ones that cover half of all closed.
    """
    of = lambda outcome: F.count_if(F.col("closed") & (F.col("outcome") == outcome))
    closed, assessed = F.col("closed"), F.col("closed") & F.col("invalidation_triggered").isNotNull()
    rows = entries.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(closed).alias("closed"), of("win").alias("wins"), of("loss").alias("losses"), of("breakeven").alias("breakeven"), of("abandoned").alias("abandoned"),
        F.count(F.when(closed, F.col("r_multiple"))).alias("r_sample"), F.avg(F.when(closed, F.col("r_multiple"))).alias("_r"), F.count_if(assessed).alias("invalidation_assessed"), F.count_if(assessed & F.col("invalidation_triggered")).alias("invalidation_triggered"),
        F.count_if(assessed & (F.col("outcome") == "loss")).alias("losses_assessed"), F.count_if(assessed & (F.col("outcome") == "loss") & ~F.col("invalidation_triggered")).alias("unanticipated_losses"),
    )
    decided, traded = F.col("wins") + F.col("losses"), F.col("closed") - F.col("abandoned")
    enough = F.col("closed") >= LEAST_ENTRIES
    r_share, checked = F.try_divide(F.col("r_sample"), traded), F.try_divide(F.col("invalidation_assessed"), F.col("closed"))
    rated = enough & (decided >= LEAST_ENTRIES)
    averaged = enough & (F.col("r_sample") >= LEAST_ENTRIES) & F.coalesce(r_share >= LEAST_COVERAGE, F.lit(False))
    shared = enough & (F.col("invalidation_assessed") >= LEAST_ENTRIES) & F.coalesce(checked >= LEAST_COVERAGE, F.lit(False))
    rounded = lambda gate, x: F.when(gate, F.round(x, 4))
    out = rows.withColumns({
        "open_entries": F.col("entries") - F.col("closed"), "decided": decided, "win_rate": rounded(rated, F.col("wins") / decided), "win_rate_coverage": rounded(rated, decided / F.col("closed")), "average_r": rounded(averaged, F.col("_r")), "average_r_coverage": rounded(averaged, r_share),
        "triggered_share": rounded(shared, F.col("invalidation_triggered") / F.col("invalidation_assessed")), "triggered_coverage": rounded(shared, checked), "available": rated | averaged | shared,
    })
    return out.drop("_r")
