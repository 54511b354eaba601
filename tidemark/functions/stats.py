"""Statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of Acklam's rational approximation of the inverse normal distribution.
ACKLAM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
ACKLAM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
ACKLAM_LOW = 0.02425
Z95 = 1.96


def _poly(coefficients, x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def inverse_normal(p: Column) -> Column:
    """The standard normal quantile; null outside (0, 1)."""
    tail = lambda q: _poly(ACKLAM_C, q) / _poly((*ACKLAM_D, 1.0), q)
    root = lambda x: F.sqrt(-2.0 * F.ln(x))
    q = p - 0.5
    r = q * q
    middle = _poly(ACKLAM_A, r) * q / _poly((*ACKLAM_B, 1.0), r)
    return F.when((p > 0) & (p < 1), F.when(p < ACKLAM_LOW, tail(root(p))).when(p > 1 - ACKLAM_LOW, -tail(root(1.0 - p))).otherwise(middle))


def bonferroni_z(comparisons: Column) -> Column:
    """The two-sided 5 % bound widened for a number of comparisons."""
    return F.when(comparisons <= 1, F.lit(Z95)).otherwise(F.abs(inverse_normal(F.lit(0.05) / comparisons / 2.0)))


def wilson(hits: Column, trials: Column, z: Column) -> tuple[Column, Column]:
    """Lower and upper Wilson bound of a proportion; (0, 1) without trials."""
    n = F.nullif(trials.cast("double"), F.lit(0.0))
    p = hits / n
    scale = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    spread = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    return F.coalesce(F.greatest(F.lit(0.0), centre - spread), F.lit(0.0)), F.coalesce(F.least(F.lit(1.0), centre + spread), F.lit(1.0))


def breakeven_hit_rate(reward_risk: Column) -> Column:
    return F.when(reward_risk > 0, 1.0 / (1.0 + reward_risk))


def breakeven_probability(reward: Column, risk: Column, costs: Column) -> Column:
    """The win probability at which reward, risk and costs cancel."""
    return F.when(reward + risk > 0, (risk + costs) / (reward + risk))


def hit_rate_error(hits_a: Column, n_a: Column, hits_b: Column, n_b: Column) -> Column:
    """Standard error of the difference of two hit rates; null if a sample is empty."""
    a, b = F.try_divide(hits_a, n_a), F.try_divide(hits_b, n_b)
    return F.sqrt(F.greatest(F.lit(0.0), F.try_divide(a * (1 - a), n_a) + F.try_divide(b * (1 - b), n_b)))


def paired_t(difference: Column) -> Column:
    """Mean over its standard error, as an aggregate; 0 for fewer than two values or no spread."""
    spread = F.stddev_samp(difference)
    return F.when((F.count(difference) > 1) & (spread > 0), F.avg(difference) / (spread / F.sqrt(F.count(difference)))).otherwise(0.0)


def spread_from_t(mean: Column, t: Column, n: Column) -> Column:
    """The standard deviation that a mean, its t and the sample size imply."""
    return F.try_divide(F.abs(mean) * F.sqrt(n), F.nullif(F.abs(t), F.lit(0.0)))


def sample_size(edge: Column, spread: Column, z_alpha: float = 1.959963984540054, z_power: float = 0.8416212335729143) -> Column:
    """Observations needed to see ``edge`` at 5 % significance and 80 % power."""
    return F.ceil(F.pow(F.try_divide((z_alpha + z_power) * spread, F.nullif(edge, F.lit(0.0))), 2))


def floor_to(x: Column, places: int) -> Column:
    return F.floor(x * 10**places) / 10**places


def money(x: Column) -> Column:
    """Rounded to two places, halves to even."""
    return F.bround(x, 2)


def ruin_root(win: Column, reward: Column, steps: int = 100) -> Column:
    """The root z in (0, 1) of win * z**(1 + reward) - z + (1 - win) = 0, by bisection; 1 where there is no edge."""
    f = lambda z: win * F.pow(z, 1 + reward) - z + (1 - win)
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1 - 1e-9).alias("hi"))

    def halve(s, _):
        mid = (s["lo"] + s["hi"]) / 2
        return F.struct(F.when(f(mid) > 0, mid).otherwise(s["lo"]).alias("lo"), F.when(f(mid) > 0, s["hi"]).otherwise(mid).alias("hi"))

    root = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2)
    return F.when(win * reward - (1 - win) > 0, root).otherwise(1.0)


def streak_probability(loss: Column, trades: Column, length: int) -> Column:
    """Chance of at least ``length`` losses in a row within a number of trades, by the run-length chain."""
    empty = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), length - 1))
    start = F.struct(empty.alias("run"), F.lit(0.0).alias("hit"))

    def step(s, _):
        alive = F.aggregate(s["run"], F.lit(0.0), lambda a, x: a + x)
        moved = F.transform(F.slice(s["run"], 1, length - 1), lambda x: x * loss)
        return F.struct(F.concat(F.array(alive * (1 - loss)), moved).alias("run"), (s["hit"] + F.element_at(s["run"], length) * loss).alias("hit"))

    return F.when(trades >= length, F.aggregate(F.sequence(F.lit(1), trades), start, step, lambda s: s["hit"])).otherwise(0.0)


def binomial_tail(p: Column, n: int, least: int) -> Column:
    """Chance of at least ``least`` hits in ``n`` trials."""
    from math import comb

    out = F.lit(0.0)
    for k in range(least, n + 1):
        out = out + comb(n, k) * F.pow(p, F.lit(float(k))) * F.pow(1 - p, F.lit(float(n - k)))
    return out
