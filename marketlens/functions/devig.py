"""Margin removal solved inside Catalyst.

The solvers see a market as a histogram ``array<struct<q, n>>`` of implied probabilities, so the state
per (market, book) is bounded by the number of distinct prices rather than by the number of quotes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Newton steps from the low end of each bracket. Both probability sums fall and are convex in their parameter,
# so the steps approach the root from one side; the counts reach double precision on sets of 2 to 12 outcomes.
POWER_STEPS = 13
SHIN_STEPS = 6
POWER_BRACKET = (1.0, 10.0)
INSIDER_BRACKET = (0.0, 0.9)


def shin_prob(q: Column, z: Column, total: Column) -> Column:
    inner = z * z + F.lit(4.0) * (F.lit(1.0) - z) * (q * q) / total
    root = F.sqrt(F.greatest(F.lit(0.0), inner))
    return F.when(q > 0, (root - z) / (F.lit(2.0) * (F.lit(1.0) - z))).otherwise(F.lit(0.0))


def power_prob(q: Column, k: Column) -> Column:
    return F.when(q > 0, F.pow(q, k)).otherwise(F.lit(0.0))


def _shin_slope(q: Column, z: Column, total: Column) -> Column:
    """Derivative of ``shin_prob`` with respect to the insider share."""
    c = q * q / total
    root = F.sqrt(z * z + F.lit(4.0) * (F.lit(1.0) - z) * c)
    left = F.lit(1.0) - z
    return (((z - F.lit(2.0) * c) / root - F.lit(1.0)) * left + (root - z)) / (F.lit(2.0) * left * left)


def _newton(hist: Column, prob_at, slope_at, bracket: tuple[float, float], steps: int) -> Column:
    """``struct<x, norm>``: the parameter whose probabilities sum to 1, and the sum it reaches.

    The sum differs from 1 only when the root lies outside the bracket, so dividing by it always returns a
    distribution.
    """
    low, high = F.lit(bracket[0]), F.lit(bracket[1])

    def step(x: Column, _i: Column) -> Column:
        zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("slope"))
        return F.aggregate(
            hist,
            zero,
            lambda acc, h: F.struct(
                (acc["sum"] + prob_at(h["q"], x) * h["n"]).alias("sum"),
                (acc["slope"] + slope_at(h["q"], x) * h["n"]).alias("slope"),
            ),
            lambda acc: F.when(
                acc["slope"] < 0, F.least(high, F.greatest(low, x - (acc["sum"] - 1.0) / acc["slope"]))
            ).otherwise(high),
        )

    def finish(x: Column) -> Column:
        reached = F.aggregate(hist, F.lit(0.0), lambda acc, h: acc + prob_at(h["q"], x) * h["n"])
        return F.struct(x.alias("x"), reached.alias("norm"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), low, step, finish)


def power_exponent(hist: Column, total: Column) -> Column:
    """Exponent for the power method (NULL when there is no margin to remove)."""
    fit = _newton(hist, power_prob, lambda q, k: power_prob(q, k) * F.log(q), POWER_BRACKET, POWER_STEPS)
    return F.when(total > 1.0, fit)


def insider_share(hist: Column, total: Column) -> Column:
    """Insider share for Shin's method (NULL when there is no margin to remove)."""
    fit = _newton(
        hist,
        lambda q, z: shin_prob(q, z, total),
        lambda q, z: _shin_slope(q, z, total),
        INSIDER_BRACKET,
        SHIN_STEPS,
    )
    return F.when(total > 1.0, fit)
