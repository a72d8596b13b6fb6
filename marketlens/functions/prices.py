"""Price formats: decimal, American, fractional, probability, expected value and stake."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketlens.functions.common import js_round

FRACTION_MAX_DENOMINATOR = 20
KELLY_FRACTION = 0.25


def implied_prob(price: Column) -> Column:
    return F.when(price > 0, F.lit(1.0) / price).otherwise(F.lit(0.0))


def usable_prob(price: Column) -> Column:
    """Implied probability of a payable price; a price at or below 1 counts as 0."""
    return F.when(price > 1, F.lit(1.0) / price).otherwise(F.lit(0.0))


def decimal_from_prob(prob: Column) -> Column:
    return F.when(prob > 0, F.lit(1.0) / prob).otherwise(F.lit(0.0))


def american_number(price: Column) -> Column:
    long_side = js_round((price - 1.0) * 100.0)
    short_side = js_round(F.lit(-100.0) / (price - 1.0))
    return (
        F.when(price.isNull() | (price <= 1.0), F.lit(0.0)).when(price >= 2.0, long_side).otherwise(short_side)
    ).cast("bigint")


def american_text(price: Column) -> Column:
    number = american_number(price)
    return F.when(number >= 0, F.concat(F.lit("+"), number.cast("string"))).otherwise(number.cast("string"))


def american_to_decimal(american: Column, strict: bool = True) -> Column:
    """Strict form rejects the unusable band (-100, 100); the lenient form only rejects 0."""
    floor = 100 if strict else 0
    gain = F.lit(1.0) + american / F.lit(100.0)
    lay = F.lit(1.0) + F.lit(100.0) / F.abs(american)
    if strict:
        return F.when(american >= floor, gain).when(american <= -floor, lay).otherwise(F.lit(0.0))
    return F.when(american > 0, gain).when(american < 0, lay).otherwise(F.lit(0.0))


def fractional_price(price: Column) -> Column:
    """Closest p/q with q up to 20; a later q must be better by 1e-9 to replace an earlier one."""
    profit = price - 1.0

    def step(best: Column, q: Column) -> Column:
        p = js_round(profit * q)
        err = F.abs(profit - p / q)
        take = err < best["err"] - 1e-9
        return F.struct(
            F.when(take, p).otherwise(best["p"]).alias("p"),
            F.when(take, q.cast("double")).otherwise(best["q"]).alias("q"),
            F.when(take, err).otherwise(best["err"]).alias("err"),
        )

    first = js_round(profit)
    seed = F.struct(first.alias("p"), F.lit(1.0).alias("q"), F.abs(profit - first).alias("err"))
    denominators = F.sequence(F.lit(1), F.lit(FRACTION_MAX_DENOMINATOR))

    def reduced(best: Column) -> Column:
        p = best["p"].cast("bigint")
        q = best["q"].cast("bigint")
        shared = F.filter(F.sequence(F.lit(1).cast("bigint"), q), lambda d: (p % d == 0) & (q % d == 0))
        g = F.array_max(shared)
        return F.concat_ws("/", F.floor(p / g).cast("string"), F.floor(q / g).cast("string"))

    best = F.aggregate(denominators, seed, step, reduced)
    return F.when(profit <= 0, F.lit("0/1")).otherwise(best)


def expected_value_pct(price: Column, prob: Column) -> Column:
    return F.when((price > 1) & (prob > 0), (price * prob - 1.0) * 100.0).otherwise(F.lit(0.0))


def kelly_stake(price: Column, prob: Column, fraction: float = KELLY_FRACTION) -> Column:
    b = price - 1.0
    edge = b * prob - (F.lit(1.0) - prob)
    usable = (price > 1) & (prob > 0) & (prob < 1) & (edge > 0)
    return F.when(usable, F.least(F.lit(1.0), edge / b * F.lit(fraction))).otherwise(F.lit(0.0))
