"""Rounding, clamping and formatting shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def js_round(x: Column, places: int = 0) -> Column:
    """Half-up rounding: floor(x * 10^n + 0.5) / 10^n."""
    factor = float(10**places)
    return F.floor(x * F.lit(factor) + F.lit(0.5)).cast("double") / F.lit(factor)


def first_rows(rows: DataFrame, limit: int | None, *order: Column | str) -> DataFrame:
    """The first ``limit`` rows in the given order; all rows, in no order, without a limit."""
    return rows if limit is None else rows.orderBy(*order).limit(limit)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), x))


def ratio(num: Column, den: Column, empty: float | None = 0.0) -> Column:
    """num / den, or ``empty`` when the denominator is not positive."""
    fallback = F.lit(None).cast("double") if empty is None else F.lit(float(empty))
    return F.when(den > 0, num.cast("double") / den).otherwise(fallback)


def pct_text(x: Column) -> Column:
    return F.format_string("%.1f%%", x * 100.0)


def number_text(x: Column, places: int = 2) -> Column:
    """A number of up to so many decimal places, without zeros at its end."""
    text = F.format_string(f"%.{places}f", x)
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")


def count_if(cond: Column) -> Column:
    """Number of rows where ``cond`` holds (0 on an empty group)."""
    return F.count(F.when(cond, F.lit(1)))


def sum_if(cond: Column, value: Column) -> Column:
    """Sum of ``value`` where ``cond`` holds, 0.0 when nothing matches."""
    return F.coalesce(F.sum(F.when(cond, value)), F.lit(0.0))


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)).cast("double") / F.lit(3_600_000_000.0)


def minus_hours(ts: Column, hours: float) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) - F.lit(int(hours * 3_600_000_000)))


def minus_days(ts: Column, days: float) -> Column:
    return minus_hours(ts, days * 24)
