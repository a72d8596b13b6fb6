"""Instant parsing and time labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketlens.functions.common import hours_between, js_round

SECONDS_CEILING = 1e11
LOCAL_ZONE = "America/New_York"
EPOCH_PATTERN = r"^-?[0-9]+(\.[0-9]+)?$"


def to_instant(raw: Column) -> Column:
    """Epoch seconds, epoch milliseconds or ISO text to a timestamp; NULL when unreadable."""
    text = F.trim(raw.cast("string"))
    number = text.try_cast("double")
    seconds = F.when(number < SECONDS_CEILING, number).otherwise(number / 1000.0)
    epoch = F.timestamp_micros(F.floor(seconds * 1e6 + 0.5).cast("bigint"))
    return F.when(text.rlike(EPOCH_PATTERN), epoch).otherwise(text.try_cast("timestamp"))


def proximity_bucket(commence_at: Column, status: Column, as_of: Column) -> Column:
    """inPlay, imminent (1 h), near (24 h) or far; NULL when finished or without a start time."""
    hours = hours_between(commence_at, as_of)
    done = status.isin("final", "settled", "cancelled")
    return (
        F.when(commence_at.isNull() | done, F.lit(None).cast("string"))
        .when(status.isin("live", "in_progress") | (hours <= 0), F.lit("inPlay"))
        .when(hours <= 1, F.lit("imminent"))
        .when(hours <= 24, F.lit("near"))
        .otherwise(F.lit("far"))
    )


def kickoff_label(commence_at: Column, status: Column, as_of: Column) -> Column:
    """Final, Live, Today, Tomorrow or a dated label, in New York time."""
    local = F.from_utc_timestamp(commence_at, LOCAL_ZONE)
    offset = (F.unix_micros(local) - F.unix_micros(commence_at)) / F.lit(3_600_000_000)
    zone = F.when(offset == -4, F.lit("EDT")).otherwise(F.lit("EST"))
    clock = F.concat_ws(" ", F.date_format(local, "h:mm a"), zone)
    days = F.floor(hours_between(commence_at, as_of) / 24.0)
    dot = F.lit(" · ")
    return (
        F.when(commence_at.isNull(), F.lit(""))
        .when(status == "final", F.lit("Final"))
        .when(status == "live", F.lit("Live"))
        .when(status.isin("postponed", "cancelled"), F.initcap(status))
        .when(days <= 0, F.concat(F.lit("Today"), dot, clock))
        .when(days == 1, F.concat(F.lit("Tomorrow"), dot, clock))
        .otherwise(F.concat(F.date_format(local, "EEE, MMM d"), dot, clock))
    )


def age_label(at: Column, as_of: Column) -> Column:
    """never, just now (under 90 s), Nm ago, Nh ago or Nd ago."""
    seconds = F.greatest(F.lit(0.0), js_round((F.unix_micros(as_of) - F.unix_micros(at)) / F.lit(1e6)))

    def ago(unit: float, letter: str) -> Column:
        return F.concat(js_round(seconds / unit).cast("bigint").cast("string"), F.lit(f"{letter} ago"))

    return (
        F.when(at.isNull(), F.lit("never"))
        .when(seconds < 90, F.lit("just now"))
        .when(seconds < 3600, ago(60.0, "m"))
        .when(seconds < 86400, ago(3600.0, "h"))
        .otherwise(ago(86400.0, "d"))
    )
