"""Ordered scans that never hold one key's whole history in one task.

A window over ``partitionBy(key)`` sends every row of a key to one task. These helpers split each key's
timeline into fixed segments (a day, an hour), run the window inside (key, segment), and carry one
summary row per segment across the boundary. A segment is any expression of the row that never falls as
the order rises (a time bucket, or a struct of leading order columns and a bucket of the next); being a
pure function of the row, a recomputed task always reproduces it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketlens.session import cut

DAY_MICROS = 86_400_000_000
SEGMENT = "__segment"
CARRY = "__carry"


def segment_of(ts: Column, micros: int = DAY_MICROS) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(micros)).cast("bigint")


def with_carry(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], segment: Column
) -> DataFrame:
    """Rows plus, for every segment, one row repeating the last ``values`` of the previous segment.

    Carry rows have ``__carry`` = true and sort first; run any look-back-one window over
    ``lag_window(keys, order)`` and then drop them with ``drop_carry``.
    """
    rows = df.withColumn(SEGMENT, segment)
    last = (
        rows.groupBy(*keys, SEGMENT)
        .agg(F.max_by(F.struct(*values), F.struct(*order)).alias("__last"))
        .withColumn(SEGMENT, F.lead(SEGMENT).over(W.partitionBy(*keys).orderBy(SEGMENT)))
        .filter(F.col(SEGMENT).isNotNull())
    )
    carried = last.select(*keys, SEGMENT, *[F.col("__last")[v].alias(v) for v in values], F.lit(True).alias(CARRY))
    return rows.withColumn(CARRY, F.lit(False)).unionByName(carried, allowMissingColumns=True)


def lag_window(keys: Sequence[str], order: Sequence[str]):
    return W.partitionBy(*keys, SEGMENT).orderBy(F.desc(CARRY), *order)


def drop_carry(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(CARRY)).drop(CARRY, SEGMENT)


def lagged(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], segment: Column
) -> DataFrame:
    """Adds ``prev_<value>`` for every value, as ``lag`` over the key's whole history would."""
    window = lag_window(keys, order)
    scanned = with_carry(df, keys, order, values, segment).select(
        "*", *[F.lag(v).over(window).alias(f"prev_{v}") for v in values]
    )
    return drop_carry(scanned)


def dealt(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows dealt by ranges of (keys, order) and checkpointed, with their range as segment: for keys with no natural one."""
    return cut(df.repartitionByRange(*keys, *order).withColumn(SEGMENT, F.spark_partition_id()))


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], values: dict[str, Column]) -> DataFrame:
    """Adds the sum of each value over all earlier rows of the key; ``rows`` carry their segment."""
    inside = W.partitionBy(*keys, SEGMENT).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, SEGMENT).agg(*[F.sum(v).alias(c) for c, v in values.items()])
    carried = totals.select(*keys, SEGMENT, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__{c}") for c in values])
    sums = [(F.coalesce(F.sum(v).over(inside), F.lit(0)) + F.col(f"__{c}")).alias(c) for c, v in values.items()]
    return rows.join(carried, [*keys, SEGMENT]).select("*", *sums).drop(*[f"__{c}" for c in values])
