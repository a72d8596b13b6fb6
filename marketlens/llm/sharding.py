"""Sharding: a keyed permutation of global row numbers gives each row its shard and its slot.

Rows are numbered without a global sort: rows that are equal in every column become one row with a count, a hash of all
columns deals them over a fixed number of buckets, a window numbers each bucket, and the sizes of the buckets before it
are added. The number goes through a Feistel network over [0, a) x [0, b), where a * b is the least such grid that holds
all rows, and walks on while it lands outside the rows (cycle walking). The place p that comes out is dealt as
shard p mod shards, slot p div shards. Everything is a column expression.

Null values hash and sort like any others; equal rows share a key and are numbered apart; an empty table gives an empty
result. Columns must be groupable (no maps). Columns may have any names but those that are added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096
ROUNDS = 6
#: Steps of the second walk. A permutation can't stay outside longer than there are outside places, under sqrt(rows) + 1.
WALK = 64
ADDED = ("row_number", "position", "shard", "slot")


def _round(value: Column, turn: Column, seed: int, width: Column) -> Column:
    return F.pmod(F.xxhash64(value, turn, F.lit(seed)), width)


def feistel(number: Column, high: Column, low: Column, seed: int) -> Column:
    """One pass of the network over the grid high x low; a bijection of [0, high * low)."""
    start = F.struct(F.floor(number / low).cast("long").alias("l"), F.pmod(number, low).alias("r"))

    def turned(pair: Column, turn: Column) -> Column:
        left = F.when(turn % 2 == 0, F.pmod(pair["l"] + _round(pair["r"], turn, seed, high), high)).otherwise(pair["l"])
        right = F.when(turn % 2 == 1, F.pmod(pair["r"] + _round(pair["l"], turn, seed, low), low)).otherwise(pair["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    turns = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(turns, start, turned, lambda pair: pair["l"] * low + pair["r"])


def walked(start: Column, high: Column, low: Column, rows: Column, seed: int) -> Column:
    """Further passes until the place lies inside ``rows``; few rows need one, so the loop is behind a condition."""
    steps = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)),
        start,
        lambda place, _: F.when(place < rows, place).otherwise(feistel(place, high, low, seed)),
    )
    inside = F.when(steps < rows, steps).otherwise(F.raise_error(F.lit("the walk did not end")).cast("long"))
    return F.when(start < rows, start).otherwise(inside)


def numbered(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``df`` with ``row_number``, 0 to rows - 1, a function of the rows alone, and ``row_count``."""
    names = df.columns
    keys = [F.col(f"`{c}`") for c in names]
    rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    sizes = df.groupBy(F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("_bucket")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_bucket")
    sizes = sizes.select(
        "_bucket",
        (F.sum("_size").over(before) - F.col("_size")).alias("_before"),
        F.sum("_size").over(before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("row_count"),
    )
    inside = Window.partitionBy("_bucket").orderBy(*[k.asc_nulls_first() for k in keys])
    rows = rows.withColumn("_last", F.sum("_copies").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    copies = F.sequence(F.col("_last") - F.col("_copies"), F.col("_last") - 1)
    rows = rows.join(sizes, "_bucket").withColumn("_place", F.explode(copies))
    return rows.select(*keys, (F.col("_before") + F.col("_place")).alias("row_number"), "row_count")


def shard(df: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """``df`` with ``row_number``, ``position`` (its place in the shuffle), ``shard`` and ``slot``."""
    if shards < 1:
        raise ValueError("shards must be positive")
    if taken := [c for c in df.columns if c.lower() in (*ADDED, "row_count")]:
        raise ValueError(f"columns {taken} are taken; rename them first")
    plain = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)])
    names = [F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)]
    rows = numbered(plain)
    count = F.col("row_count")
    rows = rows.withColumn("_high", F.greatest(F.ceil(F.sqrt(count.cast("double"))), F.lit(1)).cast("long"))
    rows = rows.withColumn("_low", F.ceil(count / F.col("_high")).cast("long"))
    rows = rows.withColumn("_start", feistel(F.col("row_number"), F.col("_high"), F.col("_low"), seed))
    place = walked(F.col("_start"), F.col("_high"), F.col("_low"), count, seed)
    rows = rows.withColumn("position", place)
    shard_of, slot = F.pmod("position", F.lit(shards)).cast("int"), F.floor(F.col("position") / shards).cast("long")
    return rows.select(*names, "row_number", "position", shard_of.alias("shard"), slot.alias("slot"))


def shard_sizes(rows: int, shards: int) -> list[int]:
    """How many rows each shard gets: counts differ by one at most."""
    return [math.ceil((rows - s) / shards) for s in range(shards)]


def document_shards(docs: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """Shard the documents by row count: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A null text has size 16 and the crc32 of no bytes.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    light = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    dealt = shard(light, shards, seed)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number", "position"
    )
