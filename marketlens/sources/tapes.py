"""Trade tapes and market metadata of two venues to one shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.common import js_round
from marketlens.functions.times import to_instant

TRADE_A_SCHEMA = (
    "trade_id string, ticker string, count_fp string, yes_price_dollars string, no_price_dollars string, "
    "taker_side string, created_time string"
)
TRADE_B_SCHEMA = (
    "proxyWallet string, side string, conditionId string, size double, price double, timestamp bigint, outcome string, "
    "transactionHash string, name string, pseudonym string"
)
RESOLVED_PRICE = 0.999


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def normalise_trades_a(raw: DataFrame, venue: str = "a") -> DataFrame:
    """Anonymous tape: the taker side picks the price column; rows without a usable number are dropped."""
    side = F.when(F.col("taker_side") == "no", "no").otherwise("yes")
    price = F.when(side == "no", F.col("no_price_dollars")).otherwise(F.col("yes_price_dollars")).try_cast("double")
    size = F.col("count_fp").try_cast("double")
    rows = raw.select(
        F.lit(venue).alias("venue"),
        F.col("trade_id").alias("external_id"),
        F.col("ticker").alias("market_external_id"),
        side.alias("side"),
        price.alias("price"),
        size.alias("size"),
        to_instant(F.col("created_time")).alias("traded_at"),
        F.lit(None).cast("string").alias("wallet"),
        F.lit(None).cast("string").alias("alias"),
    ).filter(_finite(F.col("price")) & _finite(F.col("size")))
    return rows.withColumn("notional", js_round(F.col("size") * F.col("price"), 2))


def normalise_trades_b(raw: DataFrame, venue: str = "b") -> DataFrame:
    """Attributed tape: buys only, with a composite id and the trader's wallet and alias."""
    rows = raw.filter((F.col("side") == "BUY") & _finite(F.col("price")) & _finite(F.col("size"))).select(
        F.lit(venue).alias("venue"),
        F.lower(F.concat_ws(":", "transactionHash", "conditionId", "outcome")).alias("external_id"),
        F.col("conditionId").alias("market_external_id"),
        F.lower("outcome").alias("side"),
        "price",
        "size",
        F.timestamp_seconds("timestamp").alias("traded_at"),
        F.lower("proxyWallet").alias("wallet"),
        F.coalesce(F.nullif("name", F.lit("")), F.col("pseudonym"), F.lit("")).alias("alias"),
    )
    return rows.withColumn("notional", js_round(F.col("size") * F.col("price"), 2))


def deduplicate_trades(trades: DataFrame) -> DataFrame:
    """Insert-or-ignore on (venue, external id): the earliest fill of each stays, ties by the other columns."""
    keys = ["venue", "external_id"]
    rest = sorted((c for c in trades.columns if c not in keys), key=lambda c: c != "traded_at")
    first = trades.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("fill"))
    return first.select(*[c if c in keys else F.col(f"fill.{c}").alias(c) for c in trades.columns])


MARKET_A_SCHEMA = (
    "ticker string, title string, category string, status string, result string, volume_fp string, "
    "liquidity_dollars string, last_price_dollars string, yes_sub_title string, close_time string"
)
MARKET_B_SCHEMA = (
    "conditionId string, question string, category string, closed boolean, umaResolutionStatus string, outcomes string, "
    "outcomePrices string, volumeNum double, liquidityNum double, lastTradePrice double, endDate string"
)


def _number(text: Column) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def normalise_markets_a(raw: DataFrame, venue: str = "a") -> DataFrame:
    status = (
        F.when(F.col("status").isin("finalized", "settled"), "settled")
        .when(F.col("status").isin("active", "open"), "open")
        .otherwise("closed")
    )
    return raw.select(
        F.lit(venue).alias("venue"),
        F.col("ticker").alias("external_id"),
        F.col("title").alias("question"),
        F.coalesce("yes_sub_title", F.lit("")).alias("outcome_label"),
        F.coalesce("category", F.lit("")).alias("category"),
        status.alias("status"),
        F.coalesce("result", F.lit("")).alias("result"),
        _number(F.col("volume_fp")).alias("volume"),
        _number(F.col("liquidity_dollars")).alias("liquidity"),
        _number(F.col("last_price_dollars")).alias("last_price"),
        to_instant(F.col("close_time")).alias("ends_at"),
    )


def winner_of(closed: Column, outcomes: Column, prices: Column) -> Column:
    """Lower-case outcome whose price is at least 0.999, '' when none; both lists are JSON text."""
    names = F.from_json(outcomes, "array<string>")
    values = F.transform(F.from_json(prices, "array<string>"), lambda p: p.try_cast("double"))
    at = F.array_position(F.transform(values, lambda p: F.coalesce(p >= RESOLVED_PRICE, F.lit(False))), True)
    picked = F.lower(F.get(names, at.cast("int") - 1))
    return F.when(closed & (at > 0), F.coalesce(picked, F.lit(""))).otherwise(F.lit(""))


def normalise_markets_b(raw: DataFrame, venue: str = "b") -> DataFrame:
    done = F.coalesce(F.col("umaResolutionStatus") == "resolved", F.lit(False))
    status = F.when(F.col("closed"), F.when(done, "settled").otherwise("closed")).otherwise("open")
    return raw.select(
        F.lit(venue).alias("venue"),
        F.col("conditionId").alias("external_id"),
        "question",
        F.lit("").alias("outcome_label"),
        F.coalesce("category", F.lit("")).alias("category"),
        status.alias("status"),
        winner_of(F.col("closed"), F.col("outcomes"), F.col("outcomePrices")).alias("result"),
        F.coalesce("volumeNum", F.lit(0.0)).alias("volume"),
        F.coalesce("liquidityNum", F.lit(0.0)).alias("liquidity"),
        F.coalesce("lastTradePrice", F.lit(0.0)).alias("last_price"),
        to_instant(F.col("endDate")).alias("ends_at"),
    )


def normalise_markets(venue_a: DataFrame, venue_b: DataFrame) -> DataFrame:
    return normalise_markets_a(venue_a).unionByName(normalise_markets_b(venue_b))
