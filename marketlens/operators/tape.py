"""Trade tape: fill scoring, trader ranking, flow graph and cross-venue pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.common import clamp, count_if, first_rows, js_round, minus_hours, ratio

WHALE_SINGLE_FILL = 10_000.0
WHALE_TOTAL = 100_000.0
PRIOR_WEIGHT = 6.0
MIN_RESOLVED = 2
SMART_GROUP_SCORE = 25.0


def score_fills(fills: DataFrame, markets: DataFrame) -> DataFrame:
    """Fills with ``is_winner`` set on settled markets (1 won, 0 lost, NULL unknown); known values stay."""
    settled = markets.filter((F.col("status") == "settled") & (F.col("result") != ""))
    results = settled.select("market_id", F.col("result").alias("settled_result"))
    won = F.when(F.col("settled_result").isNotNull(), (F.col("side") == F.col("settled_result")).cast("int"))
    known = F.col("is_winner") if "is_winner" in fills.columns else F.lit(None).cast("int")
    return (
        fills.join(results, "market_id", "left")
        .withColumn("is_winner", F.coalesce(known, won))
        .drop("settled_result")
    )


def smart_score(wins: Column, resolved: Column) -> Column:
    shrunk = (wins + PRIOR_WEIGHT * 0.5) / (resolved + PRIOR_WEIGHT)
    return clamp(js_round((shrunk - 0.5) * 2000.0) / 10.0, 0.0, 100.0)


def trader_scores(scored: DataFrame) -> DataFrame:
    """Volume, record, smart score and whale flag per attributable trader."""
    rows = (
        scored.filter(F.col("trader_id").isNotNull())
        .groupBy("trader_id")
        .agg(
            F.count(F.lit(1)).alias("trade_count"),
            F.sum("notional").alias("total_notional"),
            F.avg("notional").alias("avg_trade_size"),
            F.max("notional").alias("max_trade_size"),
            F.count("is_winner").alias("resolved_trade_count"),
            count_if(F.col("is_winner") == 1).alias("winning_trade_count"),
        )
    )
    wins, resolved = F.col("winning_trade_count"), F.col("resolved_trade_count")
    whale = (F.col("max_trade_size") >= WHALE_SINGLE_FILL) | (F.col("total_notional") >= WHALE_TOTAL)
    return rows.select(
        "*",
        ratio(wins, resolved).alias("win_rate"),
        smart_score(wins, resolved).alias("smart_score"),
        whale.alias("is_whale"),
    )


def display_name(alias: Column, wallet: Column) -> Column:
    short = F.concat(F.substring(wallet, 1, 6), F.lit("…"), F.right(wallet, F.lit(4)))
    return F.when(F.coalesce(alias, F.lit("")) != "", alias).otherwise(short)


def smart_money(traders: DataFrame, limit: int | None = None) -> DataFrame:
    """Best traders with a record or whale size, by score then notional."""
    rows = traders.filter((F.col("resolved_trade_count") >= MIN_RESOLVED) | F.col("is_whale"))
    if "wallet" in rows.columns:
        rows = rows.withColumn("name", display_name(F.col("alias"), F.col("wallet")))
    return first_rows(rows, limit, F.desc("smart_score"), F.desc("total_notional"), "trader_id")


def big_trades(fills: DataFrame, markets: DataFrame, traders: DataFrame, limit: int | None = None) -> DataFrame:
    """Fills with their market and trader; with ``limit`` the largest, cut before anything is joined."""
    top = first_rows(fills, limit, F.desc("notional"), "trade_id")
    named = traders.select("trader_id", *[c for c in ("alias", "smart_score", "is_whale") if c in traders.columns])
    return top.join(markets.select("market_id", "venue", "question"), "market_id").join(named, "trader_id", "left")


def graph_traders(traders: DataFrame, limit: int | None = None) -> DataFrame:
    rows = traders.filter(
        (F.col("trade_count") > 0)
        & ((F.col("resolved_trade_count") >= MIN_RESOLVED) | F.col("is_whale") | (F.col("total_notional") > 0))
    )
    return first_rows(rows, limit, F.desc("smart_score"), F.desc("total_notional"), "trader_id")


def graph_links(scored: DataFrame, traders: DataFrame) -> DataFrame:
    """Notional, trades, wins and losses between each chosen trader and the markets it traded."""
    return (
        scored.filter(F.col("trader_id").isNotNull())
        .groupBy("trader_id", "market_id")
        .agg(
            F.sum("notional").alias("value"),
            F.count(F.lit(1)).alias("trades"),
            count_if(F.col("is_winner") == 1).alias("wins"),
            count_if(F.col("is_winner") == 0).alias("losses"),
        )
        .join(traders.select("trader_id"), "trader_id", "left_semi")
        .select(
            F.concat(F.lit("t:"), F.col("trader_id").cast("string")).alias("source"),
            F.concat(F.lit("m:"), F.col("market_id").cast("string")).alias("target"),
            "value",
            "trades",
            "wins",
            "losses",
        )
    )


def graph_nodes(links: DataFrame, traders: DataFrame, markets: DataFrame) -> DataFrame:
    """Trader nodes grouped whale / smart / trader, and the markets they link to."""
    smart = (F.col("smart_score") >= SMART_GROUP_SCORE) & (F.col("resolved_trade_count") >= MIN_RESOLVED)
    people = traders.select(
        F.concat(F.lit("t:"), F.col("trader_id").cast("string")).alias("id"),
        F.lit("trader").alias("kind"),
        F.when(F.col("is_whale"), "whale").when(smart, "smart").otherwise("trader").alias("group"),
        F.col("total_notional").alias("value"),
    )
    places = markets.select(
        F.concat(F.lit("m:"), F.col("market_id").cast("string")).alias("id"),
        F.lit("market").alias("kind"),
        F.concat(F.lit("market-"), "venue").alias("group"),
        F.col("volume").alias("value"),
    ).join(links.select(F.col("target").alias("id")).distinct(), "id", "left_semi")
    return people.unionByName(places)


def cross_venue_pairs(markets: DataFrame) -> DataFrame:
    """The counterpart market on another venue for every open priced question, lowest market id first.

    Each question keeps one market per venue, so a question listed many times never multiplies rows.
    """
    live = markets.filter((F.col("status") == "open") & (F.col("last_price") > 0))
    per_venue = live.groupBy("question", "venue").agg(
        F.min("market_id").alias("other_market_id"), F.min_by("last_price", "market_id").alias("other_price")
    )
    offers = per_venue.groupBy("question").agg(
        F.sort_array(F.collect_list(F.struct("other_market_id", "venue", "other_price"))).alias("offers")
    )
    rows = markets.join(offers, "question").withColumn(
        "other", F.get(F.filter("offers", lambda o: o["venue"] != F.col("venue")), F.lit(0))
    )
    return rows.filter(F.col("other").isNotNull()).select(
        "market_id",
        "venue",
        "question",
        "last_price",
        F.col("other.other_market_id").alias("other_market_id"),
        F.col("other.venue").alias("other_venue"),
        F.col("other.other_price").alias("other_price"),
        (F.col("other.other_price") - F.col("last_price")).alias("yes_gap"),
    )


def intel_summary(markets: DataFrame, fills: DataFrame, traders: DataFrame, as_of: Column) -> DataFrame:
    """Counts of markets, trades, traders, whales, venues and fills of the last 24 hours."""
    recent = F.col("traded_at") >= minus_hours(as_of, 24)
    tape = fills.agg(F.count(F.lit(1)).alias("trade_count"), count_if(recent).alias("recent_fills"))
    people = traders.agg(F.count(F.lit(1)).alias("n"), count_if(F.col("is_whale")).alias("whales"))
    return tape.select(
        "*",
        markets.agg(F.count(F.lit(1))).scalar().alias("market_count"),
        markets.agg(F.count_distinct("venue")).scalar().alias("venue_count"),
        people.select("n").scalar().alias("trader_count"),
        people.select("whales").scalar().alias("whale_count"),
    )
