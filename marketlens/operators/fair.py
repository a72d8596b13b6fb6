"""Fair pricing: margin removal per (market, book), weighted blend, edges and arbitrage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions import devig as D
from marketlens.functions.common import clamp, count_if, hours_between, sum_if
from marketlens.functions.prices import decimal_from_prob, expected_value_pct, kelly_stake, usable_prob

PROB_CEILING = 0.999999
MIN_QUOTES = 2


def open_quotes(odds: DataFrame, selections: DataFrame, market_ids: list[int] | None = None) -> DataFrame:
    """Payable, available quotes of complete markets with their market."""
    sides = selections.select("selection_id", "market_id", *[c for c in ("complete",) if c in selections.columns])
    if "complete" in sides.columns:
        sides = sides.filter("complete").drop("complete")
    if market_ids:
        sides = sides.filter(F.col("market_id").isin(market_ids))
    quotes = odds.filter(F.col("price") > 1)
    if "available" in quotes.columns:
        quotes = quotes.filter("available")
    return quotes.select("selection_id", "bookmaker_id", "price").join(sides, "selection_id")


def solve_margins(quotes: DataFrame, min_quotes: int = MIN_QUOTES) -> DataFrame:
    """Solver parameters of every (market, book) set.

    Quotes are first folded to a histogram of prices with a map-side combine, so a set that holds a large
    part of the input still reaches the solver as one short array of distinct prices.
    """
    keys = ["market_id", "bookmaker_id"]
    bins = quotes.groupBy(*keys, usable_prob(F.col("price")).alias("q")).agg(F.count(F.lit(1)).alias("n"))
    # The solver is heavy per row, so its stage keeps the full task count instead of being coalesced by size.
    tasks = int(quotes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = bins.repartition(tasks, *keys).groupBy(*keys).agg(
        F.collect_list(F.struct("q", "n")).alias("hist"),
        F.sum(F.col("q") * F.col("n")).alias("overround"),
        F.sum("n").alias("quote_count"),
    )
    fitted = sets.filter(F.col("quote_count") >= min_quotes).select(
        *keys,
        "overround",
        "quote_count",
        "hist",
        D.power_exponent(F.col("hist"), F.col("overround")).alias("power_fit"),
        D.insider_share(F.col("hist"), F.col("overround")).alias("shin_fit"),
    )
    # The explode keeps each fit a plain column and the regrouping reuses the partitioning on the keys.
    carried = ["overround", "quote_count", "power_fit", "shin_fit"]
    per_price = fitted.select(*keys, *carried, F.explode("hist").alias("h"))
    methods = _methods(F.col("h.q"))
    return (
        per_price.withColumn("gap", F.greatest(*methods) - F.least(*methods))
        .groupBy(*keys)
        .agg(*[F.first(c).alias(c) for c in carried], F.max("gap").alias("method_spread"))
    )


def _methods(q: Column) -> list[Column]:
    """Multiplicative, power and Shin probability of ``q`` given the fit columns of its set."""
    total = F.col("overround")
    mult = F.when(total > 0, q / total).otherwise(F.lit(0.0))
    power = D.power_prob(q, F.col("power_fit.x")) / F.col("power_fit.norm")
    shin = D.shin_prob(q, F.col("shin_fit.x"), total) / F.col("shin_fit.norm")
    return [mult, F.coalesce(power, mult), F.coalesce(shin, mult)]


def devig(quotes: DataFrame, fits: DataFrame | None = None) -> DataFrame:
    """Per quote: the three margin-free probabilities, with the overround and method spread of its set."""
    keys = ["market_id", "bookmaker_id"]
    fits = solve_margins(quotes) if fits is None else fits
    mult, power, shin = _methods(usable_prob(F.col("price")))
    return quotes.join(fits, keys).select(
        "selection_id",
        *keys,
        "price",
        "overround",
        "method_spread",
        mult.alias("multiplicative"),
        power.alias("power"),
        shin.alias("shin"),
    )


def fair_prices(
    odds: DataFrame, selections: DataFrame, books: DataFrame, market_ids: list[int] | None = None
) -> DataFrame:
    """Blend every book's margin-free probabilities into one fair price per selection.

    Each book's probabilities sum to 1 over what it quotes, so the weighted blend is already a
    distribution and no second pass over the market is needed to renormalise it.
    """
    weights = books.select(
        "bookmaker_id",
        "sharp",
        F.greatest(F.lit(0.0), F.coalesce(F.col("consensus_weight"), F.lit(1.0))).alias("w"),
    )
    quotes = open_quotes(odds, selections, market_ids)
    fits = solve_margins(quotes)
    # Overround and quote count need no solver, so this branch is one plain aggregate per (market, book).
    sets = quotes.groupBy("market_id", "bookmaker_id").agg(
        F.sum(usable_prob(F.col("price"))).alias("overround"), F.count(F.lit(1)).alias("quote_count")
    )
    per_market = (
        sets.filter(F.col("quote_count") >= MIN_QUOTES)
        .join(weights, "bookmaker_id")
        .groupBy("market_id")
        .agg(
            F.count(F.lit(1)).alias("book_count"),
            count_if(F.col("sharp")).alias("sharp_book_count"),
            F.avg("overround").alias("avg_overround"),
            F.sum("w").alias("w_all"),
            sum_if(F.col("sharp"), F.col("w")).alias("w_sharp"),
        )
    )
    w = F.col("w")
    per_selection = (
        devig(quotes, fits)
        .join(weights, "bookmaker_id")
        .groupBy("market_id", "selection_id")
        .agg(
            F.sum(F.col("shin") * w).alias("shin"),
            F.sum(F.col("multiplicative") * w).alias("mult"),
            F.sum(F.col("power") * w).alias("power"),
            sum_if(F.col("sharp"), F.col("shin") * w).alias("sharp"),
            F.max("method_spread").alias("method_spread"),
            F.max("price").alias("best_price"),
            F.max_by("bookmaker_id", F.struct(F.col("price"), -F.col("bookmaker_id"))).alias("best_bookmaker_id"),
        )
    )
    total = F.when(F.col("w_all") > 0, F.col("w_all")).otherwise(F.lit(1.0))
    blended = per_selection.join(per_market, "market_id").select(
        "selection_id",
        "market_id",
        _prob(F.col("shin") / total).alias("prob_consensus"),
        F.when(F.col("w_sharp") > 0, _prob(F.col("sharp") / F.col("w_sharp")))
        .otherwise(F.lit(0.0))
        .alias("prob_sharp"),
        _prob(F.col("mult") / total).alias("prob_multiplicative"),
        _prob(F.col("power") / total).alias("prob_power"),
        _prob(F.col("shin") / total).alias("prob_shin"),
        "method_spread",
        "best_price",
        "best_bookmaker_id",
        ((F.col("avg_overround") - 1.0) * 100.0).alias("overround_pct"),
        "book_count",
        "sharp_book_count",
    )
    fair = F.col("prob_consensus")
    return blended.select(
        "*",
        decimal_from_prob(fair).alias("fair_price"),
        expected_value_pct(F.col("best_price"), fair).alias("edge_pct"),
        kelly_stake(F.col("best_price"), fair).alias("kelly_fraction"),
    )


def priced_selections(odds: DataFrame, selections: DataFrame, books: DataFrame) -> DataFrame:
    """The selections that ``fair_prices`` prices, told without solving: known books with enough quotes of the market."""
    quotes = open_quotes(odds, selections).join(books.select("bookmaker_id"), "bookmaker_id", "left_semi")
    sets = quotes.groupBy("market_id", "bookmaker_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_QUOTES)
    return quotes.join(sets, ["market_id", "bookmaker_id"], "left_semi").select("selection_id").distinct()


def _prob(p: Column) -> Column:
    return clamp(F.coalesce(p, F.lit(0.0)), 0.0, PROB_CEILING)


def upcoming(selections: DataFrame, events: DataFrame, as_of: Column, until: Column | None = None) -> DataFrame:
    """Selections of scheduled events that start after ``as_of`` (up to ``until``): what has to be priced for them.

    A market belongs to one event, so whole markets stay and their margins can be removed.
    """
    future = (F.col("status") == "scheduled") & (F.col("commence_at") >= as_of)
    future = future if until is None else future & (F.col("commence_at") <= until)
    return selections.join(events.filter(future).select("event_id"), "event_id", "left_semi")


def edges(
    fair: DataFrame,
    selections: DataFrame,
    events: DataFrame,
    as_of: Column,
    min_edge: float = 0.0,
    min_books: int = 1,
    sport: str | None = None,
    market_type: str | None = None,
    limit: int | None = None,
    offset: int = 0,
) -> DataFrame:
    """Selections of future scheduled events whose best price beats fair value."""
    rows = (
        fair.filter((F.col("edge_pct") >= min_edge) & (F.col("book_count") >= min_books))
        .join(selections.drop("market_id"), "selection_id")
        .join(events.filter((F.col("status") == "scheduled") & (F.col("commence_at") > as_of)), "event_id")
    )
    if sport:
        rows = rows.filter(F.col("sport_slug") == sport)
    if market_type:
        rows = rows.filter(F.col("market_type") == market_type)
    out = rows.select(
        "selection_id",
        "market_id",
        "event_id",
        "sport_slug",
        "market_type",
        "side",
        "label",
        "commence_at",
        "prob_consensus",
        "prob_sharp",
        "fair_price",
        "best_price",
        "best_bookmaker_id",
        "edge_pct",
        "kelly_fraction",
        "overround_pct",
        "method_spread",
        "book_count",
    )
    if limit is not None:
        out = out.orderBy(F.desc("edge_pct"), "selection_id").offset(offset).limit(limit)
    return out


def insight_candidates(
    fair: DataFrame, selections: DataFrame, events: DataFrame, as_of: Column, limit: int = 25
) -> DataFrame:
    """The strongest edges (over 1 %, three books or more) with hours to the start."""
    rows = edges(
        fair.filter(F.col("edge_pct") > 1.0), selections, events, as_of, min_edge=1.0, min_books=3, limit=limit
    )
    return rows.withColumn("hours_to_start", hours_between(F.col("commence_at"), as_of))


def market_hold(best: DataFrame, selections: DataFrame) -> DataFrame:
    """Best-price book sum per complete market of two or more selections, with the arbitrage flag.

    ``best`` has one row per quoted selection; a selection nobody quotes adds nothing to the sum.
    """
    priced = selections.select("selection_id", "market_id").join(
        best.select("selection_id", "best_price"), "selection_id", "left"
    )
    sums = priced.groupBy("market_id").agg(
        F.coalesce(F.sum(usable_prob(F.col("best_price"))), F.lit(0.0)).alias("best_book_sum"),
        F.count(F.lit(1)).alias("selection_count"),
    )
    book_sum = F.col("best_book_sum")
    arb = (book_sum > 0) & (book_sum < 1)
    return sums.filter(F.col("selection_count") >= 2).select(
        "market_id",
        "selection_count",
        "best_book_sum",
        ((book_sum - 1.0) * 100.0).alias("hold_pct"),
        arb.alias("is_arbitrage"),
        F.when(arb, (F.lit(1.0) - book_sum) * 100.0).otherwise(F.lit(0.0)).alias("arbitrage_pct"),
    )


def arbitrage_legs(holds: DataFrame, best: DataFrame, selections: DataFrame, min_profit: float = 0.0) -> DataFrame:
    """One row per leg of each arbitrage market: the price, the book and the share of the stake.

    A selection nobody quotes keeps its leg with a zero share.
    """
    markets = holds.filter(F.col("is_arbitrage") & (F.col("arbitrage_pct") >= min_profit))
    legs = selections.select("selection_id", "market_id", "side").join(
        best.select("selection_id", "best_price", "best_bookmaker_id"), "selection_id", "left"
    )
    share = F.lit(100.0) / F.col("best_price") / F.col("best_book_sum")
    return legs.join(markets, "market_id").select(
        "market_id",
        "arbitrage_pct",
        "selection_id",
        "side",
        "best_price",
        "best_bookmaker_id",
        F.when(F.col("best_price") > 0, share).otherwise(F.lit(0.0)).alias("stake_pct"),
    )


def selection_best(odds: DataFrame) -> DataFrame:
    """Best price and book, mean price and best-versus-mean edge per selection; ties go to the lowest book id."""
    rows = odds.filter("available") if "available" in odds.columns else odds
    best = rows.groupBy("selection_id").agg(
        F.max("price").alias("best_price"),
        F.max_by("bookmaker_id", F.struct(F.col("price"), -F.col("bookmaker_id"))).alias("best_bookmaker_id"),
        F.avg("price").alias("average_price"),
        F.count(F.lit(1)).alias("quote_count"),
    )
    price, mean = F.col("best_price"), F.col("average_price")
    return best.select(
        "*",
        F.when(price > 0, F.lit(100.0) / price).otherwise(F.lit(0.0)).alias("implied_pct"),
        F.when(mean > 0, (price / mean - 1.0) * 100.0).otherwise(F.lit(0.0)).alias("edge_vs_average_pct"),
    )
