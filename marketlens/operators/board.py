"""Board views over current quotes and the change log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketlens.functions.common import count_if, js_round
from marketlens.functions.prices import american_text, implied_prob

HISTORY_POINTS = 30


def filter_events(
    events: DataFrame,
    sport: str | None = None,
    category: str | None = None,
    status: str | None = None,
    start: Column | None = None,
    end: Column | None = None,
) -> DataFrame:
    """Event filters of the board; without status or dates only scheduled and live events remain."""
    rows = events
    if status is None and start is None and end is None:
        rows = rows.filter(F.col("status").isin("scheduled", "live"))
    if sport:
        rows = rows.filter(F.col("sport_slug") == sport)
    if category:
        rows = rows.filter(F.col("category") == category)
    if status:
        rows = rows.filter(F.col("status") == status)
    if start is not None:
        rows = rows.filter(F.col("commence_at") >= start)
    if end is not None:
        rows = rows.filter(F.col("commence_at") <= end)
    return rows


def page_of_events(events: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of events by start time; the order is total, so every read of the page gives the same rows."""
    return events.orderBy("commence_at", "event_id").offset(max(0, offset)).limit(max(1, limit))


def page_envelope(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Total, limit, offset and whether more rows follow the page."""
    total = F.col("total")
    counted = rows.agg(F.count(F.lit(1)).alias("total"))
    return counted.select(
        total, F.lit(limit).alias("limit"), F.lit(offset).alias("offset"), (total > offset + limit).alias("has_more")
    )


def odds_board(
    page: DataFrame,
    selections: DataFrame,
    odds: DataFrame,
    best: DataFrame,
    fair: DataFrame,
    history: DataFrame | None = None,
    market_type: str | None = None,
) -> DataFrame:
    """One page of events with markets, selections and quotes nested inside.

    ``page`` comes from ``page_of_events`` and every other input is joined to it, so the nested arrays only ever hold one
    event's markets and one selection's quotes.
    """
    sides = selections if market_type is None else selections.filter(F.col("market_type") == market_type)
    wanted = sides.join(page.select("event_id"), "event_id", "left_semi")
    top = best.select("selection_id", "best_price", "best_bookmaker_id", "average_price", "edge_vs_average_pct")
    cells = (
        odds.select("selection_id", "bookmaker_id", "price")
        .join(wanted.select("selection_id"), "selection_id", "left_semi")
        .join(top.select("selection_id", "best_bookmaker_id"), "selection_id")
        .groupBy("selection_id")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        "bookmaker_id",
                        "price",
                        american_text(F.col("price")).alias("american"),
                        (F.col("bookmaker_id") == F.col("best_bookmaker_id")).alias("is_best"),
                    )
                )
            ).alias("quotes")
        )
    )
    views = (
        wanted.join(top, "selection_id", "left")
        .join(cells, "selection_id", "left")
        .join(
            fair.select("selection_id", "prob_consensus", "prob_sharp", "edge_pct", "kelly_fraction"),
            "selection_id",
            "left",
        )
    )
    if history is not None:
        views = views.join(history.select("selection_id", "prices"), "selection_id", "left")
    else:
        views = views.withColumn("prices", F.lit(None).cast("array<double>"))
    selection_view = F.struct(
        "position", "selection_id", "label", "side", "best_price", "best_bookmaker_id", "average_price",
        "edge_vs_average_pct", "prob_consensus", "prob_sharp", "edge_pct", "kelly_fraction", "prices", "quotes",
    )
    price_sum = F.sum(F.when(F.col("best_price") > 1, F.lit(1.0) / F.col("best_price")))
    markets = views.groupBy("event_id", "market_id", "market_type").agg(
        F.sort_array(F.collect_list(selection_view)).alias("selections"),
        F.when(F.count(F.lit(1)) >= 2, F.coalesce(price_sum, F.lit(0.0))).alias("best_book_sum"),
        F.max(F.size(F.coalesce(F.col("quotes"), F.array()))).alias("max_quotes"),
    )
    per_event = markets.groupBy("event_id").agg(
        F.sort_array(F.collect_list(F.struct("market_id", "market_type", "best_book_sum", "selections"))).alias(
            "markets"
        )
    )
    return page.join(per_event, "event_id", "left").withColumn("markets", F.coalesce("markets", F.array()))


def board_as_of(
    change_log: DataFrame,
    selections: DataFrame,
    events: DataFrame,
    books: DataFrame,
    at: Column,
    sport: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """The board as it stood at an instant: latest observation per (selection, book) at or before ``at``."""
    latest = (
        change_log.filter(F.col("captured_at") <= at)
        .groupBy("selection_id", "bookmaker_id")
        .agg(
            F.max_by(F.struct("price", "captured_at"), F.struct("captured_at", "id")).alias("seen"),
        )
        .select("selection_id", "bookmaker_id", "seen.price", "seen.captured_at")
    )
    matches = events if sport is None else events.filter(F.col("sport_slug") == sport)
    rows = (
        latest.join(selections, "selection_id")
        .join(matches.select("event_id", "sport_slug", "commence_at"), "event_id")
        .join(books.select("bookmaker_id", F.col("slug").alias("bookmaker")), "bookmaker_id")
        .select(
            "event_id", "sport_slug", "commence_at", "market_id", "market_type", "selection_id",
            F.col("label").alias("selection_label"), "side", "position", "bookmaker", "price",
            implied_prob(F.col("price")).alias("implied_prob"), "captured_at",
        )
    )
    if limit is not None:
        rows = rows.orderBy("commence_at", "event_id", "market_id", "position", "bookmaker").limit(limit)
    return rows


def book_coverage(quotes: DataFrame, observed: Column) -> DataFrame:
    """Lines each book offers per event and market type with the time last seen."""
    lines = quotes.groupBy("bookmaker_id", "event_id", "market_type", "market_id").agg(F.max(observed).alias("seen"))
    return lines.groupBy("bookmaker_id", "event_id", "market_type").agg(
        F.count(F.lit(1)).alias("line_count"), F.max("seen").alias("last_seen_at")
    )


def event_coverage(coverage: DataFrame, books: DataFrame, event_id: int | None = None) -> DataFrame:
    """Coverage of events with one array of market types per book."""
    rows = coverage if event_id is None else coverage.filter(F.col("event_id") == event_id)
    return (
        rows.join(books.select("bookmaker_id", F.col("slug").alias("bookmaker")), "bookmaker_id")
        .groupBy("event_id", "bookmaker")
        .agg(
            F.sort_array(F.collect_list(F.struct("market_type", "line_count", "last_seen_at"))).alias("offers"),
        )
    )


def event_freshness(quotes: DataFrame, as_of: Column) -> DataFrame:
    """Newest quote time per event, minutes since then and the quoting books."""
    fresh = quotes.groupBy("event_id").agg(
        F.max("updated_at").alias("newest_at"),
        F.sort_array(F.collect_set("bookmaker_id")).alias("bookmaker_ids"),
    )
    minutes = (F.unix_micros(as_of) - F.unix_micros(F.col("newest_at"))) / F.lit(60_000_000.0)
    return fresh.withColumn("minutes_ago", F.greatest(F.lit(0.0), js_round(minutes)).cast("bigint"))


def board_summary(
    events: DataFrame, selections: DataFrame, books: DataFrame, best: DataFrame, holds: DataFrame, fair: DataFrame
) -> DataFrame:
    """One row of board totals: events, books by kind, markets, selections, arbitrages and mean edges."""
    shown = selections.join(events.select("event_id"), "event_id", "left_semi")
    per_selection = (
        shown.select("selection_id", "market_id")
        .join(best.select("selection_id", "edge_vs_average_pct"), "selection_id", "left")
        .join(fair.select("selection_id", "edge_pct"), "selection_id", "left")
    )
    totals = per_selection.agg(
        F.count(F.lit(1)).alias("selection_count"),
        F.coalesce(F.avg(F.coalesce("edge_vs_average_pct", F.lit(0.0))), F.lit(0.0)).alias("avg_edge_pct"),
        F.coalesce(F.avg("edge_pct"), F.lit(0.0)).alias("avg_true_edge_pct"),
    )
    # One aggregate per table, each a struct of its totals.
    marked = shown.select("market_id").distinct().join(holds.filter("is_arbitrage").select("market_id", "is_arbitrage"), "market_id", "left")
    of_events = events.agg(F.struct(F.count(F.lit(1)).alias("event_count"), F.count_distinct("sport_slug").alias("category_count")))
    of_books = books.agg(
        F.struct(
            F.count(F.lit(1)).alias("bookmaker_count"),
            count_if(F.col("kind") != "prediction").alias("sportsbook_count"),
            count_if(F.col("kind") == "prediction").alias("prediction_count"),
        )
    )
    of_markets = marked.agg(F.struct(F.count(F.lit(1)).alias("market_count"), F.count("is_arbitrage").alias("arbitrage_count")))
    whole = totals.select("*", of_events.scalar().alias("e"), of_books.scalar().alias("b"), of_markets.scalar().alias("m"))
    return whole.select(*totals.columns, "e.*", "b.*", "m.*")


def book_quotes(odds: DataFrame, best: DataFrame, selections: DataFrame, books: DataFrame, slug: str) -> DataFrame:
    """All prices of one book with the best-price flag and American text."""
    book = books.filter(F.col("slug") == slug).select("bookmaker_id")
    return (
        odds.join(book, "bookmaker_id", "left_semi")
        .join(best.select("selection_id", "best_bookmaker_id"), "selection_id")
        .join(selections.select("selection_id", "market_id", "event_id", "label"), "selection_id")
        .select(
            "event_id",
            "market_id",
            "selection_id",
            F.col("label").alias("outcome"),
            "price",
            american_text(F.col("price")).alias("american"),
            (F.col("bookmaker_id") == F.col("best_bookmaker_id")).alias("is_best"),
        )
    )


def book_index(books: DataFrame) -> DataFrame:
    """Normalised lookup keys (provider key, slug, name in that order) to book id; the first claim wins."""
    keys = F.array(F.col("provider_key"), F.col("slug"), F.col("name"))
    claims = books.select("bookmaker_id", F.posexplode(keys).alias("rank", "raw"))
    key = F.regexp_replace(F.lower("raw"), "[^a-z0-9]", "")
    return (
        claims.withColumn("key", key)
        .filter(F.col("raw").isNotNull() & (F.col("key") != ""))
        .groupBy("key")
        .agg(F.min_by("bookmaker_id", F.struct("bookmaker_id", "rank")).alias("bookmaker_id"))
    )


def pending_predictions(fair: DataFrame, selections: DataFrame, events: DataFrame, results: DataFrame) -> DataFrame:
    """Priced events without a completed result: how many and the earliest kickoff."""
    priced = selections.join(fair.select("selection_id"), "selection_id", "left_semi").select("event_id").distinct()
    waiting = (
        events.join(priced, "event_id", "left_semi")
        .join(results.filter("completed").select("event_id"), "event_id", "left_anti")
        .select("event_id", "commence_at")
    )
    return waiting.agg(
        F.count_distinct("event_id").alias("pending_predictions"), F.min("commence_at").alias("next_settlement_at")
    )


def price_history(change_log: DataFrame, points: int | None = None) -> DataFrame:
    """The prices of each selection, numbered from the newest; with ``points`` the last ones of each.

    The row-number filter lets Spark keep at most ``points`` rows per key before the shuffle, so a
    selection with a huge log stays small on both sides of it.
    """
    newest = W.partitionBy("selection_id").orderBy(F.desc("captured_at"), F.desc("id"))
    kept = change_log.withColumn("back", F.row_number().over(newest))
    kept = kept if points is None else kept.filter(F.col("back") <= points)
    return kept.select("selection_id", "id", "price", "captured_at", "back")


def history_arrays(history: DataFrame) -> DataFrame:
    """One array of prices per selection, oldest first."""
    ordered = F.sort_array(F.collect_list(F.struct(-F.col("back"), "price")))
    return history.groupBy("selection_id").agg(F.transform(ordered, lambda h: h["price"]).alias("prices"))
