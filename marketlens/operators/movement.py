"""Line movement: change log maintenance, recent moves and per-selection movement features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketlens.functions.common import count_if, minus_hours
from marketlens.functions.prices import american_number, implied_prob
from marketlens.operators.ordered import SEGMENT, lagged, segment_of

WINDOW_HOURS = 6
STEAM_CONSENSUS = 0.6
KEYS = ["selection_id", "bookmaker_id"]


def latest_batch(quotes: DataFrame, order: list[str]) -> DataFrame:
    """Last payable quote per (selection, book) of a batch."""
    payload = [c for c in quotes.columns if c not in KEYS]
    return (
        quotes.filter(F.col("price") > 1)
        .groupBy(*KEYS)
        .agg(F.max_by(F.struct(*payload), F.struct(*order)).alias("row"))
        .select(*KEYS, "row.*")
    )


def append_changes(quotes: DataFrame, prior: DataFrame, order: list[str]) -> DataFrame:
    """Current rows of a batch with ``changed`` and ``is_opening`` against the stored price and point.

    Rows with ``changed`` are the ones to append to the change log; all rows replace the current table.
    """
    before = prior.select(
        *KEYS, F.col("price").alias("prior_price"), F.col("point").alias("prior_point"), F.lit(True).alias("seen")
    )
    rows = latest_batch(quotes, order).join(before, KEYS, "left")
    same = F.col("price").eqNullSafe(F.col("prior_price")) & F.col("point").eqNullSafe(F.col("prior_point"))
    return rows.select(
        *[c for c in rows.columns if c not in ("prior_price", "prior_point", "seen")],
        american_number(F.col("price")).alias("american"),
        implied_prob(F.col("price")).alias("implied_prob"),
        (F.col("seen").isNull() | ~same).alias("changed"),
        F.col("seen").isNull().alias("is_opening"),
    )


def replay_changes(observations: DataFrame) -> DataFrame:
    """Change log of a full observation history: only the first observation and the moves."""
    day = segment_of(F.col("captured_at"))
    rows = lagged(observations.filter(F.col("price") > 1), KEYS, ["captured_at", "id"], ["price"], day)
    opening = F.col("prev_price").isNull()
    return (
        rows.filter(opening | (F.col("price") != F.col("prev_price")))
        .withColumn("is_opening", opening)
        .withColumn("implied_prob", implied_prob(F.col("price")))
    )


def replay_onto(quotes: DataFrame, prior: DataFrame) -> DataFrame:
    """The quotes of a batch that are newer than the stored one of their key, with ``changed`` and ``is_opening``.

    Every quote is compared with the one before it, the stored one first, so moves inside a batch are kept.
    """
    stored = prior.select(*KEYS, F.struct("captured_at", "id").alias("mark"), F.col("price").alias("p0"), F.col("point").alias("q0"))
    rows = quotes.filter(F.col("price") > 1).join(stored, KEYS, "left")
    rows = rows.filter(F.col("mark").isNull() | (F.struct("captured_at", "id") > F.col("mark")))
    order = W.partitionBy(*KEYS).orderBy("captured_at", "id", "price")
    before = F.lag(F.struct("price", "point")).over(order)
    stored_quote = F.when(F.col("mark").isNotNull(), F.struct(F.col("p0").alias("price"), F.col("q0").alias("point")))
    rows = rows.withColumn("before", F.coalesce(before, stored_quote))
    same = F.col("price").eqNullSafe(F.col("before.price")) & F.col("point").eqNullSafe(F.col("before.point"))
    return rows.select(
        *quotes.columns,
        american_number(F.col("price")).alias("american"),
        implied_prob(F.col("price")).alias("implied_prob"),
        (F.col("before").isNull() | ~same).alias("changed"),
        F.col("before").isNull().alias("is_opening"),
    )


def recent_moves(
    change_log: DataFrame, selections: DataFrame | None = None, books: DataFrame | None = None, limit: int | None = None
) -> DataFrame:
    """Latest two observations of each (selection, book) when they differ.

    Keeping two rows per key is a row-number filter, which Spark applies before the shuffle too; the pair
    is then folded with two aggregates.
    """
    newest = W.partitionBy(*KEYS).orderBy(F.desc("captured_at"), F.desc("id"))
    pair = change_log.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= 2)
    moves = (
        pair.groupBy(*KEYS)
        .agg(
            F.max(F.when(F.col("rn") == 2, F.col("price"))).alias("from_price"),
            F.max(F.when(F.col("rn") == 1, F.col("price"))).alias("to_price"),
            F.max(F.when(F.col("rn") == 1, F.col("captured_at"))).alias("at"),
        )
        .filter(F.col("from_price").isNotNull() & (F.col("to_price") != F.col("from_price")))
    )
    move_pct = (F.col("to_price") / F.col("from_price") - 1.0) * 100.0
    out = moves.select(
        "*",
        F.when(F.col("to_price") > F.col("from_price"), F.lit("up")).otherwise(F.lit("down")).alias("dir"),
        F.when(F.col("from_price") > 0, move_pct).otherwise(F.lit(0.0)).alias("move_pct"),
    )
    if limit is not None:
        out = out.orderBy(F.desc("at"), *KEYS).limit(limit)
    if selections is not None:
        out = out.join(selections.select("selection_id", "event_id", "market_type", "side", "label"), "selection_id")
    if books is not None:
        out = out.join(books.select("bookmaker_id", F.col("slug").alias("book_slug")), "bookmaker_id")
    return out


def direction_changes(change_log: DataFrame) -> DataFrame:
    """Sign reversals of each (selection, book) series, flat steps ignored.

    Reversals are counted inside day segments; one row per segment then adds the reversals that straddle
    a boundary.
    """
    order = ["captured_at", "id"]
    at = F.struct(*order)
    rows = change_log.withColumn(SEGMENT, segment_of(F.col("captured_at")))
    inside = W.partitionBy(*KEYS, SEGMENT).orderBy(*order)
    step = F.signum(F.col("price") - F.lag("price").over(inside))
    moved = rows.withColumn("move", F.when(step != 0, step))
    before = F.last("move", ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, -1))
    marked = moved.withColumn("flip", F.col("move") != before)
    nonzero = F.when(F.col("move").isNotNull(), at)
    segments = marked.groupBy(*KEYS, SEGMENT).agg(
        count_if(F.col("flip")).alias("flips"),
        F.min_by("price", at).alias("first_price"),
        F.max_by("price", at).alias("last_price"),
        F.min_by("move", nonzero).alias("first_move"),
        F.max_by("move", nonzero).alias("last_move"),
    )
    across = W.partitionBy(*KEYS).orderBy(SEGMENT)
    gap = F.signum(F.col("first_price") - F.lag("last_price").over(across))
    joined = segments.withColumn("gap", F.when(gap != 0, gap))
    leaving = F.last(F.coalesce("last_move", "gap"), ignorenulls=True).over(
        across.rowsBetween(W.unboundedPreceding, -1)
    )
    entering = F.coalesce("gap", "first_move")
    stitched = joined.select(
        *KEYS,
        (
            F.col("flips")
            + F.when(leaving != entering, 1).otherwise(0)
            + F.when(F.col("gap") != F.col("first_move"), 1).otherwise(0)
        ).alias("flips"),
    )
    return stitched.groupBy(*KEYS).agg(F.sum("flips").alias("direction_changes"))


def book_series(change_log: DataFrame, as_of: Column, window_hours: float = WINDOW_HOURS) -> DataFrame:
    """First, last and in-window first and last price of each (selection, book) series."""
    at = F.struct("captured_at", "id")
    recent = F.when(F.col("captured_at") >= minus_hours(as_of, window_hours), at)
    return change_log.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("observations"),
        F.min("captured_at").alias("first_at"),
        F.min_by("price", at).alias("open_price"),
        F.max_by("price", at).alias("current_price"),
        F.count(recent).alias("recent_count"),
        F.min(recent)["captured_at"].alias("recent_from"),
        F.max(recent)["captured_at"].alias("recent_to"),
        F.min_by("price", recent).alias("recent_open"),
        F.max_by("price", recent).alias("recent_close"),
    )


def movement_features(change_log: DataFrame, as_of: Column, window_hours: float = WINDOW_HOURS) -> DataFrame:
    """Movement features of every selection in one pass.

    The reference series is the book with most observations (then the earliest, then the lowest id).
    """
    series = book_series(change_log, as_of, window_hours).join(direction_changes(change_log), KEYS)
    delta = F.col("recent_close") - F.col("recent_open")
    moved = F.col("recent_count") >= 2
    rank = F.struct(
        F.col("observations"), -F.unix_micros(F.col("first_at")), -F.col("bookmaker_id")
    )
    main = F.struct(
        "bookmaker_id", "open_price", "current_price", "recent_count", "recent_from", "recent_to", "recent_open",
        "recent_close", "direction_changes",
    )
    per_selection = series.groupBy("selection_id").agg(
        F.max_by(main, rank).alias("main"),
        F.coalesce(F.stddev_samp("current_price"), F.lit(0.0)).alias("price_std_dev"),
        count_if(moved).alias("window_books"),
        count_if(moved & (delta > 0)).alias("moved_up"),
        count_if(moved & (delta < 0)).alias("moved_down"),
    )
    open_price, current = F.col("main.open_price"), F.col("main.current_price")
    span = (F.unix_micros(F.col("main.recent_to")) - F.unix_micros(F.col("main.recent_from"))) / F.lit(3.6e9)
    speed = (F.col("main.recent_close") / F.col("main.recent_open") - 1.0) * 100.0 / span
    share = F.greatest("moved_up", "moved_down") / F.col("window_books")
    steam = F.when(
        (F.col("window_books") > 0) & (share >= STEAM_CONSENSUS), (share - STEAM_CONSENSUS) / (1 - STEAM_CONSENSUS)
    )
    fast = (F.col("main.recent_count") >= 2) & (span > 0.01) & (F.col("main.recent_open") > 0)
    return per_selection.select(
        "selection_id",
        F.col("main.bookmaker_id").alias("reference_book"),
        open_price.alias("open_price"),
        current.alias("current_price"),
        F.when(open_price > 0, (current / open_price - 1.0) * 100.0).otherwise(F.lit(0.0)).alias("move_from_open_pct"),
        F.when(fast, speed).otherwise(F.lit(0.0)).alias("velocity_pct_per_hour"),
        F.coalesce(steam, F.lit(0.0)).alias("steam_score"),
        F.col("main.direction_changes").alias("direction_changes"),
        "price_std_dev",
    )
