"""Settlement: closing lines, grading, snapshot labels, calibration and training export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.common import count_if, hours_between, js_round, minus_hours
from marketlens.functions.prices import implied_prob
from marketlens.operators.fair import devig, solve_margins

CLOSING_MINUTES = 15
CLOSING_LOOKBACK_HOURS = 6
HORIZON_HOURS = 72
MIN_GAP_MINUTES = 30
BUCKETS = 10
LOG_EPSILON = 1e-15
EXACT = 1e-9


def closing_lines(
    events: DataFrame,
    selections: DataFrame,
    odds: DataFrame,
    as_of: Column,
    captured: DataFrame | None = None,
    lookback_hours: float = CLOSING_LOOKBACK_HOURS,
    ahead_minutes: float = CLOSING_MINUTES,
) -> DataFrame:
    """Closing quotes of events around kickoff that have none yet, with Shin probability.

    A book that quotes one side only keeps probability 0. ``captured`` holds the (selection, book) pairs
    already stored; the first capture wins.
    """
    due = events.filter(
        F.col("commence_at").between(minus_hours(as_of, lookback_hours), minus_hours(as_of, -ahead_minutes / 60.0))
        & F.col("status").isin("scheduled", "live")
    )
    if "closing_captured_at" in due.columns:
        due = due.filter(F.col("closing_captured_at").isNull())
    sides = selections.select("selection_id", "market_id", "event_id").join(
        due.select("event_id", "commence_at"), "event_id"
    )
    live = odds.filter(F.col("price") > 1)
    if "available" in live.columns:
        live = live.filter("available")
    quotes = live.select("selection_id", "bookmaker_id", "price").join(sides, "selection_id")
    pairs = quotes.select("selection_id", "bookmaker_id", "market_id", "price")
    probs = devig(pairs, solve_margins(pairs)).select("selection_id", "bookmaker_id", F.col("shin").alias("fair_prob"))
    rows = quotes.join(probs, ["selection_id", "bookmaker_id"], "left").select(
        "selection_id",
        "bookmaker_id",
        "price",
        implied_prob(F.col("price")).alias("implied_prob"),
        F.coalesce("fair_prob", F.lit(0.0)).alias("fair_prob"),
        js_round(hours_between(F.col("commence_at"), as_of) * 3600.0).cast("bigint").alias("seconds_before_start"),
    )
    if captured is not None:
        rows = rows.join(captured, ["selection_id", "bookmaker_id"], "left_anti")
    return rows


def grade(
    market_type: Column, side: Column, point: Column, home: Column, away: Column, winner: Column
) -> Column:
    """1 won, 0 lost, 2 push, NULL when the market cannot be graded."""
    h2h = F.when(winner == "draw", (side == "draw").cast("int")).otherwise((side == winner).cast("int"))
    margin = F.when(side == "home", home + point - away).otherwise(away + point - home)
    spread = F.when(F.abs(margin) < EXACT, 2).otherwise((margin > 0).cast("int"))
    total = home + away
    totals = (
        F.when(F.abs(total - point) < EXACT, 2)
        .when(side == "over", (total > point).cast("int"))
        .when(side == "under", (total < point).cast("int"))
    )
    return (
        F.when(market_type == "h2h", h2h)
        .when((market_type == "spreads") & point.isNotNull(), spread)
        .when((market_type == "totals") & point.isNotNull(), totals)
    )


def grade_selections(results: DataFrame, selections: DataFrame) -> DataFrame:
    """Outcome of every selection whose event has an ungraded result; an unfinished event voids to a push."""
    pending = results
    if "graded_at" in results.columns:
        pending = results.filter(F.col("graded_at").isNull())
    rows = selections.join(
        pending.select("event_id", "home_score", "away_score", "winner_side", "completed"), "event_id"
    )
    outcome = grade(
        F.col("market_type"), F.col("side"), F.col("point"), F.col("home_score"), F.col("away_score"),
        F.col("winner_side"),
    )
    graded = rows.select(
        "selection_id",
        "market_id",
        "event_id",
        F.when(~F.col("completed"), F.lit(2)).otherwise(outcome).cast("int").alias("outcome"),
    )
    return graded.filter(F.col("outcome").isNotNull())


def label_snapshots(snapshots: DataFrame, outcomes: DataFrame, closing: DataFrame) -> DataFrame:
    """Unlabelled snapshots of graded selections with label, mean closing probability and CLV."""
    close = closing.groupBy("selection_id").agg(
        F.max("price").alias("best_close"),
        F.avg("fair_prob").alias("fair_close"),
        F.avg(F.when(F.col("fair_prob") > 0, F.col("fair_prob"))).alias("fair_close_known"),
    )
    pending = snapshots.filter(F.col("label").isNull()) if "label" in snapshots.columns else snapshots
    rows = (
        pending.drop("label")
        .join(outcomes.select("selection_id", F.col("outcome").alias("label")), "selection_id")
        .join(close, "selection_id", "left")
    )
    clv = (F.col("best_price") / F.col("best_close") - 1.0) * 100.0
    return rows.select(
        *[c for c in pending.columns if c not in ("label", "closing_fair_prob", "clv_pct")],
        "label",
        F.coalesce("fair_close", F.lit(0.0)).alias("closing_fair_prob"),
        F.col("fair_close_known").alias("closing_fair_prob_known"),
        F.when((F.col("best_close") > 0) & (F.col("best_price") > 0), clv).otherwise(F.lit(0.0)).alias("clv_pct"),
    )


def snapshot_candidates(
    fair: DataFrame,
    selections: DataFrame,
    events: DataFrame,
    movement: DataFrame,
    snapshots: DataFrame,
    as_of: Column,
    horizon_hours: float = HORIZON_HOURS,
    gap_minutes: float = MIN_GAP_MINUTES,
) -> DataFrame:
    """Feature rows to freeze now: upcoming priced selections without a snapshot in the last half hour."""
    upcoming = events.filter(
        (F.col("status") == "scheduled") & F.col("commence_at").between(as_of, minus_hours(as_of, -horizon_hours))
    ).select("event_id", "commence_at", "sport_slug")
    recent = snapshots.filter(F.col("captured_at") > minus_hours(as_of, gap_minutes / 60.0)).select("selection_id")
    rows = (
        fair.filter(F.col("best_price") > 1)
        .drop("market_id")
        .join(selections.select("selection_id", "event_id", "market_type", "side"), "selection_id")
        .join(upcoming, "event_id")
        .join(recent, "selection_id", "left_anti")
        .join(movement, "selection_id", "left")
    )

    def known(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0.0)).alias(name)

    return rows.select(
        "selection_id",
        hours_between(F.col("commence_at"), as_of).alias("hours_to_start"),
        "best_price",
        F.col("prob_consensus").alias("fair_prob"),
        F.col("prob_sharp").alias("sharp_prob"),
        "edge_pct",
        "overround_pct",
        "book_count",
        known("price_std_dev"),
        known("open_price"),
        known("move_from_open_pct"),
        known("velocity_pct_per_hour"),
        known("steam_score"),
        F.coalesce("direction_changes", F.lit(0)).alias("direction_changes"),
        "sport_slug",
        "market_type",
        "side",
    )


def calibration_curves(snapshots: DataFrame) -> DataFrame:
    """Ten-bucket curves overall, per sport and per market type.

    Rows are summed once per (bucket, sport, market type); the three scopes are then rolled up from those
    few hundred sums instead of tripling the input.
    """
    p, y = F.col("fair_prob"), F.col("label")
    rows = snapshots.filter(y.isin(0, 1) & (p > 0) & (p <= 1))
    bucket = sum((F.when(p >= i / BUCKETS, 1).otherwise(0) for i in range(1, BUCKETS)), F.lit(0))
    q = F.least(F.lit(1 - LOG_EPSILON), F.greatest(F.lit(LOG_EPSILON), p))
    loss = -(y * F.log(q) + (F.lit(1) - y) * F.log(F.lit(1.0) - q))
    cells = rows.groupBy(
        bucket.alias("bucket"),
        F.coalesce("sport_slug", F.lit("")).alias("sport"),
        F.coalesce("market_type", F.lit("")).alias("market_type"),
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(p).alias("p"),
        F.sum(y.cast("double")).alias("y"),
        F.sum((p - y) * (p - y)).alias("brier"),
        F.sum(loss).alias("loss"),
        F.sum("clv_pct").alias("clv"),
    )
    scoped = cells.select(
        "*",
        F.explode(
            F.array(
                F.struct(F.lit("overall").alias("scope"), F.lit("").alias("scope_key")),
                F.struct(F.lit("sport").alias("scope"), F.col("sport").alias("scope_key")),
                F.struct(F.lit("market_type").alias("scope"), F.col("market_type").alias("scope_key")),
            )
        ).alias("s"),
    ).filter((F.col("s.scope") == "overall") | (F.col("s.scope_key") != ""))
    sums = scoped.groupBy("s.scope", "s.scope_key", "bucket").agg(
        *[F.sum(c).alias(c) for c in ("n", "p", "y", "brier", "loss", "clv")]
    )
    n = F.col("n")
    return sums.select(
        "scope",
        "scope_key",
        (F.col("bucket") / F.lit(float(BUCKETS))).alias("bucket_lower"),
        ((F.col("bucket") + 1) / F.lit(float(BUCKETS))).alias("bucket_upper"),
        (F.col("p") / n).alias("predicted_avg"),
        (F.col("y") / n).alias("observed_rate"),
        n.alias("sample_size"),
        (F.col("brier") / n).alias("brier_score"),
        (F.col("loss") / n).alias("log_loss"),
        (F.col("clv") / n).alias("avg_clv_pct"),
    )


def calibration_score(curves: DataFrame, scope: str = "overall", key: str | None = None) -> DataFrame:
    """Sample-weighted Brier score, log loss and CLV of one scope."""
    rows = curves.filter(F.col("scope") == scope)
    if key is not None:
        rows = rows.filter(F.col("scope_key") == key)
    n = F.col("sample_size")
    return rows.groupBy("scope", "scope_key").agg(
        F.sum(n).alias("sample_size"),
        *[(F.sum(F.col(c) * n) / F.sum(n)).alias(c) for c in ("brier_score", "log_loss", "avg_clv_pct")],
    )


def training_rows(
    snapshots: DataFrame,
    include_unlabelled: bool = False,
    sport: str | None = None,
    market_type: str | None = None,
    since: Column | None = None,
    limit: int | None = None,
    offset: int = 0,
) -> DataFrame:
    """Labelled feature rows; with ``limit`` one page ordered by capture time."""
    rows = snapshots if include_unlabelled else snapshots.filter(F.col("label").isin(0, 1))
    if sport:
        rows = rows.filter(F.col("sport_slug") == sport)
    if market_type:
        rows = rows.filter(F.col("market_type") == market_type)
    if since is not None:
        rows = rows.filter(F.col("captured_at") >= since)
    if limit is not None:
        rows = rows.orderBy("captured_at", "selection_id").offset(offset).limit(limit)
    return rows


def write_training_set(rows: DataFrame, path: str, test_from: str) -> None:
    """Writes the training set split by time (train before ``test_from``) and partitioned by sport."""
    cut = F.lit(test_from).cast("timestamp")
    split = F.when(F.col("captured_at") < cut, "train").otherwise("test")
    rows.withColumn("split", split).write.mode("overwrite").partitionBy("split", "sport_slug").parquet(path)


def grade_insights(insights: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Correctness and squared error of calls on graded selections; pass calls and pushes stay out.

    A lay states the probability of the opposite result.
    """
    rows = insights.filter(F.col("stance") != "pass").join(
        outcomes.filter(F.col("outcome").isin(0, 1)).select("selection_id", "outcome"), "selection_id"
    )
    back = F.col("stance") == "back"
    prob = F.when(back, F.col("stated_prob")).otherwise(F.lit(1.0) - F.col("stated_prob"))
    error = prob - F.col("outcome")
    return rows.select(
        *insights.columns,
        "outcome",
        (F.col("outcome") == back.cast("int")).alias("correct"),
        (error * error).alias("squared_error"),
    )


def signal_attribution(evidence: DataFrame, decisions: DataFrame, markets: DataFrame, min_samples: int = 30) -> DataFrame:
    """How each evidence kind did against the closing price of finished markets."""
    closed = markets.filter((F.col("status") != "open") & (F.col("last_price") > 0)).select("market_id", "last_price")
    taken = decisions.filter(F.col("market_price") > 0).select("decision_id", "market_id", "side", "market_price")
    moves = taken.join(closed, "market_id").select(
        "decision_id",
        (
            F.when(F.col("side") == "yes", F.col("last_price")).otherwise(F.lit(1.0) - F.col("last_price"))
            - F.col("market_price")
        ).alias("clv"),
    )
    rows = evidence.filter(F.col("contribution") != 0).select("decision_id", "kind", "contribution")
    sign = F.signum("contribution")
    return (
        rows.join(moves, "decision_id")
        .groupBy("kind")
        .agg(
            F.count(F.lit(1)).alias("samples"),
            (count_if(sign * F.col("clv") > 0) / F.count(F.lit(1))).alias("hit_rate"),
            (F.avg(F.when(F.col("contribution") > 0, F.col("clv")).otherwise(-F.col("clv"))) * 100.0).alias(
                "avg_clv_points"
            ),
            F.avg(F.abs("contribution")).alias("avg_contribution"),
        )
        .withColumn("meaningful", F.col("samples") >= min_samples)
    )
