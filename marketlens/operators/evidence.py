"""Evidence for trade candidates, from one pass over the recent tape.

``market_flow`` folds the tape to one wide row per market; every signal is then a column expression on
that row, so adding a signal never adds a scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketlens.functions.common import clamp, count_if, first_rows, js_round, minus_hours, number_text, pct_text
from marketlens.operators.ordered import lagged

WINDOW_HOURS = 24
TREND_HOURS = 4
PRIOR_WEIGHT = 6.0
MAX_SIGNAL = 0.08
MAX_TOTAL = 0.15
MIN_FILLS = 8
MIN_EDGE = 0.03


def market_universe(
    markets: DataFrame, venues: list[str] | None = None, categories: list[str] | None = None, limit: int | None = None
) -> DataFrame:
    """Open markets with a real price; with ``limit`` the most traded of them."""
    rows = markets.filter((F.col("status") == "open") & (F.col("last_price") > 0.02) & (F.col("last_price") < 0.98))
    if venues:
        rows = rows.filter(F.col("venue").isin(venues))
    if categories:
        rows = rows.filter(F.lower("category").isin([c.lower() for c in categories]))
    return first_rows(rows, limit, F.desc("volume"), "market_id")


def market_flow(scored: DataFrame, traders: DataFrame, universe: DataFrame, as_of: Column) -> DataFrame:
    """Per market: fills, notional, smart notional, records and price means, with the leading side.

    Fills are combined per (market, side, trader) before the trader join, so anonymous fills and busy
    markets reach the shuffle as a few rows.
    """
    at = F.col("traded_at")
    half = at >= minus_hours(as_of, WINDOW_HOURS / 2)
    trend = at >= minus_hours(as_of, TREND_HOURS)
    price = F.col("price")
    window = scored.filter((at >= minus_hours(as_of, WINDOW_HOURS)) & (at <= as_of))
    sums = {
        "fills": F.count(F.lit(1)),
        "notional": F.sum("notional"),
        "resolved": F.count("is_winner"),
        "wins": count_if(F.col("is_winner") == 1),
        "price_sum": F.sum("price"),
        "trend_sum": F.sum(F.when(trend, price)),
        "trend_fills": count_if(trend),
        "late_sum": F.sum(F.when(half, price)),
        "late_fills": count_if(half),
    }
    per_trader = (
        window.join(universe.select("market_id"), "market_id", "left_semi")
        .groupBy("market_id", "side", "trader_id")
        .agg(*[c.alias(n) for n, c in sums.items()])
    )
    score = F.coalesce(F.col("smart_score"), F.lit(0.0)) / F.lit(100.0)
    per_side = (
        per_trader.join(traders.select("trader_id", "smart_score"), "trader_id", "left")
        .groupBy("market_id", "side")
        .agg(
            F.sum(F.col("notional") * score).alias("smart_notional"),
            *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in sums],
        )
    )
    leader = F.struct("side", *sums, "smart_notional")
    flow = per_side.groupBy("market_id").agg(
        F.min_by(leader, F.struct((-F.col("notional")).alias("n"), F.col("side"))).alias("lead"),
        F.sum("fills").alias("total_fills"),
        F.sum("notional").alias("total_notional"),
        F.sum("smart_notional").alias("smart_total"),
        F.sum("price_sum").alias("all_price_sum"),
        F.sum("late_sum").alias("all_late_sum"),
        F.sum("late_fills").alias("all_late_fills"),
    )
    lead = F.col("lead.side")
    kept = flow.filter((F.col("total_fills") >= MIN_FILLS) & (F.col("total_notional") > 0))
    early_fills = F.col("total_fills") - F.col("all_late_fills")
    return kept.join(
        universe.select("market_id", "venue", "question", "category", "last_price", "liquidity"), "market_id"
    ).select(
        "market_id", "venue", "question", "category", "liquidity", "last_price",
        lead.alias("side"),
        F.when(lead == "yes", F.col("last_price")).otherwise(F.lit(1.0) - F.col("last_price")).alias("market_price"),
        "total_fills", "total_notional", "smart_total",
        F.col("lead.fills").alias("side_fills"),
        F.col("lead.notional").alias("side_notional"),
        F.col("lead.smart_notional").alias("side_smart"),
        F.col("lead.resolved").alias("side_resolved"),
        F.col("lead.wins").alias("side_wins"),
        (F.col("lead.price_sum") / F.col("lead.fills")).alias("side_price_mean"),
        _mean(F.col("lead.trend_sum"), F.col("lead.trend_fills")).alias("side_price_recent"),
        _mean(F.col("all_price_sum") - F.col("all_late_sum"), early_fills).alias("early_price"),
        _mean(F.col("all_late_sum"), F.col("all_late_fills")).alias("late_price"),
        F.col("all_late_fills").alias("late_fills"),
    )


def _mean(total: Column, n: Column) -> Column:
    return F.when(n > 0, total / n).otherwise(F.lit(0.0))


def _signal(value: Column) -> Column:
    return js_round(clamp(value, -MAX_SIGNAL, MAX_SIGNAL), 4)


def _item(
    kind: str, value: Column, contribution: Column, sample: Column, window: int, summary: Column, places: int = 4
) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        js_round(value, places).alias("value"),
        contribution.alias("contribution"),
        sample.cast("bigint").alias("sample_size"),
        F.lit(window).cast("bigint").alias("window_hours"),
        summary.alias("summary"),
    )


def _toward_leader(x: Column) -> Column:
    return F.when(F.col("side") == "yes", x).otherwise(-x)


def flow_imbalance() -> Column:
    share = F.col("side_notional") / F.col("total_notional")
    text = F.concat(
        pct_text(share), F.lit(" of $"), number_text(js_round(F.col("total_notional"), 2)),
        F.lit(" traded in 24h bought "), F.col("side"),
    )
    return _item(
        "flow_imbalance", share, _signal((share - F.col("market_price")) * 0.10), F.col("total_fills"), 24, text
    )


def smart_money() -> Column:
    share = F.col("side_smart") / F.col("smart_total")
    text = F.concat(F.lit("accuracy-weighted flow puts "), pct_text(share), F.lit(" behind "), F.col("side"))
    item = _item("smart_money", share, _signal((share - F.col("market_price")) * 0.18), F.col("total_fills"), 24, text)
    return F.when(F.col("smart_total") > 0, item)


def trader_accuracy() -> Column:
    shrunk = (F.col("side_wins") + PRIOR_WEIGHT * 0.5) / (F.col("side_resolved") + PRIOR_WEIGHT)
    text = F.concat(
        F.lit("buyers of "), F.col("side"), F.lit(" are "), F.col("side_wins").cast("string"), F.lit("/"),
        F.col("side_resolved").cast("string"), F.lit(" on settled markets ("), pct_text(shrunk), F.lit(" shrunk)"),
    )
    item = _item("trader_accuracy", shrunk, _signal((shrunk - 0.5) * 0.20), F.col("side_resolved"), 24, text)
    return F.when(F.col("side_resolved") > 0, item)


def price_trend() -> Column:
    drift = F.col("side_price_recent") - F.col("side_price_mean")
    text = F.concat(
        F.col("side"), F.lit(" traded at "), pct_text(F.col("side_price_recent")), F.lit(" in the last 4h vs "),
        pct_text(F.col("side_price_mean")), F.lit(" over 24h"),
    )
    item = _item("price_trend", drift, _signal(drift * 0.25), F.col("side_fills"), 24, text)
    return F.when((F.col("side_price_recent") > 0) & (F.col("side_price_mean") > 0), item)


def liquidity() -> Column:
    value = F.col("liquidity")
    text = F.concat(F.lit("$"), number_text(js_round(value, 2)), F.lit(" resting liquidity"))
    return _item("liquidity", value, F.lit(0.0), F.lit(1), 24, text, places=2)


def cross_venue() -> Column:
    """Needs ``other_price`` and ``other_venue`` of the counterpart market (NULL when there is none)."""
    other = F.when(F.col("side") == "yes", F.col("other_price")).otherwise(F.lit(1.0) - F.col("other_price"))
    gap = other - F.col("market_price")
    text = F.concat(
        F.col("other_venue"), F.lit(" prices "), F.col("side"), F.lit(" at "), pct_text(other), F.lit(" vs "),
        pct_text(F.col("market_price")), F.lit(" here"),
    )
    return F.when(F.col("other_price").isNotNull(), _item("cross_venue", gap, _signal(gap * 0.35), F.lit(1), 24, text))


def reverse_line() -> Column:
    move = _toward_leader(F.col("late_price") - F.col("early_price"))
    share = F.col("side_notional") / F.col("total_notional")
    text = F.concat(
        pct_text(share), F.lit(" of flow bought "), F.col("side"), F.lit(" while its price fell "), pct_text(F.abs(move))
    )
    traded = (F.col("early_price") > 0) & (F.col("late_price") > 0) & (F.col("late_fills") >= MIN_FILLS / 2)
    fired = traded & (share - 0.5 > 0.1) & (move < -0.005)
    return F.when(fired, _item("reverse_line_move", move, _signal(move * 0.5), F.col("late_fills"), 24, text))


def ladder_signal() -> Column:
    """Needs ``ladder_gap`` with ``ladder_price``, ``versus_price`` and ``versus_strike`` of this market's rung."""
    gap = F.col("ladder_gap")
    text = F.concat(
        F.lit("priced "), pct_text(F.col("ladder_price")), F.lit(" against "), pct_text(F.col("versus_price")),
        F.lit(" for the easier "), number_text(F.col("versus_strike").cast("double"), 6),
    )
    return F.when(gap.isNotNull(), _item("ladder_incoherence", gap, _signal(-_toward_leader(gap)), F.lit(2), 0, text))


def _toward_outcome(edge: Column) -> Column:
    return _toward_leader(F.when(F.col("outcome") == "home", edge).otherwise(-edge))


def schedule_signal() -> Column:
    """Needs ``outcome`` and ``schedule_edge``, ``schedule_confidence``, ``schedule_reasons``."""
    edge, confidence = F.col("schedule_edge"), F.col("schedule_confidence")
    fired = (confidence > 0) & (F.abs(edge) > 0.01) & F.col("outcome").isin("home", "away")
    item = _item(
        "schedule_rest", edge, _signal(_toward_outcome(edge) * confidence * 0.04), F.size("schedule_reasons"), 0,
        F.array_join("schedule_reasons", "; "),
    )
    return F.when(fired, item)


def steam_signal(team: Column | None = None) -> Column:
    """Needs ``steam_score`` and ``move_from_open_pct`` of the outcome's own selection; ``team`` names the outcome."""
    team = F.col("outcome") if team is None else team
    score, move = F.col("steam_score"), F.col("move_from_open_pct")
    toward = _toward_leader(F.when(move < 0, F.lit(1.0)).otherwise(F.lit(-1.0)))
    text = F.concat(
        F.lit("books moved together "), F.when(move > 0, "against").otherwise("toward"), F.lit(" "), team,
        F.lit(" ("), pct_text(score), F.lit(" consensus)"),
    )
    fired = (score > 0) & (F.abs(move) > 0.1) & F.col("outcome").isin("home", "away")
    return F.when(fired, _item("steam", score, _signal(toward * score * 0.05), F.lit(1), 0, text))


def mismatch_signal() -> Column:
    """Needs ``outcome`` and ``mismatch_edge``, ``mismatch_confidence``, ``mismatch_reasons``."""
    edge, confidence = F.col("mismatch_edge"), F.col("mismatch_confidence")
    fired = (confidence > 0) & (F.abs(edge) > 0.01) & F.col("outcome").isin("home", "away")
    item = _item(
        "squad_mismatch", edge, _signal(_toward_outcome(edge) * confidence * 0.06), F.size("mismatch_reasons"), 0,
        F.coalesce(F.nullif(F.array_join("mismatch_reasons", "; "), F.lit("")), F.lit("Fundamentals favour one side")),
    )
    return F.when(fired, item)


TAPE_SIGNALS = {
    "flow_imbalance": flow_imbalance,
    "smart_money": smart_money,
    "trader_accuracy": trader_accuracy,
    "price_trend": price_trend,
    "liquidity": liquidity,
    "reverse_line_move": reverse_line,
}
CONTEXT_SIGNALS = {
    "other_price": cross_venue,
    "ladder_gap": ladder_signal,
    "schedule_edge": schedule_signal,
    "steam_score": steam_signal,
    "mismatch_edge": mismatch_signal,
}


def signal_rows(flow: DataFrame, item: Column) -> DataFrame:
    """Evidence rows of one signal: (market_id, kind, value, contribution, sample_size, window_hours, summary)."""
    return flow.select("market_id", item.alias("item")).filter(F.col("item").isNotNull()).select("market_id", "item.*")


def with_cross_venue(flow: DataFrame, pairs: DataFrame) -> DataFrame:
    return flow.join(pairs.select("market_id", "other_price", "other_venue"), "market_id", "left")


def with_ladder(flow: DataFrame, violations: DataFrame) -> DataFrame:
    """Adds the widest violation in which this market is the rung priced too high."""
    worst = violations.groupBy("market_id").agg(
        F.max(F.struct("gap", "versus_strike", "price", "versus_price")).alias("v")
    )
    return flow.join(
        worst.select(
            "market_id",
            F.col("v.gap").alias("ladder_gap"),
            F.col("v.price").alias("ladder_price"),
            F.col("v.versus_price").alias("versus_price"),
            F.col("v.versus_strike").alias("versus_strike"),
        ),
        "market_id",
        "left",
    )


def with_evidence(flow: DataFrame) -> DataFrame:
    """Adds the ``evidence`` array; a context signal takes part when its columns have been joined."""
    items = [make() for make in TAPE_SIGNALS.values()]
    items += [make() for column, make in CONTEXT_SIGNALS.items() if column in flow.columns]
    return flow.withColumn("evidence", F.array_compact(F.array(*items)))


def score_candidates(flow: DataFrame) -> DataFrame:
    """Fair value, edge and confidence per market from its evidence."""
    rows = with_evidence(flow)
    total = F.aggregate("evidence", F.lit(0.0), lambda acc, e: acc + e["contribution"])
    directional = F.filter("evidence", lambda e: e["contribution"] != 0)
    rows = rows.select(
        "*",
        clamp(total, -MAX_TOTAL, MAX_TOTAL).alias("total_contribution"),
        F.size(directional).alias("directional"),
        F.size(F.filter("evidence", lambda e: e["contribution"] > 0)).alias("positive"),
    )
    price = F.col("market_price")
    fair = clamp(price + F.col("total_contribution"), 0.01, 0.99)
    n = F.col("directional")
    agreement = F.greatest(F.col("positive"), n - F.col("positive")) / n
    depth = F.col("total_fills") / (F.col("total_fills") + 90.0)
    breadth = F.least(F.lit(1.0), n / 3.0)
    confidence = js_round(clamp(agreement * 0.5 + depth * 0.3 + breadth * 0.2, 0.0, 1.0), 3)
    return rows.select(
        "market_id",
        "venue",
        "question",
        "category",
        "side",
        js_round(price, 4).alias("market_price"),
        js_round(fair, 4).alias("fair_value"),
        js_round(fair - price, 4).alias("edge"),
        F.when(n > 0, confidence).otherwise(F.lit(0.0)).alias("confidence"),
        "liquidity",
        "evidence",
    )


def build_candidates(flow: DataFrame, min_edge: float = MIN_EDGE, limit: int | None = None) -> DataFrame:
    """Candidates of at least ``min_edge``; with ``limit`` the strongest by edge times confidence."""
    rows = score_candidates(flow).filter(F.abs("edge") >= min_edge)
    return first_rows(rows, limit, F.desc(F.col("edge") * F.col("confidence")), "market_id")


def strategy_profiles(strategies: DataFrame) -> DataFrame:
    """Distinct (venue, categories, min_edge) filters; strategies repeat a handful of them."""
    key = F.xxhash64("venue", F.sort_array(F.coalesce("categories", F.array())), "min_edge")
    return (
        strategies.withColumn("profile", key)
        .groupBy("profile")
        .agg(
            F.first("venue").alias("venue_key"),
            F.first(F.transform(F.coalesce("categories", F.array()), F.lower)).alias("wanted"),
            F.first("min_edge").alias("min_edge"),
        )
        .withColumn("venue_key", F.when(F.col("venue_key") == "both", "*").otherwise(F.col("venue_key")))
    )


def profile_universe(markets: DataFrame, profiles: DataFrame, limit: int | None = None) -> DataFrame:
    """The open markets of each filter, as (profile, min_edge, market) rows; with ``limit`` the most traded of each.

    A filter meets the markets of its venue and category: filters are spread over the categories they name ('*' for
    none) and the two venues a market can have ('*' for both), so that every row of the join is a match.
    """
    live = markets.filter((F.col("status") == "open") & (F.col("last_price") > 0.02) & (F.col("last_price") < 0.98))
    keyed = live.select("market_id", "volume", "venue", F.lower("category").alias("c"))
    keyed = keyed.withColumn("venue_key", F.explode(F.array("venue", F.lit("*")))).withColumn(
        "category_key", F.explode(F.array(F.coalesce("c", F.lit("")), F.lit("*")))
    )
    wanted = F.when(F.size("wanted") == 0, F.array(F.lit("*"))).otherwise(F.array_distinct("wanted"))
    asked = profiles.select("profile", "min_edge", "venue_key", F.explode(wanted).alias("category_key"))
    matched = keyed.join(asked, ["venue_key", "category_key"]).select("profile", "min_edge", "market_id", "volume")
    if limit is None:
        return matched.drop("volume")
    order = W.partitionBy("profile").orderBy(F.desc("volume"), "market_id")
    return matched.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= limit).drop("rn", "volume")


def candidates_for_strategies(
    scored: DataFrame, universe: DataFrame, strategies: DataFrame, limit: int | None = None
) -> DataFrame:
    """Candidates of every strategy under its own filters, ranked; with ``limit`` at most so many each.

    ``scored`` is ``score_candidates`` over the markets of ``universe`` (``profile_universe``). Lists are
    ranked once per distinct filter before they meet the strategies.
    """
    ranked = W.partitionBy("profile").orderBy(F.desc(F.col("edge") * F.col("confidence")), "market_id")
    lists = universe.join(scored, "market_id").filter(F.abs("edge") >= F.col("min_edge")).withColumn("rank", F.row_number().over(ranked))
    if limit is not None:
        lists = lists.filter(F.col("rank") <= limit)
    key = F.xxhash64("venue", F.sort_array(F.coalesce("categories", F.array())), "min_edge")
    return strategies.withColumn("profile", key).drop("venue", "categories").join(lists.drop("min_edge"), "profile").drop("profile")


RUNG_SPAN = 100_000


def ladder_incoherence(rungs: DataFrame, ladder: list[str], min_gap: float = 0.01) -> DataFrame:
    """Adjacent rungs of a ladder where the harder strike is priced above the easier one.

    Rungs are ordered by strike, then market id. The scan is cut at every strike (and at fixed id spans
    inside one), so a long ladder spreads over many tasks.
    """
    priced = rungs.filter((F.col("price") > 0) & (F.col("price") < 1) & F.col("strike").isNotNull())
    segment = F.struct(F.col("strike").alias("s"), F.floor(F.col("market_id") / RUNG_SPAN).alias("b"))
    pairs = lagged(
        priced.select(*ladder, "market_id", "strike", "price"),
        ladder,
        ["strike", "market_id"],
        ["market_id", "strike", "price"],
        segment,
    )
    gap = F.col("price") - F.col("prev_price")
    return pairs.withColumn("gap", gap).filter(F.col("gap") >= min_gap).select(
        *ladder,
        "market_id",
        "strike",
        "price",
        F.col("prev_market_id").alias("versus_market_id"),
        F.col("prev_strike").alias("versus_strike"),
        F.col("prev_price").alias("versus_price"),
        "gap",
    )
