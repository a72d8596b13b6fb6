"""From candidates to orders: judgement, sizing, admission, paper fills, halts and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.common import count_if, hours_between, js_round
from marketlens.operators import ordered
from marketlens.operators.positions import WORKING
from marketlens.session import cut

KELLY_FRACTION = 0.25
SLIPPAGE = 0.01
MAX_QUOTE_AGE_MINUTES = 10
MAX_QUOTE_DRIFT = 0.03
RESTING_MINUTES = 45
MONEY = "decimal(28,8)"
SETTLED_DECISIONS = ["executed", "failed", "expired"]


def rules_judgement(candidates: DataFrame) -> DataFrame:
    """Accepts positive edges; the rationale quotes the three strongest signals."""
    active = F.filter("evidence", lambda e: e["contribution"] != 0)
    ranked = F.array_sort(
        F.transform(
            active,
            lambda e, i: F.struct(
                (-F.abs(e["contribution"])).alias("k"), i.alias("i"), e["summary"].alias("summary")
            ),
        )
    )
    top = F.transform(F.slice(ranked, 1, 3), lambda e: e["summary"])
    head = F.format_string("Fair value %.1f%% vs %.1f%% quoted", F.col("fair_value") * 100, F.col("market_price") * 100)
    text = F.when(F.size(top) > 0, F.concat(head, F.lit(", from: "), F.array_join(top, "; "), F.lit("."))).otherwise(
        F.concat(head, F.lit("."))
    )
    return candidates.select(
        "*", (F.col("edge") > 0).alias("accept"), text.alias("rationale"), F.lit("rules").alias("decided_by")
    )


def stake(price: Column, fair: Column, confidence: Column, bankroll: Column, max_stake: Column) -> Column:
    """Quarter Kelly scaled by confidence, capped by the stake limit and the bankroll, in whole cents."""
    kelly = (fair - price) / (F.lit(1.0) - price)
    raw = F.least(bankroll * kelly * F.lit(KELLY_FRACTION) * confidence, max_stake, bankroll)
    usable = (price > 0) & (price < 1) & (kelly > 0) & (raw > 0)
    return F.when(usable, F.floor(raw * 100.0) / 100.0).otherwise(F.lit(0.0))


def size_stakes(candidates: DataFrame) -> DataFrame:
    """Stake, limit price, contracts and notional of candidates joined to their strategy."""
    price, fair, confidence = F.col("market_price"), F.col("fair_value"), F.col("confidence")
    accepted = F.col("accept") & (confidence >= F.col("min_confidence"))
    money = stake(price, fair, confidence, F.col("bankroll"), F.col("max_stake"))
    limit = F.least(fair, price + SLIPPAGE)
    rows = candidates.select(
        "*", F.when(accepted, money).otherwise(F.lit(0.0)).alias("stake"), limit.alias("limit_price")
    )
    size = F.when(F.col("limit_price") > 0, F.floor(F.col("stake") / F.col("limit_price"))).otherwise(F.lit(0))
    rows = rows.withColumn("size", size.cast("bigint"))
    return rows.withColumn("notional", js_round(F.col("size") * F.col("limit_price"), 2))


def decision_status(sized: DataFrame) -> DataFrame:
    """rejected, skipped or approved with the reason."""
    low = F.col("confidence") < F.col("min_confidence")
    status = (
        F.when(~F.col("accept"), "rejected").when(low | (F.col("size") < 1), "skipped").otherwise("approved")
    )
    reason = (
        F.when(~F.col("accept"), F.lit("declined on review"))
        .when(low, F.format_string("confidence %.2f below the %.2f floor", "confidence", "min_confidence"))
        .when(F.col("size") < 1, F.lit("sized below one contract"))
        .otherwise(F.lit(""))
    )
    return sized.select("*", status.alias("status"), reason.alias("status_reason"))


def risk_admission(decisions: DataFrame, strategies: DataFrame, exposure: DataFrame) -> DataFrame:
    """Admits decisions in priority order while the position cap and the bankroll allow.

    Skipped decisions use no budget. Each round sums, over the earlier decisions of the strategy, the costs of those
    admitted so far and of all that are still in line: what fits even if the whole line before it is admitted is admitted,
    what doesn't fit beside those already admitted is out. The first one in line is always decided, so there are at most as
    many rounds as free slots, and few as a rule. The queue is dealt by ranges of its order, so that one strategy's
    decisions spread over tasks. Money is compared as decimals. Gives every decision with ``admitted``.
    """
    budget = strategies.select("strategy_id", "max_open_positions", "bankroll").join(
        exposure.select("strategy_id", "open_positions", "committed"), "strategy_id"
    )
    limits = budget.select(
        "strategy_id",
        (F.col("max_open_positions") - F.col("open_positions")).alias("slots"),
        (F.col("bankroll") - F.col("committed")).cast(MONEY).alias("budget"),
    )
    queue = decisions.select("strategy_id", "decision_id", "confidence", "edge", F.col("notional").cast(MONEY).alias("cost"))
    queue = queue.join(limits, "strategy_id").filter("cost <= budget AND slots > 0")
    order = [F.desc("confidence"), F.desc("edge"), F.col("decision_id")]
    line = ordered.dealt(queue, ["strategy_id"], order).withColumn("admitted", F.lit(False))
    sure = F.col("admitted")
    sums = {
        "sure_cost": F.when(sure, F.col("cost")).otherwise(0),
        "sure_rows": F.when(sure, 1).otherwise(0),
        "line_cost": F.col("cost"),
        "line_rows": F.lit(1),
    }
    while True:
        seen = ordered.running(line, ["strategy_id"], order, sums)
        fits = (F.col("line_cost") + F.col("cost") <= F.col("budget")) & (F.col("line_rows") < F.col("slots"))
        out = (F.col("sure_cost") + F.col("cost") > F.col("budget")) | (F.col("sure_rows") >= F.col("slots"))
        line = cut(seen.withColumn("admitted", sure | fits).filter(sure | ~out).drop(*sums))
        if line.filter(~sure).isEmpty():
            break
    rows = decisions.join(line.select("decision_id", "admitted"), "decision_id", "left")
    return rows.withColumn("admitted", F.coalesce("admitted", F.lit(False)))


def paper_fills(decisions: DataFrame, markets: DataFrame) -> DataFrame:
    """Simulated fill of each decision: cancelled above the limit, else filled one cent above last."""
    last = F.col("last_price")
    rows = decisions.join(markets.select("market_id", "last_price"), "market_id", "left")
    filled = last.isNotNull() & (last <= F.col("limit_price"))
    price = F.least(F.col("limit_price"), last + SLIPPAGE)
    note = (
        F.when(last.isNull(), "market no longer in our database")
        .when(~filled, "the market never traded down to the limit")
        .otherwise("")
    )
    own = F.when(F.col("side") == "yes", last).otherwise(F.lit(1.0) - last)
    return rows.select(
        "decision_id",
        "market_id",
        "side",
        F.when(filled, "filled").otherwise("cancelled").alias("status"),
        F.when(filled, F.col("size")).otherwise(F.lit(0.0)).alias("filled_size"),
        F.when(filled, price).otherwise(F.lit(0.0)).alias("fill_price"),
        note.alias("note"),
        F.coalesce(own <= F.col("limit_price"), F.lit(False)).alias("fills_on_own_side"),
    )


def quote_objection(decisions: DataFrame, markets: DataFrame, as_of: Column) -> DataFrame:
    """Why a quote cannot be used any more ('' when it can)."""
    quotes = markets.select("market_id", F.col("status").alias("market_status"), "last_price", "updated_at")
    rows = decisions.join(quotes, "market_id")
    last, limit = F.col("last_price"), F.col("limit_price")
    drift = last - F.col("market_price")
    stale = F.col("updated_at").isNull() | (hours_between(as_of, F.col("updated_at")) * 60.0 > MAX_QUOTE_AGE_MINUTES)
    reason = (
        F.when(~F.col("market_status").isin("open", "active"), F.concat(F.lit("market is "), "market_status"))
        .when(stale, F.lit("no price for this market in the last 10 minutes"))
        .when(
            F.abs(drift) > MAX_QUOTE_DRIFT,
            F.format_string(
                "market moved %s %.1f points since this was decided",
                F.when(drift > 0, "up").otherwise("down"),
                F.abs(drift) * 100.0,
            ),
        )
        .when(
            last >= limit,
            F.format_string("market is quoted at %.1f against our %.1f limit", last * 100.0, limit * 100.0),
        )
        .otherwise(F.lit(""))
    )
    return rows.select("decision_id", "market_id", reason.alias("objection"))


def halt_state(halts: DataFrame) -> DataFrame:
    """The newest halt entry decides; no entry means trading is allowed."""
    newest = halts.agg(F.max_by(F.struct("active", "reason", "actor", "created_at"), "id").alias("h"))
    halted = F.coalesce(F.col("h.active"), F.lit(False))
    return newest.select(
        halted.alias("halted"),
        F.when(halted, F.coalesce(F.nullif("h.reason", F.lit("")), F.lit("trading is halted"))).otherwise("").alias("reason"),
        F.when(halted, F.coalesce(F.nullif("h.actor", F.lit("")), F.lit("operator"))).otherwise("").alias("actor"),
        F.when(halted, F.col("h.created_at")).alias("since"),
    )


def strategy_halts(strategies: DataFrame, realised: DataFrame) -> DataFrame:
    """Why a strategy may not trade: halted, not active, or beyond its daily loss limit ('' when it may)."""
    rows = strategies.select("strategy_id", "status").join(
        realised.select("strategy_id", "realized", "breached"), "strategy_id", "left"
    )
    reason = (
        F.when(F.col("status") == "halted", F.lit("strategy is halted"))
        .when(F.col("status") != "active", F.concat(F.lit("strategy is "), "status"))
        .when(F.col("breached"), F.lit("daily loss limit reached"))
        .otherwise(F.lit(""))
    )
    return rows.select("strategy_id", "status", reason.alias("halt_reason"))


def order_reconcile(orders: DataFrame, reports: DataFrame, as_of: Column, accounts: DataFrame | None = None) -> DataFrame:
    """Working orders against the latest venue report: new status, expiry after 45 minutes, changed flag.

    Only a report of status 'not_found' says that the venue does not know an order. Orders without a report are left
    alone, since the venue may be out of reach, and so are those of strategies that ``accounts`` (strategy_id, active)
    does not list as active.
    """
    latest = reports.groupBy("order_id").agg(
        F.max_by(F.struct("status", "filled_size", "avg_fill_price"), "report_seq").alias("r")
    )
    rows = orders.filter(F.col("status").isin(WORKING))
    if accounts is not None:
        rows = rows.join(accounts.filter("active").select("strategy_id"), "strategy_id", "left_semi")
    rows = rows.join(latest, "order_id")
    unknown = F.col("r.status") == "not_found"
    resting = F.col("r.status").isin("open", "partial")
    expired = resting & (hours_between(as_of, F.col("placed_at")) * 60.0 >= RESTING_MINUTES)
    filled = F.when(unknown, 0.0).otherwise(F.coalesce(F.col("r.filled_size"), F.lit(0.0)))
    status = (
        F.when(unknown, "cancelled")
        .when(expired, F.when(filled > 0, "partial").otherwise("cancelled"))
        .otherwise(F.col("r.status"))
    )
    out = rows.select(
        "order_id",
        "decision_id",
        F.col("status").alias("old_status"),
        status.alias("new_status"),
        filled.alias("new_filled_size"),
        F.when(unknown, 0.0).otherwise(F.coalesce(F.col("r.avg_fill_price"), F.lit(0.0))).alias("avg_fill_price"),
        F.coalesce(expired, F.lit(False)).alias("expired"),
        F.when(unknown, "the venue has no record of this order").otherwise("").alias("note"),
        F.col("filled_size").alias("old_filled_size"),
    )
    changed = (F.col("new_status") != F.col("old_status")) | (F.col("new_filled_size") != F.col("old_filled_size"))
    return out.select(
        *[c for c in out.columns if c != "old_filled_size"],
        changed.alias("changed"),
        ((F.col("new_status") == "cancelled") & (F.col("new_filled_size") == 0)).alias("decision_expired"),
    )


def working_state(decisions: DataFrame, orders: DataFrame) -> DataFrame:
    """Latest decision per (strategy, market) and what a new candidate does to it: keep, update or new."""
    latest = decisions.groupBy("strategy_id", "market_id").agg(
        F.max_by(F.struct("decision_id", "status"), "decision_id").alias("d")
    )
    working = (
        orders.filter(F.col("status").isin(WORKING))
        .groupBy("decision_id")
        .agg(F.count(F.lit(1)).alias("working_orders"))
    )
    rows = latest.select("strategy_id", "market_id", "d.decision_id", "d.status").join(working, "decision_id", "left")
    n = F.coalesce("working_orders", F.lit(0))
    action = F.when(n > 0, "keep").when(F.col("status").isin(SETTLED_DECISIONS), "new").otherwise("update")
    return rows.select("strategy_id", "market_id", "decision_id", "status", n.alias("working_orders"), action.alias("action"))


def decisions_with_evidence(
    decisions: DataFrame, evidence: DataFrame, strategies: DataFrame, markets: DataFrame, limit: int | None = None
) -> DataFrame:
    """Decisions with strategy, market and evidence sorted by absolute contribution.

    A decision has one evidence row per kind, so the nested array is short; the page is cut first.
    """
    page = decisions
    if limit is not None:
        page = decisions.orderBy(F.desc("created_at"), F.desc("decision_id")).limit(limit)
        evidence = evidence.join(page.select("decision_id"), "decision_id", "left_semi")
    per_kind = evidence.groupBy("decision_id", "kind").agg(
        F.max_by(F.struct("contribution", "value"), F.struct(F.abs("contribution"), "contribution", "value")).alias("e")
    )
    nested = per_kind.groupBy("decision_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    (-F.abs("e.contribution")).alias("rank"), "kind", F.col("e.contribution").alias("contribution"),
                    F.col("e.value").alias("value"),
                )
            )
        ).alias("evidence")
    )
    return (
        page.join(strategies.select("strategy_id", "user_id"), "strategy_id")
        .join(markets.select("market_id", "question", "last_price"), "market_id")
        .join(nested, "decision_id", "left")
    )


def run_summary(decisions: DataFrame) -> DataFrame:
    """Candidates, accepted, approved and skipped per strategy of one pass."""
    return decisions.groupBy("strategy_id").agg(
        F.count(F.lit(1)).alias("candidates"),
        count_if(F.col("accept")).alias("accepted"),
        count_if(F.col("status") == "approved").alias("approved"),
        count_if(F.col("status") != "approved").alias("skipped"),
    )
