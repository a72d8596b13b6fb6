"""Position accounting: fills to positions, settlement, performance, exposure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketlens.functions.common import count_if, js_round, sum_if
from marketlens.operators.ordered import SEGMENT, segment_of

WORKING = ["pending", "open", "partial"]


def booked_orders(reports: DataFrame, keys: list[str]) -> DataFrame:
    """What each order has booked after all its cumulative reports.

    A report only books what exceeds the size already booked, so the booked total equals the largest
    cumulative size and the cost at the first report that reached it. The increments telescope, which
    turns an ordered replay into one aggregate.
    """
    first_best = F.struct("filled_size", (-F.col("report_seq")).alias("seq"))
    return (
        reports.filter(F.col("filled_size") > 0)
        .groupBy("order_id", *keys)
        .agg(
            F.max("filled_size").alias("size"),
            F.max_by(F.col("filled_size") * F.col("avg_fill_price"), first_best).alias("cost"),
        )
    )


def accrue_positions(reports: DataFrame, keys: list[str], settlements: DataFrame | None = None) -> DataFrame:
    """Positions per key (strategy, market, side) from cumulative order reports.

    ``settlements`` (market_id, settled_at) ends positions: what is filled later starts a new one, told apart by
    ``after_settlement``, and books only what its orders had not filled before.
    """
    if settlements is None:
        booked = booked_orders(reports, keys)
    else:
        marks = settlements.select("market_id", "settled_at")
        late = F.coalesce(F.col("reported_at") > F.col("settled_at"), F.lit(False))
        rows = reports.join(marks, "market_id", "left").withColumn("late", late)
        columns = ["order_id", *keys, "report_seq", "filled_size", "avg_fill_price"]
        before = booked_orders(rows.filter("NOT late").select(*columns), keys)
        after = fill_increments(rows.filter("late").select(*columns), before)
        after = after.select("order_id", *keys, F.col("delta_size").alias("size"), F.col("delta_cost").alias("cost"))
        booked = before.withColumn("after_settlement", F.lit(False)).unionByName(after.withColumn("after_settlement", F.lit(True)))
        keys = [*keys, "after_settlement"]
    return (
        booked.groupBy(*keys)
        .agg(F.sum("size").alias("size"), F.sum("cost").alias("cost_basis"), F.count(F.lit(1)).alias("orders"))
        .withColumn("avg_price", F.when(F.col("size") > 0, F.col("cost_basis") / F.col("size")).otherwise(F.lit(0.0)))
    )


def fill_increments(reports: DataFrame, booked: DataFrame) -> DataFrame:
    """New size and cost per order of a batch of reports against what is already booked."""
    seen = booked.select("order_id", F.col("size").alias("done_size"), F.col("cost").alias("done_cost"))
    keys = [c for c in reports.columns if c not in ("order_id", "report_seq", "filled_size", "avg_fill_price", "reported_at")]
    rows = booked_orders(reports, keys).join(seen, "order_id", "left")
    done = F.coalesce("done_size", F.lit(0.0))
    return rows.filter(F.col("size") > done).select(
        "order_id",
        *keys,
        (F.col("size") - done).alias("delta_size"),
        (F.col("cost") - F.coalesce("done_cost", F.lit(0.0))).alias("delta_cost"),
    )


def settle_positions(positions: DataFrame, markets: DataFrame) -> DataFrame:
    """Open positions on settled markets at 1 or 0 with realised profit to the cent."""
    done = markets.filter((F.col("status") == "settled") & (F.col("result") != "")).select("market_id", "result")
    rows = positions.join(done, "market_id")
    price = F.when(F.lower("side") == F.lower("result"), 1.0).otherwise(0.0)
    return rows.select(
        *positions.columns,
        price.alias("settlement_price"),
        js_round(price * F.col("size") - F.col("cost_basis"), 2).alias("realized_pnl"),
    )


def _drawdown(settled: DataFrame) -> DataFrame:
    """Largest fall of cumulative profit from its running peak (the peak starts at 0), per strategy.

    Each (strategy, day) is reduced to its total, its highest and lowest running sum and its own largest
    fall; the days are then chained, so the ordered part never spans a strategy's whole history.
    """
    rows = settled.withColumn(SEGMENT, segment_of(F.col("settled_at")))
    inside = W.partitionBy("strategy_id", SEGMENT).orderBy("settled_at", "position_id").rowsBetween(
        W.unboundedPreceding, 0
    )
    running = rows.withColumn("run", F.sum("realized_pnl").over(inside)).withColumn("top", F.max("run").over(inside))
    days = running.groupBy("strategy_id", SEGMENT).agg(
        F.sum("realized_pnl").alias("total"),
        F.max("run").alias("high"),
        F.min("run").alias("low"),
        F.max(F.col("top") - F.col("run")).alias("fall"),
    )
    before = W.partitionBy("strategy_id").orderBy(SEGMENT).rowsBetween(W.unboundedPreceding, -1)
    chained = days.withColumn("start", F.coalesce(F.sum("total").over(before), F.lit(0.0)))
    chained = chained.withColumn("reach", F.col("start") + F.col("high"))
    peak = F.greatest(F.lit(0.0), F.coalesce(F.max("reach").over(before), F.lit(0.0)))
    fall = F.greatest(peak - F.col("start") - F.col("low"), F.col("fall"))
    return (
        chained.select("strategy_id", fall.alias("fall"))
        .groupBy("strategy_id")
        .agg(F.greatest(F.lit(0.0), F.max("fall")).alias("max_drawdown"))
    )


def strategy_performance(positions: DataFrame) -> DataFrame:
    """Record, return and drawdown of every strategy."""
    settled = positions.filter(F.col("status") == "settled")
    pnl = F.col("realized_pnl")
    open_rows = F.col("status") == "open"
    if "size" in positions.columns:
        open_rows = open_rows & (F.col("size") > 0)
    is_settled = F.col("status") == "settled"
    base = positions.groupBy("strategy_id").agg(
        count_if(is_settled).alias("settled"),
        count_if(is_settled & (pnl > 0)).alias("wins"),
        sum_if(is_settled, F.col("cost_basis")).alias("invested"),
        sum_if(is_settled, pnl).alias("realized"),
        count_if(open_rows).alias("open_positions"),
        sum_if(open_rows, F.col("cost_basis")).alias("open_cost"),
        F.greatest(F.lit(0.0), F.coalesce(F.max(F.when(is_settled, pnl)), F.lit(0.0))).alias("best"),
        F.least(F.lit(0.0), F.coalesce(F.min(F.when(is_settled, pnl)), F.lit(0.0))).alias("worst"),
        F.max(F.when(is_settled, F.col("settled_at"))).alias("last_settled_at"),
    )
    rows = base.join(_drawdown(settled), "strategy_id", "left")
    return rows.select(
        "strategy_id",
        "settled",
        "wins",
        F.when(F.col("settled") > 0, js_round(F.col("wins") / F.col("settled"), 4)).alias("hit_rate"),
        js_round(F.col("invested"), 2).alias("invested"),
        js_round(F.col("realized"), 2).alias("realized"),
        F.when(F.col("invested") > 0, js_round(F.col("realized") / F.col("invested"), 4)).alias("roi"),
        js_round(F.coalesce("max_drawdown", F.lit(0.0)), 2).alias("max_drawdown"),
        "open_positions",
        js_round(F.col("open_cost"), 2).alias("open_cost"),
        js_round(F.col("best"), 2).alias("best"),
        js_round(F.col("worst"), 2).alias("worst"),
        "last_settled_at",
    )


def portfolio_totals(performance: DataFrame, strategies: DataFrame) -> DataFrame:
    """Sums over a user's strategies ."""
    rows = strategies.select("strategy_id", "user_id").join(performance, "strategy_id")
    money = ["realized", "invested", "open_cost"]
    return rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("strategies"),
        F.sum("settled").alias("settled"),
        *[js_round(F.sum(c), 2).alias(c) for c in money],
    )


def strategy_exposure(strategies: DataFrame, positions: DataFrame, orders: DataFrame) -> DataFrame:
    """Working orders, open positions, committed money and what is left of the bankroll."""
    held = (
        positions.filter((F.col("status") == "open") & (F.col("size") > 0))
        .groupBy("strategy_id")
        .agg(F.count(F.lit(1)).alias("open_positions"), F.sum("cost_basis").alias("open_cost"))
    )
    remainder = F.col("limit_price") * (F.col("size") - F.coalesce("accrued_size", F.lit(0.0)))
    working = (
        orders.filter(F.col("status").isin(WORKING))
        .groupBy("strategy_id")
        .agg(F.count(F.lit(1)).alias("working_orders"), F.sum(remainder).alias("working_cost"))
    )
    rows = strategies.select("strategy_id", "bankroll").join(held, "strategy_id", "left").join(
        working, "strategy_id", "left"
    )
    filled = rows.na.fill(0, ["open_positions", "open_cost", "working_orders", "working_cost"])
    committed = js_round(F.col("open_cost") + F.col("working_cost"), 2)
    return filled.select("*", committed.alias("committed")).withColumn(
        "bankroll_remaining", js_round(F.col("bankroll") - F.col("committed"), 2)
    )


def realised_since(positions: DataFrame, strategies: DataFrame, since: Column) -> DataFrame:
    """Profit settled since an instant and whether it breaches the strategy's daily loss limit."""
    sums = (
        positions.filter((F.col("status") == "settled") & (F.col("settled_at") >= since))
        .groupBy("strategy_id")
        .agg(F.sum("realized_pnl").alias("realized"))
    )
    realized = js_round(F.coalesce("realized", F.lit(0.0)), 2)
    return strategies.select("strategy_id", "daily_loss_limit").join(sums, "strategy_id", "left").select(
        "strategy_id",
        realized.alias("realized"),
        ((F.col("daily_loss_limit") > 0) & (realized <= -F.col("daily_loss_limit"))).alias("breached"),
    )
