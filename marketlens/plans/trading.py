"""Queries over decisions, orders, positions and strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.fixtures import Tables
from marketlens.operators import decisions as D
from marketlens.operators import evidence, positions
from marketlens.plans.tape import _with_pairs, scored_fills, tape_as_of, trader_table
from marketlens.registry import query

MONTH_START = "timestamp '1998-01-01 00:00:00'"
KEYS = ["strategy_id", "market_id", "side"]


def _since():
    return F.lit("1998-01-01 00:00:00").cast("timestamp")


BOOKED_SQL = """
booked AS (SELECT order_id, strategy_id, market_id, side, max(filled_size) AS size, arg_max(filled_size * avg_fill_price, filled_size) AS cost
           FROM (SELECT * FROM fx_fills WHERE filled_size > 0 ORDER BY order_id, report_seq) f GROUP BY 1, 2, 3, 4)
"""


@query(
    "accrue_positions",
    f"""WITH f AS (SELECT x.*, coalesce(x.reported_at > {MONTH_START} AND m.status = 'settled', false) AS late FROM fx_fills x LEFT JOIN fx_prediction_markets m ON m.market_id = x.market_id),
    b AS (SELECT order_id, strategy_id, market_id, side, late, max(filled_size) AS size, arg_max(filled_size * avg_fill_price, filled_size) AS cost
          FROM (SELECT * FROM f WHERE filled_size > 0 ORDER BY order_id, report_seq) x GROUP BY 1, 2, 3, 4, 5),
    g AS (SELECT l.strategy_id, l.market_id, l.side, l.late, l.size - coalesce(e.size, 0) AS size, l.cost - coalesce(e.cost, 0) AS cost
          FROM b l LEFT JOIN b e ON l.late AND NOT e.late AND e.order_id = l.order_id WHERE l.size > coalesce(e.size, 0))
    SELECT strategy_id, market_id, side, late AS after_settlement, sum(size) AS size, sum(cost) AS cost_basis, count(*) AS orders, sum(cost) / sum(size) AS avg_price FROM g GROUP BY 1, 2, 3, 4""",
    dbl="size cost_basis avg_price",
)
def _(t: Tables):
    settled = t("fx_prediction_markets").filter("status = 'settled'").select("market_id", _since().alias("settled_at"))
    return positions.accrue_positions(t("fx_fills"), KEYS, settled)


@query(
    "fill_increments",
    f"""WITH {BOOKED_SQL}, early AS (SELECT order_id, max(filled_size) AS size, arg_max(filled_size * avg_fill_price, filled_size) AS cost
        FROM fx_fills WHERE reported_at < {MONTH_START} GROUP BY 1),
    late AS (SELECT order_id, strategy_id, market_id, side, max(filled_size) AS size, arg_max(filled_size * avg_fill_price, filled_size) AS cost
        FROM fx_fills WHERE reported_at >= {MONTH_START} GROUP BY 1, 2, 3, 4)
    SELECT l.order_id, l.strategy_id, l.market_id, l.side, l.size - coalesce(e.size, 0) AS delta_size, l.cost - coalesce(e.cost, 0) AS delta_cost
    FROM late l LEFT JOIN early e ON e.order_id = l.order_id WHERE l.size > coalesce(e.size, 0)""",
    dbl="delta_size delta_cost",
)
def _(t: Tables):
    fills = t("fx_fills")
    early = positions.booked_orders(fills.filter(F.col("reported_at") < _since()), [])
    return positions.fill_increments(fills.filter(F.col("reported_at") >= _since()), early)


@query(
    "settle_positions",
    """SELECT p.position_id, p.strategy_id, p.market_id, p.side, p.size, p.cost_basis,
       CASE WHEN lower(p.side) = lower(m.result) THEN 1.0 ELSE 0.0 END AS settlement_price,
       floor((CASE WHEN lower(p.side) = lower(m.result) THEN p.size ELSE 0 END - p.cost_basis) * 100 + 0.5) / 100 AS realized_pnl
    FROM fx_open_positions p JOIN fx_prediction_markets m ON m.market_id = p.market_id
    WHERE p.status = 'open' AND m.status = 'settled' AND m.result <> ''""",
    dbl="size cost_basis settlement_price realized_pnl",
)
def _(t: Tables):
    held = t("fx_open_positions").filter(F.col("status") == "open").drop("status")
    return positions.settle_positions(held, t("fx_prediction_markets"))


PERF_SQL = """
run AS (SELECT *, sum(realized_pnl) OVER (PARTITION BY strategy_id ORDER BY settled_at, position_id ROWS UNBOUNDED PRECEDING) AS cum FROM fx_positions WHERE status = 'settled'),
dd AS (SELECT strategy_id, max(peak - cum) AS fall FROM (SELECT *, greatest(0, max(cum) OVER (PARTITION BY strategy_id ORDER BY settled_at, position_id ROWS UNBOUNDED PRECEDING)) AS peak FROM run) r GROUP BY 1),
base AS (SELECT strategy_id, count(*) FILTER (WHERE status = 'settled') AS settled, count(*) FILTER (WHERE status = 'settled' AND realized_pnl > 0) AS wins,
           coalesce(sum(cost_basis) FILTER (WHERE status = 'settled'), 0) AS invested, coalesce(sum(realized_pnl) FILTER (WHERE status = 'settled'), 0) AS realized,
           count(*) FILTER (WHERE status = 'open') AS open_positions, coalesce(sum(cost_basis) FILTER (WHERE status = 'open'), 0) AS open_cost,
           greatest(0, max(realized_pnl) FILTER (WHERE status = 'settled')) AS best, least(0, min(realized_pnl) FILTER (WHERE status = 'settled')) AS worst,
           max(settled_at) FILTER (WHERE status = 'settled') AS last_settled_at FROM fx_positions GROUP BY 1),
perf AS (SELECT b.strategy_id, settled, wins, floor(wins / settled * 10000 + 0.5) / 10000 AS hit_rate, floor(invested * 100 + 0.5) / 100 AS invested,
           floor(realized * 100 + 0.5) / 100 AS realized, floor(realized / invested * 10000 + 0.5) / 10000 AS roi, floor(dd.fall * 100 + 0.5) / 100 AS max_drawdown,
           open_positions, floor(open_cost * 100 + 0.5) / 100 AS open_cost, floor(best * 100 + 0.5) / 100 AS best, floor(worst * 100 + 0.5) / 100 AS worst, last_settled_at
         FROM base b JOIN dd ON dd.strategy_id = b.strategy_id)
"""


@query(
    "strategy_performance",
    f"WITH {PERF_SQL} SELECT * FROM perf",
    dbl="hit_rate invested realized roi max_drawdown open_cost best worst",
)
def _(t: Tables):
    return positions.strategy_performance(t("fx_positions"))


@query(
    "portfolio_totals",
    f"""WITH {PERF_SQL} SELECT s.user_id, count(*) AS strategies, sum(settled) AS settled, floor(sum(realized) * 100 + 0.5) / 100 AS realized,
       floor(sum(invested) * 100 + 0.5) / 100 AS invested, floor(sum(open_cost) * 100 + 0.5) / 100 AS open_cost
    FROM perf p JOIN fx_strategies s ON s.strategy_id = p.strategy_id GROUP BY 1""",
    dbl="realized invested open_cost",
    big="settled",
)
def _(t: Tables):
    return positions.portfolio_totals(positions.strategy_performance(t("fx_positions")), t("fx_strategies"))


EXPOSURE_SQL = """
held AS (SELECT strategy_id, count(*) AS n, sum(cost_basis) AS cost FROM fx_open_positions WHERE status = 'open' AND size > 0 GROUP BY 1),
work AS (SELECT strategy_id, count(*) AS n, sum(limit_price * (size - coalesce(accrued_size, 0))) AS cost FROM fx_exchange_orders
         WHERE status IN ('pending', 'open', 'partial') GROUP BY 1),
exposure AS (SELECT s.strategy_id, s.bankroll, coalesce(h.n, 0) AS open_positions, coalesce(h.cost, 0) AS open_cost, coalesce(w.n, 0) AS working_orders,
               coalesce(w.cost, 0) AS working_cost, floor((coalesce(h.cost, 0) + coalesce(w.cost, 0)) * 100 + 0.5) / 100 AS committed
             FROM fx_strategies s LEFT JOIN held h ON h.strategy_id = s.strategy_id LEFT JOIN work w ON w.strategy_id = s.strategy_id)
"""


def _exposure(t: Tables):
    return positions.strategy_exposure(t("fx_strategies"), t("fx_open_positions"), t("fx_exchange_orders"))


@query(
    "strategy_exposure",
    f"WITH {EXPOSURE_SQL} SELECT *, floor((bankroll - committed) * 100 + 0.5) / 100 AS bankroll_remaining FROM exposure",
    dbl="bankroll open_cost working_cost committed bankroll_remaining",
)
def _(t: Tables):
    return _exposure(t)


REALISED_SQL = f"""
rs AS (SELECT s.strategy_id, s.status, floor(coalesce(sum(p.realized_pnl), 0) * 100 + 0.5) / 100 AS realized, s.daily_loss_limit
       FROM fx_strategies s LEFT JOIN fx_positions p ON p.strategy_id = s.strategy_id AND p.status = 'settled' AND p.settled_at >= {MONTH_START} GROUP BY 1, 2, 4)
"""


@query(
    "realised_since",
    f"WITH {REALISED_SQL} SELECT strategy_id, realized, daily_loss_limit > 0 AND realized <= -daily_loss_limit AS breached FROM rs",
    dbl="realized",
)
def _(t: Tables):
    return positions.realised_since(t("fx_positions"), t("fx_strategies"), _since())


@query(
    "strategy_halts",
    f"""WITH {REALISED_SQL} SELECT strategy_id, status, CASE WHEN status = 'halted' THEN 'strategy is halted' WHEN status <> 'active' THEN concat('strategy is ', status)
       WHEN daily_loss_limit > 0 AND realized <= -daily_loss_limit THEN 'daily loss limit reached' ELSE '' END AS halt_reason FROM rs""",
)
def _(t: Tables):
    return D.strategy_halts(
        t("fx_strategies"), positions.realised_since(t("fx_positions"), t("fx_strategies"), _since())
    )


@query(
    "halt_state",
    """WITH n AS (SELECT * FROM fx_halts ORDER BY id DESC LIMIT 1)
    SELECT active AS halted, CASE WHEN active THEN reason ELSE '' END AS reason, CASE WHEN active THEN actor ELSE '' END AS actor,
           CASE WHEN active THEN created_at END AS since FROM n""",
)
def _(t: Tables):
    return D.halt_state(t("fx_halts"))


@query(
    "decisions_with_evidence",
    """WITH e AS (SELECT decision_id, kind, contribution, row_number() OVER (PARTITION BY decision_id, kind ORDER BY abs(contribution) DESC, contribution DESC, value DESC) AS rn FROM fx_evidence),
    n AS (SELECT decision_id, string_agg(concat(kind, '=', CAST(CAST(round(contribution * 1000) AS BIGINT) AS VARCHAR)), ';' ORDER BY abs(contribution) DESC, kind) AS evidence FROM e WHERE rn = 1 GROUP BY 1)
    SELECT d.decision_id, d.strategy_id, d.market_id, s.user_id, m.question, n.evidence FROM fx_decisions d JOIN fx_strategies s ON s.strategy_id = d.strategy_id
      JOIN fx_prediction_markets m ON m.market_id = d.market_id LEFT JOIN n ON n.decision_id = d.decision_id""",
)
def _(t: Tables):
    rows = D.decisions_with_evidence(t("fx_decisions"), t("fx_evidence"), t("fx_strategies"), t("fx_prediction_markets"))
    text = F.array_join(
        F.transform(
            "evidence",
            lambda e: F.concat(e["kind"], F.lit("="), F.round(e["contribution"] * 1000).cast("bigint").cast("string")),
        ),
        ";",
    )
    return rows.select("decision_id", "strategy_id", "market_id", "user_id", "question", text.alias("evidence"))


STRATEGY_CANDIDATES = """
sc AS (SELECT s.strategy_id, s.bankroll, s.max_stake, s.min_confidence, c.*,
         row_number() OVER (PARTITION BY s.strategy_id ORDER BY c.edge * c.confidence DESC, c.market_id) AS rk
       FROM fx_strategies s JOIN ref_candidates c ON (s.venue = 'both' OR s.venue = c.venue) AND abs(c.edge) >= s.min_edge),
sz AS (SELECT *, (fair_value - market_price) / (1 - market_price) AS kelly, least(fair_value, market_price + 0.01) AS limit_price, edge > 0 AS accept FROM sc),
st AS (SELECT *, CASE WHEN accept AND confidence >= min_confidence AND kelly > 0
         THEN floor(least(bankroll * kelly * 0.25 * confidence, max_stake, bankroll) * 100) / 100 ELSE 0 END AS stake FROM sz),
fin AS (SELECT *, CAST(floor(stake / limit_price) AS BIGINT) AS size FROM st)
"""


def _sized(t: Tables):
    strategies = t("fx_strategies").withColumn("categories", F.lit(None).cast("array<string>"))
    profiles = evidence.strategy_profiles(strategies)
    universe = evidence.profile_universe(t("fx_prediction_markets"), profiles)
    markets = t("fx_prediction_markets").join(universe.select("market_id").distinct(), "market_id", "left_semi")
    flow = evidence.market_flow(scored_fills(t), trader_table(t), markets, tape_as_of(t))
    scored = evidence.score_candidates(_with_pairs(flow, t))
    rows = evidence.candidates_for_strategies(scored, universe, strategies.drop("status"))
    return D.size_stakes(D.rules_judgement(rows))


@query(
    "size_stakes",
    f"WITH {STRATEGY_CANDIDATES} SELECT strategy_id, market_id, edge, stake, limit_price, size, floor(size * limit_price * 100 + 0.5) / 100 AS notional FROM fin",
    dbl="edge stake limit_price notional",
)
def _(t: Tables):
    return _sized(t).select("strategy_id", "market_id", "edge", "stake", "limit_price", "size", "notional")


@query(
    "rules_judgement",
    f"WITH {STRATEGY_CANDIDATES} SELECT strategy_id, market_id, accept, 'rules' AS decided_by, true AS has_rationale FROM fin",
)
def _(t: Tables):
    return _sized(t).select(
        "strategy_id", "market_id", "accept", "decided_by", F.col("rationale").startswith("Fair value ").alias("has_rationale")
    )


@query(
    "decision_status",
    f"""WITH {STRATEGY_CANDIDATES} SELECT strategy_id, market_id,
       CASE WHEN NOT accept THEN 'rejected' WHEN confidence < min_confidence OR size < 1 THEN 'skipped' ELSE 'approved' END AS status,
       CASE WHEN NOT accept THEN 'declined on review' WHEN confidence < min_confidence THEN printf('confidence %.2f below the %.2f floor', confidence, min_confidence)
            WHEN size < 1 THEN 'sized below one contract' ELSE '' END AS status_reason FROM fin""",
)
def _(t: Tables):
    return D.decision_status(_sized(t)).select("strategy_id", "market_id", "status", "status_reason")


@query(
    "risk_admission",
    f"""WITH RECURSIVE {EXPOSURE_SQL},
    q AS (SELECT d.decision_id, d.strategy_id, CAST(d.size * d.limit_price AS DECIMAL(28,8)) AS notional, s.max_open_positions - e.open_positions AS slots, CAST(s.bankroll - e.committed AS DECIMAL(28,8)) AS budget, d.confidence, d.edge
          FROM fx_decisions d JOIN fx_strategies s ON s.strategy_id = d.strategy_id JOIN exposure e ON e.strategy_id = d.strategy_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY confidence DESC, edge DESC, decision_id) AS rk FROM q WHERE notional <= budget),
    walk AS (SELECT strategy_id, CAST(0 AS BIGINT) AS rk, CAST(NULL AS BIGINT) AS decision_id, false AS admitted, slots, budget AS remains FROM r WHERE rk = 1
      UNION ALL SELECT r.strategy_id, r.rk, r.decision_id, w.slots > 0 AND r.notional <= w.remains, CASE WHEN w.slots > 0 AND r.notional <= w.remains THEN w.slots - 1 ELSE w.slots END,
             CASE WHEN w.slots > 0 AND r.notional <= w.remains THEN w.remains - r.notional ELSE w.remains END
      FROM walk w JOIN r ON r.strategy_id = w.strategy_id AND r.rk = w.rk + 1)
    SELECT d.decision_id, d.strategy_id, d.size * d.limit_price AS notional, coalesce(w.admitted, false) AS admitted FROM fx_decisions d LEFT JOIN walk w ON w.decision_id = d.decision_id""",
    dbl="notional",
)
def _(t: Tables):
    decisions = t("fx_decisions").withColumn("notional", F.col("size") * F.col("limit_price"))
    return D.risk_admission(decisions, t("fx_strategies"), _exposure(t)).select(
        "decision_id", "strategy_id", "notional", "admitted"
    )


@query(
    "paper_fills",
    """SELECT d.decision_id, d.market_id, d.side, CASE WHEN m.last_price <= d.limit_price THEN 'filled' ELSE 'cancelled' END AS status,
       CASE WHEN m.last_price <= d.limit_price THEN d.size ELSE 0 END AS filled_size,
       CASE WHEN m.last_price <= d.limit_price THEN least(d.limit_price, m.last_price + 0.01) ELSE 0 END AS fill_price,
       CASE WHEN m.last_price <= d.limit_price THEN '' ELSE 'the market never traded down to the limit' END AS note,
       CASE WHEN d.side = 'yes' THEN m.last_price ELSE 1 - m.last_price END <= d.limit_price AS fills_on_own_side
    FROM fx_decisions d JOIN fx_prediction_markets m ON m.market_id = d.market_id""",
    dbl="filled_size fill_price",
)
def _(t: Tables):
    return D.paper_fills(t("fx_decisions"), t("fx_prediction_markets"))


@query(
    "quote_objection",
    f"""SELECT d.decision_id, d.market_id, CASE WHEN m.status NOT IN ('open', 'active') THEN concat('market is ', m.status)
       WHEN epoch_us({MONTH_START}) - epoch_us(d.created_at) > 600000000 THEN 'no price for this market in the last 10 minutes'
       WHEN abs(m.last_price - d.market_price) > 0.03 THEN printf('market moved %s %.1f points since this was decided', CASE WHEN m.last_price > d.market_price THEN 'up' ELSE 'down' END, abs(m.last_price - d.market_price) * 100)
       WHEN m.last_price >= d.limit_price THEN printf('market is quoted at %.1f against our %.1f limit', m.last_price * 100, d.limit_price * 100) ELSE '' END AS objection
    FROM fx_decisions d JOIN fx_prediction_markets m ON m.market_id = d.market_id""",
)
def _(t: Tables):
    # The fixture's quote time is the decision's own time, so every decision brings its own market view.
    decisions = t("fx_decisions")
    views = decisions.select(F.col("decision_id"), "market_id", F.col("created_at").alias("updated_at")).join(
        t("fx_prediction_markets").select("market_id", "status", "last_price"), "market_id"
    )
    per_decision = views.select(F.col("decision_id").alias("market_id"), "status", "last_price", "updated_at")
    keyed = decisions.withColumn("market_id", F.col("decision_id"))
    rows = D.quote_objection(keyed, per_decision, _since())
    return rows.select("decision_id", "objection").join(decisions.select("decision_id", "market_id"), "decision_id")


@query(
    "order_reconcile",
    f"""WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY report_seq DESC) AS rn FROM fx_venue_answers) x WHERE rn = 1),
    j AS (SELECT o.order_id, o.decision_id, o.status AS old_status, o.filled_size AS old_filled, r.status = 'not_found' AS unknown, CASE WHEN r.status = 'not_found' THEN 0 ELSE coalesce(r.filled_size, 0) END AS filled, CASE WHEN r.status = 'not_found' THEN 0 ELSE coalesce(r.avg_fill_price, 0) END AS avg_fill_price,
            coalesce(r.status IN ('open', 'partial') AND epoch_us({MONTH_START}) - epoch_us(o.placed_at) >= 2700000000, false) AS expired, r.status AS rs
          FROM fx_exchange_orders o JOIN r ON r.order_id = o.order_id WHERE o.status IN ('pending', 'open', 'partial') AND o.strategy_id % 5 <> 4),
    k AS (SELECT *, CASE WHEN unknown THEN 'cancelled' WHEN expired THEN CASE WHEN filled > 0 THEN 'partial' ELSE 'cancelled' END ELSE rs END AS new_status FROM j)
    SELECT order_id, decision_id, old_status, new_status, filled AS new_filled_size, avg_fill_price, expired,
           CASE WHEN unknown THEN 'the venue has no record of this order' ELSE '' END AS note, new_status <> old_status OR filled <> old_filled AS changed,
           new_status = 'cancelled' AND filled = 0 AS decision_expired FROM k""",
    dbl="new_filled_size avg_fill_price",
)
def _(t: Tables):
    accounts = t("fx_exchange_orders").select("strategy_id").distinct().withColumn("active", F.col("strategy_id") % 5 != 4)
    return D.order_reconcile(t("fx_exchange_orders"), t("fx_venue_answers"), _since(), accounts)


@query(
    "working_state",
    """WITH l AS (SELECT strategy_id, market_id, max(decision_id) AS decision_id FROM fx_decisions GROUP BY 1, 2),
    w AS (SELECT decision_id, count(*) AS n FROM fx_exchange_orders WHERE status IN ('pending', 'open', 'partial') GROUP BY 1)
    SELECT l.strategy_id, l.market_id, l.decision_id, d.status, coalesce(w.n, 0) AS working_orders,
           CASE WHEN w.n > 0 THEN 'keep' WHEN d.status IN ('executed', 'failed', 'expired') THEN 'new' ELSE 'update' END AS action
    FROM l JOIN fx_decisions d ON d.decision_id = l.decision_id LEFT JOIN w ON w.decision_id = l.decision_id""",
)
def _(t: Tables):
    return D.working_state(t("fx_decisions"), t("fx_exchange_orders"))
