"""Queries over the trade tape and the evidence built from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.fixtures import Tables
from marketlens.operators import evidence, tape
from marketlens.registry import query

TAPE_AS_OF = "SELECT max(ts) AS t FROM events"


def tape_as_of(t: Tables):
    return t.scalar(TAPE_AS_OF)


def scored_fills(t: Tables):
    return tape.score_fills(t("fx_trades"), t("fx_prediction_markets"))


def trader_table(t: Tables):
    return tape.trader_scores(scored_fills(t))


def flow_rows(t: Tables, fills: str = "fx_trades"):
    universe = evidence.market_universe(t("fx_prediction_markets"))
    scored = tape.score_fills(t(fills), t("fx_prediction_markets"))
    return evidence.market_flow(scored, tape.trader_scores(scored), universe, tape_as_of(t))


@query("score_fills", "SELECT trade_id, market_id, trader_id, side, is_winner FROM ref_scored")
def _(t: Tables):
    return scored_fills(t).select("trade_id", "market_id", "trader_id", "side", "is_winner")


TRADER_DOUBLES = "total_notional avg_trade_size max_trade_size win_rate smart_score"


@query("trader_scores", "SELECT * FROM ref_traders", dbl=TRADER_DOUBLES)
def _(t: Tables):
    return trader_table(t)


@query(
    "smart_money",
    """SELECT * FROM ref_traders WHERE resolved_trade_count >= 2 OR is_whale
    ORDER BY smart_score DESC, total_notional DESC, trader_id LIMIT 50""",
    dbl=TRADER_DOUBLES,
)
def _(t: Tables):
    return tape.smart_money(trader_table(t), limit=50)


@query(
    "big_trades",
    """SELECT b.trade_id, b.market_id, b.trader_id, b.side, b.price, b.notional, b.traded_at, m.venue, m.question, r.smart_score, r.is_whale
    FROM (SELECT * FROM fx_trades ORDER BY notional DESC, trade_id LIMIT 30) b
      JOIN fx_prediction_markets m ON m.market_id = b.market_id LEFT JOIN ref_traders r ON r.trader_id = b.trader_id""",
    dbl="price notional smart_score",
)
def _(t: Tables):
    return tape.big_trades(t("fx_trades"), t("fx_prediction_markets"), trader_table(t), limit=30)


GRAPH_SQL = """
top AS (SELECT * FROM ref_traders WHERE trade_count > 0),
links AS (SELECT concat('t:', CAST(s.trader_id AS VARCHAR)) AS source, concat('m:', CAST(s.market_id AS VARCHAR)) AS target, s.market_id,
            sum(s.notional) AS value, count(*) AS trades, count(*) FILTER (WHERE is_winner = 1) AS wins, count(*) FILTER (WHERE is_winner = 0) AS losses
          FROM ref_scored s JOIN top ON top.trader_id = s.trader_id GROUP BY 1, 2, 3)
"""


@query("flow_graph_links", f"WITH {GRAPH_SQL} SELECT source, target, value, trades, wins, losses FROM links", dbl="value")
def _(t: Tables):
    return tape.graph_links(scored_fills(t), tape.graph_traders(trader_table(t)))


@query(
    "flow_graph_nodes",
    f"""WITH {GRAPH_SQL} SELECT concat('t:', CAST(trader_id AS VARCHAR)) AS id, 'trader' AS kind,
       CASE WHEN is_whale THEN 'whale' WHEN smart_score >= 25 AND resolved_trade_count >= 2 THEN 'smart' ELSE 'trader' END AS "group", total_notional AS value FROM top
    UNION ALL SELECT concat('m:', CAST(market_id AS VARCHAR)), 'market', concat('market-', venue), volume FROM fx_prediction_markets
      WHERE market_id IN (SELECT market_id FROM links)""",
    dbl="value",
)
def _(t: Tables):
    traders = tape.graph_traders(trader_table(t))
    return tape.graph_nodes(tape.graph_links(scored_fills(t), traders), traders, t("fx_prediction_markets"))


@query(
    "cross_venue_pairs",
    """WITH live AS (SELECT question, venue, min(market_id) AS id FROM fx_venue_markets WHERE status = 'open' AND last_price > 0 GROUP BY 1, 2),
    pick AS (SELECT m.market_id, min(l.id) AS other FROM fx_venue_markets m JOIN live l ON l.question = m.question AND l.venue <> m.venue GROUP BY 1)
    SELECT m.market_id, m.venue, m.question, m.last_price, o.market_id AS other_market_id, o.venue AS other_venue, o.last_price AS other_price,
           o.last_price - m.last_price AS yes_gap
    FROM pick p JOIN fx_venue_markets m ON m.market_id = p.market_id JOIN fx_venue_markets o ON o.market_id = p.other""",
    dbl="last_price other_price yes_gap",
)
def _(t: Tables):
    return tape.cross_venue_pairs(t("fx_venue_markets"))


@query(
    "intel_summary",
    f"""SELECT count(*) AS trade_count, count(*) FILTER (WHERE traded_at >= ({TAPE_AS_OF}) - INTERVAL 24 HOUR) AS recent_fills,
       (SELECT count(*) FROM fx_prediction_markets) AS market_count, (SELECT count(DISTINCT venue) FROM fx_prediction_markets) AS venue_count,
       (SELECT count(*) FROM ref_traders) AS trader_count, (SELECT count(*) FROM ref_traders WHERE is_whale) AS whale_count FROM fx_trades""",
)
def _(t: Tables):
    return tape.intel_summary(t("fx_prediction_markets"), t("fx_trades"), trader_table(t), tape_as_of(t))


FLOW_DOUBLES = (
    "liquidity last_price market_price total_notional smart_total side_notional side_smart side_price_mean "
    "side_price_recent early_price late_price"
)


@query("market_flow", "SELECT * FROM ref_flow", dbl=FLOW_DOUBLES)
def _(t: Tables):
    return flow_rows(t)


def _pct(expr: str) -> str:
    return f"printf('%.1f%%', floor(({expr}) * 1000 + 0.5) / 10)"


def _number(expr: str) -> str:
    return f"regexp_replace(regexp_replace(printf('%.2f', floor(({expr}) * 100 + 0.5) / 100), '0+$', ''), '\\.$', '')"


def _register_signal(name: str, kind: str, make, summary: str, prepare=None, known: bool = False):
    fills, mark = ("fx_known_fills", "ref_known_") if known else ("fx_trades", "ref_")
    sql = f"""SELECT e.*, concat({summary}) AS summary FROM {mark}evidence e JOIN {mark}flow f ON f.market_id = e.market_id
    LEFT JOIN {mark}pairs p ON p.market_id = e.market_id WHERE e.kind = '{kind}'"""

    @query(name, sql, dbl="value contribution")
    def _(t: Tables):
        flow = flow_rows(t, fills)
        if prepare is not None:
            flow = prepare(flow, t)
        return evidence.signal_rows(flow, make())


def _with_pairs(flow, t: Tables):
    return evidence.with_cross_venue(flow, tape.cross_venue_pairs(t("fx_prediction_markets")))


SHARE = _pct("f.side_notional / f.total_notional")
OTHER = _pct("CASE WHEN f.side = 'yes' THEN p.other_price ELSE 1 - p.other_price END")
SHRUNK = _pct("(f.side_wins + 3.0) / (f.side_resolved + 6.0)")
_register_signal("sig_flow_imbalance", "flow_imbalance", evidence.flow_imbalance, f"{SHARE}, ' of $', {_number('f.total_notional')}, ' traded in 24h bought ', f.side")
_register_signal("sig_smart_money", "smart_money", evidence.smart_money, f"'accuracy-weighted flow puts ', {_pct('f.side_smart / f.smart_total')}, ' behind ', f.side")
_register_signal(
    "sig_trader_accuracy", "trader_accuracy", evidence.trader_accuracy,
    f"'buyers of ', f.side, ' are ', f.side_wins, '/', f.side_resolved, ' on settled markets (', {SHRUNK}, ' shrunk)'", known=True,
)
_register_signal(
    "sig_price_trend", "price_trend", evidence.price_trend,
    f"f.side, ' traded at ', {_pct('f.side_price_recent')}, ' in the last 4h vs ', {_pct('f.side_price_mean')}, ' over 24h'",
)
_register_signal("sig_liquidity", "liquidity", evidence.liquidity, f"'$', {_number('f.liquidity')}, ' resting liquidity'")
_register_signal(
    "sig_reverse_line", "reverse_line_move", evidence.reverse_line,
    f"{SHARE}, ' of flow bought ', f.side, ' while its price fell ', {_pct('abs(f.late_price - f.early_price)')}",
)
_register_signal(
    "sig_cross_venue", "cross_venue", evidence.cross_venue,
    f"p.other_venue, ' prices ', f.side, ' at ', {OTHER}, ' vs ', {_pct('f.market_price')}, ' here'", _with_pairs,
)


@query(
    "build_candidates",
    """SELECT market_id, venue, side, market_price, fair_value, edge, confidence FROM ref_candidates WHERE abs(edge) >= 0.005""",
    dbl="market_price fair_value edge confidence",
)
def _(t: Tables):
    rows = evidence.build_candidates(_with_pairs(flow_rows(t), t), min_edge=0.005)
    return rows.select("market_id", "venue", "side", "market_price", "fair_value", "edge", "confidence")


@query(
    "ladder_incoherence",
    """WITH r AS (SELECT *, lag(ticker_id) OVER w AS versus_market_id, lag(strike) OVER w AS versus_strike, lag(price) OVER w AS versus_price
        FROM fx_ladder WINDOW w AS (PARTITION BY series, fixture ORDER BY strike, ticker_id))
    SELECT series, fixture, ticker_id AS market_id, strike, price, versus_market_id, versus_strike, versus_price, price - versus_price AS gap
    FROM r WHERE price - versus_price >= 0.01""",
    dbl="price versus_price gap",
)
def _(t: Tables):
    rungs = t("fx_ladder").withColumnRenamed("ticker_id", "market_id")
    return evidence.ladder_incoherence(rungs, ["series", "fixture"])
