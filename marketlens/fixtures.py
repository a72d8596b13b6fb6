"""Projections of the driver tables onto the engine's schemas.

Each projection is SQL that Spark and DuckDB both accept, so an operator and its oracle read the same
rows. A projection may use other projections; they are pulled in as CTEs.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

PROJECTIONS: dict[str, str] = {}

PROJECTIONS["fx_books"] = """
SELECT s AS bookmaker_id, concat('book', CAST(s AS VARCHAR(9))) AS slug, s % 3 = 0 AS sharp,
       CAST(1 + s % 4 AS DOUBLE) AS consensus_weight, CASE WHEN s % 4 = 3 THEN 'prediction' ELSE 'sportsbook' END AS kind
FROM (SELECT DISTINCT s_suppkey % 8 AS s FROM supplier) t
"""

PROJECTIONS["fx_selections"] = """
SELECT p_partkey AS selection_id, CAST(floor(p_partkey / 3) AS BIGINT) AS market_id, p_partkey % 3 AS position,
       CASE p_partkey % 3 WHEN 0 THEN 'home' WHEN 1 THEN 'away' ELSE 'draw' END AS side, p_name AS label,
       CAST(floor(p_partkey / 9) AS BIGINT) AS event_id,
       CASE CAST(floor(p_partkey / 3) AS BIGINT) % 3 WHEN 0 THEN 'h2h' WHEN 1 THEN 'spreads' ELSE 'totals' END AS market_type
FROM part
"""

PROJECTIONS["fx_snapshots"] = """
SELECT min(l_orderkey * 100 + l_linenumber) AS id, l_partkey AS selection_id, l_suppkey % 8 AS bookmaker_id,
       max(CAST(105 + 8 * CAST(l_quantity AS BIGINT) AS DOUBLE) / 100) AS price, l_shipdate AS captured_at
FROM lineitem GROUP BY l_partkey, l_suppkey % 8, l_shipdate
"""

PROJECTIONS["fx_odds"] = """
SELECT selection_id, bookmaker_id, price, captured_at AS updated_at FROM (
  SELECT s.*, row_number() OVER (PARTITION BY selection_id, bookmaker_id ORDER BY captured_at DESC, id DESC) AS rn
  FROM fx_snapshots s) t WHERE rn = 1
"""

# A team does not play itself.
PROJECTIONS["fx_events"] = """
SELECT o_orderkey AS event_id, o_custkey % 25 AS home_team_id, (o_custkey * 7 + o_orderkey) % 25 AS away_team_id, o_orderdate AS commence_at,
       CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'scheduled' ELSE 'live' END AS status,
       o_orderkey % 7 AS home_score, (o_orderkey * 3) % 6 AS away_score, concat('sport', CAST(o_custkey % 5 AS VARCHAR(9))) AS sport_slug
FROM orders WHERE o_custkey % 25 <> (o_custkey * 7 + o_orderkey) % 25
"""

PROJECTIONS["fx_prediction_markets"] = """
SELECT CAST(n_nationkey AS BIGINT) AS market_id, CASE WHEN n_nationkey < 13 THEN 'a' ELSE 'b' END AS venue,
       concat('Q', CAST(n_nationkey % 13 AS VARCHAR(9))) AS question, CASE WHEN n_nationkey % 3 = 0 THEN 'settled' ELSE 'open' END AS status,
       CASE WHEN n_nationkey % 3 <> 0 THEN '' WHEN n_nationkey % 2 = 0 THEN 'yes' ELSE 'no' END AS result,
       CAST(10 + (n_nationkey * 7) % 80 AS DOUBLE) / 100 AS last_price, CAST(1000 + n_nationkey * 37 AS DOUBLE) AS volume,
       CAST(100 + n_nationkey AS DOUBLE) AS liquidity, concat('cat', CAST(n_regionkey AS VARCHAR(9))) AS category
FROM nation
"""

PROJECTIONS["fx_trades"] = """
SELECT event_id AS trade_id, event_id % 25 AS market_id, CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id END AS trader_id,
       CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'yes' ELSE 'no' END AS side,
       CAST(5 + (event_id * 37) % 90 AS DOUBLE) / 100 AS price, value * 50 AS notional, ts AS traded_at
FROM events
"""

PROJECTIONS["fx_feature_snapshots"] = """
SELECT l_partkey AS selection_id, l_shipdate AS captured_at,
       CAST(CAST(l_quantity AS BIGINT) AS DOUBLE) / 51 AS fair_prob, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 0 ELSE 2 END AS label,
       l_discount * 100 AS clv_pct, concat('sport', CAST(l_suppkey % 5 AS VARCHAR(9))) AS sport_slug,
       CASE l_linenumber % 3 WHEN 0 THEN 'h2h' WHEN 1 THEN 'spreads' ELSE 'totals' END AS market_type
FROM lineitem
"""

PROJECTIONS["fx_ladder"] = """
SELECT p_brand AS series, p_type AS fixture, p_partkey AS ticker_id, p_size AS strike,
       CAST(1 + (p_partkey * 13) % 98 AS DOUBLE) / 100 AS price FROM part
"""

PROJECTIONS["fx_fills"] = """
SELECT l_orderkey AS order_id,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS report_seq, l_orderkey % 10 AS strategy_id, l_orderkey % 25 AS market_id,
       CASE WHEN l_orderkey % 2 = 0 THEN 'yes' ELSE 'no' END AS side,
       sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING) AS filled_size,
       CAST(10 + l_orderkey % 80 AS DOUBLE) / 100 AS avg_fill_price, l_shipdate AS reported_at
FROM lineitem
"""

PROJECTIONS["fx_positions"] = """
SELECT o_orderkey AS position_id, o_custkey % 10 AS strategy_id, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'settled' END AS status,
       o_totalprice AS cost_basis, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice * 0.5 ELSE -o_totalprice * 0.4 END AS realized_pnl, o_orderdate AS settled_at
FROM orders
"""

PROJECTIONS["fx_requests"] = """
SELECT event_id AS id, CASE WHEN event_type = 'signup' THEN 'POST' ELSE 'GET' END AS method,
       CASE event_type WHEN 'view' THEN '/blog/post' WHEN 'purchase' THEN '/checkout' WHEN 'click' THEN '/app.js' ELSE concat('/', event_type) END AS path,
       CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code, value AS duration_ms, CAST(user_id AS VARCHAR(20)) AS ip_address,
       CASE user_id % 4 WHEN 0 THEN 'Mozilla Chrome/1 Edg/1' WHEN 1 THEN 'Mozilla Firefox/1 Mobile' WHEN 2 THEN 'Mozilla Chrome/1 Safari/1' ELSE '' END AS user_agent, ts AS created_at
FROM events
"""

PROJECTIONS["fx_orders"] = """
SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'cancelled' END AS status,
       o_totalprice AS total_amount, CASE o_custkey % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE ' gbp ' END AS currency, o_custkey AS customer_id, o_orderdate AS created_at
FROM orders
"""

PROJECTIONS["fx_runs"] = """
SELECT event_id AS id, concat('p', CAST(user_id % 3 AS VARCHAR(9))) AS provider,
       CASE user_id % 4 WHEN 0 THEN 'odds' WHEN 1 THEN 'schedule' WHEN 2 THEN 'fundamentals' ELSE 'other' END AS kind,
       CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'partial' ELSE 'success' END AS status, ts AS finished_at
FROM events
"""

PROJECTIONS["fx_query_logs"] = """
SELECT event_id AS id, event_type AS normalized_query, value AS duration, CASE WHEN value > 100 THEN 'slow' WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status,
       ts AS executed_at, props AS tags FROM events
"""


PROJECTIONS["fx_quotes"] = """
SELECT o.selection_id, o.bookmaker_id, o.price, o.updated_at, s.market_id, s.event_id, s.market_type, s.side, s.position
FROM fx_odds o JOIN fx_selections s ON s.selection_id = o.selection_id
"""
PROJECTIONS["fx_named_books"] = """
SELECT CAST(s_suppkey AS BIGINT) AS bookmaker_id, concat('Book ', CAST(s_suppkey % 40 AS VARCHAR(9))) AS name,
       lower(s_name) AS slug, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE concat('pk-', CAST(s_suppkey % 50 AS VARCHAR(9))) END AS provider_key
FROM supplier
"""

PROJECTIONS["fx_venue_markets"] = """
SELECT p_partkey AS market_id, CASE p_partkey % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'c' ELSE 'b' END AS venue,
       concat(p_name, ' ', CAST(p_size AS VARCHAR(9))) AS question,
       CASE WHEN p_partkey % 7 = 0 THEN 'settled' ELSE 'open' END AS status, lower(p_type) AS category,
       CAST(1 + (p_partkey * 13) % 98 AS DOUBLE) / 100 AS last_price, p_retailprice AS volume
FROM part
"""
PROJECTIONS["fx_decisions"] = """
SELECT o_orderkey AS decision_id, o_custkey % 10 AS strategy_id, o_orderkey % 25 AS market_id,
       CASE WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE 'no' END AS side,
       CAST(5 + o_custkey % 90 AS DOUBLE) / 100 AS market_price, CAST(6 + o_custkey % 90 AS DOUBLE) / 100 AS limit_price,
       CAST(o_orderkey % 1000 AS DOUBLE) / 1000 AS confidence, CAST((o_orderkey * 7) % 300 - 100 AS DOUBLE) / 1000 AS edge,
       CAST(1 + o_custkey % 40 AS DOUBLE) AS size,
       CASE o_orderstatus WHEN 'F' THEN 'executed' WHEN 'O' THEN 'approved' ELSE 'skipped' END AS status, o_orderdate AS created_at
FROM orders
"""
PROJECTIONS["fx_evidence"] = """
SELECT l_orderkey AS decision_id, CASE l_linenumber WHEN 1 THEN 'flow_imbalance' WHEN 2 THEN 'smart_money' WHEN 3 THEN 'trader_accuracy'
         WHEN 4 THEN 'price_trend' WHEN 5 THEN 'liquidity' WHEN 6 THEN 'cross_venue' ELSE 'steam' END AS kind,
       CASE WHEN l_linenumber = 5 THEN 0 ELSE CAST(CAST(l_quantity AS BIGINT) - 25 AS DOUBLE) / 1000 END AS contribution,
       l_quantity AS value, l_shipdate AS created_at
FROM lineitem
"""

PROJECTIONS["fx_graded_sides"] = """
SELECT s.selection_id, s.market_id, s.event_id, s.market_type,
       CASE WHEN s.market_type <> 'totals' THEN s.side WHEN s.position = 0 THEN 'over' WHEN s.position = 1 THEN 'under' ELSE 'draw' END AS side,
       CASE WHEN s.market_type = 'h2h' OR p.p_size % 9 = 0 THEN NULL WHEN s.market_type = 'spreads' THEN CAST(p.p_size % 7 - 3 AS DOUBLE)
            ELSE CAST(p.p_size % 12 AS DOUBLE) / 2 + 2 END AS point
FROM fx_selections s JOIN part p ON p.p_partkey = s.selection_id
"""
PROJECTIONS["fx_results"] = """
SELECT event_id, home_score, away_score, CASE WHEN home_score > away_score THEN 'home' WHEN home_score < away_score THEN 'away' ELSE 'draw' END AS winner_side,
       status = 'final' AS completed
FROM fx_events WHERE status <> 'live'
"""
PROJECTIONS["fx_open_snapshots"] = """
SELECT l_partkey AS selection_id, l_shipdate AS captured_at, max(CAST(105 + 8 * CAST(l_quantity AS BIGINT) AS DOUBLE) / 100) AS best_price
FROM lineitem GROUP BY 1, 2
"""
PROJECTIONS["fx_insights"] = """
SELECT o_orderkey AS insight_id, o_custkey AS selection_id, CASE o_orderkey % 3 WHEN 0 THEN 'back' WHEN 1 THEN 'lay' ELSE 'pass' END AS stance,
       CAST(o_orderkey % 100 AS DOUBLE) / 100 AS stated_prob FROM orders
"""
PROJECTIONS["fx_open_positions"] = """
SELECT o_orderkey AS position_id, o_custkey % 10 AS strategy_id, o_orderkey % 25 AS market_id,
       CASE o_orderkey % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' ELSE 'NO' END AS side, CAST(1 + o_custkey % 500 AS DOUBLE) AS size,
       CAST(1 + o_custkey % 500 AS DOUBLE) * CAST(5 + o_orderkey % 90 AS DOUBLE) / 100 AS cost_basis,
       CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'settled' END AS status
FROM orders
"""
PROJECTIONS["fx_strategies"] = """
SELECT s_suppkey AS strategy_id, CAST(s_nationkey AS BIGINT) AS user_id, CASE s_suppkey % 3 WHEN 0 THEN 'both' WHEN 1 THEN 'a' ELSE 'b' END AS venue,
       2000000 + s_acctbal * 10 AS bankroll, CAST(50 + s_suppkey % 200 AS DOUBLE) AS max_stake, CAST(s_suppkey % 3 AS DOUBLE) / 200 AS min_edge,
       CAST(s_suppkey % 6 AS DOUBLE) / 10 AS min_confidence, CAST(900 + s_suppkey % 300 AS BIGINT) AS max_open_positions,
       CAST(CASE WHEN s_suppkey % 2 = 0 THEN 1000000 ELSE 0 END AS DOUBLE) AS daily_loss_limit,
       CASE WHEN s_suppkey % 11 = 0 THEN 'halted' WHEN s_suppkey % 13 = 0 THEN 'paused' ELSE 'active' END AS status
FROM supplier
"""
PROJECTIONS["fx_exchange_orders"] = """
SELECT decision_id AS order_id, decision_id, strategy_id, market_id, side, limit_price, size,
       CASE WHEN decision_id % 3 = 0 THEN NULL ELSE floor(size / 2) END AS accrued_size,
       CASE decision_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'open' WHEN 2 THEN 'partial' WHEN 3 THEN 'filled' ELSE 'cancelled' END AS status,
       CASE WHEN decision_id % 5 IN (2, 3) THEN floor(size / 2) ELSE 0 END AS filled_size, created_at AS placed_at
FROM fx_decisions
"""
PROJECTIONS["fx_order_reports"] = """
SELECT order_id, report_seq, strategy_id, market_id, side, filled_size, avg_fill_price, reported_at,
       CASE order_id % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'partial' WHEN 2 THEN 'filled' ELSE 'cancelled' END AS status FROM fx_fills
"""
# What venues say about orders: some are unknown to them, and of some nothing is heard.
PROJECTIONS["fx_venue_answers"] = """
SELECT order_id, report_seq, CASE WHEN order_id % 9 = 4 THEN 'not_found' ELSE status END AS status, filled_size, avg_fill_price
FROM fx_order_reports WHERE order_id % 8 <> 5
"""
# Three teams have no standing.
PROJECTIONS["fx_standings"] = """
SELECT o_orderkey AS id, o_custkey % 25 AS team_id, o_orderdate AS captured_at, CAST(o_custkey % 100 AS DOUBLE) / 100 AS win_percent,
       CAST(o_orderkey % 301 - 150 AS DOUBLE) AS point_differential, o_custkey % 40 AS games_played FROM orders WHERE o_custkey % 25 < 22
"""
# One team has no valuation.
PROJECTIONS["fx_valuations"] = """
SELECT o_orderkey AS id, o_custkey % 25 AS team_id, o_orderdate AS captured_at, o_totalprice * 1000 AS squad_value_eur,
       o_orderkey % 4 AS league_tier FROM orders WHERE o_custkey % 25 <> 3
"""
PROJECTIONS["fx_injuries"] = """
SELECT o_orderkey AS id, o_custkey % 25 AS team_id, o_orderdate AS captured_at, CAST(o_orderkey % 5 AS DOUBLE) / 4 AS severity FROM orders
"""
PROJECTIONS["fx_teams"] = """
SELECT c_nationkey AS team_id, CAST(min(c_nationkey) % 3 AS BIGINT) AS tier FROM (SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer) c GROUP BY 1
"""
PROJECTIONS["fx_market_fixtures"] = """
SELECT event_id % 25 AS market_id, max(event_id) AS event_id, CASE WHEN event_id % 25 % 4 = 3 THEN 'tie' WHEN event_id % 25 % 2 = 0 THEN 'home' ELSE 'away' END AS outcome
FROM fx_events WHERE event_id IN (SELECT event_id FROM fx_selections) GROUP BY event_id % 25
"""
PROJECTIONS["fx_halts"] = """
SELECT event_id AS id, event_type = 'error' AS active, event_type AS reason, CAST(user_id AS VARCHAR(20)) AS actor, ts AS created_at FROM events
"""

PROJECTIONS["fx_notes"] = """
SELECT event_id AS note_id, event_id % 25 AS market_id, CASE event_type WHEN 'click' THEN 'yes' WHEN 'view' THEN 'no' ELSE 'watching' END AS stance,
       concat('author', CAST(user_id AS VARCHAR(20))) AS author_name, props AS body, user_id % 10 = 0 AS hidden, ts AS created_at FROM events
"""
PROJECTIONS["fx_subscriptions"] = """
SELECT o_orderkey AS subscription_id, o_custkey AS user_id, CASE o_orderkey % 5 WHEN 0 THEN 'price_Desk_month' WHEN 1 THEN 'auto-yearly' WHEN 2 THEN 'SIGNAL' ELSE 'basic' END AS price_key,
       CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'trialing' ELSE 'canceled' END AS status,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate END AS ends_at FROM orders
"""
PROJECTIONS["fx_alerts"] = """
SELECT event_id AS alert_id, CASE WHEN user_id % 2 = 0 THEN 'edge' ELSE 'whale' END AS kind, concat('L', CAST(user_id % 5 AS VARCHAR(9))) AS league,
       CASE event_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'b' ELSE '' END AS venue, value, ts AS raised_at FROM events
"""
PROJECTIONS["fx_alert_subscriptions"] = """
SELECT c_custkey AS subscription_id, c_custkey AS user_id, CASE WHEN c_custkey % 2 = 0 THEN 'edge' ELSE 'whale' END AS kind,
       CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'l1, L2' ELSE 'l3' END AS leagues, CASE c_custkey % 4 WHEN 0 THEN 'both' WHEN 1 THEN 'a' ELSE 'B' END AS venue,
       200 + c_acctbal / 40 AS min_value, CASE c_custkey % 2 WHEN 0 THEN 'database, email' ELSE '' END AS channels, c_custkey % 7 <> 0 AS active,
       CASE WHEN c_custkey % 5 = 0 THEN timestamp '2024-01-30 23:50:00' END AS last_sent_at
FROM customer
"""
PROJECTIONS["fx_sheet_legs"] = """
SELECT l_orderkey AS sheet_id, l_partkey AS selection_id, CASE WHEN l_linenumber = 7 THEN 0 ELSE 1 + l_quantity / 25 END AS price FROM lineitem
"""

PROJECTIONS["fx_app_events"] = """
SELECT event_id AS id, event_type AS name, CASE user_id % 4 WHEN 0 THEN 'pageView' WHEN 1 THEN 'check_out' WHEN 2 THEN '' ELSE 'sign-up' END AS category,
       CASE user_id % 3 WHEN 0 THEN 'usd' WHEN 1 THEN ' EUR ' ELSE '' END AS currency, CASE WHEN event_type = 'view' THEN 0 ELSE value END AS value, ts AS created_at FROM events
"""
PROJECTIONS["fx_raw_requests"] = """
SELECT event_id AS id, CASE WHEN event_id % 11 = 0 THEN 'TRACE' WHEN event_id % 2 = 0 THEN 'get' ELSE 'POST' END AS method,
       CASE WHEN event_id % 13 = 0 THEN ' ' ELSE concat('https://example.com/p', CAST(user_id % 9 AS VARCHAR(9)), '?q=', CAST(event_id AS VARCHAR(20))) END AS path,
       CASE WHEN event_id % 17 = 0 THEN 999 ELSE 200 END AS status_code, CASE WHEN event_id % 19 = 0 THEN -1 ELSE value END AS duration_ms,
       CASE WHEN event_id % 23 = 0 THEN NULL ELSE ts END AS created_at FROM events
"""
PROJECTIONS["fx_shop_orders"] = """
SELECT id AS order_id, status, total_amount, currency, customer_id, created_at FROM fx_orders
"""
PROJECTIONS["fx_items"] = """
SELECT l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS BIGINT) AS quantity, l_extendedprice / l_quantity AS price FROM lineitem
"""
PROJECTIONS["fx_products"] = """
SELECT p_partkey AS product_id, p_name AS name, CAST(p_size % 7 AS BIGINT) AS category_id, p_retailprice AS price, p_size % 4 <> 0 AS is_available,
       CAST(CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_size * 4 END AS BIGINT) AS inventory_count FROM part
"""
PROJECTIONS["fx_categories"] = """
SELECT CAST(r_regionkey AS BIGINT) AS category_id, r_name AS name FROM region
"""
# Some customers are left out, so that orders refer to unknown ones.
PROJECTIONS["fx_customers"] = """
SELECT c_custkey AS customer_id, c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN 'Inactive' ELSE 'Active' END AS status, c_acctbal AS total_spent FROM customer WHERE c_custkey % 97 <> 0
"""
PROJECTIONS["fx_payments"] = """
SELECT o_orderkey AS payment_id, CASE o_custkey % 4 WHEN 0 THEN 'creditCard' WHEN 1 THEN 'bank_transfer' WHEN 2 THEN '' ELSE 'cash' END AS method, o_totalprice AS amount,
       CASE WHEN o_orderkey % 6 IN (2, 3) AND o_orderkey % 7 <> 0 THEN o_totalprice / 4 ELSE 0 END AS refund_amount,
       CASE o_orderkey % 6 WHEN 0 THEN 'completed' WHEN 1 THEN 'succeeded' WHEN 2 THEN 'partiallyRefunded' WHEN 3 THEN 'refunded' WHEN 4 THEN 'failed' ELSE 'pending' END AS status,
       CASE o_custkey % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'GBP' END AS currency, o_orderdate AS created_at FROM orders
"""
PROJECTIONS["fx_gift_cards"] = """
SELECT c_custkey AS card_id, CASE c_custkey % 4 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'USED' WHEN 2 THEN 'EXPIRED' ELSE 'DEACTIVATED' END AS status, c_custkey % 3 <> 0 AS is_active,
       CASE c_nationkey % 2 WHEN 0 THEN 'USD' ELSE 'EUR' END AS currency, 1000 + c_acctbal AS initial_balance, 1500 - c_acctbal / 10 AS current_balance FROM customer
"""
PROJECTIONS["fx_coupons"] = """
SELECT p_partkey AS coupon_id, p_size % 2 = 0 AS is_active, CASE p_size % 3 WHEN 0 THEN 'Scheduled' WHEN 1 THEN 'Expired' ELSE 'Active' END AS status, p_size AS usage_count FROM part
"""
PROJECTIONS["fx_reviews"] = """
SELECT l_partkey AS product_id, l_returnflag <> 'N' AS approved, l_linestatus = 'F' AS featured, l_linenumber % 2 = 0 AS verified, CAST(1 + l_quantity % 5 AS DOUBLE) AS rating FROM lineitem
"""
PROJECTIONS["fx_waitlist"] = """
SELECT o_orderkey AS entry_id, CASE o_orderstatus WHEN 'F' THEN 'waiting' WHEN 'O' THEN 'purchased' ELSE 'notified' END AS status, o_custkey % 12 AS quantity, o_orderdate AS created_at,
       CASE o_orderkey % 4 WHEN 0 THEN 'waiting' WHEN 1 THEN 'seated' WHEN 2 THEN 'cancelled' ELSE 'no_show' END AS table_status, CAST(o_custkey % 60 AS DOUBLE) AS quoted_wait FROM orders
"""
PROJECTIONS["fx_catalogue"] = """
SELECT p_partkey AS id, p_size % 3 = 0 AS flag, CASE WHEN p_size % 9 = 0 THEN '' ELSE p_brand END AS brand, p_type AS type, CASE p_size % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'draft' ELSE 'archived' END AS status,
       CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_partkey % 50 END AS parent_id, p_partkey % 300 AS product_id, p_size AS amount, p_retailprice / 100 AS rate,
       CASE p_size % 3 WHEN 0 THEN 'online' WHEN 1 THEN 'offline' ELSE 'warning' END AS device_status FROM part
"""
PROJECTIONS["fx_print_logs"] = """
SELECT event_id AS id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'warning' ELSE 'success' END AS status, user_id % 20 AS pages, value AS duration_seconds FROM events
"""
PROJECTIONS["fx_routes"] = """
SELECT o_orderkey AS route_id, o_custkey % 30 AS stops, CAST(10 + o_custkey % 200 AS DOUBLE) AS delivery_minutes, o_orderdate AS last_active FROM orders
"""
PROJECTIONS["fx_zones"] = """
SELECT c_custkey AS zone_id, CASE c_custkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'draft' ELSE 'inactive' END AS status, c_custkey % 4 AS country_count FROM customer
"""
PROJECTIONS["fx_drivers"] = """
SELECT s_suppkey AS driver_id, CASE s_suppkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'on_delivery' ELSE 'on_break' END AS status FROM supplier
"""
PROJECTIONS["fx_tax_rates"] = """
SELECT s_suppkey AS tax_rate_id, CASE WHEN s_suppkey % 3 = 1 THEN 'inactive' ELSE 'active' END AS status, s_suppkey % 5 = 3 AS is_default, CAST(s_suppkey % 25 AS DOUBLE) AS rate FROM supplier
"""

PROJECTIONS["fx_campaigns"] = """
SELECT p_partkey AS campaign_id, CASE p_size % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'socialMedia' ELSE 'push_note' END AS type, CASE p_partkey % 3 WHEN 0 THEN 'usd' WHEN 1 THEN 'EUR' ELSE '' END AS currency,
       CASE p_size % 6 WHEN 0 THEN 'sent' WHEN 1 THEN 'draft' WHEN 2 THEN 'scheduled' WHEN 3 THEN 'completed' WHEN 4 THEN 'active' ELSE '' END AS status,
       CASE WHEN p_partkey = 7 THEN NULL ELSE CAST(p_size * 10 AS DOUBLE) END AS audience_size, CASE WHEN p_partkey = 10 THEN NULL WHEN p_size % 4 = 0 THEN 0 ELSE CAST(p_size * 7 AS DOUBLE) END AS sent_count,
       CAST(p_size % 60 AS DOUBLE) AS open_rate, CASE WHEN p_size % 4 = 0 THEN NULL ELSE CAST(p_size % 30 AS DOUBLE) END AS click_rate, CASE WHEN p_partkey = 4 THEN NULL ELSE CAST(p_size % 9 AS DOUBLE) END AS conversion_rate,
       p_retailprice AS budget, p_retailprice / 2 AS spent, p_partkey % 60 AS list_id FROM part
"""
PROJECTIONS["fx_lists"] = """
SELECT s_suppkey AS list_id, s_name AS name, CASE WHEN s_suppkey % 4 = 0 THEN 'archived' ELSE 'active' END AS status, s_suppkey % 30 AS stored_subscribers FROM supplier
"""
PROJECTIONS["fx_members"] = """
SELECT c_custkey AS member_id, c_custkey % 60 AS list_id, CASE c_custkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'unsubscribed' WHEN 2 THEN 'bounced' ELSE 'subscribed' END AS status,
       CAST(make_date(2024, 1, CAST(1 + c_custkey % 28 AS INT)) AS TIMESTAMP) AS created_at FROM customer
"""
# A third of the campaigns have sent nothing.
PROJECTIONS["fx_sends"] = """
SELECT l_partkey AS campaign_id, CASE l_linenumber WHEN 1 THEN 'queued' WHEN 2 THEN 'failed' WHEN 3 THEN 'bounced' WHEN 4 THEN 'complained' ELSE 'sent' END AS status, l_discount > 0.05 AS opened, l_tax > 0.05 AS clicked, l_shipdate AS sent_at
FROM lineitem WHERE l_partkey % 3 <> 0
"""
PROJECTIONS["fx_posts"] = """
SELECT doc_id AS post_id, concat('Post ', CAST(doc_id AS VARCHAR(20))) AS title, CASE WHEN doc_id % 4 = 0 THEN 'draft' WHEN doc_id % 4 = 1 THEN 'scheduled' WHEN doc_id % 4 = 2 THEN 'failed' ELSE 'published' END AS status, n_chars AS views,
       doc_id % 400 AS author_id, n_chars * 3 AS reach, n_chars % 100 AS engagement,
       CAST(make_date(2023, CAST(1 + doc_id % 12 AS INT), CAST(1 + doc_id % 28 AS INT)) AS TIMESTAMP) AS created_at FROM documents
"""
PROJECTIONS["fx_site_pages"] = """
SELECT page_id, CAST(length(url) AS BIGINT) AS views, CAST(make_date(2023, CAST(1 + page_id % 12 AS INT), 3) AS TIMESTAMP) AS created_at FROM pages
"""
# A fifth of the posts have no category, some have two.
PROJECTIONS["fx_post_categories"] = """
SELECT doc_id AS post_id, doc_id % 7 AS category_id FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, (doc_id + 3) % 7 FROM documents WHERE doc_id % 10 = 1
"""
PROJECTIONS["fx_comments"] = """
SELECT conv_id * 1000 + turn AS comment_id, conv_id AS post_id, role AS author, text AS content, CAST(make_date(2024, CAST(1 + conv_id % 12 AS INT), CAST(1 + turn % 28 AS INT)) AS TIMESTAMP) AS created_at FROM conversations
"""
PROJECTIONS["fx_authors"] = """
SELECT c_custkey AS author_id, c_name AS name FROM customer
"""
PROJECTIONS["fx_query_rows"] = """
SELECT event_id AS id, concat(CASE event_type WHEN 'click' THEN ' select' WHEN 'view' THEN 'SELECT' WHEN 'signup' THEN 'insert' WHEN 'purchase' THEN 'Update' ELSE 'pragma' END, '  * from t', CAST(user_id % 7 AS VARCHAR(9)), chr(10), ' where k = 1') AS query,
       concat(event_type, CAST(user_id % 7 AS VARCHAR(9))) AS normalized_query, value AS duration, CASE WHEN user_id % 2 = 0 THEN 'primary' ELSE 'replica' END AS connection,
       CASE WHEN value > 100 THEN 'slow' WHEN event_type = 'error' THEN 'failed' WHEN event_id % 41 = 0 THEN 'odd' ELSE 'completed' END AS status, ts AS executed_at, concat('M', CAST(user_id % 3 AS VARCHAR(9))) AS model, 'get' AS method,
       CASE WHEN event_id % 37 = 0 THEN 'not json' ELSE concat('["', event_type, '", "x"]') END AS tags, concat('["t', CAST(user_id % 7 AS VARCHAR(9)), '"]') AS affected_tables FROM events
"""
PROJECTIONS["fx_logs"] = """
SELECT event_id AS id, ts AS logged_at, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' WHEN 'click' THEN 'info' WHEN 'view' THEN 'success' ELSE 'trace' END AS type, concat('src', CAST(user_id % 4 AS VARCHAR(9))) AS source,
       concat('proj', CAST(user_id % 6 AS VARCHAR(9))) AS project, concat('message ', props) AS message, '' AS stacktrace, concat('f', CAST(user_id % 9 AS VARCHAR(9)), '.ts') AS file FROM events
"""
PROJECTIONS["fx_errors"] = """
SELECT event_id AS id, CASE WHEN user_id % 3 = 0 THEN 'TypeError' ELSE 'RangeError' END AS type, concat('failed in ', CAST(user_id % 5 AS VARCHAR(9))) AS message,
       CASE event_id % 3 WHEN 0 THEN 'unresolved' WHEN 1 THEN 'resolved' ELSE 'ignored' END AS status, ts AS created_at FROM events WHERE event_type IN ('error', 'signup')
"""
PROJECTIONS["fx_deliveries"] = """
SELECT event_id AS id, CASE user_id % 4 WHEN 0 THEN 'email' WHEN 1 THEN 'sms' WHEN 2 THEN 'push' ELSE '' END AS channel, CASE event_type WHEN 'click' THEN 'sent' WHEN 'view' THEN 'delivered' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'pending' ELSE 'queued' END AS status, ts AS created_at FROM events
"""
PROJECTIONS["fx_sockets"] = """
SELECT event_id AS id, CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'connection' WHEN 'view' THEN 'success' ELSE 'disconnection' END AS type, CAST(user_id AS VARCHAR(20)) AS socket, ts AS created_at FROM events
"""
PROJECTIONS["fx_releases"] = """
SELECT p_partkey AS release_id, p_name AS version, CASE WHEN p_size % 3 = 0 THEN 'draft' ELSE 'published' END AS status, CAST(p_size AS BIGINT) AS downloads, CAST(make_date(2023, CAST(1 + p_partkey % 12 AS INT), CAST(1 + p_partkey % 28 AS INT)) AS TIMESTAMP) AS created_at FROM part
"""
PROJECTIONS["fx_deployments"] = """
SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'success' WHEN 1 THEN 'ready' WHEN 2 THEN 'failed' WHEN 3 THEN 'running' ELSE 'pending' END AS status, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_custkey % 600 AS DOUBLE) END AS duration, o_orderdate AS created_at FROM orders
"""
PROJECTIONS["fx_samples"] = """
SELECT event_id AS id, concat('org', CAST(user_id % 6 AS VARCHAR(9))) AS org, value AS pressure, ts AS sampled_at FROM events
"""
PROJECTIONS["fx_jobs"] = """
SELECT event_id AS id, concat('q', CAST(user_id % 4 AS VARCHAR(9))) AS queue, concat('Job', CAST(user_id % 9 AS VARCHAR(9))) AS name, CASE WHEN event_type = 'click' THEN 'processing' ELSE 'pending' END AS status, props AS payload, ts AS created_at FROM events WHERE event_type <> 'error'
"""
PROJECTIONS["fx_failed_jobs"] = """
SELECT event_id AS id, concat('q', CAST(user_id % 4 AS VARCHAR(9))) AS queue, concat('Job', CAST(user_id % 9 AS VARCHAR(9))) AS name, concat('boom ', CAST(user_id AS VARCHAR(20))) AS error, props AS payload, ts AS failed_at FROM events WHERE event_type = 'error'
"""

PROJECTIONS["fx_clubs"] = """
SELECT CAST(substr(p_brand, 7) AS BIGINT) AS sport_id, min(p_partkey) AS team_id, p_name AS name, replace(p_name, ' ', '') AS search_key,
       concat('nick', CAST(min(p_partkey) AS VARCHAR(20))) AS nick
FROM part GROUP BY p_brand, p_name
"""
PROJECTIONS["fx_club_names"] = """
SELECT CAST(substr(p_brand, 7) AS BIGINT) AS sport_id, p_partkey, p_name AS club,
       CASE p_partkey % 6 WHEN 0 THEN concat(' ', upper(replace(p_name, ' ', '-')), '! ') WHEN 1 THEN concat('Royal ', p_name) WHEN 2 THEN substr(p_name, 1 + position(' ' IN p_name))
            WHEN 3 THEN concat(substr(p_name, 1 + position(' ' IN p_name)), ' ', substr(p_name, 1, position(' ' IN p_name) - 1)) WHEN 4 THEN concat('Nick', CAST(p_partkey AS VARCHAR(20))) ELSE concat(p_name, ' united') END AS name
FROM part
"""
# Records of few team pairs, many within hours of each other; some without a team, and some heard twice with another time.
PROJECTIONS["fx_feed_records"] = """
SELECT o_orderkey + 1000000000 * again AS position, concat('p', CAST(o_orderkey % 3 AS VARCHAR(9))) AS provider, concat('x', CAST(o_orderkey AS VARCHAR(20))) AS external_id,
       CAST(o_custkey % 2 AS BIGINT) AS sport_id, CASE WHEN o_custkey % 37 = 0 THEN NULL ELSE CAST(o_custkey % 3 AS BIGINT) END AS home_team_id, CAST((o_custkey * 7 + o_orderkey) % 3 AS BIGINT) AS away_team_id,
       CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) + INTERVAL 1 HOUR * CAST((o_custkey + o_orderkey) % 40 + 3 * again AS INT) AS commence_at
FROM orders, (SELECT 0 AS again UNION ALL SELECT 1) r WHERE again = 0 OR o_orderkey % 13 = 0
"""
PROJECTIONS["fx_known_events"] = """
SELECT o_orderkey AS event_id, CAST(o_custkey % 2 AS BIGINT) AS sport_id, CAST(o_custkey % 3 AS BIGINT) AS home_team_id, CAST((o_custkey * 7 + o_orderkey) % 3 AS BIGINT) AS away_team_id,
       CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) + INTERVAL 1 HOUR * CAST(o_custkey % 40 AS INT) AS commence_at
FROM orders WHERE o_orderkey % 5 = 0
"""
PROJECTIONS["fx_known_links"] = """
SELECT concat('p', CAST(o_orderkey % 3 AS VARCHAR(9))) AS provider, concat('x', CAST(o_orderkey AS VARCHAR(20))) AS external_id, o_orderkey AS event_id FROM orders WHERE o_orderkey % 20 = 0
UNION ALL SELECT concat('p', CAST((o_orderkey + 1) % 3 AS VARCHAR(9))), concat('y', CAST(o_orderkey AS VARCHAR(20))), o_orderkey FROM orders WHERE o_orderkey % 15 = 0
"""
PROJECTIONS["fx_ticker_rows"] = """
SELECT p_partkey AS id, concat(CASE p_partkey % 4 WHEN 0 THEN 'kxmlbtotal' WHEN 1 THEN 'KXMLBSPREAD' WHEN 2 THEN 'KXEPLGAME' ELSE 'SOLO' END, CASE WHEN p_partkey % 4 = 3 THEN '' ELSE concat('-26AUG', CAST(p_size AS VARCHAR(9)), 'SDAZ-', CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'DET' ELSE 'TIE' END,
         CASE WHEN p_partkey % 4 = 2 THEN '' ELSE CAST(p_size AS VARCHAR(9)) END) END) AS ticker,
       concat(p_name, CASE p_partkey % 3 WHEN 0 THEN ' vs ' WHEN 1 THEN ' v ' ELSE ' and ' END, p_type, CASE p_partkey % 2 WHEN 0 THEN ' Winner?' ELSE '' END) AS title, p_name, p_type, p_size,
       CASE p_partkey % 5 WHEN 0 THEN concat('Reg Time: ', upper(p_name)) WHEN 1 THEN 'Draw' WHEN 2 THEN p_type ELSE '' END AS subtitle,
       CASE p_partkey % 6 WHEN 0 THEN '€1.20bn' WHEN 1 THEN concat('€', CAST(p_size AS VARCHAR(9)), 'm') WHEN 2 THEN concat(CAST(p_size AS VARCHAR(9)), '.50k') WHEN 3 THEN '-' WHEN 4 THEN CAST(p_size * 1000 AS VARCHAR(9)) ELSE '' END AS value_text,
       CASE p_partkey % 8 WHEN 0 THEN 'Out for season (knee)' WHEN 1 THEN 'Questionable' WHEN 2 THEN 'Day-To-Day' WHEN 3 THEN '15-Day-IL' WHEN 4 THEN 'sore' WHEN 5 THEN '' WHEN 6 THEN 'Out' ELSE 'Probable' END AS injury
FROM part
"""
PROJECTIONS["fx_raw_trades"] = """
SELECT event_id, concat('T', CAST(event_id % 5000 AS VARCHAR(20))) AS trade_id, concat('M', CAST(user_id % 25 AS VARCHAR(9))) AS ticker, CASE WHEN event_id % 29 = 0 THEN 'n/a' ELSE CAST(1 + event_id % 40 AS VARCHAR(9)) END AS count_fp,
       concat('0.', CAST(10 + event_id % 80 AS VARCHAR(9))) AS yes_price_dollars, concat('0.', CAST(10 + event_id % 70 AS VARCHAR(9))) AS no_price_dollars, CASE event_id % 3 WHEN 0 THEN 'no' ELSE 'yes' END AS taker_side, ts AS created_at,
       CASE WHEN event_type = 'error' THEN 'SELL' ELSE 'BUY' END AS side, CASE event_id % 2 WHEN 0 THEN 'Yes' ELSE 'No' END AS outcome, CAST(1 + event_id % 40 AS DOUBLE) AS size, CAST(10 + event_id % 80 AS DOUBLE) / 100 AS price,
       concat('0xAB', CAST(user_id AS VARCHAR(20))) AS wallet, CASE WHEN user_id % 2 = 0 THEN '' ELSE concat('n', CAST(user_id AS VARCHAR(20))) END AS name
FROM events
"""

PROJECTIONS["fx_card_sales"] = """
SELECT o_orderkey AS card_id, o_custkey % 3 <> 0 AS is_active, o_totalprice AS initial_balance, o_totalprice / 3 AS current_balance, o_orderdate AS created_at FROM orders
"""

# Reference answers used only by the SQL oracles.
PROJECTIONS["ref_devig"] = """
WITH RECURSIVE quotes AS (
  SELECT s.market_id, o.bookmaker_id, o.selection_id, 1.0 / o.price AS q
  FROM fx_odds o JOIN fx_selections s ON s.selection_id = o.selection_id WHERE o.price > 1),
sets AS (
  SELECT market_id, bookmaker_id, list(q) AS qs, sum(q) AS total FROM quotes GROUP BY 1, 2 HAVING count(*) >= 2),
steps AS (
  SELECT market_id, bookmaker_id, qs, total, 0 AS i, CAST(1 AS DOUBLE) AS klo, CAST(10 AS DOUBLE) AS khi,
         CAST(0 AS DOUBLE) AS zlo, CAST(0.9 AS DOUBLE) AS zhi FROM sets
  UNION ALL
  SELECT market_id, bookmaker_id, qs, total, i + 1,
         CASE WHEN ksum > 1 THEN (klo + khi) / 2 ELSE klo END, CASE WHEN ksum > 1 THEN khi ELSE (klo + khi) / 2 END,
         CASE WHEN zsum > 1 THEN (zlo + zhi) / 2 ELSE zlo END, CASE WHEN zsum > 1 THEN zhi ELSE (zlo + zhi) / 2 END
  FROM (SELECT *, list_sum([pow(x, (klo + khi) / 2) FOR x IN qs]) AS ksum,
          list_sum([(sqrt(((zlo + zhi) / 2) * ((zlo + zhi) / 2) + 4 * (1 - (zlo + zhi) / 2) * x * x / total)
                     - (zlo + zhi) / 2) / (2 * (1 - (zlo + zhi) / 2)) FOR x IN qs]) AS zsum
        FROM steps WHERE i < 50) s),
solved AS (SELECT market_id, bookmaker_id, total, (klo + khi) / 2 AS k, (zlo + zhi) / 2 AS z FROM steps WHERE i = 50),
raw AS (
  SELECT v.*, q.selection_id, q.q, q.q / v.total AS mult, pow(q.q, v.k) AS p_raw,
         (sqrt(v.z * v.z + 4 * (1 - v.z) * q.q * q.q / v.total) - v.z) / (2 * (1 - v.z)) AS s_raw
  FROM solved v JOIN quotes q ON q.market_id = v.market_id AND q.bookmaker_id = v.bookmaker_id),
normed AS (
  SELECT market_id, bookmaker_id, selection_id, total AS overround, mult,
         CASE WHEN total <= 1 THEN mult ELSE p_raw / sum(p_raw) OVER w END AS power,
         CASE WHEN total <= 1 THEN mult ELSE s_raw / sum(s_raw) OVER w END AS shin
  FROM raw WINDOW w AS (PARTITION BY market_id, bookmaker_id))
SELECT *, max(greatest(mult, power, shin) - least(mult, power, shin)) OVER (PARTITION BY market_id, bookmaker_id) AS method_spread
FROM normed
"""
PROJECTIONS["ref_fair"] = """
WITH per_book AS (
  SELECT DISTINCT d.market_id, d.bookmaker_id, d.overround, b.sharp, greatest(0, b.consensus_weight) AS w
  FROM ref_devig d JOIN fx_books b ON b.bookmaker_id = d.bookmaker_id),
per_market AS (
  SELECT market_id, count(*) AS book_count, count(*) FILTER (WHERE sharp) AS sharp_book_count,
         avg(overround) AS avg_overround, sum(w) AS w_all, coalesce(sum(w) FILTER (WHERE sharp), 0) AS w_sharp
  FROM per_book GROUP BY 1),
acc AS (
  SELECT d.selection_id, d.market_id, sum(d.shin * p.w) AS shin, sum(d.mult * p.w) AS mult, sum(d.power * p.w) AS power,
         coalesce(sum(d.shin * p.w) FILTER (WHERE p.sharp), 0) AS sharp, max(d.method_spread) AS method_spread
  FROM ref_devig d JOIN per_book p ON p.market_id = d.market_id AND p.bookmaker_id = d.bookmaker_id GROUP BY 1, 2),
best AS (
  SELECT selection_id, price AS best_price, bookmaker_id AS best_bookmaker_id FROM (
    SELECT d.selection_id, d.bookmaker_id, o.price,
           row_number() OVER (PARTITION BY d.selection_id ORDER BY o.price DESC, d.bookmaker_id) AS rn
    FROM ref_devig d JOIN fx_odds o ON o.selection_id = d.selection_id AND o.bookmaker_id = d.bookmaker_id) t
  WHERE rn = 1),
blend AS (
  SELECT a.*, m.book_count, m.sharp_book_count, m.avg_overround, m.w_all, m.w_sharp,
         a.shin / m.w_all / sum(a.shin / m.w_all) OVER (PARTITION BY a.market_id) AS consensus
  FROM acc a JOIN per_market m ON m.market_id = a.market_id)
SELECT b.selection_id, b.market_id, least(0.999999, b.consensus) AS prob_consensus,
       CASE WHEN w_sharp > 0 THEN least(0.999999, sharp / w_sharp) ELSE 0 END AS prob_sharp,
       least(0.999999, mult / w_all) AS prob_multiplicative, least(0.999999, power / w_all) AS prob_power,
       least(0.999999, shin / w_all) AS prob_shin, method_spread, 1 / least(0.999999, consensus) AS fair_price,
       t.best_price, t.best_bookmaker_id, (t.best_price * least(0.999999, consensus) - 1) * 100 AS edge_pct,
       greatest(0, least(1, ((t.best_price - 1) * least(0.999999, consensus) - (1 - least(0.999999, consensus))) / (t.best_price - 1) * 0.25)) AS kelly_fraction,
       (avg_overround - 1) * 100 AS overround_pct, book_count, sharp_book_count
FROM blend b JOIN best t ON t.selection_id = b.selection_id
"""

PROJECTIONS["ref_scored"] = """
SELECT t.*, CASE WHEN m.status = 'settled' AND m.result <> '' THEN CASE WHEN t.side = m.result THEN 1 ELSE 0 END END AS is_winner
FROM fx_trades t LEFT JOIN fx_prediction_markets m ON m.market_id = t.market_id
"""
PROJECTIONS["ref_traders"] = """
SELECT *, CASE WHEN resolved_trade_count > 0 THEN winning_trade_count / resolved_trade_count ELSE 0 END AS win_rate,
       greatest(0, least(100, floor(((winning_trade_count + 3) / (resolved_trade_count + 6) - 0.5) * 2000 + 0.5) / 10)) AS smart_score,
       max_trade_size >= 10000 OR total_notional >= 100000 AS is_whale
FROM (SELECT trader_id, count(*) AS trade_count, sum(notional) AS total_notional, avg(notional) AS avg_trade_size,
        max(notional) AS max_trade_size, count(is_winner) AS resolved_trade_count, count(*) FILTER (WHERE is_winner = 1) AS winning_trade_count
      FROM ref_scored WHERE trader_id IS NOT NULL GROUP BY 1) t
"""
PROJECTIONS["ref_flow"] = """
WITH u AS (SELECT * FROM fx_prediction_markets WHERE status = 'open' AND last_price > 0.02 AND last_price < 0.98),
w AS (
  SELECT t.*, coalesce(r.smart_score, 0) / 100 AS weight, t.traded_at >= n.at - INTERVAL 4 HOUR AS trend, t.traded_at >= n.at - INTERVAL 12 HOUR AS late
  FROM ref_scored t JOIN u ON u.market_id = t.market_id LEFT JOIN ref_traders r ON r.trader_id = t.trader_id,
       (SELECT max(traded_at) AS at FROM fx_trades) n WHERE t.traded_at >= n.at - INTERVAL 24 HOUR),
sides AS (
  SELECT market_id, side, count(*) AS fills, sum(notional) AS notional, sum(notional * weight) AS smart, count(is_winner) AS resolved,
         count(*) FILTER (WHERE is_winner = 1) AS wins, avg(price) AS price_mean, coalesce(avg(price) FILTER (WHERE trend), 0) AS price_recent
  FROM w GROUP BY 1, 2),
tot AS (
  SELECT market_id, count(*) AS total_fills, sum(notional) AS total_notional, sum(notional * weight) AS smart_total,
         coalesce(avg(price) FILTER (WHERE NOT late), 0) AS early_price, coalesce(avg(price) FILTER (WHERE late), 0) AS late_price,
         count(*) FILTER (WHERE late) AS late_fills
  FROM w GROUP BY 1),
lead AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY notional DESC, side) AS rn FROM sides) s WHERE rn = 1)
SELECT t.market_id, u.venue, u.question, u.category, u.liquidity, u.last_price, l.side,
       CASE WHEN l.side = 'yes' THEN u.last_price ELSE 1 - u.last_price END AS market_price, t.total_fills, t.total_notional, t.smart_total,
       l.fills AS side_fills, l.notional AS side_notional, l.smart AS side_smart, l.resolved AS side_resolved, l.wins AS side_wins,
       l.price_mean AS side_price_mean, l.price_recent AS side_price_recent, t.early_price, t.late_price, t.late_fills
FROM tot t JOIN lead l ON l.market_id = t.market_id JOIN u ON u.market_id = t.market_id WHERE t.total_fills >= 8 AND t.total_notional > 0
"""
PROJECTIONS["ref_pairs"] = """
WITH live AS (SELECT * FROM fx_prediction_markets WHERE status = 'open' AND last_price > 0)
SELECT market_id, other_price, other_venue FROM (
  SELECT m.market_id, o.last_price AS other_price, o.venue AS other_venue, row_number() OVER (PARTITION BY m.market_id ORDER BY o.market_id) AS rn
  FROM fx_prediction_markets m JOIN live o ON o.question = m.question AND o.venue <> m.venue) t WHERE rn = 1
"""
PROJECTIONS["ref_evidence"] = """
WITH s AS (SELECT *, side_notional / total_notional AS share, (late_price - early_price) * CASE WHEN side = 'yes' THEN 1 ELSE -1 END AS move FROM ref_flow),
x AS (SELECT s.*, CASE WHEN side = 'yes' THEN p.other_price ELSE 1 - p.other_price END - market_price AS gap FROM s LEFT JOIN ref_pairs p ON p.market_id = s.market_id),
raw AS (
  SELECT market_id, 'flow_imbalance' AS kind, share AS v, (share - market_price) * 0.10 AS c, total_fills AS sample_size, 24 AS window_hours, 4 AS places FROM s
  UNION ALL SELECT market_id, 'smart_money', side_smart / smart_total, (side_smart / smart_total - market_price) * 0.18, total_fills, 24, 4 FROM s WHERE smart_total > 0
  UNION ALL SELECT market_id, 'trader_accuracy', (side_wins + 3) / (side_resolved + 6), ((side_wins + 3) / (side_resolved + 6) - 0.5) * 0.20, side_resolved, 24, 4 FROM s WHERE side_resolved > 0
  UNION ALL SELECT market_id, 'price_trend', side_price_recent - side_price_mean, (side_price_recent - side_price_mean) * 0.25, side_fills, 24, 4 FROM s WHERE side_price_recent > 0 AND side_price_mean > 0
  UNION ALL SELECT market_id, 'liquidity', liquidity, 0, 1, 24, 2 FROM s
  UNION ALL SELECT market_id, 'reverse_line_move', move, move * 0.5, late_fills, 24, 4 FROM s
    WHERE early_price > 0 AND late_price > 0 AND late_fills >= 4 AND share - 0.5 > 0.1 AND move < -0.005
  UNION ALL SELECT market_id, 'cross_venue', gap, gap * 0.35, 1, 24, 4 FROM x WHERE gap IS NOT NULL)
SELECT market_id, kind, floor(v * pow(10, places) + 0.5) / pow(10, places) AS value,
       floor(greatest(-0.08, least(0.08, c)) * 10000 + 0.5) / 10000 AS contribution, CAST(sample_size AS BIGINT) AS sample_size,
       CAST(window_hours AS BIGINT) AS window_hours
FROM raw
"""
PROJECTIONS["ref_candidates"] = """
WITH agg AS (SELECT market_id, greatest(-0.15, least(0.15, sum(contribution))) AS total, count(*) FILTER (WHERE contribution <> 0) AS n,
               count(*) FILTER (WHERE contribution > 0) AS pos FROM ref_evidence GROUP BY 1),
f AS (SELECT r.*, a.n, a.pos, greatest(0.01, least(0.99, r.market_price + a.total)) AS fair FROM ref_flow r JOIN agg a ON a.market_id = r.market_id)
SELECT market_id, venue, question, category, side, liquidity, floor(market_price * 10000 + 0.5) / 10000 AS market_price,
       floor(fair * 10000 + 0.5) / 10000 AS fair_value, floor((fair - market_price) * 10000 + 0.5) / 10000 AS edge,
       CASE WHEN n > 0 THEN floor((greatest(pos, n - pos) / n * 0.5 + total_fills / (total_fills + 90.0) * 0.3 + least(1, n / 3) * 0.2) * 1000 + 0.5) / 1000 ELSE 0 END AS confidence
FROM f
"""

# The same chain for fills some of whose results are known while their market is still open.
for _name in ("ref_scored", "ref_traders", "ref_flow", "ref_pairs", "ref_evidence"):
    PROJECTIONS[_name.replace("ref_", "ref_known_")] = PROJECTIONS[_name].replace("ref_", "ref_known_")
PROJECTIONS["fx_known_fills"] = """
SELECT *, CASE trade_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS is_winner FROM fx_trades
"""
PROJECTIONS["ref_known_scored"] = """
SELECT t.* REPLACE (coalesce(t.is_winner, CASE WHEN m.status = 'settled' AND m.result <> '' THEN CASE WHEN t.side = m.result THEN 1 ELSE 0 END END) AS is_winner)
FROM fx_known_fills t LEFT JOIN fx_prediction_markets m ON m.market_id = t.market_id
"""


def _uses(sql: str) -> list[str]:
    return [name for name in dict.fromkeys(re.findall(r"\b(?:fx|ref)_\w+", sql)) if name in PROJECTIONS]


def _ordered(sql: str, seen: dict[str, None]) -> dict[str, None]:
    for name in _uses(sql):
        if name not in seen:
            _ordered(PROJECTIONS[name], seen)
            seen[name] = None
    return seen


def with_projections(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the CTEs of every projection it uses."""
    ctes = dict(extra or {})
    for name in _ordered(sql, {}):
        ctes[name] = PROJECTIONS[name].strip()
    if not ctes:
        return sql
    body = ",\n".join(f"{name} AS (\n{text}\n)" for name, text in ctes.items())
    return f"WITH {body}\n{sql}"


class Tables:
    """Loads base tables and projections of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        # Read parquet timestamps as instants so that filters on them reach the scan without a cast.
        spark.conf.set("spark.sql.parquet.inferTimestampNTZ.enabled", "false")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, sql: str) -> DataFrame:
        text = with_projections(sql)
        base = {
            name: f"SELECT * FROM parquet.`{self.sf_dir}/{name}.parquet`"
            for name in BASE_TABLES
            if re.search(rf"\b{name}\b", text)
        }
        return self.spark.sql(with_projections(sql, base))

    def __call__(self, name: str) -> DataFrame:
        if name in PROJECTIONS:
            return self.sql(f"SELECT * FROM {name}")
        return self.table(name)

    def scalar(self, sql: str) -> Column:
        """A one-value subquery usable as a column; Spark runs it once per query."""
        return self.sql(sql).scalar()
