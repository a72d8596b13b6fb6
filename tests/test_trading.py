"""Tape, candidates, admission, accrual and reconciliation cases."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marketlens.operators import decisions as D
from marketlens.operators import positions, settle, tape
from marketlens.session import cut
from marketlens.sources import tapes

NOW = datetime(2024, 5, 1, 12)
FILL = "venue string, external_id string, market_id bigint, trader_id bigint, side string, notional double, is_winner int"


def test_nine_fill_tape(spark):
    fills = [("a", f"t{i}", 1 + i % 2, 1, "yes" if i % 3 else "no", 100.0, None) for i in range(6)]
    fills += [("a", "t0", 1, 1, "no", 100.0, None), ("a", "anon", 1, None, "yes", 50.0, None), ("b", "big", 2, 2, "yes", 15000.0, None)]
    markets = spark.createDataFrame([(1, "settled", "yes"), (2, "open", "")], "market_id bigint, status string, result string")
    unique = tapes.deduplicate_trades(spark.createDataFrame(fills, FILL))
    assert unique.count() == 8
    rows = {r["trader_id"]: r for r in tape.trader_scores(tape.score_fills(unique, markets)).collect()}
    assert set(rows) == {1, 2}
    assert rows[1]["trade_count"] == 6 and rows[1]["resolved_trade_count"] == 3
    assert rows[1]["winning_trade_count"] == 2
    assert rows[1]["smart_score"] == pytest.approx(round(((2 + 3) / (3 + 6) - 0.5) * 200, 1))
    assert rows[2]["is_whale"] and not rows[1]["is_whale"] and rows[2]["win_rate"] == 0


def admit(queue, slots, budget):
    out = set()
    for d in sorted(queue, key=lambda d: (-d[2], -d[3], d[1])):
        if slots > 0 and d[4] <= budget:
            out.add(d[1])
            slots -= 1
            budget -= d[4]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_risk_admission_matches_replay(spark, seed):
    rng = random.Random(seed)
    rows = [
        (1 if rng.random() < 0.6 else rng.randint(2, 4), i, rng.randint(0, 20) / 20, rng.randint(-5, 5) / 100, float(rng.randint(1, 40)))
        for i in range(400)
    ]
    queue = spark.createDataFrame(rows, "strategy_id bigint, decision_id bigint, confidence double, edge double, notional double").repartition(7)
    plans = {1: (9, 150.0), 2: (3, 500.0), 3: (50, 60.0), 4: (0, 100.0)}
    strategies = spark.createDataFrame([(s, c + 1, b + 20.0) for s, (c, b) in plans.items()], "strategy_id bigint, max_open_positions bigint, bankroll double")
    exposure = spark.createDataFrame([(s, 1, 20.0) for s in plans], "strategy_id bigint, open_positions bigint, committed double")
    out = D.risk_admission(queue, strategies, exposure)
    assert out.count() == len(rows)
    got = {r["decision_id"] for r in out.filter("admitted").collect()}
    want = set()
    for s, (slots, budget) in plans.items():
        want |= admit([r for r in rows if r[0] == s], slots, budget)
    assert got == want


def test_risk_admission_of_falling_costs(spark, monkeypatch):
    """One strategy's long line, where each admitted cost makes room for the next smaller one only."""
    rounds = []
    monkeypatch.setattr(D, "cut", lambda df: rounds.append(1) or cut(df))
    rows = [(1, i, 0.5, 0.0, (4000 - i) / 4) for i in range(4000)] + [(2, 5000 + i, 0.1 * i, 0.0, 0.1) for i in range(9)]
    queue = spark.createDataFrame(rows, "strategy_id bigint, decision_id bigint, confidence double, edge double, notional double").repartition(5)
    strategies = spark.createDataFrame([(1, 40, 1700.0), (2, 9, 0.3)], "strategy_id bigint, max_open_positions bigint, bankroll double")
    exposure = spark.createDataFrame([(1, 0, 0.0), (2, 0, 0.0)], "strategy_id bigint, open_positions bigint, committed double")
    out = D.risk_admission(queue, strategies, exposure)
    assert "Python" not in out._jdf.queryExecution().toString()
    got = {r["decision_id"] for r in out.filter("admitted").collect()}
    cents = [(s, i, c, e, round(n * 100)) for s, i, c, e, n in rows]
    assert got == admit([r for r in cents if r[0] == 1], 40, 170000) | admit([r for r in cents if r[0] == 2], 9, 30)
    assert len(rounds) <= 12


def test_fills_are_booked_once(spark):
    schema = "order_id bigint, report_seq bigint, strategy_id bigint, market_id bigint, side string, filled_size double, avg_fill_price double"
    rows = [(1, 1, 1, 1, "yes", 10.0, 0.5), (1, 2, 1, 1, "yes", 10.0, 0.9), (1, 3, 1, 1, "yes", 30.0, 0.6), (1, 4, 1, 1, "yes", 20.0, 0.1), (2, 1, 1, 1, "yes", 5.0, 0.4)]
    got = positions.accrue_positions(spark.createDataFrame(rows, schema), ["strategy_id", "market_id", "side"]).collect()[0]
    assert got["size"] == 35 and got["cost_basis"] == pytest.approx(30 * 0.6 + 5 * 0.4)
    booked = positions.booked_orders(spark.createDataFrame(rows[:2], schema), [])
    late = positions.fill_increments(spark.createDataFrame(rows[1:4], schema), booked).collect()
    assert len(late) == 1 and late[0]["delta_size"] == 20 and late[0]["delta_cost"] == pytest.approx(18 - 5)


def test_reconcile_rules(spark):
    old, new = NOW - timedelta(minutes=50), NOW - timedelta(minutes=5)
    orders = [(i, i, "open", 0.0, at) for i, at in ((1, old), (2, old), (3, new), (4, new), (5, new), (6, old))]
    df = spark.createDataFrame(orders, "order_id bigint, decision_id bigint, status string, filled_size double, placed_at timestamp")
    reports = [(1, 1, "open", 0.0, 0.0), (2, 1, "partial", 3.0, 0.5), (3, 1, "open", 0.0, 0.0), (4, 1, "open", 0.0, 0.0), (4, 2, "filled", 9.0, 0.4), (5, 1, "open", 2.0, 0.4), (5, 2, "not_found", None, None)]
    rep = spark.createDataFrame(reports, "order_id bigint, report_seq bigint, status string, filled_size double, avg_fill_price double")
    got = {r["order_id"]: r for r in D.order_reconcile(df, rep, F.lit(NOW)).collect()}
    assert got[1]["new_status"] == "cancelled" and got[1]["expired"] and got[1]["decision_expired"]
    assert got[2]["new_status"] == "partial" and got[2]["expired"] and not got[2]["decision_expired"]
    assert not got[3]["changed"]
    assert got[4]["new_status"] == "filled" and got[4]["new_filled_size"] == 9
    assert got[5]["new_status"] == "cancelled" and got[5]["note"] and got[5]["new_filled_size"] == 0
    assert 6 not in got  # nothing was heard of it
    owned = df.withColumn("strategy_id", F.col("order_id") % 2)
    accounts = spark.createDataFrame([(0, True), (1, False)], "strategy_id bigint, active boolean")
    assert {r["order_id"] for r in D.order_reconcile(owned, rep, F.lit(NOW), accounts).collect()} == {2, 4}


def test_fills_after_a_settlement_start_a_new_position(spark):
    schema = "order_id bigint, report_seq bigint, strategy_id bigint, market_id bigint, side string, filled_size double, avg_fill_price double, reported_at timestamp"
    rows = [(1, 1, 1, 1, "yes", 10.0, 0.5, NOW - timedelta(days=2)), (1, 2, 1, 1, "yes", 30.0, 0.6, NOW), (2, 1, 1, 1, "yes", 5.0, 0.4, NOW), (3, 1, 1, 2, "yes", 4.0, 0.5, NOW)]
    settled = spark.createDataFrame([(1, NOW - timedelta(days=1))], "market_id bigint, settled_at timestamp")
    got = positions.accrue_positions(spark.createDataFrame(rows, schema), ["strategy_id", "market_id", "side"], settled).collect()
    sums = {(r["market_id"], r["after_settlement"]): (r["size"], round(r["cost_basis"], 6), r["orders"]) for r in got}
    assert sums == {(1, False): (10.0, 5.0, 1), (1, True): (25.0, 15.0, 2), (2, False): (4.0, 2.0, 1)}


def test_stake_is_capped(spark):
    df = spark.createDataFrame([(0.5, 0.6, 1.0, 1000.0, 20.0), (0.5, 0.6, 0.5, 100.0, 99.0), (0.5, 0.4, 1.0, 100.0, 99.0)], "p double, f double, c double, b double, m double")
    got = [r[0] for r in df.select(D.stake(*[F.col(c) for c in "pfcbm"])).collect()]
    assert got == pytest.approx([20.0, 2.5, 0.0], abs=0.011)


def test_grades(spark):
    rows = [
        ("h2h", "home", None, 2, 1, "home", 1), ("h2h", "away", None, 1, 1, "draw", 0), ("h2h", "draw", None, 1, 1, "draw", 1),
        ("spreads", "home", -1.0, 2, 1, "home", 2), ("spreads", "away", 1.5, 2, 1, "home", 1), ("spreads", "home", None, 2, 1, "home", None),
        ("totals", "over", 2.5, 2, 1, "home", 1), ("totals", "under", 3.0, 2, 1, "home", 2), ("totals", "under", 2.5, 2, 1, "home", 0), ("other", "x", 1.0, 2, 1, "home", None),
    ]
    df = spark.createDataFrame(rows, "t string, s string, p double, h int, a int, w string, want int")
    got = df.select("want", settle.grade(*[F.col(c) for c in ("t", "s", "p", "h", "a", "w")]).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def test_pairs_pick_one_market_per_question(spark):
    rows = [(i, "a", "q", "open", 0.4) for i in range(1, 50)] + [(100, "b", "q", "open", 0.5), (101, "b", "q", "open", 0.9), (102, "c", "r", "open", 0.1)]
    df = spark.createDataFrame(rows, "market_id bigint, venue string, question string, status string, last_price double")
    got = {r["market_id"]: r["other_market_id"] for r in tape.cross_venue_pairs(df).collect()}
    assert len(got) == 51 and got[7] == 100 and got[101] == 1 and 102 not in got
