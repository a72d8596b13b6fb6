"""Ordered scans cut into segments must equal a scan over the whole key, also when one key dominates."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marketlens.operators import movement, positions, schedule
from marketlens.operators.evidence import ladder_incoherence

BASE = datetime(2024, 1, 1)


def hot_log(n=600):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        selection = 1 if rng.random() < 0.5 else rng.randint(2, 9)
        at = BASE + timedelta(minutes=rng.randint(0, 60 * 24 * 9), seconds=i % 60)
        rows.append((i, selection, rng.randint(1, 2), rng.choice([1.5, 1.6, 1.7, 1.8]), at))
    return rows


SCHEMA = "id bigint, selection_id bigint, bookmaker_id bigint, price double, captured_at timestamp"


def series(rows):
    out = defaultdict(list)
    for row in sorted(rows, key=lambda r: (r[4], r[0])):
        out[(row[1], row[2])].append(row)
    return out


def test_replay_changes(spark):
    rows = hot_log()
    want = set()
    for line in series(rows).values():
        last = None
        for row in line:
            if last is None or row[3] != last:
                want.add((row[0], last is None))
            last = row[3]
    got = {(r["id"], r["is_opening"]) for r in movement.replay_changes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def test_direction_changes(spark):
    rows = hot_log()
    want = {}
    for key, line in series(rows).items():
        flips, last = 0, 0
        for a, b in zip(line, line[1:]):
            d = (b[3] > a[3]) - (b[3] < a[3])
            if d:
                flips += last not in (0, d)
                last = d
        want[key] = flips
    got = {
        (r["selection_id"], r["bookmaker_id"]): r["direction_changes"]
        for r in movement.direction_changes(spark.createDataFrame(rows, SCHEMA)).collect()
    }
    assert got == want


def test_drawdown(spark):
    rng = random.Random(5)
    rows = [(i, 1 if i % 3 else 2, "settled", 10.0, round(rng.uniform(-9, 9), 2), BASE + timedelta(hours=5 * i)) for i in range(200)]
    df = spark.createDataFrame(rows, "position_id bigint, strategy_id bigint, status string, cost_basis double, realized_pnl double, settled_at timestamp")
    got = {r["strategy_id"]: r["max_drawdown"] for r in positions.strategy_performance(df).collect()}
    for strategy in (1, 2):
        run = peak = worst = 0.0
        for row in rows:
            if row[1] == strategy:
                run += row[4]
                peak = max(peak, run)
                worst = max(worst, peak - run)
        assert got[strategy] == pytest.approx(worst, abs=0.006)


def test_no_settled_position_has_no_drawdown(spark):
    df = spark.createDataFrame(
        [(1, 1, "open", 5.0, None, None)],
        "position_id bigint, strategy_id bigint, status string, cost_basis double, realized_pnl double, settled_at timestamp",
    )
    row = positions.strategy_performance(df).collect()[0]
    assert row["max_drawdown"] == 0 and row["hit_rate"] is None and row["roi"] is None and row["open_positions"] == 1


def test_schedule_context(spark):
    rng = random.Random(11)
    games = [(i, rng.randint(1, 2) if i % 2 else 1, rng.randint(3, 5), BASE + timedelta(hours=rng.randint(0, 24 * 60))) for i in range(80)]
    df = spark.createDataFrame(games, "event_id bigint, home_team_id bigint, away_team_id bigint, commence_at timestamp")
    got = {(r["event_id"], r["side"]): r for r in schedule.schedule_context(df).collect()}
    assert len(got) == 160
    for event, home, away, at in games:
        for side, team in (("home", home), ("away", away)):
            past = [g[3] for g in games if team in (g[1], g[2]) and g[3] < at]
            row = got[(event, side)]
            if past:
                assert row["rest_days"] == pytest.approx((at - max(past)).total_seconds() / 86400)
            else:
                assert row["rest_days"] is None and not row["back_to_back"]
            assert row["games_in_window"] == sum(p >= at - timedelta(days=7) for p in past)


def test_schedule_edge_is_symmetric(spark):
    rows = [(1, "home", 1, 1.0, 3, True), (1, "away", 2, 4.0, 1, False), (2, "home", 2, 4.0, 1, False), (2, "away", 1, 1.0, 3, True)]
    df = spark.createDataFrame(rows, "event_id bigint, side string, team_id bigint, rest_days double, games_in_window bigint, back_to_back boolean")
    got = {r["event_id"]: r for r in schedule.schedule_edge(df).collect()}
    assert got[1]["edge"] == pytest.approx(-got[2]["edge"]) and got[1]["edge"] < 0
    assert got[1]["confidence"] == pytest.approx(1.0)
    assert "Home on a back-to-back" in got[1]["reasons"]


def test_ladder(spark):
    rungs = [("T", "G1", 1, 14.0, 0.50), ("T", "G1", 2, 15.0, 0.62), ("T", "G1", 3, 16.0, 0.40), ("T", "G2", 4, 14.0, 0.3), ("T", "G2", 5, 15.0, 0.305)]
    rungs += [("T", "G1", 6, 17.0, 0.0), ("T", "G1", 7, None, 0.9)]
    df = spark.createDataFrame(rungs, "series string, fixture string, market_id bigint, strike double, price double")
    got = ladder_incoherence(df, ["series", "fixture"]).collect()
    assert [(r["market_id"], r["versus_market_id"], round(r["gap"], 6)) for r in got] == [(2, 1, 0.12)]


def test_movement_reference_book(spark):
    rows = [(i, 1, 1, p, BASE + timedelta(hours=h)) for i, (h, p) in enumerate([(0, 2.0), (20, 1.9), (23, 1.8)])]
    rows += [(10 + i, 1, 2, p, BASE + timedelta(hours=h)) for i, (h, p) in enumerate([(21, 2.1), (23, 2.0)])]
    df = spark.createDataFrame(rows, SCHEMA)
    row = movement.movement_features(df, F.lit(BASE + timedelta(hours=24))).collect()[0]
    assert row["reference_book"] == 1 and row["open_price"] == 2.0 and row["current_price"] == 1.8
    assert row["velocity_pct_per_hour"] == pytest.approx((1.8 / 1.9 - 1) * 100 / 3)
    assert row["steam_score"] == pytest.approx(1.0)
    assert row["direction_changes"] == 0 and row["price_std_dev"] == pytest.approx(0.1414213, abs=1e-6)
