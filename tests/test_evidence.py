"""Each signal fires on the right rows with the right sign, and candidates add them up."""

import pytest
from pyspark.sql import functions as F

from marketlens.functions.common import number_text
from marketlens.operators import evidence as E

COLUMNS = (
    "market_id bigint, venue string, question string, category string, liquidity double, last_price double, side string, market_price double, "
    "total_fills bigint, total_notional double, smart_total double, side_fills bigint, side_notional double, side_smart double, side_resolved bigint, "
    "side_wins bigint, side_price_mean double, side_price_recent double, early_price double, late_price double, late_fills bigint"
)
ROWS = [
    (1, "a", "q", "c", 100.0, 0.5, "yes", 0.5, 100, 1000.0, 10.0, 60, 800.0, 9.0, 14, 12, 0.50, 0.54, 0.55, 0.50, 30),
    (2, "a", "r", "c", 50.0, 0.5, "no", 0.5, 10, 100.0, 0.0, 5, 55.0, 0.0, 0, 0, 0.50, 0.0, 0.50, 0.55, 2),
]


@pytest.fixture(scope="module")
def flow(spark):
    return spark.createDataFrame(ROWS, COLUMNS)


def signal(flow, item):
    return {r["market_id"]: (r["value"], r["contribution"], r["sample_size"]) for r in E.signal_rows(flow, item).collect()}


def test_tape_signals(flow):
    assert signal(flow, E.flow_imbalance()) == {1: (0.8, 0.03, 100), 2: (0.55, 0.005, 10)}
    assert signal(flow, E.smart_money()) == {1: (0.9, 0.072, 100)}
    # (12 + 3) / (14 + 6) = 0.75 on the winning record; a side without settled fills stays silent.
    assert signal(flow, E.trader_accuracy()) == {1: (0.75, 0.05, 14)}
    assert signal(flow, E.price_trend()) == {1: (0.04, 0.01, 60)}
    assert signal(flow, E.reverse_line()) == {1: (-0.05, -0.025, 30)}
    assert signal(flow, E.liquidity())[2] == (50.0, 0.0, 1)


def test_context_signals(flow):
    cross = flow.withColumn("other_price", F.lit(0.7)).withColumn("other_venue", F.lit("b"))
    assert signal(cross, E.cross_venue()) == {1: (0.2, 0.07, 1), 2: (-0.2, -0.07, 1)}
    ladder = flow.select(
        "*", F.lit(0.12).alias("ladder_gap"), F.lit(0.6).alias("ladder_price"), F.lit(0.48).alias("versus_price"), F.lit(15.0).alias("versus_strike")
    )
    assert signal(ladder, E.ladder_signal()) == {1: (0.12, -0.08, 2), 2: (0.12, 0.08, 2)}
    steam = flow.select("*", F.lit(1.0).alias("steam_score"), F.lit(-3.0).alias("move_from_open_pct"), F.lit("home").alias("outcome"))
    assert signal(steam, E.steam_signal()) == {1: (1.0, 0.05, 1), 2: (1.0, -0.05, 1)}
    tie = steam.withColumn("outcome", F.lit("tie"))
    assert signal(tie, E.steam_signal()) == {}


def test_candidate_sums_its_evidence(flow):
    rows = {r["market_id"]: r for r in E.score_candidates(flow).collect()}
    one = rows[1]
    total = 0.03 + 0.072 + 0.05 + 0.01 - 0.025
    assert one["fair_value"] == pytest.approx(0.5 + total, abs=1e-4)
    assert one["edge"] == pytest.approx(total, abs=1e-4)
    assert one["confidence"] == pytest.approx(round(4 / 5 * 0.5 + 100 / 190 * 0.3 + 0.2, 3), abs=1e-3)
    assert [r["market_id"] for r in E.build_candidates(flow, min_edge=0.05).collect()] == [1]


def test_numbers_in_text(spark):
    rows = spark.createDataFrame([(101.0,), (12345678.5,), (0.0,), (2.25,), (-3.1,)], "x double")
    assert [r[0] for r in rows.select(number_text(F.col("x"))).collect()] == ["101", "12345678.5", "0", "2.25", "-3.1"]
