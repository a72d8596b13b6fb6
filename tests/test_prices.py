"""Price formats and margin removal on literal cases, and against a plain restatement of the formulas."""

import math
import random

import pytest
from pyspark.sql import functions as F

from marketlens.functions import prices as P
from marketlens.operators import fair


def solve(f, low, high):
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) > 1 else (low, mid)
    return (low + high) / 2


def expected(prices):
    q = [1 / p if p > 1 else 0.0 for p in prices]
    total = sum(q)
    mult = [x / total for x in q]
    if total <= 1:
        return mult, mult, mult
    k = solve(lambda k: sum(x**k for x in q), 1, 10)
    power = [x**k for x in q]

    def shin(z):
        return [(math.sqrt(z * z + 4 * (1 - z) * x * x / total) - z) / (2 * (1 - z)) for x in q]

    s = shin(solve(lambda z: sum(shin(z)), 0, 0.9))
    return mult, [p / sum(power) for p in power], [p / sum(s) for p in s]


CASES = [[1.91, 1.91], [1.05, 15.0], [2.4, 3.5, 3.1], [2.2, 2.2], [1.01, 1.02, 1.03], [1.5] * 12, [1.01, 900.0, 2.0]]
rng = random.Random(7)
CASES += [[round(rng.uniform(1.02, 12), 2) for _ in range(rng.randint(2, 9))] for _ in range(40)]


def test_devig_matches_formulas(spark):
    rows = [(m, 1, m * 100 + i, p) for m, case in enumerate(CASES) for i, p in enumerate(case)]
    quotes = spark.createDataFrame(rows, "market_id bigint, bookmaker_id bigint, selection_id bigint, price double")
    got = {r["selection_id"]: r for r in fair.devig(quotes).collect()}
    for m, case in enumerate(CASES):
        mult, power, shin = expected(case)
        for i in range(len(case)):
            row = got[m * 100 + i]
            assert row["multiplicative"] == pytest.approx(mult[i], abs=1e-9)
            assert row["power"] == pytest.approx(power[i], abs=1e-7)
            assert row["shin"] == pytest.approx(shin[i], abs=1e-7)
        assert sum(got[m * 100 + i]["shin"] for i in range(len(case))) == pytest.approx(1.0)


def test_one_sided_market_is_not_devigged(spark):
    quotes = spark.createDataFrame([(1, 1, 1, 1.9)], "market_id bigint, bookmaker_id bigint, selection_id bigint, price double")
    assert fair.devig(quotes).count() == 0


def test_formats(spark):
    df = spark.createDataFrame([(2.5,), (1.5,), (1.91,), (2.0,), (1.0,), (3.4,)], "price double")
    rows = df.select(
        "price",
        P.american_number(F.col("price")).alias("a"),
        P.american_text(F.col("price")).alias("t"),
        P.fractional_price(F.col("price")).alias("f"),
    ).collect()
    got = {r["price"]: (r["a"], r["t"], r["f"]) for r in rows}
    assert got[2.5] == (150, "+150", "3/2")
    assert got[1.5] == (-200, "-200", "1/2")
    assert got[2.0] == (100, "+100", "1/1")
    assert got[1.0] == (0, "+0", "0/1")
    assert got[3.4][2] == "12/5"
    assert got[1.91][0] == -110


def test_american_forms(spark):
    df = spark.createDataFrame([(150.0,), (-110.0,), (50.0,), (-50.0,), (0.0,)], "a double")
    rows = df.select("a", P.american_to_decimal(F.col("a")).alias("s"), P.american_to_decimal(F.col("a"), strict=False).alias("l"))
    got = {r["a"]: (r["s"], r["l"]) for r in rows.collect()}
    assert got[150.0] == (2.5, 2.5)
    assert got[-110.0][0] == pytest.approx(1.9090909)
    assert got[50.0] == (0.0, 1.5) and got[-50.0] == (0.0, 3.0) and got[0.0] == (0.0, 0.0)


def test_kelly_never_negative(spark):
    df = spark.createDataFrame([(2.0, 0.6), (2.0, 0.4), (1.0, 0.9), (3.0, 1.0)], "price double, p double")
    got = [r[0] for r in df.select(P.kelly_stake(F.col("price"), F.col("p"))).collect()]
    assert got == pytest.approx([0.05, 0.0, 0.0, 0.0])


def test_fair_prices_blend(spark):
    odds = spark.createDataFrame(
        [(1, 1, 1.9), (2, 1, 1.9), (1, 2, 2.1), (2, 2, 1.8), (1, 3, 5.0)], "selection_id bigint, bookmaker_id bigint, price double"
    )
    sides = spark.createDataFrame([(1, 1), (2, 1)], "selection_id bigint, market_id bigint")
    books = spark.createDataFrame([(1, True, 3.0), (2, False, 1.0), (3, False, 1.0)], "bookmaker_id bigint, sharp boolean, consensus_weight double")
    rows = {r["selection_id"]: r for r in fair.fair_prices(odds, sides, books).collect()}
    _, _, second = expected([2.1, 1.8])
    assert rows[1]["prob_consensus"] == pytest.approx((0.5 * 3 + second[0]) / 4)
    assert rows[1]["prob_consensus"] + rows[2]["prob_consensus"] == pytest.approx(1.0)
    assert rows[1]["prob_sharp"] == pytest.approx(0.5)
    # The one-sided book takes no part, not even as best price.
    assert rows[1]["best_price"] == 2.1 and rows[1]["best_bookmaker_id"] == 2
    assert rows[1]["book_count"] == 2 and rows[1]["sharp_book_count"] == 1
