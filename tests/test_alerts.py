"""Alerts against subscriptions: pairs by bands of floors, and cooldowns of lines of alerts."""

import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from marketlens.operators import ops
from marketlens.streaming import jobs

BASE = datetime(2024, 1, 1)
SUBSCRIPTION = "subscription_id bigint, user_id bigint, kind string, min_value double, channels string, leagues string, venue string, active boolean, last_sent_at timestamp"
ALERT = "alert_id bigint, kind string, league string, venue string, value double, raised_at timestamp"


def subscriptions(rng, n):
    floor = lambda: rng.choice([None, float("nan"), 3.0, rng.randrange(20) / 2, rng.random() * 10])
    return [(i, i, rng.choice("ab"), floor(), "", rng.choice(["", "x", "x, Y"]), rng.choice(["both", "v", "", "W"]), rng.random() < 0.9, None) for i in range(n)]


def alerts(rng, n):
    value = lambda: rng.choice([None, float("nan"), 3.0, rng.randrange(20) / 2, rng.random() * 10])
    return [(k, rng.choice("ab"), rng.choice(["x", "y", "z", ""]), rng.choice(["V", "w", ""]), value(), BASE + timedelta(minutes=rng.randrange(300))) for k in range(n)]


def passes(alert, line):
    _, kind, league, venue, value, _ = alert
    floor = line[3] or 0.0
    over = value is not None and (value != value or (floor == floor and value >= floor))
    wanted = [x.strip().lower() for x in line[5].split(",") if x.strip()]
    return line[7] and line[2] == kind and over and (line[6] in ("both", "") or venue == "" or line[6].lower() == venue.lower()) and (not wanted or league.lower() in wanted)


def test_matches_by_definition(spark):
    rng = random.Random(3)
    lines, raised = subscriptions(rng, 150), alerts(rng, 200)
    got = ops.alert_matches(spark.createDataFrame(raised, ALERT), spark.createDataFrame(lines, SUBSCRIPTION), F.lit(BASE).cast("timestamp")).collect()
    want = Counter((a[0], s[0], s[1], "database") for a in raised for s in lines if passes(a, s))
    assert Counter(map(tuple, got)) == want and len(want) > 1000


def test_pairs_are_near_the_matches(spark):
    raised = spark.range(3000).select(F.lit("k").alias("key"), (F.col("id") % 1000 / 10).alias("value"), F.col("id").alias("alert_id"))
    wanted = spark.range(2000).select(F.lit("k").alias("key"), (F.col("id") / 20 + 50).alias("min_value"), F.col("id").alias("subscription_id"))
    pairs = ops.alert_pairs(raised, wanted, ["key"])
    assert pairs.filter("value >= min_value").count() == sum(v * 3 * 2 + 3 for v in range(500))
    assert pairs.filter("value < min_value").count() < 0.1 * 3000 * 2000 / 4


def shuffled_rows(spark, df):
    """Rows that the exchanges of a query write, and the rows it gives."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = len(df.collect())
        found, nodes = 0, [df._jdf.queryExecution().executedPlan()]
        while nodes:
            node = nodes.pop()
            if node.nodeName() == "Exchange":
                found += node.metrics().apply("shuffleRecordsWritten").value()
            nodes += [node.children().apply(i) for i in range(node.children().size())]
        return found, rows
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_alerts_below_all_floors_are_not_shuffled(spark):
    raised = spark.range(3000).select(F.lit("k").alias("key"), (F.col("id") % 1000 / 10).alias("value"), F.col("id").alias("alert_id"))
    wanted = spark.range(200).select(F.lit("k").alias("key"), (F.col("id") / 1000 + 99.7).alias("min_value"), F.col("id").alias("subscription_id"))
    found, rows = shuffled_rows(spark, ops.alert_pairs(raised, wanted, ["key"]).filter("value >= min_value"))
    assert rows == 3 * (1 + 101 + 200) and found < 200 + 100


def test_alerts_above_a_few_floors_are_shuffled_once(spark):
    raised = spark.range(1000).select(F.lit("k").alias("key"), (F.col("id") + 100.0).alias("value"), F.col("id").alias("alert_id"))
    wanted = spark.range(10).select(F.lit("k").alias("key"), F.col("id").cast("double").alias("min_value"), F.col("id").alias("subscription_id"))
    found, rows = shuffled_rows(spark, ops.alert_pairs(raised, wanted, ["key"]))
    assert rows == 10_000 and found <= 1010


def test_no_subscriptions_no_pairs(spark):
    raised = spark.range(5).select(F.lit("k").alias("key"), F.lit(1.0).alias("value"), F.col("id").alias("alert_id"))
    wanted = spark.createDataFrame([], "key string, min_value double, subscription_id bigint")
    assert ops.alert_pairs(raised, wanted, ["key"]).count() == 0
    assert ops.alert_pairs(raised, wanted.union(spark.sql("SELECT 'k', NULL, 1")), ["key"]).count() == 0


def test_cooldown_by_definition(spark):
    """Subscriptions of one and of several rows, in lines of a few, with and without earlier deliveries."""
    rng = random.Random(7)
    lines, raised = subscriptions(rng, 60), alerts(rng, 250)
    lines += [(*s[:8], BASE + timedelta(minutes=rng.randrange(200))) for s in subscriptions(rng, 90)[60:]] + subscriptions(rng, 5) + lines[:5]
    told = [(i, BASE + timedelta(minutes=10 * i)) for i in range(0, 20, 3)]
    args = (spark.createDataFrame(raised, ALERT), spark.createDataFrame(lines, SUBSCRIPTION), spark.createDataFrame(told, jobs.SENT_STATE))
    got = sorted(map(tuple, jobs.cooled_deliveries(*args, per_line=4).collect()))
    want = []
    for i in {s[0] for s in lines}:
        own = [s for s in lines if s[0] == i and s[7]]
        last = dict(told).get(i, max((s[8] for s in own if s[8]), default=None))
        for a in sorted(raised, key=lambda a: (a[5], a[0])):
            if any(passes(a, s) for s in own) and (last is None or a[5] >= last + timedelta(minutes=15)):
                last = a[5]
                want.append((i, a[0], last))
    assert got == sorted(want) and len(want) > 300


def test_alerts_meet_many_subscriptions_in_few_lines(spark):
    lines = spark.range(2000).selectExpr("id subscription_id", "id user_id", "'k' kind", "CAST(id AS DOUBLE) min_value", "'' channels", "'' leagues", "'both' venue", "true active", "CAST(NULL AS TIMESTAMP) last_sent_at")
    raised = spark.range(50).selectExpr("id alert_id", "'k' kind", "'x' league", "'' venue", "2000.0D value", "timestamp_micros(id) raised_at")
    told = spark.createDataFrame([], jobs.SENT_STATE)
    found, rows = shuffled_rows(spark, jobs.cooled_deliveries(raised, lines, told, per_line=1))
    cores = spark.sparkContext.defaultParallelism
    assert rows == 2000 and found < 8 * 2000 + 50 * (2 * 8 * cores + 100) < 50 * 2000


def test_cool_takes_subscriptions_by_floor_and_gives_deliveries_in_order(monkeypatch):
    """A line in several batches and blocks; the deliveries of a block lie in order of time, those of an alert by floor."""
    monkeypatch.setattr(jobs, "PER_LINE", 4)
    monkeypatch.setattr(jobs, "SENT_ROWS", 1)
    rng = random.Random(5)
    floors, minutes = [rng.random() * 5 for _ in range(10)], sorted(rng.randrange(600) for _ in range(100))
    told = [(0, 0, True, t * 60_000_000, k, rng.random() * 10) for k, t in enumerate(minutes)]
    rows = [(0, 0, False, jobs.NO_OWNER, i, f) for i, f in enumerate(floors)] + told
    columns = zip(("head", "chunk", "raised", "t", "name", "value"), zip(*rows))
    table = pa.table({c: pa.array(v, pa.bool_() if c == "raised" else pa.float64() if c == "value" else pa.int64()) for c, v in columns})
    got = [[np.asarray(c) for c in b.columns] for b in jobs.cool(iter(table.to_batches(max_chunksize=55)))]
    want = []
    for i, floor in enumerate(floors):
        due = None
        for _, _, _, t, k, value in told:
            if value >= floor and (due is None or t >= due):
                due = t + jobs.ALERT_COOLDOWN_MICROS
                want.append((i, k, t))
    assert sorted((int(i), int(k), int(t)) for b in got for i, k, t in zip(*b)) == sorted(want)
    for ids, names, _ in got:
        assert len(set(ids.tolist())) <= 4 and list(zip(names, [floors[i] for i in ids])) == sorted(zip(names, [floors[i] for i in ids]))
