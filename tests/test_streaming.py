"""Streaming jobs over several micro-batches, restarts and replays."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from marketlens.operators import movement
from marketlens.sources.tables import BucketedState, insert_ignore, keyed_upsert, write_csv
from marketlens.streaming import jobs

BASE = datetime(2024, 1, 1)
ONE_FILE = {"availableNow": True}


def deliver(spark, path, batches, schema, first=0):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/part{first + i}")


def source(spark, path, batches, schema):
    """A file stream that delivers one file per micro-batch, oldest first."""
    deliver(spark, path, batches, schema)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def test_quote_changes_over_batches(spark, tmp_path):
    rng = random.Random(1)
    batches = [
        [(1 + rng.randint(0, 3), 1, rng.choice([1.5, 1.6, 1.0]), rng.choice([None, 2.5]), BASE + timedelta(hours=b, minutes=i), b * 100 + i) for i in range(12)] for b in range(4)
    ]
    batches[3].append((1, 1, 9.0, None, BASE - timedelta(days=1), 7))  # older than what is stored
    src, args = str(tmp_path / "in"), (f"{tmp_path}/log", f"{tmp_path}/ckpt")
    stream = source(spark, src, batches[:2], jobs.QUOTE_STATE)
    jobs.stream_quote_changes(stream, *args, **ONE_FILE).awaitTermination()
    # Two more files come while the job is down; a third start has nothing new to do.
    deliver(spark, src, batches[2:], jobs.QUOTE_STATE, 2)
    for _ in range(2):
        jobs.stream_quote_changes(stream, *args, **ONE_FILE).awaitTermination()
    prior, want = {}, []
    for s, k, price, point, at, i in (r for batch in batches for r in sorted(batch, key=lambda r: (r[4], r[5]))):
        if price <= 1 or at < BASE:
            continue
        if prior.get((s, k)) != (price, point):
            want.append((i, s, price, point, (s, k) not in prior))
        prior[s, k] = price, point
    log = spark.read.parquet(f"{tmp_path}/log").collect()
    assert sorted((r["id"], r["selection_id"], r["price"], r["point"], r["is_opening"]) for r in log) == sorted(want)
    current = jobs.current_quotes(spark, f"{tmp_path}/ckpt").collect()
    assert {(r["selection_id"], r["bookmaker_id"]): (r["price"], r["point"]) for r in current} == prior


def test_a_batch_writes_what_it_changed(spark, tmp_path):
    """Many keys, then batches of one key: what a batch adds to the state stays small, and old versions go."""
    batches = [[(k, 1, 1.5, None, BASE, k) for k in range(20000)]] + [[(3, 1, 1.5 + b / 10, None, BASE + timedelta(hours=b), 10**6 + b)] for b in range(1, 6)]
    stream = source(spark, str(tmp_path / "in"), batches, jobs.QUOTE_STATE)
    jobs.stream_quote_changes(stream, f"{tmp_path}/log", f"{tmp_path}/ckpt", **ONE_FILE).awaitTermination()
    sizes = {}
    for file in (tmp_path / "ckpt" / "state").rglob("*.changelog"):
        sizes[file.name] = sizes.get(file.name, 0) + file.stat().st_size
    versions = sorted(sizes, key=lambda name: int(name.split(".")[0].split("_")[0]))
    assert len(versions) == 6 and all(sizes[v] * 20 < sizes[versions[0]] for v in versions[1:])
    assert spark.read.parquet(f"{tmp_path}/log").count() == 20005


def test_quotes_that_come_late_are_ignored(spark, tmp_path):
    stored = spark.createDataFrame([(1, 1, 1.5, None, BASE + timedelta(hours=2), 20)], jobs.QUOTE_STATE)
    rows = [
        (1, 1, 1.9, None, BASE + timedelta(hours=1), 10),
        (1, 1, 1.5, None, BASE + timedelta(hours=3), 30),
        (1, 1, 1.6, None, BASE + timedelta(hours=4), 40),
        (1, 1, 1.5, None, BASE + timedelta(hours=5), 50),
        (2, 1, 1.7, None, BASE, 5),
    ]
    got = movement.replay_onto(spark.createDataFrame(rows, jobs.QUOTE_STATE), stored).collect()
    assert sorted((r["id"], r["changed"], r["is_opening"]) for r in got) == [(5, True, True), (30, False, False), (40, True, False), (50, True, False)]


def test_trades_repeated_days_later_stay_out(spark, tmp_path):
    schema = "venue string, external_id string, traded_at timestamp, event_id bigint"
    batches = [[("a", str(i % 7), BASE + timedelta(days=5 * b, minutes=i), b * 100 + i) for i in range(12)] for b in range(3)]
    stream = source(spark, str(tmp_path / "in"), batches, schema)
    for _ in range(2):
        jobs.stream_trade_tape(stream, f"{tmp_path}/tape", f"{tmp_path}/ckpt", **ONE_FILE).awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/tape").collect()
    assert sorted((r["external_id"], r["event_id"], r["batch"]) for r in rows) == [(str(i), i, 0) for i in range(7)]


def test_stalls_are_told_without_new_runs_and_once_an_hour(spark, tmp_path):
    runs = [(1, "p", "odds", "success", BASE), (2, "q", "odds", "success", BASE + timedelta(minutes=80)), (3, "r", "odds", "failed", BASE)]
    stored = spark.createDataFrame(runs, "id bigint, provider string, kind string, status string, finished_at timestamp")
    ticks = source(spark, str(tmp_path / "in"), [[(b,)] for b in range(4)], "tick bigint")
    clock = lambda batch: F.lit(BASE + timedelta(minutes=30 * (batch + 1)))
    jobs.stream_stalls(ticks, lambda: stored, f"{tmp_path}/s", f"{tmp_path}/o", f"{tmp_path}/c", clock, **ONE_FILE).awaitTermination()
    told = sorted((r["batch"], r["provider"]) for r in spark.read.parquet(f"{tmp_path}/o").collect())
    assert told == [(0, "p"), (0, "r"), (2, "p"), (2, "r"), (3, "q")]
    assert not (tmp_path / "s" / "gen=1").exists() and not (tmp_path / "o" / "batch=1").exists()
    assert jobs.timer(spark).isStreaming


def test_no_stalls_are_an_empty_table(spark, tmp_path):
    stored = spark.createDataFrame([(1, "p", "odds", "success", BASE)], "id bigint, provider string, kind string, status string, finished_at timestamp")
    ticks = source(spark, str(tmp_path / "in"), [[(0,)]], "tick bigint")
    jobs.stream_stalls(ticks, lambda: stored, f"{tmp_path}/s", f"{tmp_path}/o", f"{tmp_path}/c", lambda batch: F.lit(BASE), **ONE_FILE).awaitTermination()
    told = jobs.told_stalls(spark, f"{tmp_path}/o")
    assert told.columns[:3] == ["provider", "kind", "status"] and told.isEmpty()


def test_quiet_books_close_and_late_books_do_not(spark, tmp_path):
    events = spark.createDataFrame([(1, BASE + timedelta(minutes=40), "scheduled"), (2, BASE + timedelta(days=9), "scheduled")], "event_id bigint, commence_at timestamp, status string")
    selections = spark.createDataFrame([(10, 100, 1), (11, 100, 1), (20, 200, 2)], "selection_id bigint, market_id bigint, event_id bigint")
    schema = "selection_id bigint, bookmaker_id bigint, price double"
    quotes = [(10, 1, 1.8), (11, 1, 2.2), (20, 1, 2.0)]
    ticks = source(spark, str(tmp_path / "in"), [[(b,)] for b in range(3)], "tick bigint")
    seen = []

    def prices():
        seen.append(len(seen))
        late = [(10, 2, 9.0), (11, 2, 1.1)] if len(seen) == 3 else []
        return spark.createDataFrame(quotes + late, schema)

    clock = lambda batch: F.lit(BASE + timedelta(minutes=30 * batch))
    jobs.stream_closing_lines(ticks, prices, lambda: events, selections, f"{tmp_path}/s", f"{tmp_path}/c", clock, buckets=2, **ONE_FILE).awaitTermination()
    rows = {(r["selection_id"], r["bookmaker_id"]): r for r in jobs.closing_state(spark, f"{tmp_path}/s", 2).read().collect()}
    assert set(rows) == {(10, 1), (11, 1)} and all(r["seconds_before_start"] <= 1200 for r in rows.values())
    assert abs(sum(r["fair_prob"] for r in rows.values()) - 1) < 1e-9


def test_state_replay_reads_older_generations(spark, tmp_path):
    schema = "k bigint, v double"
    state = BucketedState(spark, str(tmp_path / "s"), ["k"], schema, 4)
    assert state.read().count() == 0
    state.write(spark.createDataFrame([(i, 1.0) for i in range(20)], schema), 0)
    touched = state.touched(spark.createDataFrame([(3, 2.0)], schema))
    prior = state.read(1, touched)
    state.write(keyed_upsert(prior, spark.createDataFrame([(3, 2.0)], schema), ["k"]), 1)
    first = sorted(map(tuple, state.read().collect()))
    replay = state.read(1, touched)
    state.write(keyed_upsert(replay, spark.createDataFrame([(3, 2.0)], schema), ["k"]), 1)
    assert sorted(map(tuple, state.read().collect())) == first
    assert len(first) == 20 and (3, 2.0) in first


def test_old_generations_go(spark, tmp_path):
    state = BucketedState(spark, str(tmp_path / "s"), ["k"], "k bigint, v double", 4)
    for batch in range(12):
        change = spark.createDataFrame([(batch % 3, float(batch))], "k bigint, v double")
        prior = state.read(batch, state.touched(change))
        state.write(keyed_upsert(prior, change, ["k"]), batch)
    assert sorted(map(tuple, state.read().collect())) == [(0, 9.0), (1, 10.0), (2, 11.0)]
    assert sorted(map(tuple, state.read(11).collect())) == [(0, 9.0), (1, 10.0), (2, 8.0)]
    assert len(list((tmp_path / "s").glob("gen=*"))) <= 5


def test_orders_book_once(spark, tmp_path):
    schema = "order_id bigint, strategy_id bigint, market_id bigint, side string, report_seq bigint, filled_size double, avg_fill_price double"
    batches = [[(1, 1, 1, "yes", b, 10.0 * (b + 1), 0.5), (2, 1, 1, "yes", 2 * b, 5.0, 0.4), (2, 1, 1, "yes", 2 * b + 1, 5.0, 0.9), (3, 1, 1, "no", b, 0.0, None)] for b in range(3)]
    src, args = str(tmp_path / "in"), (f"{tmp_path}/o", f"{tmp_path}/c")
    stream = source(spark, src, batches[:1], schema)
    jobs.stream_order_reconcile(stream, *args, **ONE_FILE).awaitTermination()
    deliver(spark, src, batches[1:], schema, 1)
    jobs.stream_order_reconcile(stream, *args, **ONE_FILE).awaitTermination()
    rows = sorted((r["order_id"], r["delta_size"], r["delta_cost"]) for r in spark.read.parquet(f"{tmp_path}/o").collect())
    assert rows == [(1, 10.0, 5.0)] * 3 + [(2, 5.0, 2.0)]


def test_cooldown_over_batches(spark, tmp_path):
    at = [[0, 5, 14], [15, 16, 2, 29], [31, 45, 45]]
    schema = "alert_id bigint, kind string, league string, venue string, value double, raised_at timestamp"
    batches = [[(b * 10 + i, "edge", "L", "", 9.0, BASE + timedelta(minutes=m)) for i, m in enumerate(minutes)] for b, minutes in enumerate(at)]
    subscriptions = spark.createDataFrame(
        [(1, 1, "edge", 1.0, "", "l,L", "both", True, None), (2, 1, "edge", 1.0, "", "", "a", True, BASE + timedelta(minutes=20)), (3, 1, "edge", 99.0, "", "", "", True, None)],
        "subscription_id bigint, user_id bigint, kind string, min_value double, channels string, leagues string, venue string, active boolean, last_sent_at timestamp",
    )
    src, args = str(tmp_path / "in"), (f"{tmp_path}/o", f"{tmp_path}/c")
    stream = source(spark, src, batches[:2], schema)
    jobs.stream_alerts(stream, subscriptions, *args, **ONE_FILE).awaitTermination()
    deliver(spark, src, batches[2:], schema, 2)
    jobs.stream_alerts(stream, subscriptions, *args, **ONE_FILE).awaitTermination()
    got = sorted((r["subscription_id"], r["alert_id"]) for r in spark.read.parquet(f"{tmp_path}/o").collect())
    assert got == [(1, 0), (1, 10), (1, 20), (2, 21)]


def test_steam_window(spark, tmp_path):
    rows = [(1, b, 2.0 - 0.1 * h, None, BASE + timedelta(hours=h), b * 10 + h) for b in range(3) for h in range(3)]
    rows.append((9, 1, 2.0, None, BASE + timedelta(days=3), 999))
    stream = source(spark, str(tmp_path / "in"), [rows], jobs.QUOTE_STATE)
    jobs.stream_steam(stream, f"{tmp_path}/o", f"{tmp_path}/c", **ONE_FILE).awaitTermination()
    got = {r["window_end"]: r for r in spark.read.parquet(f"{tmp_path}/o").filter("selection_id = 1").collect()}
    row = got[BASE + timedelta(hours=3)]
    assert row["books"] == 3 and row["steam_score"] == 1.0


def test_steam_over_batches(spark, tmp_path):
    """Windows of several micro-batches and a restart against sums by definition; only quotes of open hours are stored."""
    rng = random.Random(5)
    quote = lambda h, k: (rng.randrange(2), rng.randrange(2), float(rng.randrange(2, 6)), None, BASE + timedelta(hours=h, minutes=rng.randrange(170)), k)
    batches = [[quote(h, 100 * h + k) for k in range(14)] for h in (0, 3, 45, 48, 90, 140)]
    src, args = str(tmp_path / "in"), (f"{tmp_path}/o", f"{tmp_path}/c")
    stream = source(spark, src, batches[:4], jobs.QUOTE_STATE)
    jobs.stream_steam(stream, *args, **ONE_FILE).awaitTermination()
    deliver(spark, src, batches[4:], jobs.QUOTE_STATE, 4)
    jobs.stream_steam(stream, *args, **ONE_FILE).awaitTermination()
    hour, told, kept = timedelta(hours=1), datetime.min, []
    for batch in batches:
        kept += [q for q in batch if q[4] - (q[4] - BASE) % hour + hour > told]
        told = max(told, max(q[4] for q in batch) - timedelta(minutes=10))
    want = {}
    for k in range(200):
        end = BASE + k * hour
        for s in range(2):
            lines = [sorted((q[4], q[5], q[2]) for q in kept if q[:2] == (s, b) and end - 6 * hour <= q[4] < end) for b in range(2)]
            moves = [line[-1][2] - line[0][2] for line in lines if len(line) > 1]
            if moves and end <= told:
                share = max(sum(m > 0 for m in moves), sum(m < 0 for m in moves)) / len(moves)
                want[end, s] = (len(moves), round(max(0, (share - 0.6) / 0.4), 6))
    rows = spark.read.parquet(f"{tmp_path}/o").collect()
    got = {(r["window_end"], r["selection_id"]): (r["books"], round(r["steam_score"], 6)) for r in rows}
    assert len(rows) == len(got) and got == want
    stored = spark.read.parquet(*[str(p) for p in (tmp_path / "c" / "open").glob("gen=5/bucket=*")])
    assert stored.filter(F.col("captured_at") < F.lit(BASE + timedelta(hours=132))).isEmpty() and not (tmp_path / "c" / "state").exists()


def test_flow_over_batches(spark, tmp_path):
    """Windows of several micro-batches and a restart, with gaps of more than a day, against sums by definition."""
    rng = random.Random(4)
    schema = "market_id bigint, side string, price double, notional double, traded_at timestamp"
    hours = [0, 5, 20, 60, 61, 90, 200, 260]
    batches = [[(rng.randrange(2), rng.choice(["yes", "no"]), rng.random(), 10.0 * rng.random(), BASE + timedelta(hours=h, minutes=rng.randrange(300))) for _ in range(9)] for h in hours]
    src, args = str(tmp_path / "in"), (f"{tmp_path}/o", f"{tmp_path}/cells", f"{tmp_path}/c")
    stream = source(spark, src, batches[:5], schema)
    jobs.stream_market_flow(stream, *args, **ONE_FILE).awaitTermination()
    deliver(spark, src, batches[5:], schema, 5)
    jobs.stream_market_flow(stream, *args, **ONE_FILE).awaitTermination()
    step = timedelta(minutes=15)
    fills = [(m, s, p, n, BASE + step * ((t - BASE) // step + 1)) for batch in batches for m, s, p, n, t in batch]
    final = max(t for *_, t in fills if t <= max(r[4] for batch in batches for r in batch) - timedelta(hours=24))
    want = {}
    for m, s, p, n, end in fills:
        for k in range(96):
            if end + k * step <= final:
                cell = want.setdefault((end + k * step, m, s), [0, 0.0, 0.0])
                cell[0], cell[1], cell[2] = cell[0] + 1, cell[1] + n, cell[2] + p
    rows = spark.read.parquet(f"{tmp_path}/o").collect()
    got = {(r["window_end"], r["market_id"], r["side"]): (r["fills"], round(r["notional"], 6), round(r["mean_price"], 6)) for r in rows}
    assert len(rows) == len(got) and got == {k: (c, round(n, 6), round(p / c, 6)) for k, (c, n, p) in want.items()}


def test_table_writes(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", True), (2, "b", False)], "k bigint, v string, keep boolean")
    new = spark.createDataFrame([(2, "c", True), (3, "d", True), (3, "d", True)], "k bigint, v string, keep boolean")
    got = sorted(tuple(r) for r in keyed_upsert(old, new, ["k"], ["v"]).collect())
    assert got == [(1, "a", True), (2, "c", False), (3, "d", True)]
    assert [r["k"] for r in insert_ignore(old, new, ["k"]).collect()] == [3]
    text = spark.createDataFrame([(1, 'say "hi", ok')], "id bigint, note string").coalesce(1)
    write_csv(text, str(tmp_path / "csv"), {"id": "ID"})
    lines = [r[0] for r in spark.read.text(str(tmp_path / "csv")).collect()]
    assert lines == ["ID,note", '1,"say ""hi"", ok"']
