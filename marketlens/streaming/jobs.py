"""Structured Streaming jobs, each with a batch twin in ``marketlens.operators``.

Jobs with keyed state keep it in Spark's state store, in RocksDB with a change log: a batch writes what it changed, a batch
that is run again starts from the same state, and what it appends is committed once. Jobs that watch the clock read whole
tables on each tick and keep a few marks in a ``BucketedState``. Jobs that only aggregate use watermarked windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marketlens.functions.common import count_if
from marketlens.functions.prices import american_number, implied_prob
from marketlens.functions.text import page_path
from marketlens.operators import movement, ops, settle
from marketlens.operators.evidence import MIN_FILLS
from marketlens.operators.web import is_page
from marketlens.sources.daytables import days_of
from marketlens.sources.tables import BucketedState, keyed_upsert

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
QUOTE_DELAY = "10 minutes"
QUOTE_DELAY_MICROS = 10 * 60_000_000
TRADE_DELAY = "24 hours"
ALERT_COOLDOWN_MICROS = 15 * 60_000_000
QUOTE_STATE = "selection_id bigint, bookmaker_id bigint, price double, point double, captured_at timestamp, id bigint"
CLOSING_STATE = (
    "selection_id bigint, bookmaker_id bigint, price double, implied_prob double, fair_prob double, seconds_before_start bigint"
)
CLOSED_STATE = "event_id bigint, closing_captured_at timestamp"
STEAM_QUOTE = "selection_id bigint, bookmaker_id bigint, captured_at timestamp, id bigint, price double"
#: Hours of a steam window and of the blocks that windows are found in.
STEAM_HOURS, STEAM_STEP, STEAM_BLOCK = 6, 3_600_000_000, 48
STALL_STATE = "provider string, kind string, announced_at timestamp"
STALL_COLUMNS = "provider string, kind string, status string, age_minutes bigint, reason string, announced_at timestamp"
STALL_REPEAT_MINUTES = 60
FLOW_SPAN, FLOW_STEP = 24 * 3_600_000_000, 900_000_000
#: Logarithm of the registers of a visitor sketch: 4,096 give a standard error of 1.04 / 64.
VISITOR_SKETCH = 12
#: Buckets of the jobs that keep many small keys; more keys want more of them.
BUCKETS = 2048
QUOTE = np.dtype([("selection_id", "<i8"), ("bookmaker_id", "<i8"), ("at", "<i8"), ("id", "<i8"), ("price", "<f8"), ("point", "<f8")])
REPORT = np.dtype([(c, "<i8") for c in ("row", "order_id", "report_seq")] + [("filled_size", "<f8"), ("price", "<f8")])
ORDER = np.dtype([("order_id", "<i8"), ("size", "<f8"), ("cost", "<f8")])
NO_OWNER = -(1 << 63)
LATEST = (1 << 63) - 1
SENT_STATE = "subscription_id bigint, sent_at timestamp"
#: Subscriptions that are looked at together, and that a line has at least if its filter has as many.
PER_LINE = 1024
#: Lines for each core, beside one for each filter.
LINES = 8
#: Deliveries that leave a task together.
SENT_ROWS = 100_000


def _start(stream: DataFrame, handle, checkpoint: str, trigger: dict) -> StreamingQuery:
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _append(stream: DataFrame, path: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def keyed_state(spark: SparkSession) -> None:
    """State that lives on in RocksDB with a change log, so that a batch writes what its keys changed and no more."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def bucket_of(keys: list[str], buckets: int) -> Column:
    """Keys share the state of their bucket: a group costs more than its rows, and a batch writes the buckets it touches."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket")


def kept_rows(state: GroupState, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(state.get[0], kind) if state.exists else np.zeros(0, kind)


def new_rows(chunks: Iterator[pd.DataFrame], kind: np.dtype) -> np.ndarray:
    parts = []
    for chunk in chunks:
        part = np.zeros(len(chunk), kind)
        for c in kind.names:
            part[c] = chunk[c].to_numpy()
        parts.append(part)
    return np.concatenate(parts)


def replay_quotes(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The quotes of one bucket that moved, each against the one before it of its (selection, book), the stored one first.

    Quotes that are not newer than the stored one are ignored.
    """
    old, new = kept_rows(state, QUOTE), new_rows(chunks, QUOTE)
    rows, fresh = np.concatenate([old, new]), np.arange(len(old) + len(new)) >= len(old)
    order = np.lexsort([rows["price"], rows["id"], rows["at"], fresh, rows["bookmaker_id"], rows["selection_id"]])
    rows, fresh = rows[order], fresh[order]
    heads = key_starts(rows)
    place = np.cumsum(heads) - 1
    head, stored = rows[heads][place], ~fresh[heads][place]
    late = (rows["at"] < head["at"]) | ((rows["at"] == head["at"]) & (rows["id"] <= head["id"]))
    keep = ~(fresh & stored & late)
    rows, fresh = rows[keep], fresh[keep]
    heads = key_starts(rows)
    moved = heads.copy()
    for c in ("price", "point"):
        same = (rows[c][1:] == rows[c][:-1]) | (np.isnan(rows[c][1:]) & np.isnan(rows[c][:-1]))
        moved[1:] |= ~same
    state.update((rows[np.append(heads[1:], True)].tobytes(),))
    moved &= fresh
    if moved.any():
        yield pd.DataFrame({c: rows[c][moved] for c in QUOTE.names} | {"is_opening": heads[moved]})


def key_starts(rows: np.ndarray) -> np.ndarray:
    out = np.ones(len(rows), bool)
    out[1:] = (rows["selection_id"][1:] != rows["selection_id"][:-1]) | (rows["bookmaker_id"][1:] != rows["bookmaker_id"][:-1])
    return out


def quote_changes(quotes: DataFrame, buckets: int) -> DataFrame:
    """The moves of a stream of quotes: each quote against the one before it of its key, whichever batch that came in."""
    rows = quotes.filter(F.col("price") > 1).select(
        bucket_of(movement.KEYS, buckets), *movement.KEYS, F.unix_micros("captured_at").alias("at"), "id", "price", "point"
    )
    shape = "selection_id bigint, bookmaker_id bigint, at bigint, id bigint, price double, point double, is_opening boolean"
    moves = rows.groupBy("bucket").applyInPandasWithState(replay_quotes, shape, "rows binary", "append", GroupStateTimeout.NoTimeout)
    return moves.select(
        *movement.KEYS, "price", F.nanvl("point", F.lit(None)).alias("point"), F.timestamp_micros("at").alias("captured_at"), "id",
        american_number(F.col("price")).alias("american"), implied_prob(F.col("price")).alias("implied_prob"), "is_opening",
    )


def stream_quote_changes(quotes: DataFrame, log_path: str, checkpoint: str, buckets: int = BUCKETS, **trigger) -> StreamingQuery:
    """Appends only quotes that moved, also within a batch; quotes older than the last one of their key are ignored."""
    keyed_state(quotes.sparkSession)
    return _append(quote_changes(quotes, buckets), log_path, checkpoint, trigger or {"processingTime": "1 second"})


def current_quotes(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The newest quote of every key that ``stream_quote_changes`` has seen, as of its last finished batch."""

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows in batch["rows"]:
                yield pd.DataFrame({c: np.frombuffer(rows, QUOTE)[c] for c in QUOTE.names})

    stored = spark.read.format("statestore").load(checkpoint).select("value.groupState.rows")
    rows = stored.mapInPandas(opened, "selection_id bigint, bookmaker_id bigint, at bigint, id bigint, price double, point double")
    point = F.nanvl("point", F.lit(None)).alias("point")
    return rows.select(*movement.KEYS, "price", point, F.timestamp_micros("at").alias("captured_at"), "id")


def stream_trade_tape(trades: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends the first fill of each (venue, external id), however late a repetition comes; of one batch the earliest.

    An aggregate keeps the first fill of a key with the time of its batch, which stays the same if the batch is run again.
    A batch touches the state of its own keys, and passes on the fills that came first in it.
    """
    keyed_state(trades.sparkSession)
    keys = ["venue", "external_id"]
    order = [c for c in ("traded_at", "event_id") if c in trades.columns]
    rest = [c for c in trades.columns if c not in (*keys, *order)]
    stamped = trades.withColumn("batch_at", F.current_timestamp())
    first = stamped.groupBy(*keys).agg(F.min(F.struct("batch_at", *order, *rest)).alias("fill")).filter(F.col("fill.batch_at") == F.current_timestamp())
    rows = first.select(*[c if c in keys else F.col(f"fill.{c}").alias(c) for c in trades.columns])

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = rows.writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "5 minutes"})).start()


def flow_cells(fills: DataFrame, delay: str = TRADE_DELAY) -> DataFrame:
    """Sums of each quarter of an hour per (market, side), given once when no fill of it can come any more."""
    cells = (
        fills.withWatermark("traded_at", delay)
        .groupBy(F.window("traded_at", "15 minutes"), "market_id", "side")
        .agg(F.count(F.lit(1)).alias("fills"), F.sum("notional").alias("notional"), F.sum("price").alias("price_sum"))
    )
    return cells.select("market_id", "side", F.unix_micros("window.end").alias("at"), "fills", "notional", "price_sum")


def rolled_flow(cells: DataFrame, after: int | None, until: int, span: int = FLOW_SPAN, step: int = FLOW_STEP) -> DataFrame:
    """24-hour flow per (market, side) at every quarter of an hour after ``after`` up to ``until``, where there is any.

    A cell counts from its end until a day later, so it adds its sums at one time and takes them off at another; running
    sums of these changes hold until the next one. ``cells`` reach back one day before ``after``.
    """
    values = ["fills", "notional", "price_sum"]
    off = cells.select("market_id", "side", (F.col("at") + span).alias("at"), *[(-F.col(c)).alias(c) for c in values])
    changes = cells.select(*off.columns).unionByName(off).filter(F.col("at") <= until)
    changes = changes.groupBy("market_id", "side", "at").agg(*[F.sum(c).alias(c) for c in values])
    by_time = W.partitionBy("market_id", "side").orderBy("at")
    sums = [F.sum(c).over(by_time.rowsBetween(W.unboundedPreceding, 0)).alias(c) for c in values]
    held = changes.select("market_id", "side", "at", *sums, (F.coalesce(F.lead("at").over(by_time), F.lit(until + step)) - step).alias("last"))
    held = held.filter(F.col("fills") > 0)
    if after is not None:
        held = held.withColumn("at", F.greatest("at", F.lit(after + step))).filter(F.col("at") <= F.col("last"))
    marks = held.withColumn("at", F.explode(F.sequence("at", "last", F.lit(step).cast("bigint"))))
    return marks.select(
        F.timestamp_micros("at").alias("window_end"), "market_id", "side", "fills", "notional",
        (F.col("price_sum") / F.col("fills")).alias("mean_price"), (F.col("fills") >= MIN_FILLS).alias("enough_fills"),
    )


def stream_market_flow(fills: DataFrame, path: str, cells_path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends the 24-hour flow of every quarter of an hour, once all its fills are in.

    The state is one row per cell, in folders by day: a batch adds its cells and reads those of the day before. Cells come
    in order of time, all of one end together, so the windows up to the newest cell are complete.
    """
    spark = fills.sparkSession

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("day", F.to_date(F.timestamp_micros("at"))).withColumn("batch", F.lit(batch_id)).persist()
        first, until = rows.agg(F.min("at"), F.max("at")).first()
        if until is not None:
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(cells_path)
            cells = spark.read.parquet(cells_path).filter(F.col("batch") <= batch_id)
            older, after = cells.filter(F.col("batch") < batch_id), None
            for day in reversed(days_of(spark, cells_path)):  # ends at the newest day of an older batch
                after = older.filter(F.col("day") == F.lit(day)).agg(F.max("at")).first()[0]
                if after is not None:
                    break
            since = first if after is None else min(first, after - FLOW_SPAN)
            kept = cells.filter((F.col("day") >= F.to_date(F.timestamp_micros(F.lit(since)))) & (F.col("at") >= since))
            kept = kept if after is None else kept.filter(F.col("at") > after - FLOW_SPAN)
            rolled_flow(kept, after, until).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        rows.unpersist()

    return _start(flow_cells(fills), handle, checkpoint, trigger or {"processingTime": "15 minutes"})


def steam_windows(quotes: DataFrame, since: int, until: int) -> DataFrame:
    """Share of books that moved one way per selection over sliding windows that end after hour ``since``, up to ``until``.

    Quotes are dealt by selection and block of hours; those near a block's end go to the next one too, so each window finds
    its quotes in its own block and nothing is shuffled again. Quotes with no other of their book within a span are left
    out, as no window takes one alone. The others are folded to hourly first and last prices, then per window to one move
    per book, then per selection to the share.
    """
    hour = F.floor(F.unix_micros("captured_at") / STEAM_STEP)
    blocks = F.array_distinct(F.array(F.floor((hour + 1) / STEAM_BLOCK), F.floor((hour + STEAM_HOURS) / STEAM_BLOCK)))
    dealt = quotes.select(*movement.KEYS, "captured_at", "id", "price", F.explode(blocks).alias("block")).repartition("selection_id", "block")
    line = W.partitionBy("selection_id", "block", "bookmaker_id").orderBy("captured_at", "id")
    t = F.unix_micros("captured_at")
    span = STEAM_HOURS * STEAM_STEP
    near = F.coalesce(t - F.lag(t).over(line) < span, F.lit(False)) | F.coalesce(F.lead(t).over(line) - t < span, F.lit(False))
    keys = ["selection_id", "block", "bookmaker_id"]
    at = F.struct("captured_at", "id")
    hourly = (
        dealt.withColumn("near", near)
        .filter("near")
        .groupBy(*keys, hour.alias("hour"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.struct(at.alias("at"), F.col("price"))).alias("first"),
            F.max(F.struct(at.alias("at"), F.col("price"))).alias("last"),
        )
    )
    ends = hourly.withColumn("w", F.explode(F.sequence(F.col("hour") + 1, F.col("hour") + STEAM_HOURS)))
    ends = ends.filter((F.floor(F.col("w") / STEAM_BLOCK) == F.col("block")) & (F.col("w") > since) & (F.col("w") <= until))
    windows = ends.groupBy(*keys, "w").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    move = F.signum(F.col("last.price") - F.col("first.price"))
    shares = (
        windows.filter(F.col("n") >= 2)
        .withColumn("move", move)
        .groupBy("w", "selection_id", "block")
        .agg(
            F.count(F.lit(1)).alias("books"),
            count_if(F.col("move") > 0).alias("up"),
            count_if(F.col("move") < 0).alias("down"),
        )
    )
    share = F.greatest("up", "down") / F.col("books")
    limit = movement.STEAM_CONSENSUS
    return shares.select(
        F.timestamp_micros(F.col("w") * STEAM_STEP).alias("window_end"),
        "selection_id",
        "books",
        F.when(share >= limit, (share - limit) / (1 - limit)).otherwise(F.lit(0.0)).alias("steam_score"),
    )


def hourly_ends(quotes: DataFrame) -> DataFrame:
    """The first and the last quote of each hour, selection and book; all that later windows need of them."""
    quote = F.struct("captured_at", "id", "price")
    hourly = quotes.groupBy(*movement.KEYS, F.floor(F.unix_micros("captured_at") / STEAM_STEP).alias("hour")).agg(
        F.count(F.lit(1)).alias("n"), F.min(quote).alias("first"), F.max(quote).alias("last")
    )
    ends = F.when(F.col("n") > 1, F.array("first", "last")).otherwise(F.array("first"))
    return hourly.select(*movement.KEYS, F.explode(ends).alias("q")).select(*movement.KEYS, "q.*")


def stream_steam(quotes: DataFrame, path: str, checkpoint: str, buckets: int = 16, **trigger) -> StreamingQuery:
    """Appends the windows that have closed, those that end ten minutes or more before the newest quote; later quotes of
    closed hours are dropped.

    State, beside the checkpoint's own: up to which hour windows are told, and the quotes of hours whose windows are still
    open. Quotes whose windows a batch closes are never stored.
    """
    spark = quotes.sparkSession
    marks = BucketedState(spark, f"{checkpoint}/told", ["job"], "job string, until bigint", 1)
    waiting = BucketedState(spark, f"{checkpoint}/open", movement.KEYS, STEAM_QUOTE, buckets)
    columns = [c.split()[0] for c in STEAM_QUOTE.split(", ")]
    hour = F.floor(F.unix_micros("captured_at") / STEAM_STEP)

    def handle(batch: DataFrame, batch_id: int) -> None:
        mark = marks.read(batch_id).first()
        since = mark["until"] if mark else 0
        newest = batch.agg(F.max(F.unix_micros("captured_at"))).first()[0]
        until = since if newest is None else max(since, (newest - QUOTE_DELAY_MICROS) // STEAM_STEP)
        rows = batch.select(*columns).filter(hour >= since).unionByName(waiting.read(batch_id).filter(hour > since - STEAM_HOURS))
        steam_windows(rows, since, until).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        waiting.write(hourly_ends(rows.filter(hour > until - STEAM_HOURS)), batch_id)
        marks.write(spark.createDataFrame([("steam", until)], "job string, until bigint"), batch_id)

    return _start(quotes, handle, checkpoint, trigger or {"processingTime": "1 minute"})


def stream_closing_lines(
    ticks: DataFrame,
    read_prices: Callable[[], DataFrame],
    read_events: Callable[[], DataFrame],
    selections: DataFrame,
    state_root: str,
    checkpoint: str,
    clock: Callable[[int], Column] = lambda batch: F.current_timestamp(),
    lookback_hours: float = settle.CLOSING_LOOKBACK_HOURS,
    ahead_minutes: float = settle.CLOSING_MINUTES,
    buckets: int = 64,
    **trigger,
) -> StreamingQuery:
    """Freezes the current prices of each event once when it is near kickoff.

    The ticks (``timer``) only wake the capture. Whole markets are taken from the current prices (``read_prices``, such as
    the state of ``stream_quote_changes``), so books whose price has not moved for days close too. The event is marked with
    its capture, and a book that starts later gets no line.
    """
    spark = ticks.sparkSession
    lines, marks = closing_state(spark, state_root, buckets), BucketedState(spark, f"{state_root}/events", ["event_id"], CLOSED_STATE, buckets)
    columns = [c.split()[0] for c in CLOSING_STATE.split(", ")]

    def handle(batch: DataFrame, batch_id: int) -> None:
        now = clock(batch_id)
        open_events = read_events().join(marks.read(batch_id).select("event_id"), "event_id", "left_anti")
        rows = settle.closing_lines(open_events, selections, read_prices(), now, None, lookback_hours, ahead_minutes).select(*columns).persist()
        if rows.isEmpty():
            rows.unpersist()
            return
        stored = lines.read(batch_id, lines.touched(rows))
        lines.write(stored.select(*columns).unionByName(rows), batch_id)
        closed = selections.join(rows.select("selection_id").distinct(), "selection_id").select("event_id").distinct()
        closed = closed.withColumn("closing_captured_at", now.cast("timestamp")).persist()
        known = marks.read(batch_id, marks.touched(closed)).select("event_id", "closing_captured_at")
        marks.write(known.unionByName(closed), batch_id)
        closed.unpersist()
        rows.unpersist()

    return _start(ticks, handle, checkpoint, trigger or {"processingTime": "1 minute"})


def closing_state(spark: SparkSession, state_root: str, buckets: int = 64) -> BucketedState:
    """The closing lines that ``stream_closing_lines`` has written."""
    return BucketedState(spark, f"{state_root}/lines", movement.KEYS, CLOSING_STATE, buckets)


def book_fills(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """What the largest cumulative report of each order adds to what is booked; of equal sizes the one heard first stays."""
    reports = pd.concat(list(chunks), ignore_index=True)
    old, new = kept_rows(state, ORDER), new_rows(iter([reports.assign(row=reports.index)]), REPORT)
    new = new[np.lexsort([new["report_seq"], -new["filled_size"], new["order_id"]])]
    new = new[np.diff(new["order_id"], prepend=new["order_id"][0] - 1) != 0]
    done = np.zeros(len(new), ORDER)
    at = np.minimum(np.searchsorted(old["order_id"], new["order_id"]), max(0, len(old) - 1))
    known = old["order_id"][at] == new["order_id"] if len(old) else np.zeros(len(new), bool)
    done[known] = old[at[known]]
    more = new["filled_size"] > done["size"]
    new, done, known, at = new[more], done[more], known[more], at[more]
    if not len(new):
        return
    booked = np.zeros(len(new), ORDER)
    booked["order_id"], booked["size"], booked["cost"] = new["order_id"], new["filled_size"], new["filled_size"] * new["price"]
    kept = np.concatenate([np.delete(old, at[known]), booked])
    state.update((kept[np.argsort(kept["order_id"])].tobytes(),))
    owner = reports.loc[new["row"], ["order_id", "strategy_id", "market_id", "side"]]
    yield owner.assign(delta_size=booked["size"] - done["size"], delta_cost=booked["cost"] - done["cost"])


def stream_order_reconcile(reports: DataFrame, out_path: str, checkpoint: str, buckets: int = BUCKETS, **trigger) -> StreamingQuery:
    """Turns cumulative order reports into increments, each booked once."""
    keyed_state(reports.sparkSession)
    rows = reports.filter("order_id IS NOT NULL AND filled_size > 0").select(
        bucket_of(["order_id"], buckets), "order_id", *[F.coalesce(c, F.lit(NO_OWNER)).alias(c) for c in ("strategy_id", "market_id")],
        "side", F.coalesce("report_seq", F.lit(0)).alias("report_seq"), "filled_size", F.coalesce("avg_fill_price", F.lit(0.0)).alias("price"),
    )
    shape = "order_id bigint, strategy_id bigint, market_id bigint, side string, delta_size double, delta_cost double"
    booked = rows.groupBy("bucket").applyInPandasWithState(book_fills, shape, "rows binary", "append", GroupStateTimeout.NoTimeout)
    owner = [F.nullif(c, F.lit(NO_OWNER)).alias(c) for c in ("strategy_id", "market_id")]
    return _append(booked.select("order_id", *owner, "side", "delta_size", "delta_cost"), out_path, checkpoint, trigger or {"processingTime": "1 minute"})


def value_order(values: np.ndarray) -> np.ndarray:
    """Whole numbers in Spark's order of the doubles: zeros are equal and NaN comes last."""
    bits = (values + 0.0).view(np.int64)
    bits = np.where(bits < 0, bits ^ np.int64(LATEST), bits)
    return np.where(np.isnan(values), LATEST - 1, bits)


def first_reaching(values: np.ndarray, at: np.ndarray, floors: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """The first place from ``at`` on whose value reaches the floor, or the number of values; ``steps`` are ``peaks``."""
    at = at.copy()
    for k in range(len(steps) - 1, -1, -1):
        at += np.where(steps[k][at] < floors, 1 << k, 0)
    return at


def peaks(values: np.ndarray) -> list[np.ndarray]:
    """For each place the largest of the next 1, 2, 4, ... values; one past the end is larger than all."""
    n = len(values)
    out, size = [np.append(values, LATEST)], 1
    while size < n:
        wide = np.full(n + 1, LATEST)
        wide[: n + 1 - size] = np.maximum(out[-1][: n + 1 - size], out[-1][size:])
        out, size = [*out, wide], 2 * size
    return out


def cool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The alerts each subscription of a line gets, of which each comes a cooldown after the one before or later.

    A line's subscriptions come first and its alerts follow in order of time and id. Each subscription goes on from the
    end of its cooldown to the next alert that reaches its floor, so the work is that of the deliveries. Subscriptions
    are taken by floor, since those of near floors get the same alerts, and the deliveries of so many lie in order of time.
    """
    line, ids, floors, due = None, *[np.zeros(0, np.int64)] * 3
    for batch in batches:
        head, chunk, t, name = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("head", "chunk", "t", "name"))
        raised = batch.column("raised").to_numpy(zero_copy_only=False)
        value = value_order(batch.column("value").to_numpy(zero_copy_only=False))
        heads = np.flatnonzero((np.diff(head) != 0) | (np.diff(chunk) != 0)) + 1
        sent, held = [], 0
        for low, high in zip([0, *heads], [*heads, len(head)]):
            if low == high:
                continue
            if line != (head[low], chunk[low]):
                line, ids, floors, due = (head[low], chunk[low]), *[np.zeros(0, np.int64)] * 3
            first = low + int(np.searchsorted(raised[low:high], True))
            if first > low:
                ids, floors, due = (np.concatenate([x, y[low:first]]) for x, y in ((ids, name), (floors, value), (due, t)))
                order = np.lexsort([ids, floors])
                ids, floors, due = ids[order], floors[order], due[order]
            times, reached, told = t[first:high], value[first:high], name[first:high]
            steps = peaks(reached)
            for start in range(0, len(ids) if len(times) else 0, PER_LINE):
                active, got = np.arange(start, min(start + PER_LINE, len(ids))), []
                while len(active):
                    at = first_reaching(reached, np.searchsorted(times, due[active]), floors[active], steps)
                    active, at = active[at < len(times)], at[at < len(times)]
                    got.append(np.stack([active, at]))
                    due[active] = times[at] + ALERT_COOLDOWN_MICROS
                who, at = np.concatenate(got, axis=1)
                order = np.lexsort([who, at])
                sent.append(np.stack([ids[who[order]], told[at[order]], times[at[order]]]))
                held += len(order)
                if held >= SENT_ROWS:
                    yield deliveries(sent)
                    sent, held = [], 0
        if held:
            yield deliveries(sent)


def deliveries(sent: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(sent, axis=1)], names=["subscription_id", "alert_id", "t"])


def cooled_deliveries(alerts: DataFrame, subscriptions: DataFrame, told: DataFrame, per_line: int = PER_LINE) -> DataFrame:
    """Alerts that pass the cooldown of their subscriptions, which starts with what was ``told`` last, or ``last_sent_at``.

    Subscriptions that differ by floor and cooldown alone meet their alerts together, in lines of ``per_line`` or more; one
    of several rows meets those of any row, which have passed the floor of that row. There are about as many lines as the
    cores ask for, not more with more subscriptions, so what is shuffled grows with the alerts and the subscriptions, not
    with their product.
    """
    lines = LINES * subscriptions.sparkSession.sparkContext.defaultParallelism
    rule = F.struct("kind", "leagues", "venue", F.coalesce("min_value", F.lit(0.0)).alias("floor"))
    known = subscriptions.filter(F.col("active") & F.col("subscription_id").isNotNull())
    known = known.groupBy("subscription_id").agg(F.array_sort(F.collect_set(rule)).alias("rules"), F.max("last_sent_at").alias("seed_at"))
    one = F.size("rules") == 1
    open_rule = F.transform("rules", lambda r: r.withField("floor", F.lit(None).cast("double")))
    known = known.withColumn("floor", F.when(one, F.col("rules")[0]["floor"]).otherwise(F.lit(float("-inf"))))
    known = known.withColumn("grp", F.xxhash64(F.to_json(F.when(one, open_rule).otherwise(F.col("rules")))))
    known = known.withColumn("rules", F.when(one, open_rule).otherwise(F.col("rules")))
    whole_line = F.greatest(F.lit(per_line), F.ceil(subscriptions.agg(F.count(F.lit(1))).scalar() / lines))
    groups = known.groupBy("grp", "rules").agg(F.min("subscription_id").alias("head"), F.min("floor").alias("low"), F.count(F.lit(1)).alias("n"))
    groups = groups.withColumn("chunks", F.ceil(F.col("n") / whole_line))
    filters = groups.select("head", "low", F.explode("rules").alias("r")).select(
        F.col("head").alias("subscription_id"), F.col("head").alias("user_id"), "r.kind", F.coalesce("r.floor", "low").alias("min_value"),
        F.lit("").alias("channels"), "r.leagues", "r.venue", F.lit(True).alias("active"), F.lit(None).cast("timestamp").alias("last_sent_at"),
    )
    t = F.unix_micros("raised_at")
    whole = alerts.withColumn("alert_id", F.struct(F.coalesce("alert_id", F.lit(NO_OWNER)).alias("name"), F.coalesce(t, F.lit(NO_OWNER)).alias("t"), "value"))
    pairs = ops.alert_matches(whole, filters, F.current_timestamp()).select("alert_id.*", F.col("subscription_id").alias("head"))
    raised = pairs.join(groups.select("head", "chunks"), "head").select(
        "head", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk"), F.lit(True).alias("raised"), "t", "name", "value"
    )
    last = F.unix_micros(F.coalesce("sent_at", "seed_at"))
    waiting = known.join(groups.drop("low", "n"), ["grp", "rules"]).join(told, "subscription_id", "left").select(
        "head", F.pmod(F.xxhash64("subscription_id"), F.col("chunks")).alias("chunk"), F.lit(False).alias("raised"),
        F.coalesce(last + ALERT_COOLDOWN_MICROS, F.lit(NO_OWNER)).alias("t"), F.col("subscription_id").alias("name"), F.col("floor").alias("value"),
    )
    rows = waiting.unionByName(raised).repartition(lines, "head", "chunk").sortWithinPartitions("head", "chunk", "raised", "t", "name")
    sent = rows.mapInArrow(cool, "subscription_id bigint, alert_id bigint, t bigint")
    return sent.select("subscription_id", F.nullif("alert_id", F.lit(NO_OWNER)).alias("alert_id"), F.timestamp_micros("t").alias("sent_at"))


def stream_alerts(alerts: DataFrame, subscriptions: DataFrame, out_path: str, checkpoint: str, buckets: int = 64, **trigger) -> StreamingQuery:
    """Delivers alerts to matching subscriptions, at most one per 15 minutes each.

    Alerts that match a subscription in several ways count once, as only the first of an instant can pass. State, beside
    the checkpoint's own: when each subscription was last sent one.
    """
    state = BucketedState(alerts.sparkSession, f"{checkpoint}/sent", ["subscription_id"], SENT_STATE, buckets)

    def handle(batch: DataFrame, batch_id: int) -> None:
        cooled_deliveries(batch, subscriptions, state.read(batch_id)).write.mode("overwrite").option("compression", "zstd").parquet(f"{out_path}/batch={batch_id}")
        sent = alerts.sparkSession.read.parquet(f"{out_path}/batch={batch_id}")
        newest = sent.groupBy("subscription_id").agg(F.max("sent_at").alias("sent_at")).persist()
        touched = state.touched(newest)
        if touched:
            state.write(keyed_upsert(state.read(batch_id, touched), newest, ["subscription_id"]), batch_id)
        newest.unpersist()

    return _start(alerts, handle, checkpoint, trigger or {"processingTime": "1 minute"})


def traffic_windows(requests: DataFrame, bucket: str = "1 hour", delay: str = QUOTE_DELAY) -> DataFrame:
    """Page views and visitors per bucket, a whole number of minutes.

    Each minute keeps a mergeable sketch of its visitors, and a bucket is the union of its minutes. The estimate has a
    standard error of about 1.6 % (``VISITOR_SKETCH``); exact distinct counts exist only in batch.
    """
    pages = requests.withColumn("page_path", page_path(F.col("path"))).filter(is_page(F.col("page_path")))
    minutes = (
        pages.withWatermark("created_at", delay)
        .groupBy(F.window("created_at", "1 minute"))
        .agg(F.count(F.lit(1)).alias("page_views"), F.hll_sketch_agg("ip_address", F.lit(VISITOR_SKETCH)).alias("sketch"))
    )
    return (
        minutes.groupBy(F.window(F.window_time("window"), bucket).alias("w"))
        .agg(F.sum("page_views").alias("page_views"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("visitors"))
        .select(F.col("w.start").alias("bucket"), "page_views", "visitors")
    )


def stream_traffic(requests: DataFrame, path: str, checkpoint: str, bucket: str = "1 hour", **trigger) -> StreamingQuery:
    return _append(traffic_windows(requests, bucket), path, checkpoint, trigger or {"processingTime": "1 minute"})


def stream_active_visitors(requests: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Approximate visitors of each five minutes."""
    return stream_traffic(requests, path, checkpoint, "5 minutes", **trigger)


def timer(spark: SparkSession) -> DataFrame:
    """A stream that always has input, for jobs that watch the clock."""
    return spark.readStream.format("rate").option("rowsPerSecond", 1).load()


def stream_stalls(
    ticks: DataFrame,
    read_runs: Callable[[], DataFrame],
    state_root: str,
    out_path: str,
    checkpoint: str,
    clock: Callable[[int], Column] = lambda batch: F.current_timestamp(),
    repeat_minutes: float = STALL_REPEAT_MINUTES,
    **trigger,
) -> StreamingQuery:
    """Announces stalled loops on every tick, each at most once per ``repeat_minutes``.

    The ticks (``timer``) only wake the check, so that it also speaks when every loop is dead; ages are taken by the wall
    clock from the runs read anew. State: when each loop was last announced.
    """
    keys = ["provider", "kind"]
    state = BucketedState(ticks.sparkSession, state_root, keys, STALL_STATE, buckets=1)

    def handle(batch: DataFrame, batch_id: int) -> None:
        now = clock(batch_id)
        told = state.read(batch_id)
        stalled = ops.stalled_loops(read_runs(), now).join(told, keys, "left")
        due = F.col("announced_at").isNull() | (F.unix_micros(now) - F.unix_micros("announced_at") >= F.lit(repeat_minutes * 6e7))
        fresh = stalled.filter(due).withColumn("announced_at", now.cast("timestamp")).persist()
        if fresh.isEmpty():
            fresh.unpersist()
            return
        fresh.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        state.write(keyed_upsert(told, fresh.select(*keys, "announced_at"), keys), batch_id)
        fresh.unpersist()

    return _start(ticks, handle, checkpoint, trigger or {"processingTime": "5 minutes"})


def told_stalls(spark: SparkSession, out_path: str) -> DataFrame:
    """What ``stream_stalls`` has announced; no rows while no loop has stalled, as a quiet job writes nothing."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(out_path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], STALL_COLUMNS)
    return spark.read.parquet(out_path).select(*[c.split()[0] for c in STALL_COLUMNS.split(", ")])
