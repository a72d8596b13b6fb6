"""Streaming jobs run to the end of the given tables, checked against their batch answer."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marketlens.fixtures import Tables
from marketlens.registry import query
from marketlens.session import shared_path
from marketlens.streaming import jobs

ONCE = {"availableNow": True}
CLOSE_AT = "timestamp '1998-01-01 00:00:00'"


def _stream(t: Tables, table: str):
    """The rows of one table, a file or a folder of files, as a file stream."""
    reader = t.spark.readStream.schema(t.table(table).schema)
    path = t.spark._jvm.org.apache.hadoop.fs.Path(f"{t.sf_dir}/{table}.parquet")
    if path.getFileSystem(t.spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{t.sf_dir}/{table}.parquet")
    return reader.option("pathGlobFilter", f"{table}.parquet").parquet(t.sf_dir)


def _folder(t: Tables, name: str) -> str:
    return shared_path(t.spark, f"{name}-{uuid.uuid4().hex}")


def _finish(query) -> None:
    query.awaitTermination()


def _quotes(t: Tables):
    rows = _stream(t, "lineitem")
    return rows.select(
        F.col("l_partkey").alias("selection_id"),
        (F.col("l_suppkey") % 8).alias("bookmaker_id"),
        ((F.lit(105) + 8 * F.col("l_quantity").cast("bigint")).cast("double") / 100).alias("price"),
        F.lit(None).cast("double").alias("point"),
        F.col("l_shipdate").alias("captured_at"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"),
    )


def _trades(t: Tables):
    rows = _stream(t, "events")
    return rows.select(
        F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("venue"),
        (F.col("event_id") % 3000).cast("string").alias("external_id"),
        (F.col("event_id") % 25).alias("market_id"),
        F.when(F.col("event_type").isin("click", "view", "purchase"), "yes").otherwise("no").alias("side"),
        ((F.lit(5) + (F.col("event_id") * 37) % 90).cast("double") / 100).alias("price"),
        (F.col("value") * 50).alias("notional"),
        F.col("ts").alias("traded_at"),
        "event_id",
    )


@query(
    "stream_quote_changes",
    """WITH q AS (SELECT l_partkey AS selection_id, l_suppkey % 8 AS bookmaker_id, CAST(105 + 8 * CAST(l_quantity AS BIGINT) AS DOUBLE) / 100 AS price, l_shipdate AS captured_at, l_orderkey * 100 + l_linenumber AS id FROM lineitem),
    w AS (SELECT *, lag(price) OVER (PARTITION BY selection_id, bookmaker_id ORDER BY captured_at, id, price) AS prev FROM q)
    SELECT selection_id, bookmaker_id, captured_at, id, price, prev IS NULL AS is_opening FROM w WHERE prev IS NULL OR prev <> price""",
    dbl="price",
)
def _(t: Tables):
    root = _folder(t, "quotes")
    quotes = _quotes(t)
    _finish(jobs.stream_quote_changes(quotes, f"{root}/log", f"{root}/ckpt", **ONCE))
    log = t.spark.read.parquet(f"{root}/log")
    return log.select("selection_id", "bookmaker_id", "captured_at", "id", "price", "is_opening")


@query(
    "stream_trade_tape",
    """SELECT CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS venue, CAST(event_id % 3000 AS VARCHAR) AS external_id, min(event_id) AS event_id FROM (
      SELECT *, row_number() OVER (PARTITION BY event_id % 2, event_id % 3000 ORDER BY ts, event_id) AS rn FROM events) e WHERE rn = 1 GROUP BY 1, 2""",
)
def _(t: Tables):
    root = _folder(t, "trades")
    _finish(jobs.stream_trade_tape(_trades(t), f"{root}/out", f"{root}/ckpt", **ONCE))
    return t.spark.read.parquet(f"{root}/out").select("venue", "external_id", "event_id")


@query(
    "stream_market_flow",
    """WITH f AS (SELECT event_id % 25 AS market_id, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'yes' ELSE 'no' END AS side, CAST(5 + (event_id * 37) % 90 AS DOUBLE) / 100 AS price, value * 50 AS notional,
         epoch_us(ts) // 900000000 AS b FROM events),
    c AS (SELECT market_id, side, b, count(*) AS fills, sum(notional) AS notional, sum(price) AS ps FROM f GROUP BY 1, 2, 3),
    w AS (SELECT market_id, side, b + 1 + k AS e, sum(fills) AS fills, sum(notional) AS notional, sum(ps) / sum(fills) AS mean_price FROM c, range(0, 96) r(k) GROUP BY 1, 2, 3)
    SELECT make_timestamp(e * 900000000) AS window_end, market_id, side, fills, notional, mean_price, fills >= 8 AS enough_fills FROM w
    WHERE e <= (SELECT max(b) + 1 FROM f WHERE (b + 1) * 900000000 <= (SELECT epoch_us(max(ts)) FROM events) - 86400000000)""",
    dbl="notional mean_price",
    big="fills",
)
def _(t: Tables):
    root = _folder(t, "flow")
    _finish(jobs.stream_market_flow(_trades(t), f"{root}/out", f"{root}/cells", f"{root}/ckpt", **ONCE))
    return t.spark.read.parquet(f"{root}/out").drop("batch")


def _requests(rows):
    kind = F.col("event_type")
    return rows.select(
        F.when(kind == "signup", "POST").otherwise("GET").alias("method"),
        F.when(kind == "click", "/app.js").when(kind == "error", "/api/x").otherwise(F.concat(F.lit("/"), kind)).alias("path"),
        F.lit(200).alias("status_code"),
        F.col("user_id").cast("string").alias("ip_address"),
        F.col("ts").alias("created_at"),
    )


def _against_exact(t: Tables, told, size: str):
    """The stream's buckets, and whether its visitors are within three standard errors (5 %) of the exact distinct count."""
    pages = _requests(t("events")).filter(F.col("path").isin("/view", "/purchase"))
    exact = pages.groupBy(F.window("created_at", size).alias("w")).agg(F.count_distinct("ip_address").alias("exact"))
    rows = told.join(exact.select(F.col("w.start").alias("bucket"), "exact"), "bucket", "left")
    near = F.abs(F.col("visitors") - F.col("exact")) <= 0.05 * F.col("exact")
    return rows.select("bucket", "page_views", "exact", near.alias("near"))


def _traffic_sql(size: str) -> str:
    return f"""SELECT time_bucket(INTERVAL {size}, ts) AS bucket, count(*) AS page_views, count(DISTINCT user_id) AS exact, true AS near FROM events WHERE event_type IN ('view', 'purchase') GROUP BY 1
    HAVING time_bucket(INTERVAL {size}, ts) + INTERVAL {size} <= (SELECT max(ts) FROM events WHERE event_type IN ('view', 'purchase')) - INTERVAL 10 MINUTE"""


@query("stream_traffic", _traffic_sql("1 HOUR"))
def _(t: Tables):
    root = _folder(t, "traffic")
    _finish(jobs.stream_traffic(_requests(_stream(t, "events")), f"{root}/out", f"{root}/ckpt", **ONCE))
    return _against_exact(t, t.spark.read.parquet(f"{root}/out"), "1 hour")


@query("stream_active_visitors", _traffic_sql("5 MINUTE"))
def _(t: Tables):
    root = _folder(t, "active")
    _finish(jobs.stream_active_visitors(_requests(_stream(t, "events")), f"{root}/out", f"{root}/ckpt", **ONCE))
    return _against_exact(t, t.spark.read.parquet(f"{root}/out"), "5 minutes")


@query(
    "stream_order_reconcile",
    """SELECT order_id, strategy_id, market_id, side, max(filled_size) AS delta_size, arg_max(filled_size * avg_fill_price, filled_size) AS delta_cost FROM (
      SELECT l_orderkey AS order_id, l_orderkey % 10 AS strategy_id, l_orderkey % 25 AS market_id, CASE WHEN l_orderkey % 2 = 0 THEN 'yes' ELSE 'no' END AS side, l_quantity AS filled_size, CAST(10 + l_orderkey % 80 AS DOUBLE) / 100 AS avg_fill_price FROM lineitem) f GROUP BY 1, 2, 3, 4""",
    dbl="delta_size delta_cost",
)
def _(t: Tables):
    rows = _stream(t, "lineitem")
    key = F.col("l_orderkey")
    reports = rows.select(
        key.alias("order_id"),
        (key % 10).alias("strategy_id"),
        (key % 25).alias("market_id"),
        F.when(key % 2 == 0, "yes").otherwise("no").alias("side"),
        F.col("l_linenumber").alias("report_seq"),
        F.col("l_quantity").alias("filled_size"),
        ((F.lit(10) + key % 80).cast("double") / 100).alias("avg_fill_price"),
    )
    root = _folder(t, "orders")
    _finish(jobs.stream_order_reconcile(reports, f"{root}/out", f"{root}/ckpt", **ONCE))
    return t.spark.read.parquet(f"{root}/out")


@query(
    "stream_closing_lines",
    f"""SELECT o.selection_id, o.bookmaker_id, o.price, 1 / o.price AS implied_prob, coalesce(d.shin, 0) AS fair_prob,
       CAST(floor((epoch_us(e.commence_at) - epoch_us({CLOSE_AT})) / 1e6 + 0.5) AS BIGINT) AS seconds_before_start
    FROM fx_odds o JOIN fx_selections s ON s.selection_id = o.selection_id JOIN fx_events e ON e.event_id = s.event_id
      LEFT JOIN ref_devig d ON d.selection_id = o.selection_id AND d.bookmaker_id = o.bookmaker_id
    WHERE o.price > 1 AND e.status IN ('scheduled', 'live') AND e.commence_at BETWEEN {CLOSE_AT} - INTERVAL 8760 HOUR AND {CLOSE_AT} + INTERVAL 8760 HOUR""",
    dbl="price implied_prob fair_prob",
)
def _(t: Tables):
    root = _folder(t, "closing")
    at = F.lit("1998-01-01 00:00:00").cast("timestamp")
    _finish(
        jobs.stream_closing_lines(
            _stream(t, "region"), lambda: t("fx_odds"), lambda: t("fx_events"), t("fx_selections"), f"{root}/state", f"{root}/ckpt",
            lambda batch: at, 8760, 8760 * 60, buckets=8, **ONCE,
        )
    )
    return jobs.closing_state(t.spark, f"{root}/state", 8).read()


@query(
    "stream_stalls",
    """WITH l AS (SELECT provider, kind, arg_max(status, id) AS status, max(finished_at) FILTER (WHERE status IN ('success', 'partial')) AS ok_at, CASE kind WHEN 'odds' THEN 20 WHEN 'schedule' THEN 90 WHEN 'fundamentals' THEN 2160 ELSE 360 END AS lim FROM fx_runs GROUP BY 1, 2)
    SELECT provider, kind, status FROM l WHERE ok_at IS NULL OR floor((epoch_us((SELECT max(ts) FROM events)) - epoch_us(ok_at)) / 6e7 + 0.5) > lim""",
)
def _(t: Tables):
    root = _folder(t, "stalls")
    at = t.scalar("SELECT max(ts) AS t FROM events")
    ticks = _stream(t, "region")
    _finish(jobs.stream_stalls(ticks, lambda: t("fx_runs"), f"{root}/state", f"{root}/out", f"{root}/ckpt", lambda batch: at, **ONCE))
    return jobs.told_stalls(t.spark, f"{root}/out").select("provider", "kind", "status")


@query(
    "stream_steam",
    # The observations of a day are spread over its hours, so that windows hold several instants.
    """WITH q AS (SELECT l_partkey AS s, l_suppkey % 8 AS b, l_shipdate + INTERVAL 17 MINUTE * CAST(l_orderkey % 60 AS INT) AS t, l_orderkey * 100 + l_linenumber AS id, CAST(105 + 8 * CAST(l_quantity AS BIGINT) AS DOUBLE) / 100 AS p FROM lineitem),
    v AS (SELECT *, date_trunc('hour', t) + k * INTERVAL 1 HOUR AS e FROM q, range(1, 7) r(k)),
    m AS (SELECT s, b, e, arg_max(p, (t, id, p)) - arg_min(p, (t, id, p)) AS d FROM v GROUP BY 1, 2, 3 HAVING count(*) >= 2),
    g AS (SELECT s, e, count(*) AS books, greatest(count(*) FILTER (WHERE d > 0), count(*) FILTER (WHERE d < 0)) / count(*) AS share FROM m GROUP BY 1, 2)
    SELECT e AS window_end, s AS selection_id, books, CASE WHEN share >= 0.6 THEN (share - 0.6) / 0.4 ELSE 0 END AS steam_score FROM g
    WHERE e <= (SELECT max(t) FROM q) - INTERVAL 10 MINUTE""",
    dbl="steam_score",
)
def _(t: Tables):
    root = _folder(t, "steam")
    hours = F.make_dt_interval(mins=F.lit(17) * ((F.col("id") / 100).cast("bigint") % 60).cast("int"))
    quotes = _quotes(t).withColumn("captured_at", F.col("captured_at") + hours)
    _finish(jobs.stream_steam(quotes, f"{root}/out", f"{root}/ckpt", **ONCE))
    return t.spark.read.parquet(f"{root}/out").select("window_end", "selection_id", "books", "steam_score")


@query(
    "stream_alerts",
    """WITH RECURSIVE a AS (SELECT event_id AS alert_id, CASE WHEN user_id % 2 = 0 THEN 'edge' ELSE 'whale' END AS kind, concat('L', CAST(user_id % 5 AS VARCHAR)) AS league,
         CASE event_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'b' ELSE '' END AS venue, value, ts AS raised_at FROM events),
    s AS (SELECT *, list_filter([lower(trim(x)) FOR x IN string_split(leagues, ',')], lambda x: x <> '') AS ls FROM fx_alert_subscriptions WHERE active),
    m AS (SELECT s.subscription_id, epoch_us(a.raised_at) AS t, min(a.alert_id) AS alert_id, max(epoch_us(s.last_sent_at)) AS seed FROM a JOIN s ON s.kind = a.kind AND a.value >= s.min_value
      AND (lower(s.venue) = 'both' OR a.venue = '' OR lower(s.venue) = lower(a.venue)) AND (len(s.ls) = 0 OR list_contains(s.ls, lower(a.league))) GROUP BY 1, 2),
    p AS (SELECT *, min(t) OVER (PARTITION BY subscription_id ORDER BY t RANGE BETWEEN 900000000 FOLLOWING AND UNBOUNDED FOLLOWING) AS following FROM m),
    walk AS (SELECT subscription_id, min(t) AS t FROM p WHERE seed IS NULL OR t - seed >= 900000000 GROUP BY 1
      UNION ALL SELECT p.subscription_id, p.following FROM walk w JOIN p ON p.subscription_id = w.subscription_id AND p.t = w.t WHERE p.following IS NOT NULL)
    SELECT w.subscription_id, p.alert_id, make_timestamp(w.t) AS sent_at FROM walk w JOIN p ON p.subscription_id = w.subscription_id AND p.t = w.t""",
)
def _(t: Tables):
    rows = _stream(t, "events")
    alerts = rows.select(
        F.col("event_id").alias("alert_id"),
        F.when(F.col("user_id") % 2 == 0, "edge").otherwise("whale").alias("kind"),
        F.concat(F.lit("L"), (F.col("user_id") % 5).cast("string")).alias("league"),
        F.when(F.col("event_id") % 3 == 0, "A").when(F.col("event_id") % 3 == 1, "b").otherwise("").alias("venue"),
        "value",
        F.col("ts").alias("raised_at"),
    )
    root = _folder(t, "alerts")
    _finish(jobs.stream_alerts(alerts, t("fx_alert_subscriptions"), f"{root}/out", f"{root}/ckpt", **ONCE))
    return t.spark.read.parquet(f"{root}/out").select("subscription_id", "alert_id", "sent_at")
