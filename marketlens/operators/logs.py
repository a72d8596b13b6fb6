"""Operational logs: query logs, application logs, deliveries, errors, jobs, generic roll-ups, search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.functions.common import count_if, first_rows, js_round, minus_days, minus_hours, ratio
from marketlens.functions.text import compact_text, strip_query
from marketlens.operators.web import percentage

TIMEFRAMES = {"day": (1, "yyyy-MM-dd HH:00:00"), "week": (7, "yyyy-MM-dd"), "month": (30, "yyyy-MM-dd")}
RETENTION_DAYS = 7
DELIVERY_STATUSES = ("sent", "delivered", "failed", "pending")


def _n() -> Column:
    return F.count(F.lit(1))


def contains_any(columns: list[str], needle: str) -> Column:
    """Case-insensitive substring over several columns."""
    low = needle.lower()
    hits = [F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(low)) for c in columns]
    return reduce(lambda a, b: a | b, hits)


def page_of(df: DataFrame, order: list[Column], page: int = 1, per_page: int = 10) -> DataFrame:
    return df.orderBy(*order).offset((page - 1) * per_page).limit(per_page)


def first_tag(tags: Column) -> Column:
    """First element of a JSON list, NULL when there is none."""
    return F.get_json_object(tags, "$[0]")


def query_log_stats(logs: DataFrame, as_of: Column) -> DataFrame:
    """Counts by tag and status, mean duration by tag, slow queries per hour, as (section, key, count, mean)."""
    cells = logs.groupBy(first_tag(F.col("tags")).alias("tag"), "status").agg(_n().alias("n"), F.sum("duration").alias("d"))
    none = F.lit(None).cast("double")
    by_tag = cells.groupBy(F.lit("type").alias("section"), F.col("tag").alias("key")).agg(
        F.sum("n").alias("count"), (F.sum("d") / F.sum("n")).alias("avg_duration")
    )
    by_status = cells.groupBy(F.lit("status").alias("section"), F.col("status").alias("key")).agg(
        F.sum("n").alias("count"), F.first(none).alias("avg_duration")
    )
    slow = logs.filter((F.col("status") == "slow") & (F.col("executed_at") >= minus_days(as_of, 1)))
    hours = slow.groupBy(
        F.lit("slow_hour").alias("section"), F.date_format("executed_at", "yyyy-MM-dd HH:00:00").alias("key")
    ).agg(_n().alias("count"), F.first(none).alias("avg_duration"))
    return by_tag.unionByName(by_status).unionByName(hours)


def query_log_timeline(logs: DataFrame, as_of: Column, timeframe: str = "day", tag: str | None = None) -> DataFrame:
    days, pattern = TIMEFRAMES[timeframe]
    rows = logs.filter(F.col("executed_at") >= minus_days(as_of, days))
    if tag:
        rows = rows.filter(F.contains(F.col("tags"), F.lit(f'"{tag}"')))
    return rows.groupBy(F.date_format("executed_at", pattern).alias("time_interval")).agg(
        _n().alias("count"), F.avg("duration").alias("avg_duration")
    )


def frequent_queries(logs: DataFrame, limit: int = 10) -> DataFrame:
    rows = logs.groupBy("normalized_query").agg(
        _n().alias("count"), F.avg("duration").alias("avg_duration"), F.max("duration").alias("max_duration")
    )
    return rows.orderBy(F.desc("count"), "normalized_query").limit(limit)


def query_log_search(
    logs: DataFrame, connection: str | None = None, status: str | None = None, tag: str | None = None, search: str | None = None
) -> DataFrame:
    rows = logs
    if connection:
        rows = rows.filter(F.col("connection") == connection)
    if status:
        rows = rows.filter(F.col("status") == status)
    if tag:
        rows = rows.filter(F.contains(F.col("tags"), F.lit(f'"{tag}"')))
    if search:
        rows = rows.filter(contains_any(["query", "model", "method", "affected_tables"], search))
    return rows


def slow_queries(logs: DataFrame, threshold: float = 100.0) -> DataFrame:
    return logs.filter(F.col("duration") >= threshold)


def query_log_rows(logs: DataFrame) -> DataFrame:
    """Statement type, parsed lists and the reason a row is rejected (NULL when it is fine)."""
    word = F.upper(F.regexp_extract(F.trim(F.coalesce("query", F.lit(""))), "^([A-Za-z]+)", 1))
    kind = F.when(word.isin("SELECT", "INSERT", "UPDATE", "DELETE"), word).otherwise("OTHER")
    lists = {c: F.from_json(F.col(c), T.ArrayType(T.StringType())) for c in ("tags", "affected_tables")}
    bad_list = [(F.coalesce(F.col(c), F.lit("")) != "") & parsed.isNull() for c, parsed in lists.items()]
    problem = (
        F.when(F.trim(F.coalesce("query", F.lit(""))) == "", "empty query")
        .when(~F.col("status").isin("completed", "failed", "slow"), "unknown status")
        .when(F.col("executed_at").isNull(), "missing time")
        .when(F.col("duration").isNull() | F.isnan("duration"), "bad duration")
        .when(reduce(lambda a, b: a | b, bad_list), "bad list")
    )
    return logs.select(
        "id",
        kind.alias("type"),
        "duration",
        "status",
        *[F.coalesce(parsed, F.array().cast("array<string>")).alias(c) for c, parsed in lists.items()],
        problem.alias("problem"),
    )


def log_filter(
    logs: DataFrame,
    since: Column | None = None,
    type: str | None = None,
    source: str | None = None,
    project: str | None = None,
    search: str | None = None,
) -> DataFrame:
    rows = logs if since is None else logs.filter(F.col("logged_at") >= since)
    for column, value in (("type", type), ("source", source), ("project", project)):
        if value:
            rows = rows.filter(F.col(column) == value)
    return rows.filter(contains_any(["message", "project", "file", "stacktrace"], search)) if search else rows


def log_summary(logs: DataFrame) -> DataFrame:
    return logs.agg(
        _n().alias("total"), *[count_if(F.col("type") == k).alias(k) for k in ("error", "warning", "info", "success")]
    )


def log_hourly(logs: DataFrame, as_of: Column) -> DataFrame:
    rows = logs.filter(F.col("logged_at") >= minus_hours(as_of, 24))
    return rows.groupBy(F.date_format("logged_at", "yyyy-MM-dd HH:00").alias("hour")).agg(_n().alias("count"))


def ops_insights(requests: DataFrame, logs: DataFrame, errors: DataFrame) -> DataFrame:
    """Request and query totals in one row."""
    ok = F.col("status_code") < 400
    r = requests.agg(
        _n().alias("requests"),
        count_if(ok).alias("successful_requests"),
        F.avg("duration_ms").alias("average_request_ms"),
        F.max("duration_ms").alias("maximum_request_ms"),
    )
    q = logs.agg(
        _n().alias("queries"),
        *[count_if(F.col("status") == s).alias(s) for s in ("completed", "slow", "failed")],
        F.avg("duration").alias("average"),
        F.max("duration").alias("maximum"),
    )
    whole = r.select("*", q.select(F.struct("*")).scalar().alias("q"), errors.agg(_n()).scalar().alias("errors"))
    return whole.select(
        *r.columns,
        percentage(F.col("successful_requests"), F.col("requests")).alias("request_success_rate"),
        *[F.col(f"q.{c}").alias(f"{c}_queries") for c in ("completed", "slow", "failed")],
        "q.queries",
        F.col("q.average").alias("average_query_ms"),
        F.col("q.maximum").alias("maximum_query_ms"),
        "errors",
    )


def slowest_requests(requests: DataFrame, limit: int = 5) -> DataFrame:
    top = requests.orderBy(F.desc("duration_ms"), F.desc("id")).limit(limit)
    return top.select("id", "method", strip_query(F.col("path")).alias("path"), "status_code", "duration_ms", "created_at")


def slowest_queries(logs: DataFrame, threshold: float = 100.0, limit: int = 5, length: int | None = None) -> DataFrame:
    """The longest of the slow queries, white space made single; with ``length`` their text is shortened to it."""
    top = slow_queries(logs, threshold).orderBy(F.desc("duration"), F.desc("id")).limit(limit)
    return top.select("id", compact_text(F.col("query"), length).alias("query"), "duration", "status", "connection", "executed_at")


def http_metrics(requests: DataFrame, sample: int | None = None) -> DataFrame:
    """Mean duration and success and error rates over all requests, or the newest ``sample``, with the count of all."""
    status = F.col("status_code")
    sums = first_rows(requests, sample, F.desc("created_at"), F.desc("id")).agg(
        _n().alias("sampled"),
        F.coalesce(js_round(F.avg("duration_ms")), F.lit(0.0)).alias("average_ms"),
        count_if((status >= 200) & (status < 400)).alias("ok"),
        count_if(status >= 400).alias("bad"),
    )
    total = F.col("sampled") if sample is None else requests.agg(_n()).scalar()
    return sums.select(
        total.alias("total"),
        "sampled",
        "average_ms",
        ratio(F.col("ok") * 100.0, F.col("sampled"), None).alias("success_rate"),
        ratio(F.col("bad") * 100.0, F.col("sampled"), None).alias("error_rate"),
    )


def recent_activity(orders: DataFrame, users: DataFrame, limit: int = 5) -> DataFrame:
    """Newest rows of two tables merged; each side is cut before the union."""
    a = orders.orderBy(F.desc("created_at"), F.desc("order_id")).limit(limit).select(
        F.lit("order").alias("type"), F.concat(F.lit("Order #"), F.col("order_id").cast("string")).alias("message"), "created_at"
    )
    b = users.orderBy(F.desc("created_at"), F.desc("user_id")).limit(limit).select(
        F.lit("user").alias("type"), F.concat(F.lit("User "), F.col("name"), F.lit(" registered")).alias("message"), "created_at"
    )
    return a.unionByName(b).orderBy(F.desc("created_at"), "type", "message").limit(limit)


def delivery_channels(deliveries: DataFrame) -> DataFrame:
    """Status counts and success rate per channel."""
    channel = F.coalesce(F.nullif("channel", F.lit("")), F.lit("unknown"))
    rows = deliveries.groupBy(channel.alias("channel")).agg(
        _n().alias("total"), *[count_if(F.col("status") == s).alias(s) for s in DELIVERY_STATUSES]
    )
    good = F.col("sent") + F.col("delivered")
    return rows.withColumn("success_rate", js_round(ratio(good * 100.0, F.col("total")), 1))


def delivery_stats(channels: DataFrame) -> DataFrame:
    sums = channels.agg(
        F.sum("total").alias("total"),
        (F.sum("sent") + F.sum("delivered")).alias("successful"),
        F.sum("failed").alias("failed"),
        F.sum("pending").alias("pending"),
        _n().alias("active_channels"),
    )
    return sums.withColumn("success_rate", js_round(ratio(F.col("successful") * 100.0, F.col("total")), 1))


def mail_activity(sent: DataFrame, received: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Sent, failed and received mail per day of the last ``days`` days, empty days included."""
    start = minus_days(F.date_trunc("day", as_of), days - 1)
    label = "yyyy-MM-dd"

    def daily(df: DataFrame, **counts: Column) -> DataFrame:
        rows = df.filter((F.col("created_at") >= start) & (F.col("created_at") < minus_days(start, -days)))
        return rows.groupBy(F.date_format("created_at", label).alias("bucket")).agg(*[c.alias(n) for n, c in counts.items()])

    out = daily(sent, sent=count_if(F.col("status").isin("sent", "delivered")), failed=count_if(F.col("status") == "failed"))
    inbox = daily(received, received=_n())
    step = F.explode(F.sequence(start, F.date_trunc("day", as_of), F.expr("interval 1 day")))
    grid = sent.sparkSession.range(1).select(step.alias("at")).select(F.date_format("at", label).alias("bucket"))
    return grid.join(out, "bucket", "left").join(inbox, "bucket", "left").na.fill(0)


def period_change(rows: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Count of this period against the one before: 0 when both are empty, NULL when only the old one is."""
    start = minus_days(F.date_trunc("day", as_of), days - 1)
    now = F.col("created_at") >= start
    sums = rows.filter((F.col("created_at") >= minus_days(start, days)) & (F.col("created_at") < minus_days(start, -days))).agg(
        count_if(now).alias("current"), count_if(~now).alias("previous")
    )
    change = js_round((F.col("current") - F.col("previous")) / F.col("previous") * 100.0, 1)
    return sums.withColumn(
        "change_pct", F.when(F.col("previous") > 0, change).when(F.col("current") == 0, F.lit(0.0))
    )


def realtime_stats(rows: DataFrame) -> DataFrame:
    """Events, distinct sockets, outcomes and success rate of socket traffic."""
    kinds = {"successes": "success", "errors": "error", "disconnections": "disconnection"}
    per_socket = rows.groupBy(F.nullif("socket", F.lit("")).alias("socket")).agg(
        _n().alias("n"), *[count_if(F.col("type") == k).alias(c) for c, k in kinds.items()]
    )
    sums = per_socket.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("recorded_events"),
        F.count("socket").alias("unique_sockets"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in kinds],
    )
    return sums.withColumn("success_rate", percentage(F.col("successes"), F.col("recorded_events")))


def release_summary(releases: DataFrame) -> DataFrame:
    return releases.agg(
        _n().alias("total"),
        count_if(F.lower("status") == "published").alias("published"),
        F.coalesce(F.sum("downloads"), F.lit(0)).alias("downloads"),
        F.max_by("version", F.struct("created_at", "release_id")).alias("latest_version"),
    )


def deployment_summary(rows: DataFrame) -> DataFrame:
    # Status families.
    families = {
        "successful": ["success", "successful", "completed", "ready"],
        "failed": ["failed", "error", "cancelled"],
        "active": ["pending", "queued", "running", "deploying"],
    }
    return rows.agg(
        _n().alias("total"),
        *[count_if(F.col("status").isin(names)).alias(f) for f, names in families.items()],
        F.avg(F.when(F.col("duration") >= 0, F.col("duration"))).alias("average_duration"),
    )


def count_by(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    rows = df.groupBy(F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit("unknown")).alias("key")).agg(_n().alias("count"))
    return rows if limit is None else rows.orderBy(F.desc("count"), "key").limit(limit)


def daily_rollup(df: DataFrame, ts: str, as_of: Column, days: int, value: str | None = None) -> DataFrame:
    """Dense count (and sum of ``value``) per day over the last ``days`` days."""
    start = minus_days(F.date_trunc("day", as_of), days - 1)
    measures = [_n().alias("count")] + ([F.sum(value).alias("sum")] if value else [])
    cells = (
        df.filter((F.col(ts) >= start) & (F.col(ts) <= as_of))
        .groupBy(F.date_format(ts, "yyyy-MM-dd").alias("day"))
        .agg(*measures)
    )
    step = F.explode(F.sequence(start, F.date_trunc("day", as_of), F.expr("interval 1 day")))
    grid = df.sparkSession.range(1).select(step.alias("at")).select(F.date_format("at", "yyyy-MM-dd").alias("day"))
    return grid.join(cells, "day", "left").na.fill(0)


def global_search(tables: dict[str, tuple[DataFrame, str, list[str]]], needle: str, per_table: int | None = None) -> DataFrame:
    """Matches of each table, with ``per_table`` those of the lowest ids: ``tables`` maps name to (rows, id column, fields)."""
    parts = [
        first_rows(
            df.filter(contains_any(fields, needle)).select(
                F.lit(name).alias("table"), F.col(key).cast("bigint").alias("id"), F.col(fields[0]).cast("string").alias("title")
            ),
            per_table,
            "id",
        )
        for name, (df, key, fields) in tables.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def error_groups(errors: DataFrame) -> DataFrame:
    return errors.groupBy("type", "message").agg(
        _n().alias("count"),
        F.min("created_at").alias("first_seen"),
        F.max("created_at").alias("last_seen"),
        *[count_if(F.col("status") == s).alias(s) for s in ("unresolved", "resolved", "ignored")],
    )


def error_timeline(errors: DataFrame, as_of: Column) -> DataFrame:
    """Errors per hour over the last 24 hours, empty hours included."""
    start = F.date_trunc("hour", minus_hours(as_of, 23))
    cells = (
        errors.filter((F.col("created_at") >= start) & (F.col("created_at") <= as_of))
        .groupBy(F.date_format("created_at", "yyyy-MM-dd HH:00").alias("hour"))
        .agg(_n().alias("count"))
    )
    step = F.explode(F.sequence(start, F.date_trunc("hour", as_of), F.expr("interval 1 hour")))
    grid = errors.sparkSession.range(1).select(step.alias("at")).select(F.date_format("at", "yyyy-MM-dd HH:00").alias("hour"))
    return grid.join(cells, "hour", "left").na.fill(0)


def retention_prune(df: DataFrame, ts: str, as_of: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """Rows that survive the retention period."""
    return df.filter(F.col(ts) >= minus_days(as_of, days))


def pressure_samples(samples: DataFrame, as_of: Column, hours: float = 24, limit: int | None = None) -> DataFrame:
    """Samples of each organisation in a window, numbered from the newest; with ``limit`` the newest of each."""
    order = W.partitionBy("org").orderBy(F.desc("sampled_at"), F.desc("id"))
    rows = samples.filter(F.col("sampled_at") >= minus_hours(as_of, hours))
    rows = rows.withColumn("back", F.row_number().over(order))
    return rows if limit is None else rows.filter(F.col("back") <= limit)


def job_history(active: DataFrame, failed: DataFrame) -> DataFrame:
    """Waiting, running and failed jobs in one shape."""
    a = active.select(
        F.concat(F.lit("active:"), F.col("id").cast("string")).alias("job_id"), "queue", "name", "status",
        F.lit("").alias("error"), "payload", F.col("created_at").alias("happened_at"),
    )
    b = failed.select(
        F.concat(F.lit("failed:"), F.col("id").cast("string")).alias("job_id"), "queue", "name",
        F.lit("failed").alias("status"), "error", "payload", F.col("failed_at").alias("happened_at"),
    )
    return a.unionByName(b)


def job_search(jobs: DataFrame, queue: str | None = None, status: str | None = None, search: str | None = None) -> DataFrame:
    rows = jobs
    if queue:
        rows = rows.filter(F.col("queue") == queue)
    if status:
        rows = rows.filter(F.col("status") == status)
    return rows.filter(contains_any(["job_id", "name", "queue", "status", "error", "payload"], search)) if search else rows


def job_stats(jobs: DataFrame) -> DataFrame:
    rows = jobs.groupBy("queue").agg(_n().alias("jobs"), count_if(F.col("status") == "failed").alias("failed"))
    return rows.withColumn("failure_rate", js_round(ratio(F.col("failed") * 100.0, F.col("jobs")), 1))


def table_explorer(
    df: DataFrame, filters: dict[str, object] | None = None, search: str | None = None, hidden: set[str] | None = None
) -> DataFrame:
    """Equality filters and substring search over the text columns of any table, hidden columns excluded."""
    hidden = hidden or set()
    rows = df
    for column, value in (filters or {}).items():
        if column in df.columns and column not in hidden:
            rows = rows.filter(F.col(column) == F.lit(value))
    if search:
        texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in hidden]
        rows = rows.filter(contains_any(texts, search)) if texts else rows.filter(F.lit(False))
    return rows.select(*[c for c in df.columns if c not in hidden])


def release_interval(releases: DataFrame) -> DataFrame:
    """Mean seconds between consecutive releases.

    The gaps telescope to (last - first), so no ordered pass is needed.
    """
    rows = releases.filter(F.col("created_at").isNotNull()).agg(
        _n().alias("n"), F.unix_micros(F.max("created_at")).alias("hi"), F.unix_micros(F.min("created_at")).alias("lo")
    )
    several = F.col("n") >= 2
    mean = js_round((F.col("hi") - F.col("lo")) / F.when(several, F.col("n") - 1) / 1e6)
    return rows.select(
        F.when(several, mean).alias("average_seconds"),
        F.when(several, F.col("n") - 1).otherwise(F.lit(0)).alias("intervals"),
    )


def overview_counts(users: DataFrame, orders: DataFrame, posts: DataFrame, customers: DataFrame) -> DataFrame:
    parts = {
        "users": users,
        "orders": orders.filter(F.lower("status") != "cancelled"),
        "posts": posts,
        "customers": customers,
    }
    rows = [df.agg(_n().alias("count")).select(F.lit(name).alias("name"), "count") for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), rows)
