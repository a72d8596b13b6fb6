"""Web traffic: request validation, page views, visitors, and product-analytics events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.common import count_if, first_rows, js_round, minus_days, sum_if
from marketlens.functions.text import browser_name, currency_code, device_name, page_path, title_label

RANGE_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}
# Path prefixes of each scope, accepted methods and static file endings.
SCOPES = {
    "blog": ["/blog"],
    "commerce": ["/commerce", "/products", "/product", "/cart", "/checkout", "/orders"],
}
METHODS = ["GET", "POST", "PUT", "PATCH", "DELETE", "OPTIONS", "HEAD"]
STATIC = r"(?i)\.(css|js|map|png|jpe?g|gif|svg|ico|woff2?|ttf)$"


def percentage(part: Column, whole: Column) -> Column:
    """Share in percent with one decimal, 0 of nothing."""
    return F.when(whole > 0, js_round(part / whole * 1000.0) / 10.0).otherwise(F.lit(0.0))


def request_problem(df: DataFrame) -> Column:
    """Why a request row is unusable, NULL when it is fine."""
    method = F.upper(F.coalesce("method", F.lit("")))
    status, took = F.col("status_code"), F.col("duration_ms")
    return (
        F.when(~method.isin(METHODS), "unsupported method")
        .when(F.trim(F.coalesce("path", F.lit(""))) == "", "missing path")
        .when(status.isNull() | (status < 100) | (status > 599), "bad status code")
        .when(took.isNull() | F.isnan(took) | (took < 0), "bad duration")
        .when(F.col("created_at").isNull(), "bad timestamp")
    )


def split_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable rows, quarantined rows with the reason)."""
    checked = requests.withColumn("problem", request_problem(requests))
    good = checked.filter(F.col("problem").isNull()).drop("problem")
    return good, checked.filter(F.col("problem").isNotNull())


def in_range(ts: Column, as_of: Column, span: str) -> Column:
    return (ts >= minus_days(as_of, RANGE_DAYS[span])) & (ts <= as_of)


def in_scope(path: Column, scope: str) -> Column:
    if scope == "all":
        return F.lit(True)
    hits = [(path == p) | F.startswith(path, F.lit(p + "/")) for p in SCOPES[scope]]
    out = hits[0]
    for hit in hits[1:]:
        out = out | hit
    return out


def is_page(path: Column) -> Column:
    return (
        (F.upper("method") == "GET")
        & (F.col("status_code") < 400)
        & ~F.startswith(path, F.lit("/api/"))
        & ~F.startswith(path, F.lit("/__"))
        & ~path.rlike(STATIC)
    )


def scoped_requests(requests: DataFrame, as_of: Column, span: str = "month", scope: str = "all") -> DataFrame:
    path = page_path(F.col("path"))
    rows = requests.filter(in_range(F.col("created_at"), as_of, span))
    return rows.withColumn("page_path", path).filter(in_scope(F.col("page_path"), scope))


def page_requests(requests: DataFrame, as_of: Column, span: str = "month", scope: str = "all") -> DataFrame:
    return scoped_requests(requests, as_of, span, scope).filter(is_page(F.col("page_path")))


def _visitors(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Views per key and visitor: the first level of an exact distinct count that combines map-side."""
    return df.groupBy(*keys, "ip_address").agg(F.count(F.lit(1)).alias("views"))


def _known_visitor() -> Column:
    return F.coalesce(F.col("ip_address"), F.lit("")) != ""


def web_overview(requests: DataFrame, as_of: Column, span: str = "month", scope: str = "all") -> DataFrame:
    """Visitors, views, mean response, error rate and live visitors in one row.

    Rows are folded per visitor first, so the distinct counts need no second copy of the input.
    """
    rows = scoped_requests(requests, as_of, span, scope)
    page = is_page(F.col("page_path"))
    live = page & (F.col("created_at") >= minus_days(as_of, 5 / 1440))
    took = F.col("duration_ms") > 0
    per_visitor = rows.groupBy("ip_address").agg(
        F.count(F.lit(1)).alias("requests"),
        count_if(page).alias("pages"),
        count_if(live).alias("live"),
        count_if(F.col("status_code") >= 400).alias("errors"),
        count_if((F.col("status_code") > 0) & (F.col("status_code") < 400)).alias("ok"),
        sum_if(took, F.col("duration_ms")).alias("took"),
        count_if(took).alias("timed"),
    )
    total = per_visitor.agg(
        count_if(_known_visitor() & (F.col("live") > 0)).alias("realtime_visitors"),
        count_if(_known_visitor() & (F.col("pages") > 0)).alias("unique_visitors"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pages", "requests", "errors", "ok", "took", "timed")],
    )
    return total.select(
        "realtime_visitors",
        "unique_visitors",
        F.col("pages").alias("page_views"),
        F.when(F.col("timed") > 0, js_round(F.col("took") / F.col("timed"))).otherwise(0.0).alias("average_response_ms"),
        percentage(F.col("errors"), F.col("requests")).alias("error_rate_pct"),
        F.col("ok").alias("successful_requests"),
    )


def bucket_label(ts: Column, span: str) -> Column:
    pattern = {"day": "HH:00", "year": "yyyy-MM"}.get(span, "yyyy-MM-dd")
    return F.date_format(ts, pattern)


def traffic_series(pages: DataFrame, span: str = "month") -> DataFrame:
    """Views and distinct visitors per hour, day or month."""
    per_visitor = _visitors(pages.withColumn("bucket", bucket_label(F.col("created_at"), span)), "bucket")
    return per_visitor.groupBy("bucket").agg(
        F.sum("views").alias("page_views"), count_if(_known_visitor()).alias("visitors")
    )


def top_pages(pages: DataFrame, limit: int = 10) -> DataFrame:
    """Views, visitors and share of each path, most viewed first."""
    total = pages.agg(F.count(F.lit(1)).alias("n")).scalar()
    per_path = (
        _visitors(pages, "page_path")
        .groupBy(F.col("page_path").alias("path"))
        .agg(F.sum("views").alias("views"), count_if(_known_visitor()).alias("visitors"))
    )
    top = per_path.orderBy(F.desc("views"), "path").limit(limit)
    return top.withColumn("percentage", percentage(F.col("views"), total))


def visitor_breakdown(pages: DataFrame, kind: str = "device") -> DataFrame:
    """Distinct visitors per device or browser with the share of the summed counts."""
    name = device_name(F.col("user_agent")) if kind == "device" else browser_name(F.col("user_agent"))
    groups = (
        _visitors(pages.withColumn("name", name), "name")
        .groupBy("name")
        .agg(count_if(_known_visitor()).alias("visitors"))
    )
    total = groups.agg(F.sum("visitors").alias("n")).scalar()
    return groups.withColumn("percentage", percentage(F.col("visitors"), total))


def analytics_events(events: DataFrame, as_of: Column, span: str = "month") -> DataFrame:
    rows = events.filter(in_range(F.col("created_at"), as_of, span))
    category = F.coalesce(F.nullif("category", F.lit("")), F.lit("custom"))
    return rows.withColumn("category", category).withColumn("currency", currency_code(F.col("currency")))


def event_totals(events: DataFrame, limit: int | None = None) -> DataFrame:
    rows = events.groupBy("name", "category", "currency").agg(
        F.count(F.lit(1)).alias("count"), F.sum("value").alias("value"), F.max("created_at").alias("last_seen")
    )
    return first_rows(rows, limit, F.desc("count"), "name", "category", "currency")


def event_categories(events: DataFrame) -> DataFrame:
    total = events.agg(F.count(F.lit(1)).alias("n")).scalar()
    rows = events.groupBy(F.col("category").alias("name")).agg(F.count(F.lit(1)).alias("count"))
    return rows.select("name", title_label(F.col("name")).alias("label"), "count", percentage(F.col("count"), total).alias("percentage"))


def event_values(events: DataFrame) -> DataFrame:
    paid = events.filter(F.col("value") > 0)
    return paid.groupBy("currency").agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("events"))


def event_timeline(events: DataFrame, span: str = "month") -> DataFrame:
    return events.groupBy(bucket_label(F.col("created_at"), span).alias("bucket")).agg(F.count(F.lit(1)).alias("count"))


def event_overview(events: DataFrame) -> DataFrame:
    names = events.groupBy("name", "category").agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col("value") > 0).alias("valued")
    )
    return names.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences"),
        F.count_distinct("name").alias("event_names"),
        F.count_distinct("category").alias("categories"),
        F.coalesce(F.sum("valued"), F.lit(0)).alias("valued_events"),
    )


def recent_rows(df: DataFrame, ts: str, key: str, limit: int) -> DataFrame:
    """Newest rows first, ties by key."""
    return df.orderBy(F.desc(ts), F.desc(key)).limit(limit)
