"""Queries over requests and product-analytics events."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.fixtures import Tables
from marketlens.functions import text
from marketlens.operators import web
from marketlens.plans.tape import TAPE_AS_OF, tape_as_of
from marketlens.registry import query

NOW = f"({TAPE_AS_OF})"
# The default range is 30 days, as on the report pages.
ROWS_SQL = f"""
rows_ AS (SELECT *, CASE WHEN path LIKE '/%' THEN path ELSE concat('/', path) END AS page_path FROM fx_requests WHERE created_at >= {NOW} - INTERVAL 30 DAY AND created_at <= {NOW}),
pages AS (SELECT * FROM rows_ WHERE method = 'GET' AND status_code < 400 AND page_path NOT LIKE '/api/%' AND page_path NOT LIKE '/\\_\\_%' ESCAPE '\\'
          AND NOT regexp_matches(lower(page_path), '\\.(css|js|map|png|jpe?g|gif|svg|ico|woff2?|ttf)$'))
"""


def _pct(part: str, whole: str) -> str:
    return f"floor({part} / {whole} * 1000 + 0.5) / 10"


@query(
    "request_validation",
    """SELECT id, CASE WHEN upper(method) NOT IN ('GET', 'POST', 'PUT', 'PATCH', 'DELETE', 'OPTIONS', 'HEAD') THEN 'unsupported method' WHEN trim(path) = '' THEN 'missing path'
       WHEN status_code < 100 OR status_code > 599 THEN 'bad status code' WHEN duration_ms < 0 THEN 'bad duration' WHEN created_at IS NULL THEN 'bad timestamp' ELSE 'ok' END AS problem FROM fx_raw_requests""",
)
def _(t: Tables):
    good, bad = web.split_requests(t("fx_raw_requests"))
    return good.select("id", F.lit("ok").alias("problem")).unionByName(bad.select("id", "problem"))


@query(
    "page_paths",
    "SELECT id, CASE WHEN trim(path) = '' THEN '/' ELSE regexp_replace(regexp_replace(path, '^https://[^/]*', ''), '[?].*$', '') END AS page_path FROM fx_raw_requests",
)
def _(t: Tables):
    return t("fx_raw_requests").select("id", text.page_path(F.col("path")).alias("page_path"))


@query("page_requests", f"WITH {ROWS_SQL} SELECT id, page_path, ip_address FROM pages")
def _(t: Tables):
    return web.page_requests(t("fx_requests"), tape_as_of(t)).select("id", "page_path", "ip_address")


@query(
    "user_agent_class",
    """SELECT user_agent, CASE WHEN user_agent LIKE '%Edg/%' THEN 'Edge' WHEN user_agent LIKE '%Firefox/%' THEN 'Firefox' WHEN user_agent LIKE '%Chrome/%' THEN 'Chrome'
       WHEN user_agent LIKE '%Safari/%' THEN 'Safari' WHEN user_agent <> '' THEN 'Other' ELSE 'Unknown' END AS browser,
       CASE WHEN user_agent LIKE '%Mobile%' THEN 'Phone' WHEN user_agent <> '' THEN 'Desktop' ELSE 'Unknown' END AS device, count(*) AS requests FROM fx_requests GROUP BY 1, 2, 3""",
)
def _(t: Tables):
    rows = t("fx_requests").groupBy("user_agent").agg(F.count(F.lit(1)).alias("requests"))
    agent = F.col("user_agent")
    return rows.select(agent, text.browser_name(agent).alias("browser"), text.device_name(agent).alias("device"), "requests")


@query(
    "web_overview",
    f"""WITH {ROWS_SQL} SELECT (SELECT count(DISTINCT ip_address) FROM pages WHERE created_at >= {NOW} - INTERVAL 5 MINUTE) AS realtime_visitors,
       (SELECT count(DISTINCT ip_address) FROM pages) AS unique_visitors, (SELECT count(*) FROM pages) AS page_views,
       floor(avg(duration_ms) FILTER (WHERE duration_ms > 0) + 0.5) AS average_response_ms, {_pct("count(*) FILTER (WHERE status_code >= 400)", "count(*)")} AS error_rate_pct,
       count(*) FILTER (WHERE status_code > 0 AND status_code < 400) AS successful_requests FROM rows_""",
    dbl="average_response_ms error_rate_pct",
)
def _(t: Tables):
    return web.web_overview(t("fx_requests"), tape_as_of(t))


@query(
    "web_traffic_series",
    f"WITH {ROWS_SQL} SELECT strftime(created_at, '%Y-%m-%d') AS bucket, count(*) AS page_views, count(DISTINCT ip_address) AS visitors FROM pages GROUP BY 1",
)
def _(t: Tables):
    return web.traffic_series(web.page_requests(t("fx_requests"), tape_as_of(t)))


@query(
    "web_traffic_hours",
    f"""WITH {ROWS_SQL} SELECT strftime(created_at, '%H:00') AS bucket, count(*) AS page_views, count(DISTINCT ip_address) AS visitors FROM pages
    WHERE created_at >= {NOW} - INTERVAL 1 DAY GROUP BY 1""",
)
def _(t: Tables):
    return web.traffic_series(web.page_requests(t("fx_requests"), tape_as_of(t), span="day"), span="day")


@query(
    "top_pages",
    f"""WITH {ROWS_SQL} SELECT page_path AS path, count(*) AS views, count(DISTINCT ip_address) AS visitors, {_pct("count(*)", "(SELECT count(*) FROM pages)")} AS percentage
    FROM pages GROUP BY 1 ORDER BY views DESC, path LIMIT 10""",
    dbl="percentage",
)
def _(t: Tables):
    return web.top_pages(web.page_requests(t("fx_requests"), tape_as_of(t)))


@query(
    "visitor_breakdown",
    f"""WITH {ROWS_SQL}, g AS (SELECT 'device' AS kind, CASE WHEN user_agent LIKE '%Mobile%' THEN 'Phone' WHEN user_agent <> '' THEN 'Desktop' ELSE 'Unknown' END AS name, count(DISTINCT ip_address) AS visitors FROM pages GROUP BY 1, 2
      UNION ALL SELECT 'browser', CASE WHEN user_agent LIKE '%Edg/%' THEN 'Edge' WHEN user_agent LIKE '%Firefox/%' THEN 'Firefox' WHEN user_agent LIKE '%Chrome/%' THEN 'Chrome' ELSE 'Unknown' END, count(DISTINCT ip_address) FROM pages GROUP BY 1, 2)
    SELECT kind, name, visitors, {_pct("visitors", "sum(visitors) OVER (PARTITION BY kind)")} AS percentage FROM g""",
    dbl="percentage",
)
def _(t: Tables):
    pages = web.page_requests(t("fx_requests"), tape_as_of(t))
    parts = [web.visitor_breakdown(pages, kind).withColumn("kind", F.lit(kind)) for kind in ("device", "browser")]
    return parts[0].unionByName(parts[1])


EVENTS_SQL = f"""
ev AS (SELECT id, name, CASE WHEN category = '' THEN 'custom' ELSE category END AS category, CASE WHEN trim(currency) = '' THEN 'USD' ELSE upper(trim(currency)) END AS currency, value, created_at
       FROM fx_app_events WHERE created_at >= {NOW} - INTERVAL 30 DAY AND created_at <= {NOW})
"""


def _events(t: Tables):
    return web.analytics_events(t("fx_app_events"), tape_as_of(t))


@query(
    "event_analytics",
    f"""WITH {EVENTS_SQL} SELECT name, category, currency, count(*) AS count, sum(value) AS value, max(created_at) AS last_seen FROM ev GROUP BY 1, 2, 3
    ORDER BY count(*) DESC, name, category, currency LIMIT 100""",
    dbl="value",
)
def _(t: Tables):
    return web.event_totals(_events(t), limit=100)


@query(
    "event_categories",
    f"""WITH {EVENTS_SQL} SELECT category AS name, CASE category WHEN 'pageView' THEN 'Page View' WHEN 'check_out' THEN 'Check Out' WHEN 'sign-up' THEN 'Sign Up' ELSE 'Custom' END AS label,
       count(*) AS count, {_pct("count(*)", "(SELECT count(*) FROM ev)")} AS percentage FROM ev GROUP BY 1""",
    dbl="percentage",
)
def _(t: Tables):
    return web.event_categories(_events(t))


@query("event_values", f"WITH {EVENTS_SQL} SELECT currency, sum(value) AS value, count(*) AS events FROM ev WHERE value > 0 GROUP BY 1", dbl="value")
def _(t: Tables):
    return web.event_values(_events(t))


@query("event_timeline", f"WITH {EVENTS_SQL} SELECT strftime(created_at, '%Y-%m-%d') AS bucket, count(*) AS count FROM ev GROUP BY 1")
def _(t: Tables):
    return web.event_timeline(_events(t))


@query(
    "event_overview",
    f"""WITH {EVENTS_SQL} SELECT count(*) AS occurrences, count(DISTINCT name) AS event_names, count(DISTINCT category) AS categories, count(*) FILTER (WHERE value > 0) AS valued_events FROM ev""",
)
def _(t: Tables):
    return web.event_overview(_events(t))


@query("event_recent", f"WITH {EVENTS_SQL} SELECT id, name, category, currency FROM ev ORDER BY created_at DESC, id DESC LIMIT 20")
def _(t: Tables):
    return web.recent_rows(_events(t), "created_at", "id", 20).select("id", "name", "category", "currency")
