"""Queries over query logs, application logs, deliveries, errors, jobs and generic tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marketlens.fixtures import Tables
from marketlens.operators import logs as L
from marketlens.operators.search import TrigramIndex
from marketlens.plans.shop import SHOP_AS_OF
from marketlens.plans.tape import TAPE_AS_OF, tape_as_of
from marketlens.registry import query
from marketlens.session import shared_path
from marketlens.sources import daytables

NOW = f"({TAPE_AS_OF})"
HOUR = "'%Y-%m-%d %H:00'"


@query(
    "query_log_stats",
    f"""WITH q AS (SELECT *, CASE WHEN tags LIKE '[%' THEN json_extract_string(CASE WHEN tags LIKE '[%' THEN tags ELSE '[]' END, '$[0]') END AS tag FROM fx_query_rows)
    SELECT 'type' AS section, tag AS key, count(*) AS count, avg(duration) AS avg_duration FROM q GROUP BY 1, 2
    UNION ALL SELECT 'status', status, count(*), NULL FROM q GROUP BY 1, 2
    UNION ALL SELECT 'slow_hour', strftime(executed_at, '%Y-%m-%d %H:00:00'), count(*), NULL FROM q WHERE status = 'slow' AND executed_at >= {NOW} - INTERVAL 1 DAY GROUP BY 1, 2""",
    dbl="avg_duration",
)
def _(t: Tables):
    return L.query_log_stats(t("fx_query_rows"), tape_as_of(t))


@query(
    "query_log_timeline",
    f"""SELECT strftime(executed_at, '%Y-%m-%d') AS time_interval, count(*) AS count, avg(duration) AS avg_duration FROM fx_query_rows
    WHERE executed_at >= {NOW} - INTERVAL 7 DAY AND contains(tags, '"click"') GROUP BY 1""",
    dbl="avg_duration",
)
def _(t: Tables):
    return L.query_log_timeline(t("fx_query_rows"), tape_as_of(t), "week", "click")


@query(
    "frequent_queries",
    """SELECT normalized_query, count(*) AS count, avg(duration) AS avg_duration, max(duration) AS max_duration FROM fx_query_rows GROUP BY 1 ORDER BY count(*) DESC, normalized_query LIMIT 10""",
    dbl="avg_duration max_duration",
)
def _(t: Tables):
    return L.frequent_queries(t("fx_query_rows"))


@query(
    "query_log_search",
    """SELECT id, connection, status, executed_at FROM fx_query_rows WHERE connection = 'primary' AND status = 'slow' AND contains(tags, '"view"') AND contains(lower(query || model || method || affected_tables), 't3')""",
)
def _(t: Tables):
    rows = L.query_log_search(t("fx_query_rows"), connection="primary", status="slow", tag="view", search="T3")
    return rows.select("id", "connection", "status", "executed_at")


@query(
    "query_log_page",
    """SELECT id, status FROM fx_query_rows WHERE duration >= 100 ORDER BY executed_at DESC, id DESC LIMIT 10 OFFSET 20""",
)
def _(t: Tables):
    rows = L.slow_queries(t("fx_query_rows"))
    return L.page_of(rows, [F.desc("executed_at"), F.desc("id")], page=3, per_page=10).select("id", "status")


@query(
    "query_log_rows",
    """SELECT id, CASE WHEN lower(ltrim(query)) LIKE 'select%' THEN 'SELECT' WHEN lower(query) LIKE 'insert%' THEN 'INSERT' WHEN lower(query) LIKE 'update%' THEN 'UPDATE' ELSE 'OTHER' END AS type, status,
       CASE WHEN tags LIKE '[%' THEN 2 ELSE 0 END AS tag_count, CASE WHEN status = 'odd' THEN 'unknown status' WHEN tags NOT LIKE '[%' THEN 'bad list' END AS problem FROM fx_query_rows""",
    big="tag_count",
)
def _(t: Tables):
    return L.query_log_rows(t("fx_query_rows")).select("id", "type", "status", F.size("tags").alias("tag_count"), "problem")


LOG_SINCE = f"{NOW} - INTERVAL 10 DAY"


@query(
    "log_explorer",
    f"""SELECT project, count(*) AS total, count(*) FILTER (WHERE type = 'error') AS error, count(*) FILTER (WHERE type = 'warning') AS warning, count(*) FILTER (WHERE type = 'info') AS info, count(*) FILTER (WHERE type = 'success') AS success
    FROM fx_logs WHERE logged_at >= {LOG_SINCE} AND source = 'src1' AND contains(lower(message || project || file || stacktrace), '"k": 4') GROUP BY 1""",
)
def _(t: Tables):
    since = F.timestamp_micros(F.unix_micros(tape_as_of(t)) - 10 * 86_400_000_000)
    rows = L.log_filter(t("fx_logs"), since=since, source="src1", search='"K": 4')
    counts = [F.count(F.when(F.col("type") == k, 1)).alias(k) for k in ("error", "warning", "info", "success")]
    return rows.groupBy("project").agg(F.count(F.lit(1)).alias("total"), *counts)


@query(
    "log_summary",
    "SELECT count(*) AS total, count(*) FILTER (WHERE type = 'error') AS error, count(*) FILTER (WHERE type = 'warning') AS warning, count(*) FILTER (WHERE type = 'info') AS info, count(*) FILTER (WHERE type = 'success') AS success FROM fx_logs",
)
def _(t: Tables):
    return L.log_summary(t("fx_logs"))


@query("log_hourly", f"SELECT strftime(logged_at, {HOUR}) AS hour, count(*) AS count FROM fx_logs WHERE logged_at >= {NOW} - INTERVAL 24 HOUR GROUP BY 1")
def _(t: Tables):
    return L.log_hourly(t("fx_logs"), tape_as_of(t))


@query(
    "ops_insights",
    """SELECT count(*) AS requests, count(*) FILTER (WHERE status_code < 400) AS successful_requests, avg(duration_ms) AS average_request_ms, max(duration_ms) AS maximum_request_ms,
       floor(count(*) FILTER (WHERE status_code < 400) / count(*) * 1000 + 0.5) / 10 AS request_success_rate, (SELECT count(*) FROM fx_query_rows WHERE status = 'completed') AS completed_queries,
       (SELECT count(*) FROM fx_query_rows WHERE status = 'slow') AS slow_queries, (SELECT count(*) FROM fx_query_rows WHERE status = 'failed') AS failed_queries, (SELECT count(*) FROM fx_query_rows) AS queries,
       (SELECT avg(duration) FROM fx_query_rows) AS average_query_ms, (SELECT max(duration) FROM fx_query_rows) AS maximum_query_ms, (SELECT count(*) FROM fx_errors) AS errors FROM fx_requests""",
    dbl="average_request_ms maximum_request_ms request_success_rate average_query_ms maximum_query_ms",
)
def _(t: Tables):
    return L.ops_insights(t("fx_requests"), t("fx_query_rows"), t("fx_errors"))


@query("slowest_requests", "SELECT id, method, path, status_code, duration_ms, created_at FROM fx_requests ORDER BY duration_ms DESC, id DESC LIMIT 5", dbl="duration_ms", big="status_code")
def _(t: Tables):
    return L.slowest_requests(t("fx_requests"))


@query(
    "slowest_queries",
    """SELECT id, trim(regexp_replace(query, '\\s+', ' ', 'g')) AS query, duration, status, connection, executed_at FROM fx_query_rows WHERE duration >= 100 ORDER BY duration DESC, id DESC LIMIT 5""",
    dbl="duration",
)
def _(t: Tables):
    return L.slowest_queries(t("fx_query_rows"))


@query(
    "text_compaction",
    """WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM documents)
    SELECT doc_id, CASE WHEN length(s) <= 240 THEN s ELSE concat(rtrim(s[1:239]), '…') END AS short FROM c""",
)
def _(t: Tables):
    from marketlens.functions.text import compact_text

    return t("documents").select("doc_id", compact_text(F.col("text"), 240).alias("short"))


@query(
    "http_metrics",
    """WITH n AS (SELECT * FROM fx_requests) SELECT (SELECT count(*) FROM fx_requests) AS total, count(*) AS sampled, floor(avg(duration_ms) + 0.5) AS average_ms,
       count(*) FILTER (WHERE status_code BETWEEN 200 AND 399) * 100 / count(*) AS success_rate, count(*) FILTER (WHERE status_code >= 400) * 100 / count(*) AS error_rate FROM n""",
    dbl="average_ms success_rate error_rate",
)
def _(t: Tables):
    return L.http_metrics(t("fx_requests"))


@query(
    "recent_activity",
    """SELECT * FROM (SELECT 'order' AS type, concat('Order #', CAST(order_id AS VARCHAR)) AS message, created_at FROM fx_shop_orders
      UNION ALL SELECT 'user', concat('User ', author, ' registered'), created_at FROM (SELECT * FROM fx_comments ORDER BY created_at DESC, comment_id DESC LIMIT 5) c) u ORDER BY created_at DESC, type, message LIMIT 5""",
)
def _(t: Tables):
    users = t("fx_comments").select(F.col("comment_id").alias("user_id"), F.col("author").alias("name"), "created_at")
    return L.recent_activity(t("fx_shop_orders"), users)


CHANNEL_SQL = """
ch AS (SELECT CASE WHEN channel = '' THEN 'unknown' ELSE channel END AS channel, count(*) AS total, count(*) FILTER (WHERE status = 'sent') AS sent, count(*) FILTER (WHERE status = 'delivered') AS delivered,
         count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'pending') AS pending, floor(count(*) FILTER (WHERE status IN ('sent', 'delivered')) * 100 / count(*) * 10 + 0.5) / 10 AS success_rate
       FROM fx_deliveries GROUP BY 1)
"""


@query("delivery_channels", f"WITH {CHANNEL_SQL} SELECT * FROM ch", dbl="success_rate")
def _(t: Tables):
    return L.delivery_channels(t("fx_deliveries"))


@query(
    "delivery_stats",
    f"""WITH {CHANNEL_SQL} SELECT sum(total) AS total, sum(sent + delivered) AS successful, sum(failed) AS failed, sum(pending) AS pending, count(*) AS active_channels,
       floor(sum(sent + delivered) * 100 / sum(total) * 10 + 0.5) / 10 AS success_rate FROM ch""",
    dbl="success_rate",
    big="total successful failed pending",
)
def _(t: Tables):
    return L.delivery_stats(L.delivery_channels(t("fx_deliveries")))


@query(
    "mail_activity",
    f"""WITH w AS (SELECT date_trunc('day', {NOW}) AS e), g AS (SELECT strftime(d, '%Y-%m-%d') AS bucket FROM (SELECT unnest(generate_series(e - INTERVAL 6 DAY, e, INTERVAL 1 DAY)) AS d FROM w) x),
    o AS (SELECT strftime(created_at, '%Y-%m-%d') AS bucket, count(*) FILTER (WHERE status IN ('sent', 'delivered')) AS sent, count(*) FILTER (WHERE status = 'failed') AS failed FROM fx_deliveries GROUP BY 1),
    i AS (SELECT strftime(created_at, '%Y-%m-%d') AS bucket, count(*) AS received FROM fx_app_events WHERE name = 'signup' GROUP BY 1)
    SELECT g.bucket, coalesce(o.sent, 0) AS sent, coalesce(o.failed, 0) AS failed, coalesce(i.received, 0) AS received FROM g LEFT JOIN o ON o.bucket = g.bucket LEFT JOIN i ON i.bucket = g.bucket""",
)
def _(t: Tables):
    return L.mail_activity(t("fx_deliveries"), t("fx_app_events").filter(F.col("name") == "signup"), tape_as_of(t))


@query(
    "mail_change",
    f"""WITH s AS (SELECT count(*) FILTER (WHERE created_at >= e - INTERVAL 6 DAY) AS current, count(*) FILTER (WHERE created_at < e - INTERVAL 6 DAY) AS previous FROM fx_deliveries, (SELECT date_trunc('day', {NOW}) AS e) w
        WHERE created_at >= e - INTERVAL 13 DAY) SELECT *, floor((current - previous) / previous * 1000 + 0.5) / 10 AS change_pct FROM s""",
    dbl="change_pct",
)
def _(t: Tables):
    return L.period_change(t("fx_deliveries"), tape_as_of(t))


@query(
    "realtime_stats",
    """SELECT count(*) AS recorded_events, count(DISTINCT socket) AS unique_sockets, count(*) FILTER (WHERE type = 'success') AS successes, count(*) FILTER (WHERE type = 'error') AS errors,
       count(*) FILTER (WHERE type = 'disconnection') AS disconnections, floor(count(*) FILTER (WHERE type = 'success') / count(*) * 1000 + 0.5) / 10 AS success_rate FROM fx_sockets""",
    dbl="success_rate",
)
def _(t: Tables):
    return L.realtime_stats(t("fx_sockets"))


@query(
    "release_summary",
    "SELECT count(*) AS total, count(*) FILTER (WHERE status = 'published') AS published, sum(downloads) AS downloads, (SELECT version FROM fx_releases ORDER BY created_at DESC, release_id DESC LIMIT 1) AS latest_version FROM fx_releases",
    big="downloads",
)
def _(t: Tables):
    return L.release_summary(t("fx_releases"))


@query(
    "deployment_summary",
    """SELECT count(*) AS total, count(*) FILTER (WHERE status IN ('success', 'ready')) AS successful, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status IN ('running', 'pending')) AS active,
       avg(duration) AS average_duration FROM fx_deployments""",
    dbl="average_duration",
)
def _(t: Tables):
    return L.deployment_summary(t("fx_deployments"))


@query(
    "release_interval",
    "SELECT floor((epoch_us(max(created_at)) - epoch_us(min(created_at))) / (count(*) - 1) / 1e6 + 0.5) AS average_seconds, count(*) - 1 AS intervals FROM fx_releases",
    dbl="average_seconds",
)
def _(t: Tables):
    return L.release_interval(t("fx_releases"))


@query("count_by", "SELECT CASE WHEN user_agent = '' THEN 'unknown' ELSE user_agent END AS key, count(*) AS count FROM fx_requests GROUP BY 1")
def _(t: Tables):
    return L.count_by(t("fx_requests"), "user_agent")


@query("top_values", "SELECT ip_address AS key, count(*) AS count FROM fx_requests GROUP BY 1 ORDER BY count(*) DESC, key LIMIT 5")
def _(t: Tables):
    return L.count_by(t("fx_requests"), "ip_address", 5)


@query(
    "daily_rollup",
    f"""WITH w AS (SELECT date_trunc('day', ({SHOP_AS_OF})) AS e), g AS (SELECT strftime(d, '%Y-%m-%d') AS day FROM (SELECT unnest(generate_series(e - INTERVAL 29 DAY, e, INTERVAL 1 DAY)) AS d FROM w) x)
    SELECT g.day, count(o.order_id) AS count, coalesce(sum(o.total_amount), 0) AS sum FROM g LEFT JOIN fx_shop_orders o ON strftime(o.created_at, '%Y-%m-%d') = g.day GROUP BY 1""",
    dbl="sum",
)
def _(t: Tables):
    return L.daily_rollup(t("fx_shop_orders"), "created_at", t.scalar(SHOP_AS_OF), 30, "total_amount")


@query(
    "global_search",
    """SELECT * FROM (SELECT 'parts' AS "table", p_partkey AS id, p_name AS title FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring') ORDER BY id LIMIT 5) a
    UNION ALL SELECT * FROM (SELECT 'customers', c_custkey AS id, c_name FROM customer WHERE contains(lower(c_name), 'ring') OR contains(lower(c_mktsegment), 'ring') ORDER BY id LIMIT 5) b
    UNION ALL SELECT * FROM (SELECT 'pages', page_id AS id, url FROM pages WHERE contains(lower(url), 'ring') OR contains(lower(html), 'ring') ORDER BY id LIMIT 5) c""",
)
def _(t: Tables):
    return L.global_search(
        {
            "parts": (t("part"), "p_partkey", ["p_name", "p_type"]),
            "customers": (t("customer"), "c_custkey", ["c_name", "c_mktsegment"]),
            "pages": (t("pages"), "page_id", ["url", "html"]),
        },
        "RING",
        per_table=5,
    )


@query(
    "error_groups",
    """SELECT type, message, count(*) AS count, min(created_at) AS first_seen, max(created_at) AS last_seen, count(*) FILTER (WHERE status = 'unresolved') AS unresolved, count(*) FILTER (WHERE status = 'resolved') AS resolved,
       count(*) FILTER (WHERE status = 'ignored') AS ignored FROM fx_errors GROUP BY 1, 2""",
)
def _(t: Tables):
    return L.error_groups(t("fx_errors"))


@query(
    "error_timeline",
    f"""WITH w AS (SELECT date_trunc('hour', {NOW}) AS e), g AS (SELECT strftime(d, {HOUR}) AS hour FROM (SELECT unnest(generate_series(e - INTERVAL 23 HOUR, e, INTERVAL 1 HOUR)) AS d FROM w) x)
    SELECT g.hour, count(x.id) AS count FROM g LEFT JOIN fx_errors x ON strftime(x.created_at, {HOUR}) = g.hour GROUP BY 1""",
)
def _(t: Tables):
    return L.error_timeline(t("fx_errors"), tape_as_of(t))


@query("retention_prune", f"SELECT id, executed_at FROM fx_query_rows WHERE executed_at >= {NOW} - INTERVAL 7 DAY")
def _(t: Tables):
    return L.retention_prune(t("fx_query_rows"), "executed_at", tape_as_of(t)).select("id", "executed_at")


@query("retention_rewrite", f"SELECT id, executed_at FROM fx_query_rows WHERE executed_at >= {NOW} - INTERVAL 7 DAY - INTERVAL 5 HOUR OR executed_at IS NULL")
def _(t: Tables):
    """The rows that are left in a stored table once old days are removed from it."""
    path = shared_path(t.spark, f"query-log-{uuid.uuid4().hex}")
    daytables.write_days(t("fx_query_rows").select("id", "executed_at"), path, "executed_at")
    cutoff = F.timestamp_micros(F.unix_micros(tape_as_of(t)) - (7 * 24 + 5) * 3_600_000_000)
    daytables.prune_days(t.spark, path, "executed_at", cutoff)
    return t.spark.read.parquet(path).select("id", "executed_at")


@query("indexed_search", "SELECT page_id, url FROM pages WHERE contains(lower(url), 'able') OR contains(lower(html), 'able')")
def _(t: Tables):
    """Pages with a text in them, by way of the trigrams of their addresses and contents."""
    index = TrigramIndex(t.spark, shared_path(t.spark, f"pages-{uuid.uuid4().hex}"), "page_id", ["url", "html"], parts=16, shards=16)
    index.build(t("pages"))
    return index.search("ABLE").select("page_id", "url")


@query(
    "indexed_log_search",
    """SELECT id, status, executed_at FROM fx_query_rows WHERE status = 'slow' AND contains(lower(query || model || method || affected_tables), 'from t3')""",
)
def _(t: Tables):
    """Log rows by text and status: the text by way of the trigram index."""
    fields = ["query", "model", "method", "affected_tables"]
    index = TrigramIndex(t.spark, shared_path(t.spark, f"log-index-{uuid.uuid4().hex}"), "id", fields, parts=16, shards=16)
    index.build(t("fx_query_rows"))
    return L.query_log_search(index.search("From T3"), status="slow").select("id", "status", "executed_at")


@query(
    "pressure_samples",
    f"""SELECT * FROM (SELECT org, id, pressure, sampled_at, row_number() OVER (PARTITION BY org ORDER BY sampled_at DESC, id DESC) AS back FROM fx_samples WHERE sampled_at >= {NOW} - INTERVAL 72 HOUR) s WHERE back <= 60""",
    dbl="pressure",
)
def _(t: Tables):
    return L.pressure_samples(t("fx_samples"), tape_as_of(t), hours=72, limit=60)


JOBS_SQL = """
jobs AS (SELECT concat('active:', CAST(id AS VARCHAR)) AS job_id, queue, name, status, '' AS error, payload, created_at AS happened_at FROM fx_jobs
         UNION ALL SELECT concat('failed:', CAST(id AS VARCHAR)), queue, name, 'failed', error, payload, failed_at FROM fx_failed_jobs)
"""


def _jobs(t: Tables):
    return L.job_history(t("fx_jobs"), t("fx_failed_jobs"))


@query(
    "job_history",
    f"WITH {JOBS_SQL} SELECT job_id, name, status, happened_at FROM jobs WHERE queue = 'q1' AND contains(lower(job_id || name || queue || status || error || payload), 'boom')",
)
def _(t: Tables):
    return L.job_search(_jobs(t), queue="q1", search="boom").select("job_id", "name", "status", "happened_at")


@query(
    "job_stats",
    f"WITH {JOBS_SQL} SELECT queue, count(*) AS jobs, count(*) FILTER (WHERE status = 'failed') AS failed, floor(count(*) FILTER (WHERE status = 'failed') * 100 / count(*) * 10 + 0.5) / 10 AS failure_rate FROM jobs GROUP BY 1",
    dbl="failure_rate",
)
def _(t: Tables):
    return L.job_stats(_jobs(t))


@query(
    "overview_counts",
    """SELECT 'users' AS name, count(*) AS count FROM fx_authors UNION ALL SELECT 'orders', count(*) FROM fx_shop_orders WHERE status <> 'cancelled' UNION ALL SELECT 'posts', count(*) FROM fx_posts UNION ALL SELECT 'customers', count(*) FROM fx_customers""",
)
def _(t: Tables):
    return L.overview_counts(t("fx_authors"), t("fx_shop_orders"), t("fx_posts"), t("fx_customers"))


@query(
    "table_explorer",
    "SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part WHERE p_size = 7 AND (contains(lower(p_name), 'ed') OR contains(lower(p_brand), 'ed') OR contains(lower(p_type), 'ed'))",
    big="p_size",
)
def _(t: Tables):
    return L.table_explorer(t("part"), {"p_size": 7, "p_retailprice": 1.0}, search="ED", hidden={"p_retailprice"})
