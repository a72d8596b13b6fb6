"""Queries over ingest runs, alerts, subscriptions, usage and discussion."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.fixtures import Tables
from marketlens.functions import times
from marketlens.operators import fair, ops
from marketlens.plans.quotes import quotes_as_of
from marketlens.plans.tape import TAPE_AS_OF, tape_as_of
from marketlens.registry import query

NOW = f"({TAPE_AS_OF})"


@query(
    "latest_runs",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY provider, kind ORDER BY id DESC) AS rn, floor((epoch_us({NOW}) - epoch_us(finished_at)) / 1e6 + 0.5) AS age FROM fx_runs)
    SELECT provider, kind, id, status, finished_at AS last_run_at, CAST(age AS BIGINT) AS age_seconds,
       CASE WHEN age < 90 THEN 'just now' WHEN age < 3600 THEN concat(CAST(CAST(floor(age / 60 + 0.5) AS BIGINT) AS VARCHAR), 'm ago')
            WHEN age < 86400 THEN concat(CAST(CAST(floor(age / 3600 + 0.5) AS BIGINT) AS VARCHAR), 'h ago') ELSE concat(CAST(CAST(floor(age / 86400 + 0.5) AS BIGINT) AS VARCHAR), 'd ago') END AS age_label,
       status = 'failed' OR age > 3600 AS degraded FROM r WHERE rn = 1""",
)
def _(t: Tables):
    return ops.latest_runs(t("fx_runs"), tape_as_of(t))


@query(
    "feed_freshness",
    "SELECT provider, max(finished_at) AS last_success FROM fx_runs WHERE status IN ('success', 'partial') GROUP BY 1",
)
def _(t: Tables):
    return ops.feed_freshness(t("fx_runs"))


@query(
    "feed_state",
    f"""WITH n AS (SELECT * FROM fx_runs WHERE kind = 'odds' ORDER BY id DESC LIMIT 1)
    SELECT provider <> 'synthetic' AS live, provider, finished_at AS last_run_at,
       CAST(floor((epoch_us({NOW}) - epoch_us(finished_at)) / 1e6 + 0.5) AS BIGINT) AS age_seconds,
       floor((epoch_us({NOW}) - epoch_us(finished_at)) / 1e6 + 0.5) > 900 AS stale FROM n""",
)
def _(t: Tables):
    return ops.feed_state(t("fx_runs"), tape_as_of(t))


LATE = "timestamp '2024-01-31 12:00:00'"


def _late():
    return F.lit("2024-01-31 12:00:00").cast("timestamp")


@query(
    "stalled_loops",
    f"""WITH l AS (SELECT provider, kind, arg_max(status, id) AS status, max(finished_at) FILTER (WHERE status IN ('success', 'partial')) AS ok_at,
         CASE kind WHEN 'odds' THEN 20 WHEN 'schedule' THEN 90 WHEN 'fundamentals' THEN 2160 ELSE 360 END AS lim FROM fx_runs GROUP BY 1, 2),
    a AS (SELECT *, CAST(floor((epoch_us({LATE}) - epoch_us(ok_at)) / 6e7 + 0.5) AS BIGINT) AS age_minutes FROM l)
    SELECT provider, kind, status, age_minutes, CASE WHEN ok_at IS NULL THEN 'has never completed a pass'
       ELSE concat('last succeeded ', CAST(age_minutes AS VARCHAR), ' minutes ago, and runs every ', CAST(lim AS VARCHAR), ' at the latest') END AS reason
    FROM a WHERE ok_at IS NULL OR age_minutes > lim""",
)
def _(t: Tables):
    return ops.stalled_loops(t("fx_runs"), _late())


@query(
    "ingest_health",
    f"""WITH a AS (SELECT CAST(floor((epoch_us({LATE}) - epoch_us(max(finished_at))) / 6e7 + 0.5) AS BIGINT) AS age FROM fx_runs WHERE status = 'success')
    SELECT 'ingest' AS name, CASE WHEN age <= 30 THEN 'ok' ELSE 'degraded' END AS status, concat('last succeeded ', CAST(age AS VARCHAR), ' minutes ago') AS detail FROM a""",
)
def _(t: Tables):
    return ops.ingest_health(t("fx_runs"), _late())


@query(
    "health_rollup",
    """WITH c AS (SELECT kind = 'odds' AS required, CASE arg_max(status, id) WHEN 'success' THEN 'ok' WHEN 'partial' THEN 'degraded' ELSE 'down' END AS status, provider FROM fx_runs GROUP BY provider, kind),
    p AS (SELECT provider, bool_or(required AND status = 'down') AS down, bool_or(status <> 'ok') AS shaky FROM c GROUP BY 1 UNION ALL SELECT 'all', bool_or(required AND status = 'down'), bool_or(status <> 'ok') FROM c)
    SELECT provider, CASE WHEN down THEN 'down' WHEN shaky THEN 'degraded' ELSE 'ok' END AS status FROM p""",
)
def _(t: Tables):
    kinds = t("fx_runs").groupBy("provider", "kind").agg(F.max_by("status", "id").alias("status"))
    told = F.when(F.col("status") == "success", "ok").when(F.col("status") == "partial", "degraded").otherwise("down")
    checks = kinds.select("provider", (F.col("kind") == "odds").alias("required"), told.alias("status"))
    whole = ops.health_rollup(checks).select(F.lit("all").alias("provider"), "status")
    return ops.health_rollup(checks, ["provider"]).select("provider", "status").unionByName(whole)


@query(
    "status_counts",
    """SELECT (SELECT count(*) FROM fx_books) AS bookmakers, (SELECT count(*) FROM fx_teams) AS teams, (SELECT count(*) FROM fx_events) AS events,
       (SELECT count(*) FROM fx_events WHERE status = 'scheduled') AS upcoming_events, (SELECT count(DISTINCT market_id) FROM fx_selections) AS markets,
       (SELECT count(*) FROM fx_selections) AS selections, (SELECT count(*) FROM fx_odds) AS odds, (SELECT count(*) FROM fx_snapshots) AS price_history,
       (SELECT count(*) FROM ref_fair) AS fair_prices, (SELECT count(*) FROM fx_results) AS results, (SELECT count(*) FROM fx_feature_snapshots) AS feature_snapshots,
       (SELECT count(*) FROM fx_feature_snapshots WHERE label IS NOT NULL) AS labelled_snapshots, (SELECT count(*) FROM fx_insights) AS insights""",
)
def _(t: Tables):
    return ops.status_counts(
        {
            "bookmakers": t("fx_books"),
            "teams": t("fx_teams"),
            "events": t("fx_events"),
            "upcoming_events": t("fx_events").filter(F.col("status") == "scheduled"),
            "markets": t("fx_selections").select("market_id").distinct(),
            "selections": t("fx_selections"),
            "odds": t("fx_odds"),
            "price_history": t("fx_snapshots"),
            "fair_prices": fair.priced_selections(t("fx_odds"), t("fx_selections"), t("fx_books")),
            "results": t("fx_results"),
            "feature_snapshots": t("fx_feature_snapshots"),
            "labelled_snapshots": t("fx_feature_snapshots").filter(F.col("label").isNotNull()),
            "insights": t("fx_insights"),
        }
    )


@query(
    "fundamentals_coverage",
    """SELECT count(DISTINCT team_id) AS teams_with_standing, max(captured_at) AS last_captured_at, (SELECT count(*) FROM fx_teams) AS teams_total,
       (SELECT count(DISTINCT team_id) FROM fx_injuries) AS injuries_tracked, (SELECT count(DISTINCT team_id) FROM fx_valuations) AS clubs_valued FROM fx_standings""",
)
def _(t: Tables):
    return ops.fundamentals_coverage(t("fx_teams"), t("fx_standings"), t("fx_injuries"), t("fx_valuations"))


@query(
    "alert_matches",
    f"""WITH s AS (SELECT *, list_filter([lower(trim(x)) FOR x IN string_split(leagues, ',')], lambda x: x <> '') AS ls,
          list_filter([lower(trim(x)) FOR x IN string_split(CASE WHEN channels = '' THEN 'database' ELSE channels END, ',')], lambda x: x <> '') AS cs
        FROM fx_alert_subscriptions WHERE active AND (last_sent_at IS NULL OR last_sent_at <= {NOW} - INTERVAL 15 MINUTE))
    SELECT a.alert_id, s.subscription_id, s.user_id, unnest(s.cs) AS channel FROM fx_alerts a JOIN s ON s.kind = a.kind AND a.value >= s.min_value
      AND (lower(s.venue) = 'both' OR a.venue = '' OR lower(s.venue) = lower(a.venue)) AND (len(s.ls) = 0 OR list_contains(s.ls, lower(a.league)))""",
)
def _(t: Tables):
    return ops.alert_matches(t("fx_alerts"), t("fx_alert_subscriptions"), tape_as_of(t))


@query(
    "entitlements",
    """WITH r AS (SELECT user_id, max(CASE WHEN status IN ('active', 'trialing') AND (ends_at IS NULL OR ends_at >= timestamp '1998-01-01 00:00:00') THEN
          CASE WHEN lower(price_key) LIKE '%desk%' THEN 3 WHEN lower(price_key) LIKE '%auto%' THEN 2 WHEN lower(price_key) LIKE '%signal%' THEN 1 ELSE 0 END ELSE 0 END) AS k
        FROM fx_subscriptions GROUP BY 1)
    SELECT user_id, CASE k WHEN 3 THEN 'desk' WHEN 2 THEN 'auto' WHEN 1 THEN 'signal' ELSE 'none' END AS tier, k >= 2 AS can_auto_execute,
       CASE k WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 5 END AS max_strategies, k >= 2 AS can_use_deep_research FROM r""",
    big="max_strategies",
)
def _(t: Tables):
    return ops.entitlements(t("fx_subscriptions"), F.lit("1998-01-01 00:00:00").cast("timestamp"))


@query(
    "discussion_threads",
    """WITH s AS (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY created_at DESC, note_id DESC) AS rn FROM fx_notes WHERE NOT hidden),
    c AS (SELECT market_id, count(*) AS note_count, count(*) FILTER (WHERE stance = 'yes') AS yes, count(*) FILTER (WHERE stance = 'no') AS no,
            count(*) FILTER (WHERE stance = 'watching') AS watching, max(created_at) AS last_at FROM s GROUP BY 1 ORDER BY last_at DESC, market_id LIMIT 12)
    SELECT c.*, l.latest FROM c JOIN (SELECT market_id, string_agg(CAST(note_id AS VARCHAR), ',' ORDER BY rn) AS latest FROM s WHERE rn <= 3 GROUP BY 1) l ON l.market_id = c.market_id""",
)
def _(t: Tables):
    rows = ops.discussion_threads(t("fx_notes"), limit=12)
    ids = F.array_join(F.transform("latest", lambda n: n["note_id"].cast("string")), ",")
    return rows.withColumn("latest", ids)


@query(
    "api_usage",
    "SELECT ip_address AS api_key, CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, path AS endpoint, count(*) AS requests FROM fx_requests GROUP BY 1, 2, 3",
)
def _(t: Tables):
    rows = t("fx_requests").withColumnRenamed("ip_address", "api_key").withColumnRenamed("path", "endpoint")
    return ops.api_usage(rows).withColumn("day", F.col("day").cast("string"))


@query(
    "quota_use",
    """WITH u AS (SELECT ip_address AS api_key, CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, count(*) AS used FROM fx_requests GROUP BY 1, 2),
    q AS (SELECT ip_address AS api_key, CASE WHEN count(*) % 3 = 0 THEN NULL ELSE count(*) // 30 END AS daily_quota FROM fx_requests GROUP BY 1)
    SELECT u.api_key, u.day, u.used, q.daily_quota, coalesce(u.used <= q.daily_quota, true) AS allowed FROM u JOIN q ON q.api_key = u.api_key""",
)
def _(t: Tables):
    rows = t("fx_requests").withColumnRenamed("ip_address", "api_key").withColumnRenamed("path", "endpoint")
    n = F.count(F.lit(1))
    quotas = rows.groupBy("api_key").agg(F.when(n % 3 != 0, F.floor(n / 30)).alias("daily_quota"))
    return ops.quota_use(ops.api_usage(rows), quotas).withColumn("day", F.col("day").cast("string"))


@query(
    "saved_sheets",
    "SELECT sheet_id, count(*) AS leg_count, product(CASE WHEN price = 0 THEN 1 ELSE price END) AS parlay_price FROM fx_sheet_legs GROUP BY 1",
    dbl="parlay_price",
)
def _(t: Tables):
    return ops.saved_sheets(t("fx_sheet_legs"))


@query(
    "proximity_bucket",
    """WITH e AS (SELECT *, (epoch_us(commence_at) - epoch_us(timestamp '1998-03-01 12:00:00')) / 3.6e9 AS h FROM fx_events)
    SELECT event_id, CASE WHEN status = 'final' THEN NULL WHEN status = 'live' OR h <= 0 THEN 'inPlay' WHEN h <= 1 THEN 'imminent' WHEN h <= 24 THEN 'near' ELSE 'far' END AS bucket FROM e""",
)
def _(t: Tables):
    at = F.lit("1998-03-01 12:00:00").cast("timestamp")
    return t("fx_events").select("event_id", times.proximity_bucket(F.col("commence_at"), F.col("status"), at).alias("bucket"))


@query(
    "kickoff_label",
    """WITH e AS (SELECT *, floor((epoch_us(commence_at) - epoch_us(timestamp '1998-03-01 12:00:00')) / 8.64e10) AS d,
          CASE WHEN (commence_at >= timestamp '1992-04-05 07:00:00' AND commence_at < timestamp '1992-10-25 06:00:00') OR (commence_at >= timestamp '1993-04-04 07:00:00' AND commence_at < timestamp '1993-10-31 06:00:00')
             OR (commence_at >= timestamp '1994-04-03 07:00:00' AND commence_at < timestamp '1994-10-30 06:00:00') OR (commence_at >= timestamp '1995-04-02 07:00:00' AND commence_at < timestamp '1995-10-29 06:00:00')
             OR (commence_at >= timestamp '1996-04-07 07:00:00' AND commence_at < timestamp '1996-10-27 06:00:00') OR (commence_at >= timestamp '1997-04-06 07:00:00' AND commence_at < timestamp '1997-10-26 06:00:00')
             OR (commence_at >= timestamp '1998-04-05 07:00:00' AND commence_at < timestamp '1998-10-25 06:00:00') OR (commence_at >= timestamp '1999-04-04 07:00:00' AND commence_at < timestamp '1999-10-31 06:00:00')
             OR (commence_at >= timestamp '2000-04-02 07:00:00' AND commence_at < timestamp '2000-10-29 06:00:00') OR (commence_at >= timestamp '2001-04-01 07:00:00' AND commence_at < timestamp '2001-10-28 06:00:00') THEN 4 ELSE 5 END AS off FROM fx_events),
    l AS (SELECT *, commence_at - CASE WHEN off = 4 THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END AS loc FROM e)
    SELECT event_id, CASE WHEN status = 'final' THEN 'Final' WHEN status = 'live' THEN 'Live' ELSE concat(CASE WHEN d <= 0 THEN 'Today' WHEN d = 1 THEN 'Tomorrow' ELSE strftime(loc, '%a, %b %-d') END,
       ' · ', strftime(loc, '%-I:%M %p'), CASE WHEN off = 4 THEN ' EDT' ELSE ' EST' END) END AS label FROM l""",
)
def _(t: Tables):
    at = F.lit("1998-03-01 12:00:00").cast("timestamp")
    return t("fx_events").select("event_id", times.kickoff_label(F.col("commence_at"), F.col("status"), at).alias("label"))


@query(
    "age_label",
    f"""WITH a AS (SELECT event_id, floor((epoch_us({NOW}) - epoch_us(ts)) / 1e6 + 0.5) AS s FROM events)
    SELECT event_id, CASE WHEN s < 90 THEN 'just now' WHEN s < 3600 THEN concat(CAST(CAST(floor(s / 60 + 0.5) AS BIGINT) AS VARCHAR), 'm ago')
       WHEN s < 86400 THEN concat(CAST(CAST(floor(s / 3600 + 0.5) AS BIGINT) AS VARCHAR), 'h ago') ELSE concat(CAST(CAST(floor(s / 86400 + 0.5) AS BIGINT) AS VARCHAR), 'd ago') END AS label FROM a""",
)
def _(t: Tables):
    return t("events").select("event_id", times.age_label(F.col("ts"), tape_as_of(t)).alias("label"))
