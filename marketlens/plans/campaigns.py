"""Queries over campaigns, lists and content."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.fixtures import Tables
from marketlens.operators import marketing as M
from marketlens.registry import query

CAMPAIGN_SQL = """
c AS (SELECT *, CASE WHEN trim(currency) = '' THEN 'USD' ELSE upper(trim(currency)) END AS code, CASE WHEN sent_count = 0 THEN 0 ELSE floor(sent_count * open_rate / 100 + 0.5) END AS opens,
        CASE WHEN sent_count = 0 THEN 0 ELSE floor(sent_count * click_rate / 100 + 0.5) END AS clicks, CASE WHEN sent_count = 0 THEN 0 ELSE floor(sent_count * conversion_rate / 100 + 0.5) END AS conversions FROM fx_campaigns)
"""


def _full(column: str) -> str:
    return f"CASE WHEN count(*) = count({column}) THEN sum({column}) END AS {column}"


def _rate(column: str) -> str:
    return (
        f"CASE WHEN count(*) > count(sent_count) OR count(*) FILTER (WHERE sent_count > 0 AND {column} IS NULL) > 0 THEN NULL "
        f"WHEN sum(sent_count) > 0 THEN floor(sum({column} * sent_count) FILTER (WHERE sent_count > 0) / sum(sent_count) * 10 + 0.5) / 10 ELSE floor(avg({column}) * 10 + 0.5) / 10 END AS {column}"
    )


RATES = ", ".join(_rate(r) for r in M.RATES)


def _campaigns(t: Tables):
    return M.campaign_rows(t("fx_campaigns"))


@query(
    "campaign_channels",
    f"""WITH {CAMPAIGN_SQL}, g AS (SELECT type, code AS currency, count(*) AS campaigns, {_full("audience_size")}, {_full("sent_count")}, {_full("spent")}, {RATES} FROM c GROUP BY 1, 2)
    SELECT type, currency, campaigns, audience_size AS audience, sent_count AS sent, spent, open_rate, click_rate, conversion_rate,
       CASE type WHEN 'email' THEN 'Email' WHEN 'socialMedia' THEN 'Social Media' ELSE 'Push Note' END AS name FROM g""",
    dbl="audience sent spent open_rate click_rate conversion_rate",
)
def _(t: Tables):
    return M.campaign_channels(_campaigns(t))


@query(
    "campaign_overview",
    f"""WITH {CAMPAIGN_SQL}, g AS (SELECT count(*) AS campaigns, {_full("audience_size")}, {_full("sent_count")}, {_full("opens")}, {_full("clicks")}, {_full("conversions")}, {RATES} FROM c)
    SELECT campaigns, audience_size AS audience, sent_count AS sent, opens, clicks, conversions, open_rate, click_rate, conversion_rate FROM g""",
    dbl="audience sent opens clicks conversions open_rate click_rate conversion_rate",
)
def _(t: Tables):
    return M.campaign_overview(_campaigns(t))


@query(
    "campaign_spend",
    f"WITH {CAMPAIGN_SQL} SELECT code AS currency, {_full('budget')}, {_full('spent')}, count(*) AS campaigns FROM c GROUP BY 1",
    dbl="budget spent",
)
def _(t: Tables):
    return M.campaign_spend(_campaigns(t))


@query(
    "campaign_statuses",
    "SELECT CASE WHEN status = '' THEN 'unknown' ELSE status END AS status, CASE status WHEN '' THEN 'Unknown' ELSE upper(status[1]) || status[2:] END AS label, count(*) AS count FROM fx_campaigns GROUP BY 1, 2",
)
def _(t: Tables):
    return M.campaign_statuses(_campaigns(t))


LIST_AT = "timestamp '2024-01-25 00:00:00'"
LISTS_SQL = f"""
m AS (SELECT list_id, count(*) FILTER (WHERE status = 'subscribed') AS sub, count(*) FILTER (WHERE status = 'pending') AS pen, count(*) FILTER (WHERE status = 'unsubscribed') AS uns, count(*) FILTER (WHERE status = 'bounced') AS bou,
        count(*) FILTER (WHERE created_at >= {LIST_AT} - INTERVAL 7 DAY AND created_at <= {LIST_AT}) AS new FROM fx_members GROUP BY 1),
k AS (SELECT list_id, count(*) AS n FROM fx_campaigns GROUP BY 1),
lists AS (SELECT l.list_id, l.name, l.status, coalesce(sub + pen, 0) AS subscriber_count, coalesce(sub, 0) AS active_count, coalesce(uns, 0) AS unsubscribed, coalesce(bou, 0) AS bounced, coalesce(new, 0) AS new_this_week,
            l.stored_subscribers, l.stored_subscribers <> coalesce(sub + pen, 0) AS count_drift, coalesce(k.n, 0) AS campaign_count
          FROM fx_lists l LEFT JOIN m ON m.list_id = l.list_id LEFT JOIN k ON k.list_id = l.list_id)
"""


def _lists(t: Tables):
    at = F.lit("2024-01-25 00:00:00").cast("timestamp")
    return M.marketing_lists(t("fx_lists"), t("fx_members"), t("fx_campaigns"), at)


@query("marketing_lists", f"WITH {LISTS_SQL} SELECT * FROM lists")
def _(t: Tables):
    return _lists(t)


@query(
    "marketing_list_summary",
    f"""WITH {LISTS_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'active') AS active, sum(subscriber_count) AS subscribers, sum(new_this_week) AS new_this_week, sum(campaign_count) AS campaigns,
       count(*) FILTER (WHERE count_drift) AS counter_drift_lists FROM lists""",
    big="subscribers new_this_week campaigns",
)
def _(t: Tables):
    return M.list_summary(_lists(t))


DELIVERY_SQL = """
s AS (SELECT campaign_id, count(*) FILTER (WHERE status = 'sent') AS sent, count(*) FILTER (WHERE status = 'queued') AS queued, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'bounced') AS bounced,
        count(*) FILTER (WHERE status = 'complained') AS complained, count(*) FILTER (WHERE opened) AS opened, count(*) FILTER (WHERE clicked) AS clicked FROM fx_sends GROUP BY 1),
a AS (SELECT list_id, count(*) AS members FROM fx_members WHERE status = 'subscribed' GROUP BY 1),
j AS (SELECT c.*, CASE WHEN s.sent > 0 THEN s.sent ELSE coalesce(c.sent_count, 0) END AS total, coalesce(queued, 0) AS queued_count, coalesce(failed, 0) AS failed_count, coalesce(bounced, 0) AS bounced_count,
        coalesce(complained, 0) AS complained_count, coalesce(opened, 0) AS opened_count, coalesce(clicked, 0) AS clicked_count, coalesce(a.members, 0) AS members
      FROM fx_campaigns c LEFT JOIN s ON s.campaign_id = c.campaign_id LEFT JOIN a ON a.list_id = c.list_id),
d AS (SELECT campaign_id, status, total AS sent_count, queued_count, failed_count, bounced_count, complained_count, opened_count, clicked_count,
        CASE WHEN total > 0 THEN opened_count / total * 100 ELSE coalesce(open_rate, 0) END AS open_rate, CASE WHEN total > 0 THEN clicked_count / total * 100 ELSE coalesce(click_rate, 0) END AS click_rate,
        CASE WHEN members > 0 THEN members ELSE coalesce(audience_size, 0) END AS audience_size FROM j)
"""


def _delivery(t: Tables):
    return M.campaign_delivery(t("fx_campaigns"), t("fx_sends"), t("fx_members"))


@query("campaign_delivery", f"WITH {DELIVERY_SQL} SELECT * FROM d", dbl="sent_count open_rate click_rate audience_size")
def _(t: Tables):
    return _delivery(t)


@query(
    "campaign_delivery_summary",
    f"""WITH {DELIVERY_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE status IN ('scheduled', 'sending', 'active')) AS live, count(*) FILTER (WHERE status IN ('sent', 'completed')) AS sent,
       sum(sent_count) AS recipients, sum(failed_count + bounced_count + complained_count) AS failed_deliveries FROM d""",
    dbl="recipients",
    big="failed_deliveries",
)
def _(t: Tables):
    return M.delivery_summary(_delivery(t))


@query(
    "social_summary",
    """SELECT count(*) AS total, count(*) FILTER (WHERE status = 'published') AS published, count(*) FILTER (WHERE status = 'scheduled') AS scheduled, count(*) FILTER (WHERE status = 'draft') AS draft,
       count(*) FILTER (WHERE status = 'failed') AS failed, sum(reach) AS reach, sum(engagement) AS engagement FROM fx_posts""",
    big="reach engagement",
)
def _(t: Tables):
    return M.social_summary(t("fx_posts"))


@query(
    "content_totals",
    "SELECT count(*) AS posts, (SELECT count(*) FROM fx_site_pages) AS pages, (SELECT count(*) FROM fx_comments) AS comments, sum(views) + (SELECT sum(views) FROM fx_site_pages) AS views FROM fx_posts",
    big="views",
)
def _(t: Tables):
    return M.content_totals(t("fx_posts"), t("fx_site_pages"), t("fx_comments"))


@query(
    "content_overview",
    """WITH top AS (SELECT * FROM fx_posts ORDER BY views DESC, post_id DESC LIMIT 5), f AS (SELECT post_id, min(category_id) AS category_id FROM fx_post_categories GROUP BY 1)
    SELECT t.post_id, t.title, t.status, t.views, coalesce(c.name, 'Uncategorized') AS category, (SELECT count(*) FROM fx_comments x WHERE x.post_id = t.post_id) AS comments
    FROM top t LEFT JOIN f ON f.post_id = t.post_id LEFT JOIN fx_categories c ON c.category_id = f.category_id""",
)
def _(t: Tables):
    return M.top_posts(t("fx_posts"), t("fx_post_categories"), t("fx_categories"), t("fx_comments"))


@query(
    "content_views_by_month",
    "SELECT strftime(created_at, '%Y-%m') AS month, sum(views) AS views FROM (SELECT created_at, views FROM fx_posts UNION ALL SELECT created_at, views FROM fx_site_pages) u GROUP BY 1",
    big="views",
)
def _(t: Tables):
    return M.views_by_month(t("fx_posts"), t("fx_site_pages"))


@query(
    "content_posts_per_category",
    """SELECT coalesce(n.name, 'Uncategorized') AS category, count(*) AS posts FROM fx_posts p
    LEFT JOIN (SELECT l.post_id, c.name FROM fx_post_categories l JOIN fx_categories c ON c.category_id = l.category_id) n ON n.post_id = p.post_id GROUP BY 1""",
)
def _(t: Tables):
    return M.posts_per_category(t("fx_posts"), t("fx_post_categories"), t("fx_categories"))


@query("content_recent_comments", "SELECT comment_id, post_id, author, created_at FROM fx_comments ORDER BY created_at DESC, comment_id DESC LIMIT 5")
def _(t: Tables):
    from marketlens.operators.web import recent_rows

    return recent_rows(t("fx_comments"), "created_at", "comment_id", 5).select("comment_id", "post_id", "author", "created_at")


@query("content_drafts", "SELECT post_id, title, created_at FROM fx_posts WHERE status = 'draft' ORDER BY created_at DESC, post_id DESC LIMIT 5")
def _(t: Tables):
    from marketlens.operators.web import recent_rows

    drafts = t("fx_posts").filter(F.col("status") == "draft")
    return recent_rows(drafts, "created_at", "post_id", 5).select("post_id", "title", "created_at")


@query(
    "tag_counts",
    "SELECT c.category_id AS tag_id, c.name, (SELECT count(*) FROM fx_post_categories l WHERE l.category_id = c.category_id) AS post_count FROM fx_categories c",
)
def _(t: Tables):
    tags = t("fx_categories").withColumnRenamed("category_id", "tag_id")
    return M.tag_counts(tags, t("fx_post_categories").withColumnRenamed("category_id", "tag_id"))


@query(
    "author_counts",
    "SELECT a.author_id, a.name, (SELECT count(*) FROM fx_posts p WHERE p.author_id = a.author_id) AS post_count FROM fx_authors a",
)
def _(t: Tables):
    return M.author_counts(t("fx_authors"), t("fx_posts"))
