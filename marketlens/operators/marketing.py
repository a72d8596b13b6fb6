"""Marketing and content reports: campaigns, lists, sends, social posts, posts, tags, authors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.common import count_if, js_round, minus_days
from marketlens.functions.text import currency_code, title_label

RATES = ("open_rate", "click_rate", "conversion_rate")


def complete_sum(value: Column) -> Column:
    """Sum that is NULL as soon as one value is missing."""
    return F.when(count_if(value.isNull()) == 0, F.sum(value))


def weighted_rate(rate: Column, sent: Column) -> Column:
    """Send-weighted mean with one decimal; the plain mean of recorded rates when nothing was sent."""
    used = sent > 0
    missing = (count_if(sent.isNull()) > 0) | (count_if(used & rate.isNull()) > 0)
    total = F.sum(F.when(used, sent))
    weighted = F.sum(F.when(used, rate * sent)) / F.when(total > 0, total)
    value = F.when(total > 0, weighted).otherwise(F.avg(rate))
    return F.when(~missing, js_round(value, 1))


def campaign_rows(campaigns: DataFrame) -> DataFrame:
    """Campaigns with derived opens, clicks and conversions."""
    sent = F.col("sent_count")
    derived = {
        "opens": "open_rate",
        "clicks": "click_rate",
        "conversions": "conversion_rate",
    }
    return campaigns.select(
        *[c for c in campaigns.columns if c != "currency"],
        currency_code(F.col("currency")).alias("currency"),
        *[
            F.when(sent == 0, F.lit(0.0)).otherwise(js_round(sent * F.col(rate) / 100.0)).alias(name)
            for name, rate in derived.items()
        ],
    )


def campaign_channels(campaigns: DataFrame) -> DataFrame:
    """Campaigns, audience, sends, spend and rates per (type, currency)."""
    rows = campaigns.groupBy("type", "currency").agg(
        F.count(F.lit(1)).alias("campaigns"),
        complete_sum(F.col("audience_size")).alias("audience"),
        complete_sum(F.col("sent_count")).alias("sent"),
        complete_sum(F.col("spent")).alias("spent"),
        *[weighted_rate(F.col(r), F.col("sent_count")).alias(r) for r in RATES],
    )
    return rows.withColumn("name", title_label(F.col("type")))


def campaign_overview(campaigns: DataFrame) -> DataFrame:
    return campaigns.agg(
        F.count(F.lit(1)).alias("campaigns"),
        complete_sum(F.col("audience_size")).alias("audience"),
        complete_sum(F.col("sent_count")).alias("sent"),
        *[complete_sum(F.col(c)).alias(c) for c in ("opens", "clicks", "conversions")],
        *[weighted_rate(F.col(r), F.col("sent_count")).alias(r) for r in RATES],
    )


def campaign_spend(campaigns: DataFrame) -> DataFrame:
    return campaigns.groupBy("currency").agg(
        complete_sum(F.col("budget")).alias("budget"),
        complete_sum(F.col("spent")).alias("spent"),
        F.count(F.lit(1)).alias("campaigns"),
    )


def campaign_statuses(campaigns: DataFrame) -> DataFrame:
    status = F.coalesce(F.nullif("status", F.lit("")), F.lit("unknown"))
    rows = campaigns.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("count"))
    return rows.withColumn("label", title_label(F.col("status")))


def marketing_lists(lists: DataFrame, members: DataFrame, campaigns: DataFrame, as_of: Column) -> DataFrame:
    """Members by status, drift of the stored counter, new members of the week and campaigns per list."""
    counts = members.groupBy("list_id").agg(
        *[count_if(F.col("status") == s).alias(s) for s in ("subscribed", "pending", "unsubscribed", "bounced")],
        count_if((F.col("created_at") >= minus_days(as_of, 7)) & (F.col("created_at") <= as_of)).alias("new_this_week"),
    )
    sent = campaigns.groupBy("list_id").agg(F.count(F.lit(1)).alias("campaign_count"))
    rows = lists.join(counts, "list_id", "left").join(sent, "list_id", "left").na.fill(0)
    subscribers = F.col("subscribed") + F.col("pending")
    return rows.select(
        "list_id",
        "name",
        "status",
        subscribers.alias("subscriber_count"),
        F.col("subscribed").alias("active_count"),
        "unsubscribed",
        "bounced",
        "new_this_week",
        "stored_subscribers",
        (F.col("stored_subscribers") != subscribers).alias("count_drift"),
        "campaign_count",
    )


def list_summary(records: DataFrame) -> DataFrame:
    return records.agg(
        F.count(F.lit(1)).alias("total"),
        count_if(F.col("status") == "active").alias("active"),
        F.sum("subscriber_count").alias("subscribers"),
        F.sum("new_this_week").alias("new_this_week"),
        F.sum("campaign_count").alias("campaigns"),
        count_if(F.col("count_drift")).alias("counter_drift_lists"),
    )


def campaign_delivery(campaigns: DataFrame, sends: DataFrame, members: DataFrame) -> DataFrame:
    """Sends by status, opens, clicks and rates per campaign; stored figures fill in where no sends exist."""
    statuses = ("sent", "queued", "failed", "bounced", "complained")
    delivery = sends.groupBy("campaign_id").agg(
        *[count_if(F.col("status") == s).alias(f"{s}_n") for s in statuses],
        count_if(F.col("opened")).alias("opened"),
        count_if(F.col("clicked")).alias("clicked"),
    )
    active = (
        members.filter(F.col("status") == "subscribed").groupBy("list_id").agg(F.count(F.lit(1)).alias("members"))
    )
    columns = [f"{s}_n" for s in statuses] + ["opened", "clicked", "members"]
    rows = campaigns.join(delivery, "campaign_id", "left").join(active, "list_id", "left").na.fill(0, columns)
    stored = F.coalesce("sent_count", F.lit(0.0))
    rows = rows.withColumn("sent_total", F.when(F.col("sent_n") > 0, F.col("sent_n")).otherwise(stored))
    audience = F.when(F.col("members") > 0, F.col("members")).otherwise(F.coalesce("audience_size", F.lit(0.0)))

    def rate(hits: str, stored_rate: str) -> Column:
        live = F.col(hits) / F.col("sent_total") * 100.0
        return F.when(F.col("sent_total") > 0, live).otherwise(F.coalesce(stored_rate, F.lit(0.0)))

    return rows.select(
        "campaign_id",
        "status",
        F.col("sent_total").cast("double").alias("sent_count"),
        *[F.col(f"{s}_n").alias(f"{s}_count") for s in statuses if s != "sent"],
        F.col("opened").alias("opened_count"),
        F.col("clicked").alias("clicked_count"),
        rate("opened", "open_rate").alias("open_rate"),
        rate("clicked", "click_rate").alias("click_rate"),
        audience.cast("double").alias("audience_size"),
    )


def delivery_summary(records: DataFrame) -> DataFrame:
    lost = F.col("failed_count") + F.col("bounced_count") + F.col("complained_count")
    return records.agg(
        F.count(F.lit(1)).alias("total"),
        count_if(F.col("status").isin("scheduled", "sending", "active")).alias("live"),
        count_if(F.col("status").isin("sent", "completed")).alias("sent"),
        F.sum("sent_count").alias("recipients"),
        F.sum(lost).alias("failed_deliveries"),
    )


def social_summary(posts: DataFrame) -> DataFrame:
    return posts.agg(
        F.count(F.lit(1)).alias("total"),
        *[count_if(F.col("status") == s).alias(s) for s in ("published", "scheduled", "draft", "failed")],
        F.sum("reach").alias("reach"),
        F.sum("engagement").alias("engagement"),
    )


def content_totals(posts: DataFrame, pages: DataFrame, comments: DataFrame) -> DataFrame:
    p = posts.agg(F.count(F.lit(1)).alias("posts"), F.coalesce(F.sum("views"), F.lit(0)).alias("post_views"))
    g = pages.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("views"), F.lit(0)).alias("v"))
    return p.select(
        "posts",
        g.select("n").scalar().alias("pages"),
        comments.agg(F.count(F.lit(1))).scalar().alias("comments"),
        (F.col("post_views") + g.select("v").scalar()).alias("views"),
    )


def top_posts(posts: DataFrame, links: DataFrame, categories: DataFrame, comments: DataFrame, limit: int = 5) -> DataFrame:
    """Most viewed posts with their first category and comment count; the top rows are cut before joining."""
    top = posts.orderBy(F.desc("views"), F.desc("post_id")).limit(limit)
    keys = top.select("post_id")
    first = (
        links.join(keys, "post_id", "left_semi")
        .groupBy("post_id")
        .agg(F.min("category_id").alias("category_id"))
        .join(categories.select("category_id", F.col("name").alias("category")), "category_id", "left")
    )
    talk = comments.join(keys, "post_id", "left_semi").groupBy("post_id").agg(F.count(F.lit(1)).alias("comments"))
    return (
        top.join(first.select("post_id", "category"), "post_id", "left")
        .join(talk, "post_id", "left")
        .select(
            "post_id",
            "title",
            "status",
            "views",
            F.coalesce("category", F.lit("Uncategorized")).alias("category"),
            F.coalesce("comments", F.lit(0)).alias("comments"),
        )
    )


def views_by_month(posts: DataFrame, pages: DataFrame) -> DataFrame:
    """Views of posts and pages together per month."""
    rows = posts.select("created_at", "views").unionByName(pages.select("created_at", "views"))
    return rows.groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.sum("views").alias("views"))


def posts_per_category(posts: DataFrame, links: DataFrame, categories: DataFrame) -> DataFrame:
    """Posts per category name; a post without a known category counts as Uncategorized."""
    named = links.join(categories.select("category_id", "name"), "category_id").select("post_id", "name")
    rows = posts.select("post_id").join(named, "post_id", "left")
    return rows.groupBy(F.coalesce("name", F.lit("Uncategorized")).alias("category")).agg(
        F.count(F.lit(1)).alias("posts")
    )


def tag_counts(tags: DataFrame, links: DataFrame) -> DataFrame:
    counts = links.groupBy("tag_id").agg(F.count(F.lit(1)).alias("post_count"))
    return tags.join(counts, "tag_id", "left").na.fill(0, ["post_count"])


def author_counts(authors: DataFrame, posts: DataFrame) -> DataFrame:
    """Posts per listed author; posts of unknown authors are not counted."""
    counts = posts.filter(F.col("author_id").isNotNull()).groupBy("author_id").agg(F.count(F.lit(1)).alias("post_count"))
    return authors.join(counts, "author_id", "left").na.fill(0, ["post_count"])
