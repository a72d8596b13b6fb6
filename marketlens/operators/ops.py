"""Operations: ingest runs, stalls, health, coverage, alerts, entitlements, usage, discussion, sheets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketlens.functions.common import count_if, js_round, minus_hours
from marketlens.functions.times import age_label

STALE_FEED_SECONDS = 900
DEGRADED_SECONDS = 3600
STALE_INGEST_MINUTES = 30
DEFAULT_OVERDUE_MINUTES = 360
# Minutes after which a loop of each kind is overdue.
OVERDUE_MINUTES = {"odds": 20, "schedule": 90, "fundamentals": 2160}
ALERT_COOLDOWN_MINUTES = 15
TIERS = ["none", "signal", "auto", "desk"]


def _age_seconds(at: Column, as_of: Column) -> Column:
    return js_round((F.unix_micros(as_of) - F.unix_micros(at)) / F.lit(1e6))


def latest_runs(runs: DataFrame, as_of: Column) -> DataFrame:
    """Most recent run per (provider, kind) with its age and degraded flag."""
    rows = runs.groupBy("provider", "kind").agg(
        F.max_by(F.struct("id", "status", "finished_at"), "id").alias("r")
    )
    age = _age_seconds(F.col("r.finished_at"), as_of)
    return rows.select(
        "provider",
        "kind",
        "r.id",
        "r.status",
        F.col("r.finished_at").alias("last_run_at"),
        age.cast("bigint").alias("age_seconds"),
        age_label(F.col("r.finished_at"), as_of).alias("age_label"),
        ((F.col("r.status") == "failed") | F.coalesce(age > DEGRADED_SECONDS, F.lit(False))).alias("degraded"),
    )


def feed_freshness(runs: DataFrame) -> DataFrame:
    """Last success (full or partial) per provider."""
    done = runs.filter(F.col("status").isin("success", "partial") & F.col("finished_at").isNotNull())
    return done.groupBy("provider").agg(F.max("finished_at").alias("last_success"))


def feed_state(runs: DataFrame, as_of: Column) -> DataFrame:
    """Latest price-feed run: live or simulated, age and staleness; one row even without runs."""
    newest = runs.filter(F.col("kind") == "odds").agg(
        F.max_by(F.struct("provider", "status", "finished_at"), "id").alias("r")
    )
    age = F.greatest(F.lit(0.0), _age_seconds(F.col("r.finished_at"), as_of))
    known = F.col("r").isNotNull()
    age = F.when(F.col("r.finished_at").isNotNull(), age)
    return newest.select(
        (known & F.coalesce(F.col("r.provider") != "synthetic", F.lit(False))).alias("live"),
        F.coalesce(F.col("r.provider"), F.lit("none")).alias("provider"),
        F.col("r.finished_at").alias("last_run_at"),
        age.cast("bigint").alias("age_seconds"),
        F.coalesce(age > STALE_FEED_SECONDS, F.lit(True)).alias("stale"),
    )


def stalled_loops(runs: DataFrame, as_of: Column) -> DataFrame:
    """Loops whose last success is older than the limit of their kind, or that never succeeded."""
    good = F.col("status").isin("success", "partial")
    loops = runs.groupBy("provider", "kind").agg(
        F.max_by("status", "id").alias("status"), F.max(F.when(good, F.col("finished_at"))).alias("last_success")
    )
    limit = F.lit(DEFAULT_OVERDUE_MINUTES)
    for kind, minutes in OVERDUE_MINUTES.items():
        limit = F.when(F.col("kind") == kind, minutes).otherwise(limit)
    age = js_round((F.unix_micros(as_of) - F.unix_micros("last_success")) / F.lit(6e7)).cast("bigint")
    rows = loops.select("*", limit.alias("limit_minutes"), age.alias("age_minutes"))
    late = F.col("last_success").isNull() | (F.col("age_minutes") > F.col("limit_minutes"))
    reason = F.when(F.col("last_success").isNull(), F.lit("has never completed a pass")).otherwise(
        F.format_string(
            "last succeeded %d minutes ago, and runs every %d at the latest", "age_minutes", "limit_minutes"
        )
    )
    return rows.filter(late).select("provider", "kind", "status", "age_minutes", reason.alias("reason"))


def ingest_health(runs: DataFrame, as_of: Column) -> DataFrame:
    """ok or degraded from the age of the last successful run."""
    last = runs.filter(F.col("status") == "success").agg(F.max("finished_at").alias("last_at"))
    age = js_round((F.unix_micros(as_of) - F.unix_micros("last_at")) / F.lit(6e7)).cast("bigint")
    fine = F.coalesce(age <= STALE_INGEST_MINUTES, F.lit(False))
    return last.select(
        F.lit("ingest").alias("name"),
        F.when(fine, "ok").otherwise("degraded").alias("status"),
        F.when(F.col("last_at").isNull(), F.lit("no successful run on record"))
        .otherwise(F.format_string("last succeeded %d minutes ago", age))
        .alias("detail"),
    )


def health_rollup(checks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Of all checks, or of those of each key: down when a required check is down, degraded when any check is not ok."""
    down = count_if(F.col("required") & (F.col("status") == "down")) > 0
    shaky = count_if(F.col("status") != "ok") > 0
    return checks.groupBy(*keys).agg(F.when(down, "down").when(shaky, "degraded").otherwise("ok").alias("status"))


def status_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row of row counts, one column per table."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.agg(*[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in tables])


def fundamentals_coverage(
    teams: DataFrame, standings: DataFrame, injuries: DataFrame, valuations: DataFrame
) -> DataFrame:
    """Distinct teams with a standing, an injury list and a valuation against all teams."""
    return standings.agg(
        F.count_distinct("team_id").alias("teams_with_standing"), F.max("captured_at").alias("last_captured_at")
    ).select(
        "*",
        teams.agg(F.count(F.lit(1))).scalar().alias("teams_total"),
        injuries.agg(F.count_distinct("team_id")).scalar().alias("injuries_tracked"),
        valuations.agg(F.count_distinct("team_id")).scalar().alias("clubs_valued"),
    )


def _list(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")


#: Bands of value floors within a join key: more of them form fewer vain pairs and want more rows of each alert.
FLOOR_BANDS = 64
#: Floors that a band holds at least, so that the rows of an alert are far fewer than its pairs.
BAND_FLOORS = 64
#: Slots that join keys are hashed to; keys of a slot share its lowest floor and its bands.
KEY_SLOTS = 1024


def floor_slots(wanted: DataFrame, keys: Sequence[str]) -> Column:
    """The lowest floor and the cuts between bands of each slot of keys, NULL for a slot without keys: one value of bounded size.

    Cuts lie above the lowest floor, at quantiles, as many as leave each band its floors. They are approximate, so they are
    taken once, here, and both sides of a join use the same.
    """
    quantiles = F.percentile_approx("min_value", [i / FLOOR_BANDS for i in range(1, FLOOR_BANDS)], F.lit(1000))
    slots = wanted.groupBy(_slot(keys).alias("slot")).agg(
        F.min("min_value").alias("lowest"), quantiles.alias("cuts"), F.ceil(FLOOR_BANDS * BAND_FLOORS / F.count(F.lit(1))).alias("step")
    )
    wide = F.filter("cuts", lambda c, i: ((i + 1) % F.col("step") == 0) & (c > F.col("lowest")))
    slots = slots.filter(F.col("lowest").isNotNull()).select("slot", F.struct("lowest", F.array_distinct(wide).alias("cuts")).alias("held"))
    held = F.map_from_entries(F.collect_list(F.struct("slot", "held")))
    every = F.sequence(F.lit(0), F.lit(KEY_SLOTS - 1))
    told = slots.agg(held.alias("held")).select(F.transform(every, lambda i: F.try_element_at("held", i)).alias("slots"))
    return wanted.sparkSession.createDataFrame(told.collect(), told.schema).scalar()


def _slot(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(KEY_SLOTS)).cast("int")


def alert_pairs(raised: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Alerts beside the subscriptions of their ``keys`` with floors in the bands up to that of the alert's value.

    All floors of a lower band lie below the value, so only pairs of the alert's own band can miss, and a hot key is spread
    over its bands. Alerts below every floor of their slot meet nobody and are dropped where they are read.
    """
    slots = floor_slots(wanted, keys)
    band = lambda value: F.size(F.filter("held.cuts", lambda c: c <= F.col(value)))
    near = raised.withColumn("held", F.get(slots, _slot(keys))).filter(F.col("value") >= F.col("held.lowest"))
    near = near.withColumn("band", F.explode(F.sequence(F.lit(0), band("value")))).drop("held")
    dealt = wanted.withColumn("held", F.get(slots, _slot(keys))).withColumn("band", band("min_value")).drop("held")
    return near.join(dealt.hint("merge"), [*keys, "band"])


def alert_matches(alerts: DataFrame, subscriptions: DataFrame, as_of: Column) -> DataFrame:
    """Deliveries of each alert: active subscriptions of its kind, league, venue and value, per channel.

    League and venue are part of the join key (with a wildcard spelling), and so is the band of the value floor.
    """
    cooled = F.col("last_sent_at").isNull() | (
        F.col("last_sent_at") <= minus_hours(as_of, ALERT_COOLDOWN_MINUTES / 60.0)
    )
    leagues = _list(F.col("leagues"))
    venue = F.lower(F.coalesce(F.nullif("venue", F.lit("")), F.lit("both")))
    channels = _list(F.coalesce(F.nullif("channels", F.lit("")), F.lit("database")))
    wanted = (
        subscriptions.filter(F.col("active") & cooled)
        .select(
            "subscription_id",
            "user_id",
            "kind",
            F.coalesce("min_value", F.lit(0.0)).alias("min_value"),
            channels.alias("channels"),
            F.explode(F.when(F.size(leagues) > 0, F.array_distinct(leagues)).otherwise(F.array(F.lit("*")))).alias(
                "league_key"
            ),
            F.array(venue, F.lit("")).alias("venue_keys"),
        )
        .withColumn("venue_key", F.explode("venue_keys"))
        .drop("venue_keys")
    )
    alert_venue = F.lower(F.coalesce("venue", F.lit("")))
    raised = (
        alerts.withColumn(
            "league_key", F.explode(F.array(F.lower(F.coalesce("league", F.lit(""))), F.lit("*")))
        )
        .withColumn(
            "venue_key",
            F.explode(F.when(alert_venue == "", F.array(F.lit(""))).otherwise(F.array(alert_venue, F.lit("both")))),
        )
        .select("alert_id", "kind", "league_key", "venue_key", "value")
    )
    pairs = alert_pairs(raised, wanted, ["kind", "league_key", "venue_key"]).filter(F.col("value") >= F.col("min_value"))
    return pairs.select("alert_id", "subscription_id", "user_id", F.explode("channels").alias("channel"))


def entitlements(subscriptions: DataFrame, as_of: Column) -> DataFrame:
    """Best tier of every user's live subscriptions with what it allows."""
    key = F.lower(F.coalesce("price_key", F.lit("")))
    rank = F.when(key.contains("desk"), 3).when(key.contains("auto"), 2).when(key.contains("signal"), 1).otherwise(0)
    live = F.col("status").isin("active", "trialing") & (F.col("ends_at").isNull() | (F.col("ends_at") >= as_of))
    best = subscriptions.groupBy("user_id").agg(F.max(F.when(live, rank).otherwise(0)).alias("rank"))
    tier = F.element_at(F.array(*[F.lit(x) for x in TIERS]), F.col("rank") + 1)
    limit = F.when(F.col("rank") == 0, 0).when(F.col("rank") == 1, 1).when(F.col("rank") == 2, 5)
    return best.select(
        "user_id",
        tier.alias("tier"),
        (F.col("rank") >= 2).alias("can_auto_execute"),
        limit.alias("max_strategies"),
        (F.col("rank") >= 2).alias("can_use_deep_research"),
    )


def discussion_threads(notes: DataFrame, limit: int | None = None) -> DataFrame:
    """Note counts by stance and the newest three notes per market; hidden notes stay out."""
    shown = notes.filter(~F.col("hidden"))
    counts = shown.groupBy("market_id").agg(
        F.count(F.lit(1)).alias("note_count"),
        *[count_if(F.col("stance") == s).alias(s) for s in ("yes", "no", "watching")],
        F.max("created_at").alias("last_at"),
    )
    if limit is not None:
        counts = counts.orderBy(F.desc("last_at"), "market_id").limit(limit)
    newest = W.partitionBy("market_id").orderBy(F.desc("created_at"), F.desc("note_id"))
    listed = shown.join(counts.select("market_id"), "market_id", "left_semi")
    top = listed.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= 3)
    latest = top.groupBy("market_id").agg(
        F.sort_array(F.collect_list(F.struct("rn", "note_id", "author_name", "stance", "body", "created_at"))).alias("latest")
    )
    return counts.join(latest, "market_id")


def api_usage(requests: DataFrame) -> DataFrame:
    """Requests per key, day and endpoint."""
    return requests.groupBy("api_key", F.to_date("created_at").alias("day"), "endpoint").agg(
        F.count(F.lit(1)).alias("requests")
    )


def quota_use(usage: DataFrame, quotas: DataFrame) -> DataFrame:
    """Day total per key against its plan quota (NULL quota means unlimited)."""
    days = usage.groupBy("api_key", "day").agg(F.sum("requests").alias("used"))
    rows = days.join(quotas.select("api_key", "daily_quota"), "api_key", "left")
    return rows.withColumn("allowed", F.coalesce(F.col("used") <= F.col("daily_quota"), F.lit(True)))


def saved_sheets(legs: DataFrame) -> DataFrame:
    """Legs and parlay price per sheet; a leg without a usable price counts as 1."""
    price = F.when(F.isnan("price") | (F.col("price") == 0) | F.col("price").isNull(), 1.0).otherwise(F.col("price"))
    return legs.groupBy("sheet_id").agg(
        F.count(F.lit(1)).alias("leg_count"), F.product(price).alias("parlay_price")
    )
