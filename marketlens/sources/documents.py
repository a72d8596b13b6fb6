"""Scoreboard, standings, injury and game documents, and page snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.common import clamp, js_round
from marketlens.functions.text import injury_severity
from marketlens.functions.times import to_instant

COMPETITOR = (
    "struct<homeAway: string, score: string, team: struct<id: string, displayName: string, name: string>, "
    "linescores: array<struct<value: double, displayValue: string>>>"
)
SCHEDULE_SCHEMA = (
    f"sport string, id string, date string, competitions array<struct<competitors: array<{COMPETITOR}>, "
    "status: struct<type: struct<state: string, detail: string>>>>"
)


def _side(competitors: Column, role: str, index: int) -> Column:
    """The competitor with the role, else the one at the position."""
    named = F.get(F.filter(competitors, lambda c: c["homeAway"] == role), F.lit(0))
    return F.coalesce(named, F.get(competitors, F.lit(index)))


def event_status(state: Column, detail: Column) -> Column:
    text = F.lower(F.coalesce(detail, F.lit("")))
    return (
        F.when(F.contains(text, F.lit("postponed")), "postponed")
        .when(F.contains(text, F.lit("canceled")) | F.contains(text, F.lit("cancelled")), "cancelled")
        .when(state == "in", "live")
        .when(state == "post", "final")
        .otherwise("scheduled")
    )


def normalise_schedule(documents: DataFrame) -> DataFrame:
    """Fixture rows with scores: sides by role, then by position; status and winner from the document."""
    first = F.get("competitions", F.lit(0))
    sides = first["competitors"]
    rows = documents.filter((F.coalesce("id", F.lit("")) != "") & (F.size(sides) >= 2)).select(
        "sport",
        F.col("id").alias("external_id"),
        to_instant(F.col("date")).alias("commence_at"),
        event_status(first["status"]["type"]["state"], first["status"]["type"]["detail"]).alias("status"),
        _side(sides, "home", 0).alias("h"),
        _side(sides, "away", 1).alias("a"),
    )

    def name(c: str) -> Column:
        return F.coalesce(F.nullif(f"{c}.team.displayName", F.lit("")), F.col(f"{c}.team.name"), F.lit(""))

    def line(c: str) -> Column:
        return F.transform(F.coalesce(f"{c}.linescores", F.array()), lambda s: F.coalesce(s["value"], F.lit(0.0)))

    home, away = F.col("h.score").try_cast("double"), F.col("a.score").try_cast("double")
    winner = F.when(home > away, "home").when(away > home, "away").when(home == away, "draw")
    done = F.col("status") == "final"
    return rows.filter((name("h") != "") & (name("a") != "")).select(
        F.col("sport").alias("sport_slug"),
        "external_id",
        "commence_at",
        "status",
        name("h").alias("home_team"),
        name("a").alias("away_team"),
        F.when(done, home).alias("home_score"),
        F.when(done, away).alias("away_score"),
        F.when(done, winner).alias("winner_side"),
        (done & winner.isNotNull()).alias("completed"),
        line("h").alias("home_periods"),
        line("a").alias("away_periods"),
    )


ENTRY = "struct<team: struct<id: string, displayName: string>, stats: array<struct<name: string, value: double>>>"
STANDINGS_LEVELS = 6


def _group(depth: int) -> str:
    own = f"name: string, standings: struct<entries: array<{ENTRY}>>"
    return f"struct<{own}, children: array<{'string' if depth == 0 else _group(depth - 1)}>>"


def standings_schema(levels: int = STANDINGS_LEVELS) -> str:
    """Schema of standings documents nested so many levels deep; what lies below the last stays text."""
    return f"sport string, root {_group(levels - 1)}"


STANDINGS_SCHEMA = standings_schema()


def standings_from_stats(documents: DataFrame, levels: int = STANDINGS_LEVELS) -> DataFrame:
    """Entries of every nesting level with their named statistics as columns; deeper documents are an error."""
    level = documents.select("sport", F.col("root").alias("g"))
    entries = None
    for depth in range(levels):
        if depth == levels - 1:
            deeper = F.raise_error(F.lit(f"standings are nested more than {levels} levels deep"))
            level = level.filter(F.when(F.size("g.children") > 0, deeper.cast("boolean")).otherwise(F.lit(True)))
        here = level.select("sport", F.col("g.name").alias("group_name"), F.explode("g.standings.entries").alias("e"))
        entries = here if entries is None else entries.unionByName(here)
        if depth < levels - 1:
            level = level.select("sport", F.explode("g.children").alias("g"))

    def stat(name: str) -> Column:
        first = F.get(F.filter("e.stats", lambda s: s["name"] == name), F.lit(0))
        return F.coalesce(first["value"], F.lit(0.0))

    def either(a: Column, b: Column) -> Column:
        return F.when(a != 0, a).otherwise(b)

    wins, losses, ties = stat("wins"), stat("losses"), stat("ties")
    played = either(stat("gamesPlayed"), wins + losses + ties)
    share = F.when(played > 0, (wins + ties / 2.0) / F.when(played > 0, played)).otherwise(F.lit(0.0))
    return entries.filter(F.trim(F.coalesce("e.team.displayName", F.lit(""))) != "").select(
        "sport",
        "group_name",
        F.trim("e.team.displayName").alias("team"),
        wins.alias("wins"),
        losses.alias("losses"),
        ties.alias("ties"),
        played.alias("games_played"),
        clamp(share, 0.0, 1.0).alias("win_percent"),
        stat("pointsFor").alias("points_for"),
        stat("pointsAgainst").alias("points_against"),
        either(stat("pointDifferential"), stat("differential")).alias("point_differential"),
    )


INJURY_SCHEMA = (
    "sport string, injuries array<struct<displayName: string, injuries: array<struct<status: string, "
    "athlete: struct<displayName: string>, details: struct<type: string>>>>>"
)


def injuries_from_feed(documents: DataFrame) -> DataFrame:
    """One row per injured athlete with the severity of the status text."""
    blocks = documents.select("sport", F.explode("injuries").alias("t"))
    rows = blocks.select("sport", F.trim("t.displayName").alias("team"), F.explode("t.injuries").alias("i"))
    athlete = F.trim(F.coalesce("i.athlete.displayName", F.lit("")))
    return rows.filter((F.coalesce("team", F.lit("")) != "") & (athlete != "")).select(
        "sport",
        "team",
        athlete.alias("athlete"),
        F.coalesce("i.status", F.lit("")).alias("status"),
        F.coalesce("i.details.type", F.lit("")).alias("injury_type"),
        injury_severity(F.col("i.status")).alias("severity"),
    )


STAT = "struct<name: string, displayValue: string>"
BOX_TEAM = f"struct<team: struct<id: string>, statistics: array<struct<name: string, displayValue: string, stats: array<{STAT}>>>>"
MONEY = "struct<moneyLine: double, favorite: boolean>"
GAME_SCHEMA = (
    f"league string, id string, competitors array<{COMPETITOR}>, teams array<{BOX_TEAM}>, "
    f"odds array<struct<provider: struct<name: string>, details: string, spread: double, overUnder: double, homeTeamOdds: {MONEY}, awayTeamOdds: {MONEY}>>"
)
# Statistics shown per league.
STAT_PICKS = {
    "mlb": ["hits", "runs", "homeRuns", "RBIs", "strikeouts", "walks"],
    "nba": ["fieldGoalPct", "threePointFieldGoalPct", "freeThrowPct", "totalRebounds", "assists", "turnovers"],
    "nfl": ["totalYards", "netPassingYards", "rushingYards", "firstDowns", "turnovers", "possessionTime"],
    "nhl": ["shotsTotal", "powerPlayGoals", "faceoffsWon", "penaltyMinutes", "hits", "blockedShots"],
    "epl": ["possessionPct", "totalShots", "shotsOnTarget", "foulsCommitted", "wonCorners", "saves"],
    "atp": ["aces", "doubleFaults", "firstServePointsWon", "breakPoints", "totalPointsWon", "winners"],
}


def _stat_list(team: Column) -> Column:
    """Flattened (name, value) list of one team: nested groups are opened, plain groups count as entries."""
    groups = F.coalesce(team["statistics"], F.array())
    return F.flatten(
        F.transform(
            groups,
            lambda g: F.when(F.size(F.coalesce(g["stats"], F.array())) > 0, g["stats"]).otherwise(
                F.array(F.struct(g["name"].alias("name"), g["displayValue"].alias("displayValue")))
            ),
        )
    )


def _first_stat(stats: Column, name: Column) -> Column:
    return F.get(F.filter(stats, lambda s: (s["name"] == name) & s["displayValue"].isNotNull()), F.lit(0))["displayValue"]


def game_stat_pairs(documents: DataFrame) -> DataFrame:
    """Chosen statistics of both teams side by side with the away share of the pair total (50 when 0-0)."""
    picks = F.create_map(*[x for k, v in STAT_PICKS.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in v]))])
    home, away = _side(F.col("competitors"), "home", 0), _side(F.col("competitors"), "away", 1)

    def box(side: Column) -> Column:
        return F.get(F.filter("teams", lambda b: b["team"]["id"] == side["team"]["id"]), F.lit(0))

    rows = documents.filter(F.size("competitors") >= 2).select(
        "league", "id", _stat_list(box(home)).alias("hs"), _stat_list(box(away)).alias("as_"),
        F.explode(F.try_element_at(picks, F.col("league"))).alias("stat"),
    )
    pairs = rows.select(
        "league", "id", "stat", _first_stat(F.col("as_"), F.col("stat")).alias("away"), _first_stat(F.col("hs"), F.col("stat")).alias("home")
    ).filter(F.col("away").isNotNull() & F.col("home").isNotNull())

    def number(text: str) -> Column:
        return F.coalesce(F.regexp_replace(text, "[^0-9.-]", "").try_cast("double"), F.lit(0.0))

    a, h = number("away"), number("home")
    share = F.when(a + h > 0, js_round(a / F.when(a + h > 0, a + h) * 100.0)).otherwise(F.lit(50.0))
    return pairs.withColumn("away_share", share)


def game_summary(documents: DataFrame) -> DataFrame:
    """Line score, totals and the first provider's odds per game."""
    home, away = _side(F.col("competitors"), "home", 0), _side(F.col("competitors"), "away", 1)

    def line(side: Column) -> Column:
        return F.transform(F.coalesce(side["linescores"], F.array()), lambda s: F.coalesce(s["displayValue"], F.lit("-")))

    odds = F.get("odds", F.lit(0))
    favorite = F.when(odds["homeTeamOdds"]["favorite"], "home").when(odds["awayTeamOdds"]["favorite"], "away")
    return documents.filter(F.size("competitors") >= 2).select(
        "league",
        "id",
        F.coalesce(home["team"]["displayName"], home["team"]["name"]).alias("home_team"),
        F.coalesce(away["team"]["displayName"], away["team"]["name"]).alias("away_team"),
        home["score"].alias("home_total"),
        away["score"].alias("away_total"),
        line(home).alias("home_line"),
        line(away).alias("away_line"),
        F.greatest(F.size(line(home)), F.size(line(away))).alias("periods"),
        F.coalesce(odds["provider"]["name"], F.when(odds.isNotNull(), "Book")).alias("odds_provider"),
        odds["spread"].alias("spread"),
        odds["overUnder"].alias("over_under"),
        odds["homeTeamOdds"]["moneyLine"].alias("home_money_line"),
        odds["awayTeamOdds"]["moneyLine"].alias("away_money_line"),
        favorite.alias("favorite"),
    )


# What pages say that ask for proof of a person.
CHALLENGE = r"(?i)captcha|access denied|unusual traffic|automated (access|requests)|cf-chl-"


def document_snapshot(pages: DataFrame, provider: str = "web") -> DataFrame:
    """Content-addressed snapshots of whole pages; challenge pages and repeats of the same content are dropped."""
    fresh = pages.filter(F.col("html").isNotNull() & ~F.col("html").rlike(CHALLENGE))
    hashed = fresh.select(
        F.lit(provider).alias("provider"),
        "url",
        F.sha2("url", 256).alias("url_hash"),
        F.sha2("html", 256).alias("content_hash"),
        F.octet_length("html").alias("byte_length"),
        "page_id",
    )
    return hashed.groupBy("provider", "url_hash", "content_hash").agg(
        F.min("page_id").alias("page_id"), F.first("url").alias("url"), F.first("byte_length").alias("byte_length")
    )
