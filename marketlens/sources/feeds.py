"""Quote feeds: nested or flat JSON documents to one row per (event, book, market, outcome)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.prices import american_to_decimal
from marketlens.functions.text import search_key
from marketlens.functions.times import to_instant

FEED_SCHEMA = (
    "externalId string, sportSlug string, commenceAt string, homeTeam string, awayTeam string, "
    "books array<struct<key: string, title: string, lastUpdate: string, markets: array<struct<"
    "marketType: string, line: double, period: string, playerName: string, outcomes: array<struct<"
    "side: string, label: string, point: double, price: double, limitAmount: double, link: string, sid: string, "
    "tradedVolume: double>>>>>>"
)
# Market labels and the codes of each feed.
MARKET_LABELS = {"h2h": "Moneyline", "spreads": "Spread", "totals": "Total"}
FLAT_MARKETS = {"1_0": "h2h", "2_0": "spreads", "3_0": "totals"}
FLAT_SIDES = {"Home": "home", "Away": "away", "Over": "over", "Under": "under", "Draw": "draw"}
MATCHUP_MARKETS = {"moneyline": "h2h", "spread": "spreads", "total": "totals"}
SIDES = ["home", "away", "draw", "over", "under"]
NON_SOCCER = ["mlb", "nfl", "ncaaf", "nba", "ncaab", "nhl"]


def _lookup(column: Column, table: dict[str, str]) -> Column:
    out = None
    for key, value in table.items():
        out = F.when(column == key, value) if out is None else out.when(column == key, value)
    return out


def explode_feed(feed: DataFrame) -> DataFrame:
    """One row per outcome with its position; ``complete`` marks markets of two or more outcomes."""
    books = feed.select("externalId", "sportSlug", "commenceAt", "homeTeam", "awayTeam", F.explode("books").alias("b"))
    markets = books.select("*", F.explode("b.markets").alias("m"))
    rows = markets.select("*", F.posexplode("m.outcomes").alias("position", "o"))
    return rows.select(
        F.col("externalId").alias("external_id"),
        F.col("sportSlug").alias("sport_slug"),
        to_instant(F.col("commenceAt")).alias("commence_at"),
        F.col("homeTeam").alias("home_team"),
        F.col("awayTeam").alias("away_team"),
        F.col("b.key").alias("book_key"),
        to_instant(F.col("b.lastUpdate")).alias("observed_at"),
        F.col("m.marketType").alias("market_type"),
        F.coalesce(_lookup(F.col("m.marketType"), MARKET_LABELS), F.col("m.marketType")).alias("market_label"),
        F.col("m.line").alias("line"),
        F.coalesce("m.period", F.lit("full_game")).alias("period"),
        F.coalesce("m.playerName", F.lit("")).alias("player_name"),
        (F.size("m.outcomes") >= 2).alias("complete"),
        "position",
        "o.side",
        "o.label",
        "o.point",
        "o.price",
        F.col("o.limitAmount").alias("limit_amount"),
    )


def flatten_feed(feed: DataFrame, sports: DataFrame, book_keys: DataFrame) -> DataFrame:
    """Outcomes of known sports and books with their ids (``book_keys`` is ``board.book_index``)."""
    rows = explode_feed(feed).withColumn("key", search_key(F.col("book_key")))
    return rows.join(sports.select("sport_slug"), "sport_slug", "left_semi").join(book_keys, "key").drop("key")


def feed_unmatched(feed: DataFrame, sports: DataFrame, book_keys: DataFrame) -> DataFrame:
    """Events of unknown sports and (event, book) pairs of unknown books."""
    lost_sports = feed.select("externalId", F.col("sportSlug").alias("sport_slug")).join(
        sports.select("sport_slug"), "sport_slug", "left_anti"
    )
    known = feed.withColumnRenamed("sportSlug", "sport_slug").join(sports.select("sport_slug"), "sport_slug", "left_semi")
    pairs = known.select("externalId", F.explode("books.key").alias("book_key"))
    lost_books = pairs.withColumn("key", search_key(F.col("book_key"))).join(book_keys, "key", "left_anti")
    return lost_sports.select(F.lit("sport").alias("kind"), F.col("sport_slug").alias("name")).unionByName(
        lost_books.select(F.lit("book").alias("kind"), F.col("book_key").alias("name"))
    )


FLAT_SCHEMA = (
    "sport string, events array<struct<id: string, startEventDate: string, participants: array<struct<name: string, "
    "venueRole: string>>>>, markets array<struct<id: string, eventId: string, marketType: struct<id: string>>>, "
    "selections array<struct<id: string, marketId: string, label: string, points: double, trueOdds: double, outcomeType: string>>"
)


def _participant(parts: Column, field: str, role: str) -> Column:
    return F.get(F.filter(parts, lambda p: F.lower(p[field]) == role), F.lit(0))["name"]


def _quoted(rows: DataFrame) -> DataFrame:
    """Markets with ``quotes`` (side, label, point, price, sid) of two or more outcomes, one row per quote, with the line."""
    lead = F.filter("quotes", lambda q: q["side"].isin("home", "over"))
    sized = rows.withColumn("outcomes", F.size("quotes").cast("bigint")).filter(F.col("outcomes") >= 2)
    lined = sized.withColumn("line", F.array_max(F.transform(lead, lambda q: q["point"])))
    kept = [c for c in lined.columns if c != "quotes"]
    return lined.select(*kept, F.explode("quotes").alias("q")).select(*kept, "q.*")


def _usable(external_id: str) -> Column:
    named = [F.coalesce(F.col(c), F.lit("")) != "" for c in ("home_team", "away_team")]
    return F.col(external_id).isNotNull() & (F.col(external_id).cast("string") != "") & F.col("commence_at").isNotNull() & named[0] & named[1]


def normalise_flat_feed(feed: DataFrame) -> DataFrame:
    """Three flat arrays (events, markets, selections) put together on their ids, inside each document and so without a shuffle."""

    def market(m: Column) -> Column:
        own = F.filter("selections", lambda s: (s["marketId"] == m["id"]) & (s["trueOdds"] > 1))
        quotes = F.transform(
            own,
            lambda s: F.struct(
                _lookup(s["outcomeType"], FLAT_SIDES).alias("side"), s["label"].alias("label"), s["points"].alias("point"), s["trueOdds"].alias("price"), s["id"].alias("sid")
            ),
        )
        return F.struct(
            m["id"].alias("market_ref"),
            m["eventId"].alias("external_id"),
            _lookup(m["marketType"]["id"], FLAT_MARKETS).alias("market_type"),
            F.get(F.filter("events", lambda e: e["id"] == m["eventId"]), F.lit(0)).alias("event"),
            F.filter(quotes, lambda q: q["side"].isNotNull()).alias("quotes"),
        )

    rows = feed.select(F.col("sport").alias("sport_slug"), F.explode(F.transform("markets", market)).alias("m")).select("sport_slug", "m.*")
    rows = rows.filter(F.col("market_type").isNotNull()).select(
        "external_id",
        "market_ref",
        "market_type",
        "sport_slug",
        to_instant(F.col("event.startEventDate")).alias("commence_at"),
        _participant(F.col("event.participants"), "venueRole", "home").alias("home_team"),
        _participant(F.col("event.participants"), "venueRole", "away").alias("away_team"),
        "quotes",
    )
    return _quoted(rows.filter(_usable("external_id"))).withColumn("period", F.lit("full_game"))


MATCHUP_SCHEMA = (
    "sport string, matchups array<struct<id: bigint, parentId: bigint, startTime: string, participants: "
    "array<struct<alignment: string, name: string>>>>, markets array<struct<matchupId: bigint, type: string, period: int, "
    "status: string, prices: array<struct<designation: string, points: double, price: double>>, "
    "limits: array<struct<amount: double, type: string>>>>"
)


def period_name(period: Column, sport: Column) -> Column:
    numbered = F.concat(F.lit("period_"), period.cast("string"))
    return (
        F.when(F.coalesce(period, F.lit(0)) == 0, "full_game")
        .when(sport.isin(NON_SOCCER), numbered)
        .when(period == 1, "first_half")
        .otherwise(numbered)
    )


def normalise_matchup_feed(feed: DataFrame) -> DataFrame:
    """Matchups put together with their open markets inside each document, American prices to decimal, best stake limit kept."""

    def market(k: Column, number: Column) -> Column:
        own = F.filter("matchups", lambda m: (m["id"] == k["matchupId"]) & m["parentId"].isNull())
        prices = F.transform(
            k["prices"],
            lambda p: F.struct(p["designation"].alias("side"), p["points"].alias("point"), american_to_decimal(p["price"]).alias("price")),
        )
        amounts = F.filter(F.transform(k["limits"], lambda x: x["amount"]), lambda a: a > 0)
        return F.struct(
            k["matchupId"].alias("matchup_id"),
            number.alias("market_no"),
            _lookup(k["type"], MATCHUP_MARKETS).alias("market_type"),
            k["period"].alias("period_no"),
            F.array_max(amounts).alias("limit_amount"),
            F.coalesce(k["status"], F.lit("open")).alias("status"),
            F.get(own, F.lit(0)).alias("event"),
            F.filter(prices, lambda q: q["side"].isin(SIDES) & (q["price"] > 1)).alias("quotes"),
        )

    rows = feed.select(F.col("sport").alias("sport_slug"), F.explode(F.transform("markets", market)).alias("k")).select("sport_slug", "k.*")
    rows = rows.filter(F.col("market_type").isNotNull() & F.col("status").isin("open", "")).select(
        "matchup_id",
        "market_no",
        "market_type",
        "period_no",
        "limit_amount",
        "sport_slug",
        to_instant(F.col("event.startTime")).alias("commence_at"),
        _participant(F.col("event.participants"), "alignment", "home").alias("home_team"),
        _participant(F.col("event.participants"), "alignment", "away").alias("away_team"),
        "quotes",
    )
    label = F.when(F.col("side") == "home", F.col("home_team")).when(F.col("side") == "away", F.col("away_team"))
    return _quoted(rows.filter(_usable("matchup_id"))).select(
        "*",
        F.coalesce(label, F.col("side")).alias("label"),
        period_name(F.col("period_no"), F.col("sport_slug")).alias("period"),
    )


NAMED_SCHEMA = (
    "id string, sport string, commence_time string, home_team string, away_team string, bookmakers array<struct<key: string, "
    "title: string, last_update: string, markets: array<struct<key: string, outcomes: array<struct<name: string, "
    "price: double, point: double>>>>>>"
)


def normalise_named_feed(feed: DataFrame) -> DataFrame:
    """Outcomes identified by name: home, away or draw by normalised team name, over and under for totals."""
    base = feed.filter(
        (F.coalesce("id", F.lit("")) != "") & (F.coalesce("home_team", F.lit("")) != "") & (F.coalesce("away_team", F.lit("")) != "")
    )
    books = base.select("*", F.explode("bookmakers").alias("b")).filter(F.coalesce("b.key", F.lit("")) != "")
    markets = books.select("*", F.explode("b.markets").alias("m")).filter(F.col("m.key").isin("h2h", "spreads", "totals"))
    rows = markets.select("*", F.posexplode("m.outcomes").alias("position", "o"))
    name = search_key(F.coalesce("o.name", F.lit("")))
    team_side = (
        F.when(name == search_key(F.col("home_team")), "home")
        .when(name == search_key(F.col("away_team")), "away")
        .when(name.isin("draw", "tie"), "draw")
    )
    side = F.when(F.col("m.key") == "totals", F.when(name.isin("over", "under"), name)).otherwise(team_side)
    quotes = rows.select(
        F.col("id").alias("external_id"),
        F.col("sport").alias("sport_slug"),
        to_instant(F.col("commence_time")).alias("commence_at"),
        "home_team",
        "away_team",
        F.col("b.key").alias("book_key"),
        to_instant(F.col("b.last_update")).alias("observed_at"),
        F.col("m.key").alias("market_type"),
        "position",
        side.alias("side"),
        F.col("o.name").alias("label"),
        F.col("o.point").alias("point"),
        F.col("o.price").alias("price"),
    ).filter(F.col("side").isNotNull() & (F.col("price") > 1) & F.col("commence_at").isNotNull())
    keys = ["external_id", "book_key", "market_type"]
    first = F.min_by("point", F.when(F.col("point").isNotNull(), F.col("position")))

    def point_of(which: str) -> Column:
        return F.max(F.when(F.col("side") == which, F.col("point")))

    lines = quotes.groupBy(*keys).agg(
        F.when(F.first("market_type") == "totals", F.coalesce(point_of("over"), first))
        .when(F.first("market_type") == "spreads", F.coalesce(point_of("home"), point_of("away")))
        .alias("line")
    )
    return quotes.join(lines, keys)


def fallback_fill(primary: DataFrame, fallback: DataFrame, key: str = "sport_slug") -> DataFrame:
    """Primary rows plus fallback rows of the leagues the primary did not cover."""
    return primary.unionByName(fallback.join(primary.select(key).distinct(), key, "left_anti"))
