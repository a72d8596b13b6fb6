"""Queries over feeds, tapes, documents, keyed tables and entity resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.fixtures import Tables
from marketlens.functions import text as X
from marketlens.operators import resolve as R
from marketlens.plans.quotes import _fair
from marketlens.plans.tape import TAPE_AS_OF  # noqa: F401
from marketlens.registry import query
from marketlens.sources import documents, feeds, tables, tapes


def _as_json(df, schema: str):
    """Round-trips rows through JSON text, so the query parses documents as a reader would."""
    packed = df.select(F.to_json(F.struct(*df.columns)).alias("j"))
    return packed.select(F.from_json("j", schema).alias("d")).select("d.*")


def _feed(t: Tables):
    """Nested feed documents of the fixture quotes: at most nine selections and eight books per event."""
    outcome = F.struct(
        "side", F.concat(F.lit("sel"), F.col("selection_id").cast("string")).alias("label"), F.lit(None).cast("double").alias("point"),
        "price", F.lit(None).cast("double").alias("limitAmount"), F.lit("").alias("link"),
        F.col("selection_id").cast("string").alias("sid"), F.lit(0.0).alias("tradedVolume"),
    )
    per_market = (
        t("fx_quotes")
        .groupBy("event_id", "bookmaker_id", "market_id", "market_type")
        .agg(F.sort_array(F.collect_list(outcome)).alias("outcomes"))
    )
    market = F.struct(
        F.col("market_type").alias("marketType"), F.lit(None).cast("double").alias("line"), F.lit(None).cast("string").alias("period"),
        F.lit(None).cast("string").alias("playerName"), "outcomes",
    )
    per_book = per_market.groupBy("event_id", "bookmaker_id").agg(F.collect_list(market).alias("markets"))
    name = F.concat(F.lit("Book-"), F.col("bookmaker_id").cast("string"))
    book = F.struct(name.alias("key"), name.alias("title"), F.lit("2024-01-01T00:00:00Z").alias("lastUpdate"), "markets")
    per_event = per_book.groupBy("event_id").agg(F.collect_list(book).alias("books"))
    docs = per_event.select(
        F.col("event_id").cast("string").alias("externalId"),
        F.concat(F.lit("sport"), (F.col("event_id") % 6).cast("string")).alias("sportSlug"),
        F.lit("2024-02-01T18:00:00Z").alias("commenceAt"),
        F.lit("Home").alias("homeTeam"),
        F.lit("Away").alias("awayTeam"),
        "books",
    )
    return _as_json(docs, feeds.FEED_SCHEMA)


def _sports(t: Tables):
    return t("fx_events").select("sport_slug").distinct()


def _keys(t: Tables):
    return t("fx_books").filter(F.col("bookmaker_id") < 7).select(
        X.search_key(F.col("slug")).alias("key"), "bookmaker_id"
    )


@query(
    "flatten_feed",
    """SELECT CAST(q.event_id AS VARCHAR) AS external_id, q.bookmaker_id, q.market_type, CASE q.market_type WHEN 'h2h' THEN 'Moneyline' WHEN 'spreads' THEN 'Spread' ELSE 'Total' END AS market_label,
       count(*) OVER (PARTITION BY q.bookmaker_id, q.market_id) >= 2 AS complete, concat('sel', CAST(q.selection_id AS VARCHAR)) AS label, q.side, q.price
    FROM fx_quotes q WHERE q.bookmaker_id < 7 AND q.event_id % 6 <> 5""",
    dbl="price",
)
def _(t: Tables):
    rows = feeds.flatten_feed(_feed(t), _sports(t), _keys(t))
    return rows.select("external_id", "bookmaker_id", "market_type", "market_label", "complete", "label", "side", "price")


@query(
    "feed_unmatched",
    """SELECT 'sport' AS kind, 'sport5' AS name, count(DISTINCT event_id) AS n FROM fx_quotes WHERE event_id % 6 = 5
    UNION ALL SELECT 'book', 'Book-7', count(DISTINCT event_id) FROM fx_quotes WHERE bookmaker_id = 7 AND event_id % 6 <> 5""",
)
def _(t: Tables):
    rows = feeds.feed_unmatched(_feed(t), _sports(t), _keys(t))
    return rows.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))


FLAT_SQL = """
q AS (SELECT event_id, market_id * 8 + bookmaker_id AS market_id, selection_id, market_type, side, price FROM fx_quotes),
sized AS (SELECT market_id, count(*) AS n FROM q WHERE side <> 'draw' OR market_type = 'h2h' GROUP BY 1)
"""


def _flat_docs(t: Tables):
    # Every (market, book) set of the fixture is one market of the feed.
    q = t("fx_quotes").withColumn("market_id", F.col("market_id") * 8 + F.col("bookmaker_id"))
    sid = F.col("selection_id").cast("string")
    code = F.when(F.col("market_type") == "h2h", "1_0").when(F.col("market_type") == "spreads", "2_0").otherwise("3_0")
    side = F.when(F.col("market_type") == "totals", F.when(F.col("side") == "home", "Over").when(F.col("side") == "away", "Under")).otherwise(F.initcap("side"))
    side = F.when((F.col("market_type") != "h2h") & (F.col("side") == "draw"), "Other").otherwise(side)
    point = F.when(F.col("market_type") != "h2h", (F.col("selection_id") % 10).cast("double"))
    markets = q.select("event_id", "market_id", "market_type").distinct()
    market = F.struct(F.col("market_id").cast("string").alias("id"), F.col("event_id").cast("string").alias("eventId"), F.struct(code.alias("id")).alias("marketType"))
    selection = F.struct(sid.alias("id"), F.col("market_id").cast("string").alias("marketId"), F.col("side").alias("label"), point.alias("points"), F.col("price").alias("trueOdds"), side.alias("outcomeType"))
    teams = F.array(
        F.struct(F.lit("H").alias("name"), F.lit("Home").alias("venueRole")), F.struct(F.lit("A").alias("name"), F.lit("Away").alias("venueRole"))
    )
    m = markets.groupBy("event_id").agg(F.collect_list(market).alias("markets"))
    s = q.groupBy("event_id").agg(F.collect_list(selection).alias("selections"))
    event = F.array(F.struct(F.col("event_id").cast("string").alias("id"), F.lit("2024-02-01T18:00:00Z").alias("startEventDate"), teams.alias("participants")))
    docs = m.join(s, "event_id").select(F.lit("mlb").alias("sport"), event.alias("events"), "markets", "selections")
    return _as_json(docs, feeds.FLAT_SCHEMA)


@query(
    "normalise_flat_feed",
    f"""WITH {FLAT_SQL}, r AS (SELECT CAST(q.event_id AS VARCHAR) AS external_id, CAST(q.market_id AS VARCHAR) AS market_ref, q.market_type,
       CASE WHEN q.market_type = 'totals' THEN CASE q.side WHEN 'home' THEN 'over' ELSE 'under' END ELSE q.side END AS side, q.price, s.n AS outcomes,
       max(CASE WHEN q.side = 'home' AND q.market_type <> 'h2h' THEN CAST(q.selection_id % 10 AS DOUBLE) END) OVER (PARTITION BY q.market_id) AS line
    FROM q JOIN sized s ON s.market_id = q.market_id WHERE (q.side <> 'draw' OR q.market_type = 'h2h') AND s.n >= 2)
    SELECT * FROM r UNION ALL SELECT * FROM r""",
    dbl="price line",
)
def _(t: Tables):
    docs = _flat_docs(t)
    rows = feeds.normalise_flat_feed(docs.unionAll(docs))  # two polls of every event
    return rows.select("external_id", "market_ref", "market_type", "side", "price", "outcomes", "line")


@query(
    "normalise_matchup_feed",
    """WITH q AS (SELECT *, CAST(CASE WHEN price >= 2 THEN floor((price - 1) * 100 + 0.5) ELSE floor(-100 / (price - 1) + 0.5) END AS DOUBLE) AS am FROM (SELECT event_id, market_id * 8 + bookmaker_id AS market_id, market_type, side, price FROM fx_quotes WHERE event_id % 9 <> 0) z),
    d AS (SELECT *, CASE WHEN am >= 100 THEN 1 + am / 100 WHEN am <= -100 THEN 1 + 100 / abs(am) ELSE 0 END AS dec FROM q),
    n AS (SELECT market_id, count(*) AS outcomes FROM d WHERE dec > 1 GROUP BY 1), r AS (
    SELECT d.event_id AS matchup_id, d.market_type, d.side, d.dec AS price, n.outcomes, CASE WHEN d.event_id % 4 = 0 THEN 'full_game' WHEN d.event_id % 4 = 1 THEN 'first_half' ELSE concat('period_', CAST(d.event_id % 4 AS VARCHAR)) END AS period,
       CASE WHEN d.market_id % 3 = 0 THEN NULL ELSE CAST(250 + d.market_id % 5 AS DOUBLE) END AS limit_amount
    FROM d JOIN n ON n.market_id = d.market_id WHERE d.dec > 1 AND n.outcomes >= 2)
    SELECT * FROM r UNION ALL SELECT * FROM r""",
    dbl="price limit_amount",
)
def _(t: Tables):
    from marketlens.functions.prices import american_number

    q = t("fx_quotes").withColumn("market_id", F.col("market_id") * 8 + F.col("bookmaker_id"))
    price = F.struct(F.col("side").alias("designation"), F.lit(None).cast("double").alias("points"), american_number(F.col("price")).cast("double").alias("price"))
    kind = F.when(F.col("market_type") == "h2h", "moneyline").when(F.col("market_type") == "spreads", "spread").otherwise("total")
    m = q.groupBy("event_id", "market_id", "market_type").agg(F.collect_list(price).alias("prices"))
    limits = F.when(F.col("market_id") % 3 == 0, F.array(F.struct(F.lit(0.0).alias("amount"), F.lit("x").alias("type")))).otherwise(
        F.array(F.struct(F.lit(100.0).alias("amount"), F.lit("a").alias("type")), F.struct((F.col("market_id") % 5 + 250).cast("double").alias("amount"), F.lit("b").alias("type")))
    )
    market = F.struct(
        F.col("event_id").alias("matchupId"), kind.alias("type"), (F.col("event_id") % 4).cast("int").alias("period"), F.lit("open").alias("status"), "prices", limits.alias("limits")
    )
    people = F.array(F.struct(F.lit("home").alias("alignment"), F.lit("H").alias("name")), F.struct(F.lit("away").alias("alignment"), F.lit("A").alias("name")))
    parent = F.when(F.col("event_id") % 9 == 0, F.lit(1)).cast("bigint")
    matchup = F.array(F.struct(F.col("event_id").alias("id"), parent.alias("parentId"), F.lit("2024-02-01T18:00:00Z").alias("startTime"), people.alias("participants")))
    docs = m.groupBy("event_id").agg(F.collect_list(market).alias("markets")).select(F.lit("epl").alias("sport"), matchup.alias("matchups"), "markets")
    docs = _as_json(docs, feeds.MATCHUP_SCHEMA)
    rows = feeds.normalise_matchup_feed(docs.unionAll(docs))  # two polls of every event
    return rows.select("matchup_id", "market_type", "side", "price", "outcomes", "period", "limit_amount")


@query(
    "normalise_named_feed",
    """SELECT CAST(event_id AS VARCHAR) AS external_id, concat('Book-', CAST(bookmaker_id AS VARCHAR)) AS book_key, market_type,
       CASE WHEN market_type = 'totals' THEN CASE side WHEN 'home' THEN 'over' ELSE 'under' END ELSE side END AS side, price,
       CASE WHEN market_type = 'h2h' THEN NULL ELSE CAST(coalesce(max(CASE WHEN side = 'home' THEN market_id % 7 END) OVER w, max(CASE WHEN side = 'away' THEN market_id % 7 END) OVER w) AS DOUBLE) END AS line
    FROM fx_quotes WHERE NOT (market_type = 'totals' AND side = 'draw') WINDOW w AS (PARTITION BY market_id, bookmaker_id)""",
    dbl="price line",
)
def _(t: Tables):
    q = t("fx_quotes")
    team = F.when(F.col("side") == "home", "F.C. North").when(F.col("side") == "away", "South-United").otherwise("Draw")
    name = F.when(F.col("market_type") == "totals", F.when(F.col("side") == "home", "OVER").when(F.col("side") == "away", "Under").otherwise("Push")).otherwise(team)
    point = F.when(F.col("side") != "draw", (F.col("market_id") % 7).cast("double"))
    outcome = F.struct(name.alias("name"), "price", point.alias("point"))
    m = q.groupBy("event_id", "bookmaker_id", "market_id", "market_type").agg(F.collect_list(outcome).alias("outcomes"))
    b = m.groupBy("event_id", "bookmaker_id").agg(F.collect_list(F.struct(F.col("market_type").alias("key"), "outcomes")).alias("markets"))
    key = F.concat(F.lit("Book-"), F.col("bookmaker_id").cast("string"))
    docs = b.groupBy("event_id").agg(F.collect_list(F.struct(key.alias("key"), key.alias("title"), F.lit("2024-01-01T00:00:00Z").alias("last_update"), "markets")).alias("bookmakers"))
    docs = docs.select(
        F.col("event_id").cast("string").alias("id"), F.lit("epl").alias("sport"), F.lit("2024-02-01T18:00:00Z").alias("commence_time"),
        F.lit("FC North").alias("home_team"), F.lit("South United").alias("away_team"), "bookmakers",
    )
    rows = feeds.normalise_named_feed(_as_json(docs, feeds.NAMED_SCHEMA))
    return rows.select("external_id", "book_key", "market_type", "side", "price", "line")


@query(
    "fallback_fill",
    """SELECT event_id, sport_slug, 'primary' AS origin FROM fx_events WHERE sport_slug IN ('sport0', 'sport1') UNION ALL SELECT event_id, sport_slug, 'fallback' FROM fx_events WHERE sport_slug NOT IN ('sport0', 'sport1')""",
)
def _(t: Tables):
    rows = t("fx_events").select("event_id", "sport_slug")
    primary = rows.filter(F.col("sport_slug").isin("sport0", "sport1")).withColumn("origin", F.lit("primary"))
    return feeds.fallback_fill(primary, rows.withColumn("origin", F.lit("fallback")))


@query(
    "normalise_trades_a",
    """SELECT trade_id AS external_id, ticker AS market_external_id, taker_side AS side, CAST(CASE WHEN taker_side = 'no' THEN no_price_dollars ELSE yes_price_dollars END AS DOUBLE) AS price, CAST(count_fp AS DOUBLE) AS size,
       floor(CAST(count_fp AS DOUBLE) * CAST(CASE WHEN taker_side = 'no' THEN no_price_dollars ELSE yes_price_dollars END AS DOUBLE) * 100 + 0.5) / 100 AS notional, created_at AS traded_at
    FROM fx_raw_trades WHERE count_fp <> 'n/a'""",
    dbl="price size notional",
)
def _(t: Tables):
    raw = t("fx_raw_trades").withColumn("created_time", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    return tapes.normalise_trades_a(raw).drop("venue", "wallet", "alias")


@query(
    "normalise_trades_b",
    """SELECT lower(concat(trade_id, ':', ticker, ':', outcome)) AS external_id, ticker AS market_external_id, lower(outcome) AS side, price, size, floor(size * price * 100 + 0.5) / 100 AS notional,
       make_timestamp(epoch_us(created_at) // 1000000 * 1000000) AS traded_at, lower(wallet) AS wallet, CASE WHEN name = '' THEN 'anon' ELSE name END AS alias FROM fx_raw_trades WHERE side = 'BUY'""",
    dbl="price size notional",
)
def _(t: Tables):
    raw = t("fx_raw_trades").select(
        "side", "price", "size", "outcome", "name", F.lit("anon").alias("pseudonym"), F.col("trade_id").alias("transactionHash"),
        F.col("ticker").alias("conditionId"), F.col("wallet").alias("proxyWallet"), F.floor(F.unix_micros("created_at") / 1000000).alias("timestamp"),
    )
    return tapes.normalise_trades_b(raw).drop("venue")


@query(
    "trade_tape",
    """SELECT external_id, market_external_id, side, price, size, traded_at FROM (SELECT *, row_number() OVER (PARTITION BY external_id ORDER BY traded_at, market_external_id, side, price, size) AS rn FROM (
      SELECT trade_id AS external_id, ticker AS market_external_id, taker_side AS side, CAST(CASE WHEN taker_side = 'no' THEN no_price_dollars ELSE yes_price_dollars END AS DOUBLE) AS price, CAST(count_fp AS DOUBLE) AS size,
             make_timestamp(epoch_us(created_at) // 1000000 * 1000000) AS traded_at FROM fx_raw_trades WHERE count_fp <> 'n/a') r) k WHERE rn = 1""",
    dbl="price size",
)
def _(t: Tables):
    raw = t("fx_raw_trades").withColumn("created_time", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    rows = tapes.deduplicate_trades(tapes.normalise_trades_a(raw))
    return rows.select("external_id", "market_external_id", "side", "price", "size", "traded_at")


@query(
    "normalise_markets",
    """SELECT 'a' AS venue, CAST(p_partkey AS VARCHAR) AS external_id, CASE p_size % 4 WHEN 0 THEN 'settled' WHEN 1 THEN 'open' WHEN 2 THEN 'settled' ELSE 'closed' END AS status, CASE WHEN p_size % 2 = 0 THEN 'yes' ELSE '' END AS result, p_retailprice AS volume FROM part
    UNION ALL SELECT 'b', CAST(p_partkey AS VARCHAR), CASE WHEN p_size % 3 = 0 THEN 'open' WHEN p_size % 2 = 0 THEN 'settled' ELSE 'closed' END, CASE WHEN p_size % 3 = 0 OR p_size % 5 = 0 THEN '' WHEN p_size % 5 < 3 THEN 'yes' ELSE 'no' END, p_retailprice FROM part""",
    dbl="volume",
)
def _(t: Tables):
    part, size = t("part"), F.col("p_size")
    key = F.col("p_partkey").cast("string")
    status = F.when(size % 4 == 0, "finalized").when(size % 4 == 1, "active").when(size % 4 == 2, "settled").otherwise("halted")
    none = F.lit(None).cast("string")
    a = part.select(
        key.alias("ticker"), F.col("p_name").alias("title"), none.alias("category"), status.alias("status"), F.when(size % 2 == 0, "yes").alias("result"),
        F.col("p_retailprice").cast("string").alias("volume_fp"), none.alias("liquidity_dollars"), F.lit("bad").alias("last_price_dollars"), none.alias("yes_sub_title"), none.alias("close_time"),
    )
    prices = F.when(size % 5 == 0, F.lit('["0.5", "0.5"]')).when(size % 5 < 3, F.lit('["1", "0"]')).otherwise(F.lit('["0.0005", "0.9995"]'))
    b = part.select(
        key.alias("conditionId"), F.col("p_name").alias("question"), none.alias("category"), (size % 3 != 0).alias("closed"), F.when(size % 2 == 0, "resolved").alias("umaResolutionStatus"),
        F.lit('["Yes", "No"]').alias("outcomes"), prices.alias("outcomePrices"), F.col("p_retailprice").alias("volumeNum"), F.lit(None).cast("double").alias("liquidityNum"),
        F.lit(None).cast("double").alias("lastTradePrice"), none.alias("endDate"),
    )
    return tapes.normalise_markets(a, b).select("venue", "external_id", "status", "result", "volume")


def _competitor(role, name, score):
    return F.struct(
        role.alias("homeAway"), score.cast("string").alias("score"),
        F.struct(F.lit("1").alias("id"), name.alias("displayName"), F.lit("n").alias("name")).alias("team"),
        F.array(F.struct(score.cast("double").alias("value"), F.lit("1").alias("displayValue"))).alias("linescores"),
    )


@query(
    "normalise_schedule",
    """SELECT CAST(event_id AS VARCHAR) AS external_id, commence_at, status, concat('T', CAST(home_team_id AS VARCHAR)) AS home_team, concat('T', CAST(away_team_id AS VARCHAR)) AS away_team,
       CASE WHEN status = 'final' THEN home_score END AS home_score, CASE WHEN status = 'final' THEN away_score END AS away_score,
       CASE WHEN status = 'final' THEN CASE WHEN home_score > away_score THEN 'home' WHEN home_score < away_score THEN 'away' ELSE 'draw' END END AS winner_side, status = 'final' AS completed FROM fx_events""",
    dbl="home_score away_score",
)
def _(t: Tables):
    e = t("fx_events")
    home = _competitor(F.lit("home"), F.concat(F.lit("T"), F.col("home_team_id").cast("string")), F.col("home_score"))
    away = _competitor(F.lit("away"), F.concat(F.lit("T"), F.col("away_team_id").cast("string")), F.col("away_score"))
    state = F.when(F.col("status") == "final", "post").when(F.col("status") == "live", "in").otherwise("pre")
    order = F.when(F.col("event_id") % 2 == 0, F.array(home, away)).otherwise(F.array(away, home))
    status = F.struct(F.struct(state.alias("state"), F.lit("").alias("detail")).alias("type"))
    docs = e.select(
        F.col("sport_slug").alias("sport"), F.col("event_id").cast("string").alias("id"), F.date_format("commence_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
        F.array(F.struct(order.alias("competitors"), status.alias("status"))).alias("competitions"),
    )
    rows = documents.normalise_schedule(_as_json(docs, documents.SCHEDULE_SCHEMA))
    return rows.drop("sport_slug", "home_periods", "away_periods")


@query(
    "standings_from_stats",
    """SELECT concat('T', CAST(c_custkey AS VARCHAR)) AS team, CASE c_custkey % 3 WHEN 0 THEN 'top' WHEN 1 THEN 'mid' ELSE 'deep' END AS group_name, CAST(c_custkey % 20 AS DOUBLE) AS wins, CAST(c_custkey % 7 AS DOUBLE) AS losses,
       CAST(CASE WHEN c_custkey % 4 = 0 THEN 30 ELSE c_custkey % 20 + c_custkey % 7 END AS DOUBLE) AS games_played,
       CASE WHEN (CASE WHEN c_custkey % 4 = 0 THEN 30 ELSE c_custkey % 20 + c_custkey % 7 END) > 0 THEN least(1, c_custkey % 20 / (CASE WHEN c_custkey % 4 = 0 THEN 30 ELSE c_custkey % 20 + c_custkey % 7 END)) ELSE 0 END AS win_percent, c_acctbal AS point_differential FROM customer""",
    dbl="wins losses games_played win_percent point_differential",
)
def _(t: Tables):
    c = t("customer")
    key = F.col("c_custkey")
    stat = lambda n, v: F.struct(F.lit(n).alias("name"), v.cast("double").alias("value"))
    base = F.array(stat("wins", key % 20), stat("losses", key % 7), stat("differential", F.col("c_acctbal")))
    stats = F.when(key % 4 == 0, F.concat(base, F.array(stat("gamesPlayed", F.lit(30))))).otherwise(base)
    entry = F.struct(
        F.struct(F.lit("1").alias("id"), F.concat(F.lit("T"), key.cast("string")).alias("displayName")).alias("team"), stats.alias("stats")
    )
    holder = F.struct(F.array(entry).alias("entries"))
    leaf = F.to_json(F.struct(F.lit("deep").alias("name"), holder.alias("standings")))
    mid = F.to_json(F.struct(F.lit("mid").alias("name"), holder.alias("standings")))
    top = F.to_json(F.struct(F.lit("top").alias("name"), holder.alias("standings")))
    wrap = lambda child: F.concat(F.lit('{"name":"w","children":['), child, F.lit("]}"))
    root = F.when(key % 3 == 0, top).when(key % 3 == 1, wrap(mid)).otherwise(wrap(wrap(leaf)))
    text = F.concat(F.lit('{"sport":"nfl","root":'), root, F.lit("}"))
    docs = c.select(F.from_json(text, documents.STANDINGS_SCHEMA).alias("d")).select("d.*")
    return documents.standings_from_stats(docs).select(
        "team", "group_name", "wins", "losses", "games_played", "win_percent", "point_differential"
    )


INJURY_SQL = "CASE id % 8 WHEN 0 THEN 1 WHEN 1 THEN 0.5 WHEN 2 THEN 0.3 WHEN 3 THEN 0.9 WHEN 4 THEN 0.5 WHEN 5 THEN 0 WHEN 6 THEN 1 ELSE 0.25 END"


@query(
    "injuries_from_feed",
    f"SELECT p_type AS team, concat('A', CAST(id AS VARCHAR)) AS athlete, injury AS status, {INJURY_SQL} AS severity FROM fx_ticker_rows",
    dbl="severity",
)
def _(t: Tables):
    item = F.struct(
        F.col("injury").alias("status"), F.struct(F.concat(F.lit("A"), F.col("id").cast("string")).alias("displayName")).alias("athlete"),
        F.struct(F.lit("knee").alias("type")).alias("details"),
    )
    block = F.array(F.struct(F.col("p_type").alias("displayName"), F.array(item).alias("injuries")))
    docs = t("fx_ticker_rows").select(F.lit("nfl").alias("sport"), block.alias("injuries"))
    rows = documents.injuries_from_feed(_as_json(docs, documents.INJURY_SCHEMA))
    return rows.select("team", "athlete", "status", "severity")


@query("injury_severity", f"SELECT id, {INJURY_SQL} AS severity FROM fx_ticker_rows", dbl="severity")
def _(t: Tables):
    return t("fx_ticker_rows").select("id", X.injury_severity(F.col("injury")).alias("severity"))


@query(
    "game_summary",
    """SELECT CAST(event_id AS VARCHAR) AS id, concat('T', CAST(home_team_id AS VARCHAR)) AS home_team, CAST(home_score AS VARCHAR) AS home_total, 1 AS periods, 'Bk' AS odds_provider, 'home' AS favorite, CAST(away_score AS DOUBLE) AS spread FROM fx_events""",
    dbl="spread",
    big="periods",
)
def _(t: Tables):
    return documents.game_summary(_games(t)).select(
        "id", "home_team", "home_total", "periods", "odds_provider", "favorite", "spread"
    )


def _games(t: Tables):
    e = t("fx_events")
    home = _competitor(F.lit("home"), F.concat(F.lit("T"), F.col("home_team_id").cast("string")), F.col("home_score"))
    away = _competitor(F.lit("away"), F.concat(F.lit("T"), F.col("away_team_id").cast("string")), F.col("away_score"))
    away = away.withField("team.id", F.lit("2"))
    stat = lambda n, v: F.struct(F.lit(n).alias("name"), v.cast("string").alias("displayValue"))
    none = F.lit(None).cast("array<struct<name:string,displayValue:string>>")
    no = F.lit(None).cast("string")

    def box(tid: str, score):
        nested = F.struct(no.alias("name"), no.alias("displayValue"), F.array(stat("totalShots", score), stat("saves", score * 0)).alias("stats"))
        plain = F.struct(F.lit("saves").alias("name"), F.lit("99").alias("displayValue"), none.alias("stats"))
        return F.struct(F.struct(F.lit(tid).alias("id")).alias("team"), F.array(nested, plain).alias("statistics"))

    money = lambda fav: F.struct(F.lit(-110.0).alias("moneyLine"), F.lit(fav).alias("favorite"))
    odds = F.array(
        F.struct(
            F.struct(F.lit("Bk").alias("name")).alias("provider"), F.lit("d").alias("details"), F.col("away_score").cast("double").alias("spread"),
            F.lit(8.5).alias("overUnder"), money(True).alias("homeTeamOdds"), money(False).alias("awayTeamOdds"),
        )
    )
    docs = e.select(
        F.lit("epl").alias("league"), F.col("event_id").cast("string").alias("id"), F.array(home, away).alias("competitors"),
        F.array(box("1", F.col("home_score")), box("2", F.col("away_score"))).alias("teams"), odds.alias("odds"),
    )
    return _as_json(docs, documents.GAME_SCHEMA)


@query(
    "game_stat_pairs",
    """SELECT CAST(event_id AS VARCHAR) AS id, 'totalShots' AS stat, CAST(away_score AS VARCHAR) AS away, CAST(home_score AS VARCHAR) AS home, CASE WHEN home_score + away_score > 0 THEN floor(away_score / (home_score + away_score) * 100 + 0.5) ELSE 50 END AS away_share FROM fx_events
    UNION ALL SELECT CAST(event_id AS VARCHAR), 'saves', '0', '0', 50 FROM fx_events""",
    dbl="away_share",
)
def _(t: Tables):
    return documents.game_stat_pairs(_games(t)).drop("league")


@query(
    "document_snapshot",
    """SELECT sha256(url) AS url_hash, sha256(html) AS content_hash, min(page_id) AS page_id, min(strlen(html)) AS byte_length FROM pages
    WHERE NOT regexp_matches(lower(html), 'captcha|access denied|unusual traffic|automated (access|requests)|cf-chl-') GROUP BY 1, 2""",
)
def _(t: Tables):
    return documents.document_snapshot(t("pages")).select("url_hash", "content_hash", "page_id", "byte_length")


@query(
    "keyed_upsert",
    """WITH o AS (SELECT o_custkey AS k, max(o_totalprice) AS price, 'old' AS note FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
    n AS (SELECT o_custkey AS k, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn
          FROM orders WHERE o_orderstatus = 'O') x WHERE rn = 1)
    SELECT coalesce(o.k, n.k) AS k, coalesce(n.price, o.price) AS price, o.note FROM o FULL OUTER JOIN n ON n.k = o.k""",
    dbl="price",
)
def _(t: Tables):
    orders = t("orders")
    stored = orders.filter(F.col("o_orderstatus") == "F").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("price"))
    stored = stored.withColumn("note", F.lit("old"))
    price = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice"))
    fresh = orders.filter(F.col("o_orderstatus") == "O").select(F.col("o_custkey").alias("k"), price.alias("price"), "o_orderkey")
    return tables.keyed_upsert(stored, fresh, ["k"], ["price"], order=["o_orderkey"])


@query(
    "insert_ignore",
    """SELECT o_custkey AS k, arg_max(o_totalprice, o_orderkey) AS price FROM orders WHERE o_orderstatus = 'O' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1""",
    dbl="price",
)
def _(t: Tables):
    orders = t("orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("price"), "o_orderkey", "o_orderstatus")
    stored = orders.filter(F.col("o_orderstatus") == "P")
    fresh = orders.filter(F.col("o_orderstatus") == "O").drop("o_orderstatus")
    return tables.insert_ignore(stored, fresh, ["k"], ["o_orderkey"]).select("k", "price")


@query(
    "dimension_sync",
    """SELECT p_partkey AS slug, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_type END AS title, CASE WHEN p_partkey % 2 = 0 THEN false ELSE true END AS active FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 <> 0""",
)
def _(t: Tables):
    part = t("part")
    key = F.col("p_partkey")
    stored = part.filter(key % 2 == 0).select(key.alias("slug"), F.col("p_name").alias("title"), F.lit(False).alias("active"))
    catalogue = part.filter(key % 3 != 0).select(key.alias("slug"), F.col("p_type").alias("title"), F.lit(True).alias("active"))
    return tables.dimension_sync(stored, catalogue, "slug", keep=["active"])


@query(
    "verified_copy",
    """SELECT count(*) AS source_rows, (SELECT count(*) FROM customer WHERE c_custkey % 3 = 0) AS target_rows, count(*) FILTER (WHERE c_custkey % 3 <> 0) AS appended, 0 AS missing FROM customer""",
    big="missing",
)
def _(t: Tables):
    source = t("customer")
    target = source.filter(F.col("c_custkey") % 3 == 0).select("c_custkey", "c_name", F.lit(1).alias("extra"))
    return tables.verified_copy(source, target, ["c_custkey"])[1]


@query("verified_copy_rows", "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 <> 0")
def _(t: Tables):
    source = t("customer")
    target = source.filter(F.col("c_custkey") % 3 == 0).select("c_custkey", "c_name", F.lit(1).alias("extra"))
    return tables.verified_copy(source, target, ["c_custkey"])[0].select("c_custkey", "c_name")


@query(
    "merge_named_identity",
    """WITH k AS (SELECT sport_id, search_key, min(team_id) AS id FROM fx_clubs GROUP BY 1, 2),
    r AS (SELECT CAST(substr(p_brand, 7) AS BIGINT) AS sport_id, CAST(p_partkey AS VARCHAR) AS external_id, CASE WHEN p_partkey % 4 = 0 THEN 'other club' ELSE p_name END AS name, p_partkey FROM part)
    SELECT r.sport_id, r.external_id, CASE WHEN p_partkey % 5 = 0 THEN p_partkey + 1000000 WHEN k.id IS NOT NULL THEN k.id END AS canonical_id,
       CASE WHEN p_partkey % 5 = 0 THEN 'identity' WHEN k.id IS NOT NULL THEN 'name' ELSE 'new' END AS matched_by FROM r LEFT JOIN k ON k.sport_id = r.sport_id AND k.search_key = replace(r.name, ' ', '')""",
)
def _(t: Tables):
    part = t("part")
    name = F.when(F.col("p_partkey") % 4 == 0, "other club").otherwise(F.col("p_name"))
    records = part.select(
        F.substring("p_brand", 7, 9).cast("bigint").alias("sport_id"), F.col("p_partkey").cast("string").alias("external_id"), name.alias("name"),
        X.search_key(name).alias("search_key"),
    )
    linked = part.filter(F.col("p_partkey") % 5 == 0).select(
        F.lit("tm").alias("provider"), F.col("p_partkey").cast("string").alias("external_id"), (F.col("p_partkey") + 1000000).alias("canonical_id")
    )
    known = t("fx_clubs").select("sport_id", "search_key", F.col("team_id").alias("id"))
    return tables.merge_named_identity(records, linked, known, "tm").drop("name", "search_key")


@query(
    "career_history_merge",
    """WITH old AS (SELECT DISTINCT l_partkey AS athlete_id, 'tm' AS provider, l_returnflag AS injury_type, l_linenumber AS started_on FROM lineitem WHERE l_linenumber < 4),
    new AS (SELECT l_partkey AS athlete_id, 'tm' AS provider, l_returnflag AS injury_type, l_linenumber AS started_on, max(CASE WHEN l_quantity > 25 THEN 'x' ELSE '' END) AS ended_on FROM lineitem WHERE l_linenumber > 2 GROUP BY 1, 2, 3, 4)
    SELECT coalesce(o.athlete_id, n.athlete_id) AS athlete_id, coalesce(o.injury_type, n.injury_type) AS injury_type, coalesce(o.started_on, n.started_on) AS started_on,
       CASE WHEN n.athlete_id IS NULL THEN 'active' WHEN n.ended_on <> '' THEN 'resolved' ELSE 'active' END AS status FROM old o FULL OUTER JOIN new n ON n.athlete_id = o.athlete_id AND n.injury_type = o.injury_type AND n.started_on = o.started_on""",
    big="started_on",
)
def _(t: Tables):
    rows = t("lineitem").select(
        F.col("l_partkey").alias("athlete_id"), F.lit("tm").alias("provider"), F.col("l_returnflag").alias("injury_type"), F.col("l_linenumber").alias("started_on"),
        F.when(F.col("l_quantity") > 25, "x").otherwise("").alias("ended_on"),
    )
    stored = rows.filter(F.col("started_on") < 4).drop("ended_on").distinct().withColumn("ended_on", F.lit("")).withColumn("status", F.lit("active"))
    merged = tables.career_history_merge("injuries", stored, rows.filter(F.col("started_on") > 2))
    return merged.select("athlete_id", "injury_type", "started_on", "status")


@query(
    "csv_export",
    """SELECT concat(CAST(payment_id AS VARCHAR), ',', status, ',', chr(34), 'Paid, ', chr(34), chr(34), CASE WHEN method = '' THEN '-' ELSE method END, chr(34), chr(34), chr(34), ',', currency) AS line FROM fx_payments""",
)
def _(t: Tables):
    note = F.concat(F.lit('Paid, "'), F.when(F.col("method") == "", "-").otherwise(F.col("method")), F.lit('"'))
    return tables.csv_lines(t("fx_payments").select("payment_id", "status", note.alias("note"), "currency"))


@query(
    "entity_keys",
    """SELECT sport_id, name, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS search_key, array_to_string([x FOR x IN string_split_regex(regexp_replace(lower(name), '[^a-z0-9 ]', ' ', 'g'), ' +') IF len(x) > 1], ' ') AS tokens FROM fx_club_names""",
)
def _(t: Tables):
    name = F.col("name")
    return t("fx_club_names").select("sport_id", "name", X.search_key(name).alias("search_key"), F.array_join(X.tokens(name), " ").alias("tokens"))


@query(
    "line_keys",
    """SELECT selection_id, CASE WHEN point IS NULL THEN '' WHEN point = floor(point) THEN CAST(CAST(point AS BIGINT) AS VARCHAR) ELSE CAST(point AS VARCHAR) END AS point_key FROM fx_graded_sides""",
)
def _(t: Tables):
    return t("fx_graded_sides").select("selection_id", X.line_key(F.col("point")).alias("point_key"))


@query(
    "ticker_dimension",
    """SELECT id, CASE id % 4 WHEN 0 THEN 'KXMLBTOTAL' WHEN 1 THEN 'KXMLBSPREAD' WHEN 2 THEN 'KXEPLGAME' ELSE 'SOLO' END AS series, CASE WHEN id % 4 = 3 THEN '' ELSE concat('26AUG', CAST(p_size AS VARCHAR), 'SDAZ') END AS fixture,
       CASE WHEN id % 4 IN (0, 1) THEN CAST(p_size AS DOUBLE) END AS strike, CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN 'DET' WHEN 2 THEN 'TIE' ELSE 'SOLO' END AS side FROM fx_ticker_rows""",
    dbl="strike",
)
def _(t: Tables):
    k = F.col("ticker")
    return t("fx_ticker_rows").select(
        "id", X.series_of(k).alias("series"), X.fixture_key(k).alias("fixture"), X.strike_of(k).alias("strike"), X.ladder_side(k).alias("side")
    )


@query("fixture_title", "SELECT id, CASE WHEN id % 3 < 2 THEN p_name END AS home, CASE WHEN id % 3 < 2 THEN p_type END AS away FROM fx_ticker_rows")
def _(t: Tables):
    return t("fx_ticker_rows").select("id", X.fixture_sides(F.col("title")).alias("s")).select("id", "s.home", "s.away")


@query(
    "outcome_side",
    """WITH k AS (SELECT *, contains(replace(upper(p_name), ' ', ''), upper(p_type)) AS vague FROM fx_ticker_rows)
    SELECT id, CASE WHEN id % 5 = 1 THEN 'tie' WHEN id % 5 = 0 AND NOT vague THEN 'home' WHEN id % 5 = 2 AND NOT vague THEN 'away' WHEN id % 4 = 2 THEN 'tie' END AS outcome FROM k""",
)
def _(t: Tables):
    side = X.outcome_side(F.col("ticker"), F.col("p_name"), F.col("p_type"), F.col("subtitle"))
    return t("fx_ticker_rows").select("id", side.alias("outcome"))


@query(
    "market_value",
    "SELECT id, CAST(CASE id % 6 WHEN 0 THEN 1200000000 WHEN 1 THEN p_size * 1000000 WHEN 2 THEN p_size * 1000 + 500 WHEN 4 THEN p_size * 1000 ELSE 0 END AS BIGINT) AS euros FROM fx_ticker_rows",
)
def _(t: Tables):
    return t("fx_ticker_rows").select("id", X.market_value(F.col("value_text")).alias("euros"))


@query(
    "name_similarity",
    """WITH k AS (SELECT p_partkey, name, club, [x FOR x IN string_split_regex(regexp_replace(lower(name), '[^a-z0-9 ]', ' ', 'g'), ' +') IF len(x) > 1] AS a, string_split(club, ' ') AS b FROM fx_club_names)
    SELECT p_partkey, name, club, least(1, 0.6 * len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) + CASE WHEN a[-1] = b[-1] THEN 0.4 ELSE 0 END) AS score FROM k""",
    dbl="score",
)
def _(t: Tables):
    score = X.name_similarity(F.col("name"), F.col("club"))
    return t("fx_club_names").select("p_partkey", "name", "club", score.alias("score"))


@query(
    "slugs",
    """SELECT id, regexp_replace(regexp_replace(regexp_replace(trim(lower(title)), '[^a-z0-9_ -]+', '', 'g'), ' +', '-', 'g'), '-+', '-', 'g') AS list_slug, replace(p_name, ' ', '-') AS club_slug FROM fx_ticker_rows""",
)
def _(t: Tables):
    accented = F.concat(F.lit("«"), F.translate("p_name", "eo", "éö"), F.lit("»"))
    return t("fx_ticker_rows").select("id", X.list_slug(F.col("title")).alias("list_slug"), X.club_slug(accented).alias("club_slug"))


@query(
    "title_labels",
    """SELECT id, array_to_string([upper(x[1]) || x[2:] FOR x IN string_split(p_name, ' ')], ' ') AS label FROM fx_ticker_rows""",
)
def _(t: Tables):
    snake = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    return t("fx_ticker_rows").select("id", X.title_label(snake).alias("label"))


@query(
    "feature_fingerprint",
    """SELECT id, sha256(concat_ws(':', CAST(selection_id AS VARCHAR), printf('%.2f', price), printf('%.3f', 1 / price), printf('%.1f', selection_id % 37 * 0.3),
         CAST(bookmaker_id AS VARCHAR), CAST(CAST(floor(id % 97 * 0.25 + 0.5) AS BIGINT) AS VARCHAR))) AS fingerprint FROM fx_snapshots""",
)
def _(t: Tables):
    edge, hours = F.col("selection_id") % 37 * F.lit(0.3), F.col("id") % 97 * F.lit(0.25)
    price = F.col("price")
    print_ = X.feature_fingerprint(F.col("selection_id"), price, 1 / price, edge, F.col("bookmaker_id"), hours)
    return t("fx_snapshots").select("id", print_.alias("fingerprint"))


CLUBS_SQL = """
base AS (SELECT DISTINCT sport_id, trim(name) AS name, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS key FROM fx_club_names),
ex AS (SELECT b.*, c.team_id, 'exact' AS matched_by FROM base b JOIN fx_clubs c ON c.sport_id = b.sport_id AND c.search_key = b.key),
al AS (SELECT b.*, min(c.team_id) AS team_id, 'alias' AS matched_by FROM base b JOIN fx_clubs c ON c.sport_id = b.sport_id AND c.nick = b.key AND c.team_id % 2 = 0 WHERE (b.sport_id, b.name) NOT IN (SELECT sport_id, name FROM ex) GROUP BY 1, 2, 3),
done AS (SELECT * FROM ex UNION ALL SELECT * FROM al),
rest AS (SELECT * FROM base WHERE (sport_id, name) NOT IN (SELECT sport_id, name FROM done)),
tk AS (SELECT *, [x FOR x IN string_split_regex(regexp_replace(lower(name), '[^a-z0-9 ]', ' ', 'g'), ' +') IF len(x) > 1] AS a FROM rest),
sc AS (SELECT t.sport_id, t.name, t.key, c.team_id, 0.6 * len(list_intersect(t.a, string_split(c.name, ' '))) / len(list_distinct(list_concat(t.a, string_split(c.name, ' ')))) + CASE WHEN t.a[-1] = string_split(c.name, ' ')[-1] THEN 0.4 ELSE 0 END AS score
       FROM tk t JOIN fx_clubs c ON c.sport_id = t.sport_id WHERE len(t.a) > 0),
fz AS (SELECT sport_id, name, key, team_id, 'fuzzy' AS matched_by FROM (SELECT *, row_number() OVER (PARTITION BY sport_id, name ORDER BY score DESC, team_id) AS rn FROM sc WHERE score >= 0.7 - 1e-12) s WHERE rn = 1)
"""


def _clubs(t: Tables):
    aliases = F.when(F.col("team_id") % 2 == 0, F.array("nick")).otherwise(F.array().cast("array<string>"))
    return t("fx_clubs").withColumn("aliases", aliases)


@query(
    "resolve_teams",
    f"""WITH {CLUBS_SQL} SELECT * FROM done UNION ALL SELECT * FROM fz UNION ALL SELECT sport_id, name, key, NULL, 'new' FROM rest WHERE (sport_id, name) NOT IN (SELECT sport_id, name FROM fz)""",
)
def _(t: Tables):
    return R.resolve_teams(t("fx_club_names"), _clubs(t)).select("sport_id", "name", "key", "team_id", "matched_by")


@query(
    "learn_aliases",
    f"""WITH {CLUBS_SQL}, l AS (SELECT team_id, list_distinct(list(key)) AS ks FROM fz GROUP BY 1)
    SELECT c.team_id, array_to_string(list_sort(list_distinct(list_concat(CASE WHEN c.team_id % 2 = 0 THEN [c.nick] ELSE CAST([] AS VARCHAR[]) END, coalesce(l.ks, CAST([] AS VARCHAR[]))))), ',') AS aliases FROM fx_clubs c LEFT JOIN l ON l.team_id = c.team_id""",
)
def _(t: Tables):
    clubs = _clubs(t)
    out = R.learn_aliases(clubs, R.resolve_teams(t("fx_club_names"), clubs))
    return out.select("team_id", F.array_join("aliases", ",").alias("aliases"))


@query(
    "match_existing_teams",
    f"""WITH {CLUBS_SQL}, ws AS (SELECT *, list_distinct([x FOR x IN string_split_regex(lower(name), '[^a-z0-9]+') IF x <> '']) AS w FROM rest),
    ct AS (SELECT w.sport_id, w.name, w.key, count(*) AS n, min(c.team_id) AS team_id FROM ws w JOIN fx_clubs c ON c.sport_id = w.sport_id
           AND (len(list_intersect(w.w, string_split(c.name, ' '))) = len(w.w) OR len(list_intersect(w.w, string_split(c.name, ' '))) = len(list_distinct(string_split(c.name, ' ')))) GROUP BY 1, 2, 3)
    SELECT * FROM done UNION ALL SELECT sport_id, name, key, CASE WHEN n = 1 THEN team_id END, CASE WHEN n = 1 THEN 'contained' ELSE 'ambiguous' END FROM ct
    UNION ALL SELECT * FROM fz WHERE (sport_id, name) NOT IN (SELECT sport_id, name FROM ct)
    UNION ALL SELECT sport_id, name, key, NULL, 'none' FROM rest WHERE (sport_id, name) NOT IN (SELECT sport_id, name FROM ct) AND (sport_id, name) NOT IN (SELECT sport_id, name FROM fz)""",
)
def _(t: Tables):
    return R.match_existing_teams(t("fx_club_names"), _clubs(t))


@query(
    "resolve_events",
    """WITH RECURSIVE inc AS (
      SELECT r.position, r.provider, r.external_id, concat(r.provider, ':', r.external_id) AS name, epoch_us(r.commence_at) AS t, r.home_team_id IS NOT NULL AS paired, coalesce(e.sport_id, r.sport_id) AS sport_id,
             coalesce(e.home_team_id, r.home_team_id) AS home, coalesce(e.away_team_id, r.away_team_id) AS away
      FROM fx_feed_records r LEFT JOIN fx_known_links l ON l.provider = r.provider AND l.external_id = r.external_id LEFT JOIN fx_known_events e ON e.event_id = l.event_id),
    seq AS (SELECT *, row_number() OVER (PARTITION BY sport_id, home, away ORDER BY position) AS n FROM inc WHERE home IS NOT NULL),
    lk AS (SELECT event_id, list(concat(provider, ':', external_id)) AS links, list(provider) AS claims FROM fx_known_links GROUP BY 1),
    st AS (SELECT e.sport_id, e.home_team_id AS home, e.away_team_id AS away,
                  list({'id': e.event_id, 'name': CAST(NULL AS VARCHAR), 't': epoch_us(e.commence_at), 'links': coalesce(lk.links, CAST([] AS VARCHAR[])), 'claims': coalesce(lk.claims, CAST([] AS VARCHAR[]))} ORDER BY e.event_id) AS evs
           FROM fx_known_events e LEFT JOIN lk ON lk.event_id = e.event_id GROUP BY 1, 2, 3),
    walk AS (
      SELECT k.sport_id, k.home, k.away, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS position, CAST(NULL AS VARCHAR) AS provider, CAST(NULL AS VARCHAR) AS external_id,
             coalesce(st.evs, CAST([] AS STRUCT(id BIGINT, name VARCHAR, t BIGINT, links VARCHAR[], claims VARCHAR[])[])) AS evs, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS new_event, CAST(NULL AS VARCHAR) AS matched_by
      FROM (SELECT DISTINCT sport_id, home, away FROM seq) k LEFT JOIN st ON st.sport_id = k.sport_id AND st.home = k.home AND st.away = k.away
      UNION ALL
      SELECT sport_id, home, away, n, position, provider, external_id,
             CASE WHEN hit IS NULL THEN list_append(evs, {'id': CAST(NULL AS BIGINT), 'name': name, 't': t, 'links': [name], 'claims': [provider]})
                  ELSE list_concat(list_concat(evs[1:hit - 1], [{'id': evs[hit].id, 'name': evs[hit].name, 't': t, 'links': list_append(evs[hit].links, name), 'claims': list_append(evs[hit].claims, provider)}]), evs[hit + 1:]) END,
             evs[hit].id, CASE WHEN hit IS NULL THEN name ELSE evs[hit].name END, CASE WHEN own IS NOT NULL THEN 'external_id' WHEN hit IS NULL THEN 'new' ELSE 'team_pair' END
      FROM (SELECT *, coalesce(own, near) AS hit FROM (
        SELECT i.*, w.evs, [k FOR k IN range(1, len(w.evs) + 1) IF list_contains(w.evs[k].links, i.name)][1] AS own,
               list_sort([{'gap': abs(w.evs[k].t - i.t), 'at': w.evs[k].t, 'k': k} FOR k IN range(1, len(w.evs) + 1) IF i.paired AND abs(w.evs[k].t - i.t) <= 21600000000 AND NOT list_contains(w.evs[k].claims, i.provider)])[1].k AS near
        FROM walk w JOIN seq i ON i.sport_id = w.sport_id AND i.home = w.home AND i.away = w.away AND i.n = w.n + 1) c) d)
    SELECT provider, external_id, position, event_id, new_event, matched_by, CASE matched_by WHEN 'team_pair' THEN 0.9 ELSE 1.0 END AS confidence FROM walk WHERE n > 0
    UNION ALL SELECT provider, external_id, position, NULL, name, CASE row_number() OVER (PARTITION BY name ORDER BY position) WHEN 1 THEN 'new' ELSE 'external_id' END, 1.0 FROM inc WHERE home IS NULL""",
    dbl="confidence",
)
def _(t: Tables):
    return R.resolve_events(t("fx_feed_records"), t("fx_known_events"), t("fx_known_links"))


def _book_records(t: Tables):
    """Records of the same fixtures from several books, kickoffs differing by a few hours."""
    e = t("fx_events")
    shift = F.explode(F.array(F.lit(0), F.lit(2), F.lit(5), F.lit(9)))
    rows = e.select("*", shift.alias("h"))
    return rows.select(
        "sport_slug",
        F.concat(F.lit("Team "), F.when(F.col("h") == 2, F.col("away_team_id")).otherwise(F.col("home_team_id")).cast("string")).alias("home_team"),
        F.concat(F.lit("team-"), F.when(F.col("h") == 2, F.col("home_team_id")).otherwise(F.col("away_team_id")).cast("string")).alias("away_team"),
        F.timestamp_micros(F.unix_micros("commence_at") + F.col("h") * 3_600_000_000).alias("commence_at"),
        (F.unix_micros("commence_at") / 1000000 + F.col("h")).cast("bigint").alias("position"),
        F.concat(F.lit("b"), F.col("h").cast("string")).alias("book_key"),
    )


@query(
    "cluster_feed_events",
    """WITH r AS (SELECT sport_slug, concat('team', CAST(least(CAST(home_team_id AS VARCHAR), CAST(away_team_id AS VARCHAR)) AS VARCHAR), '-team', greatest(CAST(home_team_id AS VARCHAR), CAST(away_team_id AS VARCHAR))) AS pair, commence_at, h FROM fx_events, (VALUES (0), (2), (5), (9)) v(h))
    SELECT concat(sport_slug, ':', pair, ':', strftime(commence_at, '%Y-%m-%d')) AS merged_id, sport_slug, CASE WHEN h < 9 THEN 'b0,b2,b5' ELSE 'b9' END AS books, count(*) AS records FROM r GROUP BY 1, 2, 3""",
)
def _(t: Tables):
    out = R.merge_clusters(R.cluster_feed_events(_book_records(t)))
    return out.select("merged_id", "sport_slug", F.array_join("books", ",").alias("books"), "records")


@query(
    "resolve_markets",
    """WITH i AS (SELECT DISTINCT l_orderkey AS event_id, CASE l_linenumber % 2 WHEN 0 THEN 'totals' ELSE 'spreads' END AS market_type, CAST(CAST(l_quantity AS BIGINT) % 5 AS VARCHAR) AS line_key FROM lineitem)
    SELECT event_id, market_type, line_key, 'full_game' AS period, CASE WHEN event_id % 3 = 0 AND market_type = 'totals' THEN event_id * 10 + CAST(line_key AS BIGINT) END AS market_id FROM i""",
)
def _(t: Tables):
    rows = t("lineitem").select(
        F.col("l_orderkey").alias("event_id"), F.when(F.col("l_linenumber") % 2 == 0, "totals").otherwise("spreads").alias("market_type"),
        (F.col("l_quantity").cast("bigint") % 5).cast("double").alias("line"), F.lit(None).cast("string").alias("period"), F.lit(None).cast("string").alias("player_name"),
    )
    stored = (
        rows.filter((F.col("event_id") % 3 == 0) & (F.col("market_type") == "totals"))
        .select("event_id", "market_type", X.line_key(F.col("line")).alias("line_key"), F.lit("full_game").alias("period"), F.lit("").alias("player_name"))
        .distinct()
        .withColumn("market_id", F.col("event_id") * 10 + F.col("line_key").cast("bigint"))
    )
    return R.resolve_markets(rows, stored).drop("player_name")


@query(
    "resolve_selections",
    """WITH i AS (SELECT l_orderkey AS market_id, CASE l_returnflag WHEN 'A' THEN 'home' ELSE 'away' END AS side, arg_max(concat('L', CAST(l_linenumber AS VARCHAR)), l_linenumber) AS label, max(l_suppkey % 9) AS new_team FROM lineitem GROUP BY 1, 2)
    SELECT market_id, side, '' AS point_key, CASE WHEN market_id % 2 = 0 THEN market_id * 2 END AS selection_id, label, CASE WHEN market_id % 4 = 0 THEN 77 ELSE new_team END AS team_id FROM i""",
    big="team_id",
)
def _(t: Tables):
    rows = t("lineitem").select(
        F.col("l_orderkey").alias("market_id"), F.when(F.col("l_returnflag") == "A", "home").otherwise("away").alias("side"), F.lit(None).cast("double").alias("point"),
        F.concat(F.lit("L"), F.col("l_linenumber").cast("string")).alias("label"), F.col("l_linenumber").alias("position"), (F.col("l_suppkey") % 9).alias("team_id"),
    )
    keys = rows.filter(F.col("market_id") % 2 == 0).select("market_id", "side", F.lit("").alias("point_key")).distinct()
    stored = keys.select(
        "*", (F.col("market_id") * 2).alias("selection_id"), F.when(F.col("market_id") % 4 == 0, F.lit(77)).cast("bigint").alias("team_id")
    )
    return R.resolve_selections(rows, stored)


@query(
    "resolve_fixtures",
    """WITH ev AS (SELECT home_team_id, away_team_id, arg_max(event_id, commence_at) AS e0, max(commence_at) AS at FROM fx_events GROUP BY 1, 2),
    last AS (SELECT v.home_team_id, v.away_team_id, max(v.event_id) AS event_id, ev.at AS commence_at FROM fx_events v JOIN ev ON ev.home_team_id = v.home_team_id AND ev.away_team_id = v.away_team_id AND ev.at = v.commence_at GROUP BY 1, 2, 4)
    SELECT concat('KXEPLGAME-', CAST(o_orderkey AS VARCHAR), '-X') AS ticker, 'Premier League' AS competition, o_custkey % 25 AS home_team_id, (o_custkey * 7 + o_orderkey) % 25 AS away_team_id, l.event_id, l.commence_at, true AS matched
    FROM orders LEFT JOIN last l ON l.home_team_id = o_custkey % 25 AND l.away_team_id = (o_custkey * 7 + o_orderkey) % 25""",
)
def _(t: Tables):
    title = F.concat(
        F.lit("Town"), (F.col("o_custkey") % 25).cast("string"), F.lit(" City vs Town"),
        ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % 25).cast("string"), F.lit(" City Winner?"),
    )
    tickers = t("orders").select(F.concat(F.lit("KXEPLGAME-"), F.col("o_orderkey").cast("string"), F.lit("-X")).alias("ticker"), title.alias("title"))
    nation = t("nation").select(F.col("n_nationkey").cast("bigint").alias("n"))
    name = F.concat(F.lit("Town"), F.col("n").cast("string"), F.lit(" City"))
    teams = nation.select(
        F.when(F.col("n") % 2 == 0, 1).otherwise(2).cast("bigint").alias("sport_id"), F.col("n").alias("team_id"), name.alias("name"),
        X.search_key(name).alias("search_key"), F.array().cast("array<string>").alias("aliases"),
    )
    region = F.col("r_regionkey")
    sports = t("region").select(
        (region + 1).cast("bigint").alias("sport_id"), F.when(region == 0, "epl").otherwise(F.concat(F.lit("cup"), region.cast("string"))).alias("sport_slug"),
        F.when(region < 3, "Soccer").otherwise("Other").alias("grouping"), F.lit(True).alias("active"), region.alias("position"),
    )
    rows = R.resolve_fixtures(tickers, sports, teams, t("fx_events"))
    return rows.select("ticker", "competition", "home_team_id", "away_team_id", "event_id", "commence_at", "matched")
