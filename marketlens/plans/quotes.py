"""Queries over quotes, fair prices and the board."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marketlens.fixtures import Tables
from marketlens.functions import prices as P
from marketlens.functions.times import to_instant
from marketlens.operators import board, fair, movement
from marketlens.registry import query
from marketlens.session import shared_path
from marketlens.sources import daytables

QUOTES_AS_OF = "SELECT max(l_shipdate) AS t FROM lineitem"


def quotes_as_of(t: Tables):
    return t.scalar(QUOTES_AS_OF)


def _fair(t: Tables, selections=None):
    return fair.fair_prices(t("fx_odds"), t("fx_selections") if selections is None else selections, t("fx_books"))


def _best(t: Tables):
    return fair.selection_best(t("fx_odds"))


BEST_SQL = """
best AS (
  SELECT selection_id, max(price) AS best_price, avg(price) AS average_price, count(*) AS quote_count,
         100 / max(price) AS implied_pct, (max(price) / avg(price) - 1) * 100 AS edge_vs_average_pct
  FROM fx_odds GROUP BY 1),
best_book AS (
  SELECT b.*, x.bookmaker_id AS best_bookmaker_id FROM best b JOIN (
    SELECT o.selection_id, min(o.bookmaker_id) AS bookmaker_id FROM fx_odds o
    JOIN best b ON b.selection_id = o.selection_id AND b.best_price = o.price GROUP BY 1) x ON x.selection_id = b.selection_id)
"""

HOLD_SQL = """
holds AS (
  SELECT s.market_id, count(*) AS selection_count,
         coalesce(sum(CASE WHEN b.best_price > 1 THEN 1 / b.best_price ELSE 0 END), 0) AS best_book_sum
  FROM fx_selections s LEFT JOIN best b ON b.selection_id = s.selection_id GROUP BY 1 HAVING count(*) >= 2)
"""


@query(
    "price_formats",
    """SELECT selection_id, bookmaker_id, price, 1 / price AS implied_prob, price AS back_to_price,
       CAST(CASE WHEN price >= 2 THEN floor((price - 1) * 100 + 0.5) ELSE floor(-100 / (price - 1) + 0.5) END AS BIGINT) AS american,
       CASE WHEN price >= 2 THEN concat('+', CAST(CAST(floor((price - 1) * 100 + 0.5) AS BIGINT) AS VARCHAR))
            ELSE CAST(CAST(floor(-100 / (price - 1) + 0.5) AS BIGINT) AS VARCHAR) END AS american_text
    FROM fx_odds""",
    dbl="price implied_prob back_to_price",
)
def _(t: Tables):
    price = F.col("price")
    return t("fx_odds").select(
        "selection_id",
        "bookmaker_id",
        "price",
        P.implied_prob(price).alias("implied_prob"),
        P.decimal_from_prob(P.implied_prob(price)).alias("back_to_price"),
        P.american_number(price).alias("american"),
        P.american_text(price).alias("american_text"),
    )


@query(
    "american_to_decimal",
    """WITH a AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
         CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END * CAST(l_quantity AS BIGINT) * 4 AS american FROM lineitem)
    SELECT american, CASE WHEN american >= 100 THEN 1 + american / 100.0 WHEN american <= -100 THEN 1 + 100.0 / abs(american) ELSE 0 END AS strict_price,
           CASE WHEN american > 0 THEN 1 + american / 100.0 WHEN american < 0 THEN 1 + 100.0 / abs(american) ELSE 0 END AS lenient_price,
           count(*) AS n FROM a GROUP BY 1, 2, 3""",
    dbl="strict_price lenient_price",
)
def _(t: Tables):
    sign = F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(-1)
    rows = t("lineitem").select((sign * F.col("l_quantity").cast("bigint") * 4).alias("american"))
    counted = rows.groupBy("american").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        "american",
        P.american_to_decimal(F.col("american")).alias("strict_price"),
        P.american_to_decimal(F.col("american"), strict=False).alias("lenient_price"),
        "n",
    )


@query(
    "fractional_price",
    """WITH prices AS (SELECT price, count(*) AS n FROM fx_odds GROUP BY 1),
    grid AS (SELECT price, n, q, floor((price - 1) * q + 0.5) AS p, abs(price - 1 - floor((price - 1) * q + 0.5) / q) AS err
             FROM prices, range(1, 21) r(q)),
    best AS (SELECT price, n, min(err) AS e FROM grid GROUP BY 1, 2),
    pick AS (SELECT g.price, g.n, min(g.q) AS q FROM grid g JOIN best b ON b.price = g.price AND g.err <= b.e + 1e-9 GROUP BY 1, 2)
    SELECT k.price, k.n, concat(CAST(CAST(g.p AS BIGINT) // gcd(CAST(g.p AS BIGINT), g.q) AS VARCHAR), '/', CAST(g.q // gcd(CAST(g.p AS BIGINT), g.q) AS VARCHAR)) AS fractional
    FROM pick k JOIN grid g ON g.price = k.price AND g.q = k.q""",
    dbl="price",
)
def _(t: Tables):
    priced = t("fx_odds").groupBy("price").agg(F.count(F.lit(1)).alias("n"))
    return priced.select("price", "n", P.fractional_price(F.col("price")).alias("fractional"))


@query(
    "ev_kelly",
    """SELECT selection_id, best_price, prob_consensus, (best_price * prob_consensus - 1) * 100 AS ev_pct,
       greatest(0, least(1, ((best_price - 1) * prob_consensus - (1 - prob_consensus)) / (best_price - 1) * 0.25)) AS quarter_kelly,
       greatest(0, least(1, ((best_price - 1) * prob_consensus - (1 - prob_consensus)) / (best_price - 1))) AS full_kelly
    FROM ref_fair""",
    dbl="best_price prob_consensus ev_pct quarter_kelly full_kelly",
)
def _(t: Tables):
    price, prob = F.col("best_price"), F.col("prob_consensus")
    return _fair(t).select(
        "selection_id",
        "best_price",
        "prob_consensus",
        P.expected_value_pct(price, prob).alias("ev_pct"),
        P.kelly_stake(price, prob).alias("quarter_kelly"),
        P.kelly_stake(price, prob, 1.0).alias("full_kelly"),
    )


@query(
    "to_instant",
    """SELECT event_id, make_timestamp(epoch_us(ts) // 1000000 * 1000000) AS from_seconds,
       make_timestamp(epoch_us(ts) // 1000 * 1000) AS from_millis, date_trunc('day', ts) AS from_text FROM events""",
)
def _(t: Tables):
    millis = F.floor(F.unix_micros("ts") / 1000)
    return t("events").select(
        "event_id",
        to_instant(F.floor(millis / 1000).cast("string")).alias("from_seconds"),
        to_instant(millis.cast("string")).alias("from_millis"),
        to_instant(F.date_format("ts", "yyyy-MM-dd")).alias("from_text"),
    )


@query(
    "devig",
    "SELECT market_id, bookmaker_id, selection_id, overround, mult AS multiplicative, power, shin, method_spread FROM ref_devig",
    dbl="overround multiplicative power shin method_spread",
)
def _(t: Tables):
    return fair.devig(fair.open_quotes(t("fx_odds"), t("fx_selections"))).drop("price")


@query(
    "fair_prices",
    "SELECT * FROM ref_fair",
    dbl="prob_consensus prob_sharp prob_multiplicative prob_power prob_shin method_spread fair_price best_price "
    "edge_pct kelly_fraction overround_pct",
)
def _(t: Tables):
    return _fair(t)


@query(
    "edges",
    f"""SELECT f.selection_id, f.market_id, s.event_id, e.sport_slug, s.market_type, s.side, f.edge_pct, f.prob_consensus,
       f.best_price, f.best_bookmaker_id, f.kelly_fraction, f.book_count
    FROM ref_fair f JOIN fx_selections s ON s.selection_id = f.selection_id JOIN fx_events e ON e.event_id = s.event_id
    WHERE f.edge_pct >= 1 AND f.book_count >= 3 AND e.status = 'scheduled' AND e.commence_at > (SELECT min(l_shipdate) FROM lineitem)""",
    dbl="edge_pct prob_consensus best_price kelly_fraction",
)
def _(t: Tables):
    start = t.scalar("SELECT min(l_shipdate) AS t FROM lineitem")
    sides = fair.upcoming(t("fx_selections"), t("fx_events"), start)
    rows = fair.edges(_fair(t, sides), sides, t("fx_events"), start, min_edge=1.0, min_books=3)
    return rows.select(
        "selection_id", "market_id", "event_id", "sport_slug", "market_type", "side", "edge_pct", "prob_consensus",
        "best_price", "best_bookmaker_id", "kelly_fraction", "book_count",
    )


@query(
    "insight_candidates",
    """SELECT selection_id, round(edge_pct, 6) AS edge_pct, book_count,
       (epoch_us(commence_at) - epoch_us((SELECT min(l_shipdate) FROM lineitem))) / 3.6e9 AS hours_to_start
    FROM (SELECT f.*, e.commence_at FROM ref_fair f JOIN fx_selections s ON s.selection_id = f.selection_id
      JOIN fx_events e ON e.event_id = s.event_id WHERE f.edge_pct > 1 AND f.book_count >= 3 AND e.status = 'scheduled'
        AND e.commence_at > (SELECT min(l_shipdate) FROM lineitem) ORDER BY f.edge_pct DESC, f.selection_id LIMIT 25) t""",
    dbl="edge_pct hours_to_start",
)
def _(t: Tables):
    start = t.scalar("SELECT min(l_shipdate) AS t FROM lineitem")
    sides = fair.upcoming(t("fx_selections"), t("fx_events"), start)
    rows = fair.insight_candidates(_fair(t, sides), sides, t("fx_events"), start)
    return rows.select("selection_id", "edge_pct", "book_count", "hours_to_start")


@query(
    "selection_best",
    f"WITH {BEST_SQL} SELECT * FROM best_book",
    dbl="best_price average_price implied_pct edge_vs_average_pct",
)
def _(t: Tables):
    return _best(t)


@query(
    "market_hold",
    f"""WITH {BEST_SQL}, {HOLD_SQL} SELECT *, (best_book_sum - 1) * 100 AS hold_pct,
       best_book_sum > 0 AND best_book_sum < 1 AS is_arbitrage,
       CASE WHEN best_book_sum > 0 AND best_book_sum < 1 THEN (1 - best_book_sum) * 100 ELSE 0 END AS arbitrage_pct FROM holds""",
    dbl="best_book_sum hold_pct arbitrage_pct",
)
def _(t: Tables):
    return fair.market_hold(_best(t), t("fx_selections"))


@query(
    "arbitrage",
    f"""WITH {BEST_SQL}, {HOLD_SQL} SELECT s.market_id, (1 - h.best_book_sum) * 100 AS arbitrage_pct, s.selection_id, s.side,
       b.best_price, b.best_bookmaker_id, coalesce(100 / b.best_price / h.best_book_sum, 0) AS stake_pct
    FROM holds h JOIN fx_selections s ON s.market_id = h.market_id LEFT JOIN best_book b ON b.selection_id = s.selection_id
    WHERE h.best_book_sum > 0 AND h.best_book_sum < 1 AND (1 - h.best_book_sum) * 100 >= 5""",
    dbl="arbitrage_pct best_price stake_pct",
)
def _(t: Tables):
    best, sides = _best(t), t("fx_selections")
    return fair.arbitrage_legs(fair.market_hold(best, sides), best, sides, min_profit=5.0)


@query(
    "event_freshness",
    f"""SELECT event_id, max(updated_at) AS newest_at, list_aggregate(list_sort(list_distinct(list(bookmaker_id))), 'string_agg', ',') AS books,
       CAST(floor((epoch_us(({QUOTES_AS_OF})) - epoch_us(max(updated_at))) / 6e7 + 0.5) AS BIGINT) AS minutes_ago
    FROM fx_quotes GROUP BY 1""",
)
def _(t: Tables):
    rows = board.event_freshness(t("fx_quotes"), quotes_as_of(t))
    return rows.select(
        "event_id", "newest_at", F.array_join(F.col("bookmaker_ids").cast("array<string>"), ",").alias("books"), "minutes_ago"
    )


@query(
    "board_summary",
    f"""WITH {BEST_SQL}, {HOLD_SQL},
    shown AS (SELECT s.* FROM fx_selections s JOIN fx_events e ON e.event_id = s.event_id WHERE e.status IN ('scheduled', 'live'))
    SELECT count(*) AS selection_count, avg(coalesce(b.edge_vs_average_pct, 0)) AS avg_edge_pct, avg(f.edge_pct) AS avg_true_edge_pct,
       (SELECT count(*) FROM fx_events WHERE status IN ('scheduled', 'live')) AS event_count,
       (SELECT count(DISTINCT sport_slug) FROM fx_events WHERE status IN ('scheduled', 'live')) AS category_count,
       (SELECT count(*) FROM fx_books) AS bookmaker_count, (SELECT count(*) FROM fx_books WHERE kind <> 'prediction') AS sportsbook_count,
       (SELECT count(*) FROM fx_books WHERE kind = 'prediction') AS prediction_count, count(DISTINCT s.market_id) AS market_count,
       (SELECT count(*) FROM holds WHERE best_book_sum > 0 AND best_book_sum < 1 AND market_id IN (SELECT market_id FROM shown)) AS arbitrage_count
    FROM shown s LEFT JOIN best b ON b.selection_id = s.selection_id LEFT JOIN ref_fair f ON f.selection_id = s.selection_id""",
    dbl="avg_edge_pct avg_true_edge_pct",
)
def _(t: Tables):
    best, sides = _best(t), t("fx_selections")
    holds = fair.market_hold(best, sides)
    return board.board_summary(board.filter_events(t("fx_events")), sides, t("fx_books"), best, holds, _fair(t))


@query(
    "odds_board",
    f"""WITH {BEST_SQL}, page AS (SELECT event_id, commence_at, status FROM fx_events WHERE status IN ('scheduled', 'live') ORDER BY commence_at, event_id LIMIT 200),
    m AS (SELECT s.event_id, s.market_id, count(*) AS sides, sum(CASE WHEN b.best_price > 1 THEN 1 / b.best_price END) AS book_sum
          FROM fx_selections s JOIN page p ON p.event_id = s.event_id LEFT JOIN best b ON b.selection_id = s.selection_id GROUP BY 1, 2),
    q AS (SELECT s.event_id, count(*) AS quotes FROM fx_odds o JOIN fx_selections s ON s.selection_id = o.selection_id GROUP BY 1)
    SELECT p.event_id, p.commence_at, p.status, count(m.market_id) AS markets, coalesce(sum(m.sides), 0) AS selections,
           coalesce(max(q.quotes), 0) AS quotes, coalesce(sum(m.book_sum), 0) AS book_sum
    FROM page p LEFT JOIN m ON m.event_id = p.event_id LEFT JOIN q ON q.event_id = p.event_id GROUP BY 1, 2, 3""",
    dbl="book_sum",
    big="selections quotes",
)
def _(t: Tables):
    page = _board_page(t)
    flat = F.flatten(F.transform("markets", lambda m: m["selections"]))

    def total(items, value):
        return F.aggregate(items, F.lit(0).cast("bigint"), lambda acc, x: acc + value(x))

    return page.select(
        "event_id",
        "commence_at",
        "status",
        F.size("markets").alias("markets"),
        F.size(flat).alias("selections"),
        total(flat, lambda s: F.size(F.coalesce(s["quotes"], F.array())).cast("bigint")).alias("quotes"),
        F.aggregate(
            "markets", F.lit(0.0), lambda acc, m: acc + F.coalesce(m["best_book_sum"], F.lit(0.0))
        ).alias("book_sum"),
    )


def _board_page(t: Tables):
    # The page is taken first, and every other input only for it.
    shown = board.page_of_events(board.filter_events(t("fx_events")), limit=200)
    sides = t("fx_selections").join(shown.select("event_id"), "event_id", "left_semi")
    ids = sides.select("selection_id")
    odds = t("fx_odds").join(ids, "selection_id", "left_semi")
    history = board.history_arrays(board.price_history(t("fx_snapshots").join(ids, "selection_id", "left_semi"), board.HISTORY_POINTS))
    prices = fair.fair_prices(odds, sides, t("fx_books"))
    return board.odds_board(shown, sides, odds, fair.selection_best(odds), prices, history)


CELLS_SQL = f"""
  past AS (SELECT selection_id, count(*) AS points, sum(price * (31 - back)) AS mark FROM (
    SELECT *, row_number() OVER (PARTITION BY selection_id ORDER BY captured_at DESC, id DESC) AS back FROM fx_snapshots) h WHERE back <= 30 GROUP BY 1),
  page AS (SELECT event_id FROM fx_events WHERE status IN ('scheduled', 'live') ORDER BY commence_at, event_id LIMIT 200),
  sums AS (SELECT s.market_id, CASE WHEN count(*) >= 2 THEN coalesce(sum(CASE WHEN b.best_price > 1 THEN 1 / b.best_price END), 0) END AS best_book_sum FROM fx_selections s LEFT JOIN best b ON b.selection_id = s.selection_id GROUP BY 1)
"""


@query(
    "odds_board_cells",
    f"""WITH {BEST_SQL}, {CELLS_SQL}
    SELECT s.event_id, s.market_id, s.market_type, m.best_book_sum, s.selection_id, s.label, s.side, b.best_price, b.best_bookmaker_id, b.average_price, b.edge_vs_average_pct, f.prob_consensus, f.prob_sharp, f.edge_pct, f.kelly_fraction,
       p.points, p.mark, o.bookmaker_id, o.price, o.bookmaker_id = b.best_bookmaker_id AS is_best,
       CASE WHEN o.price >= 2 THEN concat('+', CAST(CAST(floor((o.price - 1) * 100 + 0.5) AS BIGINT) AS VARCHAR)) ELSE CAST(CAST(floor(-100 / (o.price - 1) + 0.5) AS BIGINT) AS VARCHAR) END AS american
    FROM page g JOIN fx_selections s ON s.event_id = g.event_id JOIN sums m ON m.market_id = s.market_id LEFT JOIN best_book b ON b.selection_id = s.selection_id LEFT JOIN ref_fair f ON f.selection_id = s.selection_id
      LEFT JOIN past p ON p.selection_id = s.selection_id LEFT JOIN fx_odds o ON o.selection_id = s.selection_id""",
    dbl="best_book_sum best_price average_price edge_vs_average_pct prob_consensus prob_sharp edge_pct kelly_fraction mark price",
    big="points",
)
def _(t: Tables):
    """Everything that is nested in the board, one row per quote."""
    page = _board_page(t)
    markets = page.select("event_id", F.explode("markets").alias("m"))
    sides = markets.select("event_id", "m.market_id", "m.market_type", "m.best_book_sum", F.explode("m.selections").alias("s"))
    history = F.coalesce("s.prices", F.array().cast("array<double>"))
    short = F.lit(board.HISTORY_POINTS) - F.size(history)
    marks = F.zip_with(history, F.sequence(F.lit(1), F.size(history)), lambda price, k: price * (k + short))
    cells = sides.select(
        "*", F.when(F.size(history) > 0, F.size(history)).alias("points"),
        F.when(F.size(history) > 0, F.aggregate(marks, F.lit(0.0), lambda total, x: total + x)).alias("mark"), F.explode_outer("s.quotes").alias("q"),
    )
    chosen = ["selection_id", "label", "side", "best_price", "best_bookmaker_id", "average_price", "edge_vs_average_pct", "prob_consensus", "prob_sharp", "edge_pct", "kelly_fraction"]
    return cells.select("event_id", "market_id", "market_type", "best_book_sum", *[f"s.{c}" for c in chosen], "points", "mark", "q.bookmaker_id", "q.price", "q.is_best", "q.american")


@query(
    "board_as_of_snapshot",
    """WITH cut AS (SELECT timestamp '1997-06-11 00:00:00' AS at),
    seen AS (SELECT s.*, row_number() OVER (PARTITION BY selection_id, bookmaker_id ORDER BY captured_at DESC, id DESC) AS rn FROM fx_snapshots s, cut WHERE captured_at <= cut.at)
    SELECT e.event_id, e.sport_slug, s.market_id, s.selection_id, b.slug AS bookmaker, x.price, 1 / x.price AS implied_prob, x.captured_at
    FROM seen x JOIN fx_selections s ON s.selection_id = x.selection_id JOIN fx_events e ON e.event_id = s.event_id
      JOIN fx_books b ON b.bookmaker_id = x.bookmaker_id WHERE x.rn = 1""",
    dbl="price implied_prob",
)
def _(t: Tables):
    """The board from a history with snapshots: one snapshot and the log's months since are read."""
    at = F.lit("1997-06-11 00:00:00").cast("timestamp")
    history = daytables.History(t.spark, shared_path(t.spark, f"history-{uuid.uuid4().hex}"), movement.KEYS, ["captured_at", "id"], "month")
    history.append(t("fx_snapshots"))
    history.snapshot_every(12)
    rows = board.board_as_of(history.as_of(at), t("fx_selections"), t("fx_events"), t("fx_books"), at)
    return rows.select("event_id", "sport_slug", "market_id", "selection_id", "bookmaker", "price", "implied_prob", "captured_at")


@query(
    "board_as_of",
    """WITH cut AS (SELECT timestamp '1998-01-01 00:00:00' AS at),
    seen AS (SELECT s.*, row_number() OVER (PARTITION BY selection_id, bookmaker_id ORDER BY captured_at DESC, id DESC) AS rn
             FROM fx_snapshots s, cut WHERE captured_at <= cut.at)
    SELECT e.event_id, e.sport_slug, s.market_id, s.selection_id, b.slug AS bookmaker, x.price, 1 / x.price AS implied_prob, x.captured_at
    FROM seen x JOIN fx_selections s ON s.selection_id = x.selection_id JOIN fx_events e ON e.event_id = s.event_id
      JOIN fx_books b ON b.bookmaker_id = x.bookmaker_id WHERE x.rn = 1""",
    dbl="price implied_prob",
)
def _(t: Tables):
    at = F.lit("1998-01-01 00:00:00").cast("timestamp")
    rows = board.board_as_of(t("fx_snapshots"), t("fx_selections"), t("fx_events"), t("fx_books"), at)
    return rows.select(
        "event_id", "sport_slug", "market_id", "selection_id", "bookmaker", "price", "implied_prob", "captured_at"
    )


COVERAGE_SQL = """
cover AS (SELECT bookmaker_id, event_id, market_type, count(DISTINCT market_id) AS line_count, max(updated_at) AS last_seen_at
          FROM fx_quotes GROUP BY 1, 2, 3)
"""


@query("book_coverage", f"WITH {COVERAGE_SQL} SELECT * FROM cover")
def _(t: Tables):
    return board.book_coverage(t("fx_quotes"), F.col("updated_at"))


@query(
    "event_coverage",
    f"""WITH {COVERAGE_SQL} SELECT c.event_id, b.slug AS bookmaker, count(*) AS market_types, sum(c.line_count) AS lines, max(c.last_seen_at) AS last_seen_at
    FROM cover c JOIN fx_books b ON b.bookmaker_id = c.bookmaker_id GROUP BY 1, 2""",
    big="lines",
)
def _(t: Tables):
    rows = board.event_coverage(board.book_coverage(t("fx_quotes"), F.col("updated_at")), t("fx_books"))
    return rows.select(
        "event_id",
        "bookmaker",
        F.size("offers").alias("market_types"),
        F.aggregate("offers", F.lit(0).cast("bigint"), lambda acc, o: acc + o["line_count"]).alias("lines"),
        F.array_max(F.transform("offers", lambda o: o["last_seen_at"])).alias("last_seen_at"),
    )


@query(
    "pending_predictions",
    """SELECT count(DISTINCT e.event_id) AS pending_predictions, min(e.commence_at) AS next_settlement_at FROM fx_events e
    WHERE e.status <> 'final' AND e.event_id IN (SELECT s.event_id FROM fx_selections s JOIN ref_fair f ON f.selection_id = s.selection_id)""",
)
def _(t: Tables):
    results = t("fx_events").select("event_id", (F.col("status") == "final").alias("completed"))
    priced = fair.priced_selections(t("fx_odds"), t("fx_selections"), t("fx_books"))
    return board.pending_predictions(priced, t("fx_selections"), t("fx_events"), results)


@query(
    "book_index",
    """WITH k AS (SELECT bookmaker_id, regexp_replace(lower(key), '[^a-z0-9]', '', 'g') AS key FROM (
        SELECT bookmaker_id, provider_key AS key FROM fx_named_books UNION ALL SELECT bookmaker_id, slug FROM fx_named_books
        UNION ALL SELECT bookmaker_id, name FROM fx_named_books) u)
    SELECT key, min(bookmaker_id) AS bookmaker_id FROM k WHERE key <> '' GROUP BY 1""",
)
def _(t: Tables):
    return board.book_index(t("fx_named_books"))


@query(
    "book_quotes",
    f"""WITH {BEST_SQL} SELECT s.event_id, s.market_id, s.selection_id, s.label AS outcome, o.price,
       CASE WHEN o.price >= 2 THEN concat('+', CAST(CAST(floor((o.price - 1) * 100 + 0.5) AS BIGINT) AS VARCHAR))
            ELSE CAST(CAST(floor(-100 / (o.price - 1) + 0.5) AS BIGINT) AS VARCHAR) END AS american,
       o.bookmaker_id = b.best_bookmaker_id AS is_best
    FROM fx_odds o JOIN best_book b ON b.selection_id = o.selection_id JOIN fx_selections s ON s.selection_id = o.selection_id WHERE o.bookmaker_id = 3""",
    dbl="price",
)
def _(t: Tables):
    return board.book_quotes(t("fx_odds"), _best(t), t("fx_selections"), t("fx_books"), "book3")


@query(
    "price_history",
    """SELECT * FROM (SELECT selection_id, id, price, captured_at,
       row_number() OVER (PARTITION BY selection_id ORDER BY captured_at DESC, id DESC) AS back FROM fx_snapshots) t WHERE back <= 30""",
    dbl="price",
)
def _(t: Tables):
    return board.price_history(t("fx_snapshots"), board.HISTORY_POINTS)


@query(
    "recent_moves",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY selection_id, bookmaker_id ORDER BY captured_at DESC, id DESC) AS rn FROM fx_snapshots)
    SELECT a.selection_id, a.bookmaker_id, s.event_id, b.price AS from_price, a.price AS to_price, a.captured_at AS at,
           CASE WHEN a.price > b.price THEN 'up' ELSE 'down' END AS dir, (a.price / b.price - 1) * 100 AS move_pct, k.slug AS book_slug
    FROM r a JOIN r b ON b.selection_id = a.selection_id AND b.bookmaker_id = a.bookmaker_id AND b.rn = 2
      JOIN fx_selections s ON s.selection_id = a.selection_id JOIN fx_books k ON k.bookmaker_id = a.bookmaker_id
    WHERE a.rn = 1 AND a.price <> b.price""",
    dbl="from_price to_price move_pct",
)
def _(t: Tables):
    rows = movement.recent_moves(t("fx_snapshots"), t("fx_selections"), t("fx_books"))
    return rows.drop("market_type", "side", "label")


MOVE_SQL = f"""
ranked AS (SELECT *, count(*) OVER k AS n, min(captured_at) OVER k AS first_at, lag(price) OVER (k ORDER BY captured_at, id) AS prev
           FROM fx_snapshots WINDOW k AS (PARTITION BY selection_id, bookmaker_id)),
steps AS (SELECT *, CASE WHEN price > prev THEN 1 WHEN price < prev THEN -1 END AS d FROM ranked),
flips AS (SELECT selection_id, bookmaker_id, count(*) FILTER (WHERE d <> pd) AS direction_changes FROM (
            SELECT *, lag(d) OVER (PARTITION BY selection_id, bookmaker_id ORDER BY captured_at, id) AS pd FROM steps WHERE d IS NOT NULL) t GROUP BY 1, 2),
series AS (SELECT selection_id, bookmaker_id, count(*) AS n, min(captured_at) AS first_at,
             arg_min(price, captured_at) AS open_price, arg_max(price, captured_at) AS current_price,
             count(*) FILTER (WHERE recent) AS rn, min(captured_at) FILTER (WHERE recent) AS r0, max(captured_at) FILTER (WHERE recent) AS r1,
             arg_min(price, captured_at) FILTER (WHERE recent) AS p0, arg_max(price, captured_at) FILTER (WHERE recent) AS p1
           FROM (SELECT *, captured_at >= ({QUOTES_AS_OF}) - INTERVAL 4320 HOUR AS recent FROM fx_snapshots) t GROUP BY 1, 2),
main AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY selection_id ORDER BY n DESC, first_at, bookmaker_id) AS rk FROM series) t WHERE rk = 1),
steam AS (SELECT selection_id, coalesce(stddev_samp(current_price), 0) AS price_std_dev, count(*) FILTER (WHERE rn >= 2) AS w,
            count(*) FILTER (WHERE rn >= 2 AND p1 > p0) AS up, count(*) FILTER (WHERE rn >= 2 AND p1 < p0) AS dn FROM series GROUP BY 1)
"""


MOVEMENT_SQL = f"""WITH {MOVE_SQL} SELECT m.selection_id, m.bookmaker_id AS reference_book, m.open_price, m.current_price,
       (m.current_price / m.open_price - 1) * 100 AS move_from_open_pct,
       CASE WHEN m.rn >= 2 AND (epoch_us(r1) - epoch_us(r0)) / 3.6e9 > 0.01 THEN (p1 / p0 - 1) * 100 / ((epoch_us(r1) - epoch_us(r0)) / 3.6e9) ELSE 0 END AS velocity_pct_per_hour,
       CASE WHEN s.w > 0 AND greatest(s.up, s.dn) / s.w >= 0.6 THEN (greatest(s.up, s.dn) / s.w - 0.6) / 0.4 ELSE 0 END AS steam_score,
       coalesce(f.direction_changes, 0) AS direction_changes, s.price_std_dev
    FROM main m JOIN steam s ON s.selection_id = m.selection_id
      LEFT JOIN flips f ON f.selection_id = m.selection_id AND f.bookmaker_id = m.bookmaker_id"""


@query(
    "movement_features",
    MOVEMENT_SQL,
    dbl="open_price current_price move_from_open_pct velocity_pct_per_hour steam_score price_std_dev",
)
def _(t: Tables):
    return movement.movement_features(t("fx_snapshots"), quotes_as_of(t), window_hours=4320)


@query(
    "append_changes",
    """WITH prior AS (SELECT selection_id, bookmaker_id, arg_max(price, captured_at) AS price FROM fx_snapshots
        WHERE captured_at < timestamp '1998-01-01 00:00:00' GROUP BY 1, 2),
    batch AS (SELECT selection_id, bookmaker_id, max(captured_at) AS captured_at, arg_max(price, captured_at) AS price FROM fx_snapshots
        WHERE captured_at >= timestamp '1998-01-01 00:00:00' AND price > 1 GROUP BY 1, 2)
    SELECT b.selection_id, b.bookmaker_id, b.price, b.captured_at, 1 / b.price AS implied_prob,
           p.price IS NULL OR p.price <> b.price AS changed, p.price IS NULL AS is_opening
    FROM batch b LEFT JOIN prior p ON p.selection_id = b.selection_id AND p.bookmaker_id = b.bookmaker_id""",
    dbl="price implied_prob",
)
def _(t: Tables):
    log = t("fx_snapshots").withColumn("point", F.lit(None).cast("double"))
    cut = F.lit("1998-01-01 00:00:00").cast("timestamp")
    prior = movement.latest_batch(log.filter(F.col("captured_at") < cut), ["captured_at", "id"])
    batch = log.filter(F.col("captured_at") >= cut)
    return movement.append_changes(batch, prior, ["captured_at", "id"]).drop("id", "point", "american")


@query(
    "replay_changes",
    """SELECT id, selection_id, bookmaker_id, price, captured_at, prev IS NULL AS is_opening FROM (
        SELECT *, lag(price) OVER (PARTITION BY selection_id, bookmaker_id ORDER BY captured_at, id) AS prev FROM fx_snapshots WHERE price > 1) t
    WHERE prev IS NULL OR prev <> price""",
    dbl="price",
)
def _(t: Tables):
    return movement.replay_changes(t("fx_snapshots")).drop("prev_price", "implied_prob")


@query(
    "page_envelope",
    """SELECT count(*) AS total, 50 AS "limit", 100 AS "offset", count(*) > 150 AS has_more FROM fx_events WHERE status IN ('scheduled', 'live')""",
    big='"limit" "offset"',
)
def _(t: Tables):
    return board.page_envelope(board.filter_events(t("fx_events")), 50, 100)
