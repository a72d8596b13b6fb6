"""Queries over settlement, calibration, schedule and fundamentals."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.fixtures import Tables
from marketlens.operators import evidence, fair, movement, schedule, settle
from marketlens.plans.quotes import MOVEMENT_SQL, _fair, quotes_as_of
from marketlens.plans.tape import _number, _pct, flow_rows
from marketlens.registry import query

CLOSE_AT = "timestamp '1998-01-01 00:00:00'"
WIDE_HOURS = 24 * 365


def _at(text: str = "1998-01-01 00:00:00"):
    return F.lit(text).cast("timestamp")


@query(
    "closing_lines",
    f"""SELECT o.selection_id, o.bookmaker_id, o.price, 1 / o.price AS implied_prob, coalesce(d.shin, 0) AS fair_prob,
       CAST(floor((epoch_us(e.commence_at) - epoch_us({CLOSE_AT})) / 1e6 + 0.5) AS BIGINT) AS seconds_before_start
    FROM fx_odds o JOIN fx_selections s ON s.selection_id = o.selection_id JOIN fx_events e ON e.event_id = s.event_id
      LEFT JOIN ref_devig d ON d.selection_id = o.selection_id AND d.bookmaker_id = o.bookmaker_id
    WHERE o.price > 1 AND e.status IN ('scheduled', 'live')
      AND e.commence_at BETWEEN {CLOSE_AT} - INTERVAL {WIDE_HOURS} HOUR AND {CLOSE_AT} + INTERVAL {WIDE_HOURS} HOUR""",
    dbl="price implied_prob fair_prob",
)
def _(t: Tables):
    return settle.closing_lines(
        t("fx_events"), t("fx_selections"), t("fx_odds"), _at(), lookback_hours=WIDE_HOURS, ahead_minutes=WIDE_HOURS * 60
    )


GRADED_SQL = """
graded AS (
  SELECT * FROM (
    SELECT s.selection_id, s.market_id, s.event_id, CASE WHEN NOT r.completed THEN 2
      WHEN s.market_type = 'h2h' THEN CASE WHEN s.side = r.winner_side THEN 1 ELSE 0 END
      WHEN s.point IS NULL THEN NULL
      WHEN s.market_type = 'spreads' THEN CASE
        WHEN CASE WHEN s.side = 'home' THEN home_score + point - away_score ELSE away_score + point - home_score END = 0 THEN 2
        WHEN CASE WHEN s.side = 'home' THEN home_score + point - away_score ELSE away_score + point - home_score END > 0 THEN 1 ELSE 0 END
      WHEN home_score + away_score = point THEN 2
      WHEN s.side = 'over' THEN CASE WHEN home_score + away_score > point THEN 1 ELSE 0 END
      WHEN s.side = 'under' THEN CASE WHEN home_score + away_score < point THEN 1 ELSE 0 END END AS outcome
    FROM fx_graded_sides s JOIN fx_results r ON r.event_id = s.event_id) g WHERE outcome IS NOT NULL)
"""


def _graded(t: Tables):
    return settle.grade_selections(t("fx_results"), t("fx_graded_sides"))


@query("grade_selections", f"WITH {GRADED_SQL} SELECT * FROM graded", big="outcome")
def _(t: Tables):
    return _graded(t)


def _closing(t: Tables, graded):
    """Closing quotes of the graded selections; margins are solved for the markets these are in."""
    markets = t("fx_selections").join(graded.select("selection_id"), "selection_id", "left_semi").select("market_id").distinct()
    sides = t("fx_selections").join(markets, "market_id", "left_semi")
    devigged = fair.devig(fair.open_quotes(t("fx_odds"), sides))
    probs = devigged.select("selection_id", "bookmaker_id", F.col("shin").alias("fair_prob"))
    return (
        t("fx_odds")
        .join(graded.select("selection_id"), "selection_id", "left_semi")
        .select("selection_id", "bookmaker_id", "price")
        .join(probs, ["selection_id", "bookmaker_id"], "left")
        .na.fill(0.0, ["fair_prob"])
    )


@query(
    "label_snapshots",
    f"""WITH {GRADED_SQL}, close AS (SELECT o.selection_id, max(o.price) AS best_close, avg(coalesce(d.shin, 0)) AS fair_close,
        avg(d.shin) FILTER (WHERE d.shin > 0) AS fair_known FROM fx_odds o
        LEFT JOIN ref_devig d ON d.selection_id = o.selection_id AND d.bookmaker_id = o.bookmaker_id GROUP BY 1)
    SELECT f.selection_id, f.captured_at, f.best_price, g.outcome AS label, coalesce(c.fair_close, 0) AS closing_fair_prob,
           c.fair_known AS closing_fair_prob_known, coalesce((f.best_price / c.best_close - 1) * 100, 0) AS clv_pct
    FROM fx_open_snapshots f JOIN graded g ON g.selection_id = f.selection_id LEFT JOIN close c ON c.selection_id = f.selection_id""",
    dbl="best_price closing_fair_prob closing_fair_prob_known clv_pct",
    big="label",
)
def _(t: Tables):
    pending = t("fx_open_snapshots").withColumn("label", F.lit(None).cast("int"))
    graded = _graded(t)
    return settle.label_snapshots(pending, graded, _closing(t, graded))


@query(
    "snapshot_candidates",
    f"""SELECT f.selection_id, (epoch_us(e.commence_at) - epoch_us({CLOSE_AT})) / 3.6e9 AS hours_to_start, f.best_price, f.prob_consensus AS fair_prob,
       f.edge_pct, e.sport_slug, s.market_type, s.side, f.prob_sharp AS sharp_prob, f.overround_pct, f.book_count, coalesce(v.price_std_dev, 0) AS price_std_dev, coalesce(v.open_price, 0) AS open_price,
       coalesce(v.move_from_open_pct, 0) AS move_from_open_pct, coalesce(v.velocity_pct_per_hour, 0) AS velocity_pct_per_hour, coalesce(v.steam_score, 0) AS steam_score
    FROM ref_fair f JOIN fx_selections s ON s.selection_id = f.selection_id JOIN fx_events e ON e.event_id = s.event_id LEFT JOIN ({MOVEMENT_SQL}) v ON v.selection_id = f.selection_id
    WHERE e.status = 'scheduled' AND e.commence_at BETWEEN {CLOSE_AT} AND {CLOSE_AT} + INTERVAL {WIDE_HOURS} HOUR
      AND NOT EXISTS (SELECT 1 FROM fx_open_snapshots n WHERE n.selection_id = f.selection_id AND n.captured_at > {CLOSE_AT} - INTERVAL 30 MINUTE
                      AND n.captured_at < {CLOSE_AT} + INTERVAL 30 DAY)""",
    dbl="hours_to_start best_price fair_prob edge_pct sharp_prob overround_pct price_std_dev open_price move_from_open_pct velocity_pct_per_hour steam_score",
)
def _(t: Tables):
    past = t("fx_open_snapshots").filter(F.col("captured_at") < _at("1998-01-31 00:00:00"))
    moves = movement.movement_features(t("fx_snapshots"), quotes_as_of(t), window_hours=4320)
    sides = fair.upcoming(t("fx_selections"), t("fx_events"), _at(), _at() + F.expr(f"interval {WIDE_HOURS} hours"))
    rows = settle.snapshot_candidates(
        _fair(t, sides), sides, t("fx_events"), moves, past, _at(), horizon_hours=WIDE_HOURS
    )
    return rows.select(
        "selection_id", "hours_to_start", "best_price", "fair_prob", "edge_pct", "sport_slug", "market_type", "side", "sharp_prob", "overround_pct", "book_count",
        "price_std_dev", "open_price", "move_from_open_pct", "velocity_pct_per_hour", "steam_score",
    )


CURVES_SQL = """
pts AS (SELECT *, greatest(1e-15, least(1 - 1e-15, fair_prob)) AS q,
          CASE WHEN fair_prob >= 0.9 THEN 9 WHEN fair_prob >= 0.8 THEN 8 WHEN fair_prob >= 0.7 THEN 7 WHEN fair_prob >= 0.6 THEN 6 WHEN fair_prob >= 0.5 THEN 5
               WHEN fair_prob >= 0.4 THEN 4 WHEN fair_prob >= 0.3 THEN 3 WHEN fair_prob >= 0.2 THEN 2 WHEN fair_prob >= 0.1 THEN 1 ELSE 0 END AS b
        FROM fx_feature_snapshots WHERE label IN (0, 1) AND fair_prob > 0),
curves AS (
  SELECT CASE WHEN sport_slug IS NOT NULL THEN 'sport' WHEN market_type IS NOT NULL THEN 'market_type' ELSE 'overall' END AS scope,
         coalesce(sport_slug, market_type, '') AS scope_key, b / 10 AS bucket_lower, (b + 1) / 10 AS bucket_upper, avg(fair_prob) AS predicted_avg,
         avg(label) AS observed_rate, count(*) AS sample_size, avg((fair_prob - label) * (fair_prob - label)) AS brier_score,
         avg(-(label * ln(q) + (1 - label) * ln(1 - q))) AS log_loss, avg(clv_pct) AS avg_clv_pct
  FROM pts GROUP BY GROUPING SETS ((b), (b, sport_slug), (b, market_type)))
"""
CURVE_DOUBLES = "bucket_lower bucket_upper predicted_avg observed_rate brier_score log_loss avg_clv_pct"


@query("calibration_curves", f"WITH {CURVES_SQL} SELECT * FROM curves", dbl=CURVE_DOUBLES)
def _(t: Tables):
    return settle.calibration_curves(t("fx_feature_snapshots"))


@query(
    "calibration_score",
    f"""WITH {CURVES_SQL} SELECT scope, scope_key, sum(sample_size) AS sample_size, sum(brier_score * sample_size) / sum(sample_size) AS brier_score,
       sum(log_loss * sample_size) / sum(sample_size) AS log_loss, sum(avg_clv_pct * sample_size) / sum(sample_size) AS avg_clv_pct
    FROM curves WHERE scope = 'sport' GROUP BY 1, 2""",
    dbl="brier_score log_loss avg_clv_pct",
    big="sample_size",
)
def _(t: Tables):
    return settle.calibration_score(settle.calibration_curves(t("fx_feature_snapshots")), scope="sport")


@query(
    "training_export",
    """SELECT selection_id, captured_at, fair_prob, label, clv_pct, sport_slug, market_type,
       CASE WHEN captured_at < timestamp '1999-01-01 00:00:00' THEN 'train' ELSE 'test' END AS split
    FROM fx_feature_snapshots WHERE label IN (0, 1) AND captured_at >= timestamp '1996-01-01 00:00:00'""",
    dbl="fair_prob clv_pct",
    big="label",
)
def _(t: Tables):
    rows = settle.training_rows(t("fx_feature_snapshots"), since=_at("1996-01-01 00:00:00"))
    split = F.when(F.col("captured_at") < _at("1999-01-01 00:00:00"), "train").otherwise("test")
    return rows.withColumn("split", split)


@query(
    "grade_insights",
    f"""WITH {GRADED_SQL} SELECT i.insight_id, i.selection_id, i.stance, i.stated_prob, g.outcome,
       g.outcome = CASE WHEN i.stance = 'back' THEN 1 ELSE 0 END AS correct,
       pow(CASE WHEN i.stance = 'back' THEN i.stated_prob ELSE 1 - i.stated_prob END - g.outcome, 2) AS squared_error
    FROM fx_insights i JOIN graded g ON g.selection_id = i.selection_id WHERE i.stance <> 'pass' AND g.outcome IN (0, 1)""",
    dbl="stated_prob squared_error",
    big="outcome",
)
def _(t: Tables):
    return settle.grade_insights(t("fx_insights"), _graded(t))


@query(
    "signal_attribution",
    """WITH r AS (SELECT e.kind, e.contribution AS c, CASE WHEN d.side = 'yes' THEN m.last_price ELSE 1 - m.last_price END - d.market_price AS clv
        FROM fx_evidence e JOIN fx_decisions d ON d.decision_id = e.decision_id JOIN fx_prediction_markets m ON m.market_id = d.market_id
        WHERE m.status <> 'open' AND m.last_price > 0 AND d.market_price > 0 AND e.contribution <> 0)
    SELECT kind, count(*) AS samples, avg(CASE WHEN (c > 0 AND clv > 0) OR (c < 0 AND clv < 0) THEN 1.0 ELSE 0 END) AS hit_rate,
           avg(CASE WHEN c > 0 THEN clv ELSE -clv END) * 100 AS avg_clv_points, avg(abs(c)) AS avg_contribution, count(*) >= 30 AS meaningful
    FROM r GROUP BY 1""",
    dbl="hit_rate avg_clv_points avg_contribution",
)
def _(t: Tables):
    return settle.signal_attribution(t("fx_evidence"), t("fx_decisions"), t("fx_prediction_markets"))


CONTEXT_SQL = """
games AS (SELECT event_id, 'home' AS side, home_team_id AS team_id, commence_at FROM fx_events
          UNION ALL SELECT event_id, 'away', away_team_id, commence_at FROM fx_events),
ctx AS (SELECT event_id, side, team_id,
          (epoch_us(commence_at) - epoch_us(max(commence_at) OVER (PARTITION BY team_id ORDER BY commence_at RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING))) / 8.64e10 AS rest_days,
          count(*) OVER (PARTITION BY team_id ORDER BY commence_at RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS games_in_window
        FROM games),
context AS (SELECT *, coalesce(rest_days < 1.5, false) AS back_to_back FROM ctx)
"""
EDGE_SQL = """
pairs AS (SELECT h.event_id, CASE WHEN h.rest_days > 4 THEN 4 ELSE h.rest_days END AS hr, CASE WHEN a.rest_days > 4 THEN 4 ELSE a.rest_days END AS ar, h.back_to_back AS hb, a.back_to_back AS ab,
            a.games_in_window - h.games_in_window AS gap FROM context h JOIN context a ON a.event_id = h.event_id AND h.side = 'home' AND a.side = 'away'),
parts AS (SELECT event_id,
            CASE WHEN abs(hr - ar) >= 1 THEN greatest(-1, least(1, (hr - ar) / 3)) ELSE 0 END
            + CASE WHEN hr IS NOT NULL AND ar IS NOT NULL AND hb <> ab THEN CASE WHEN hb THEN -0.5 ELSE 0.5 END ELSE 0 END
            + CASE WHEN abs(gap) >= 2 THEN greatest(-1, least(1, gap / 3)) ELSE 0 END AS raw,
            CASE WHEN abs(hr - ar) >= 1 THEN 2 ELSE 0 END + CASE WHEN hr IS NOT NULL AND ar IS NOT NULL AND hb <> ab THEN 1.5 ELSE 0 END
            + CASE WHEN abs(gap) >= 2 THEN 1 ELSE 0 END AS weight FROM pairs),
sched AS (SELECT event_id, greatest(-1, least(1, raw / greatest(weight, 3))) AS edge, least(1, weight / 4.5) AS confidence FROM parts)
"""


@query("schedule_context", f"WITH {CONTEXT_SQL} SELECT * FROM context", dbl="rest_days")
def _(t: Tables):
    return schedule.schedule_context(t("fx_events"))


@query("schedule_edge", f"WITH {CONTEXT_SQL}, {EDGE_SQL} SELECT * FROM sched", dbl="edge confidence")
def _(t: Tables):
    return schedule.schedule_edge(schedule.schedule_context(t("fx_events"))).drop("reasons")


FUNDAMENTALS_SQL = """
st AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY captured_at DESC, id DESC) AS rn FROM fx_standings) x WHERE rn = 1),
va AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY captured_at DESC, id DESC) AS rn FROM fx_valuations) x WHERE rn = 1),
inj AS (SELECT i.team_id, sum(severity) AS burden FROM fx_injuries i JOIN (SELECT team_id, max(captured_at) AS at FROM fx_injuries GROUP BY 1) m
        ON m.team_id = i.team_id AND m.at = i.captured_at GROUP BY 1),
fund AS (SELECT t.team_id, CASE WHEN va.league_tier > 0 THEN va.league_tier ELSE t.tier END AS league_tier, coalesce(va.squad_value_eur, 0) AS squad_value_eur,
           coalesce(st.win_percent, 0) AS win_percent, coalesce(st.point_differential, 0) AS point_differential, coalesce(st.games_played, 0) AS games_played,
           coalesce(inj.burden, 0) AS injury_burden, st.id IS NOT NULL AS has_standing, va.id IS NOT NULL OR t.tier > 0 AS has_valuation
         FROM fx_teams t LEFT JOIN st ON st.team_id = t.team_id LEFT JOIN va ON va.team_id = t.team_id LEFT JOIN inj ON inj.team_id = t.team_id)
"""
MISMATCH_SQL = """
mm AS (SELECT e.event_id, h.league_tier AS ht, a.league_tier AS atier, h.squad_value_eur AS hv, a.squad_value_eur AS av, h.has_standing AND a.has_standing AND least(h.games_played, a.games_played) >= 10 AS form,
         h.win_percent - a.win_percent AS wp, (h.point_differential - a.point_differential) / greatest(1, least(h.games_played, a.games_played)) AS pg, a.injury_burden - h.injury_burden AS ig
       FROM fx_events e JOIN fund h ON h.team_id = e.home_team_id JOIN fund a ON a.team_id = e.away_team_id),
mp AS (SELECT event_id, CASE WHEN ht > 0 AND atier > 0 AND ht <> atier THEN 3 ELSE 0 END AS w1, CASE WHEN hv > 0 AND av > 0 THEN 2 ELSE 0 END AS w2, CASE WHEN form THEN 1.5 ELSE 0 END AS w3,
         CASE WHEN form THEN 1 ELSE 0 END AS w4, CASE WHEN abs(ig) >= 2 THEN 0.5 ELSE 0 END AS w5, greatest(-1, least(1, (atier - ht) / 3)) AS e1,
         CASE WHEN hv > 0 AND av > 0 THEN tanh(ln(hv / av) / 1.6) ELSE 0 END AS e2, greatest(-1, least(1, wp * 2)) AS e3, tanh(pg / 1.5) AS e4, tanh(ig / 8) AS e5 FROM mm),
mismatch AS (SELECT event_id, greatest(-1, least(1, (w1 * e1 + w2 * e2 + w3 * e3 + w4 * e4 + w5 * e5) / greatest(3, w1 + w2 + w3 + w4 + w5))) AS edge,
               least(1, (w1 + w2 + w3 + w4 + w5) / 8) AS confidence FROM mp)
"""


def _fundamentals(t: Tables):
    return schedule.team_fundamentals(t("fx_teams"), t("fx_standings"), t("fx_valuations"), t("fx_injuries"))


@query(
    "team_fundamentals",
    f"WITH {FUNDAMENTALS_SQL} SELECT * FROM fund",
    dbl="squad_value_eur win_percent point_differential injury_burden",
)
def _(t: Tables):
    return _fundamentals(t)


@query(
    "squad_mismatch",
    f"WITH {FUNDAMENTALS_SQL}, {MISMATCH_SQL} SELECT * FROM mismatch",
    dbl="edge confidence",
)
def _(t: Tables):
    fixtures = t("fx_events").select("event_id", "home_team_id", "away_team_id")
    return schedule.squad_mismatch(fixtures, _fundamentals(t)).select("event_id", "edge", "confidence")


def _signed_sql(edge: str) -> str:
    return f"CASE WHEN f.side = 'yes' THEN 1 ELSE -1 END * CASE WHEN x.outcome = 'home' THEN 1 ELSE -1 END * {edge}"


def _signal4(expr: str) -> str:
    return f"floor(greatest(-0.08, least(0.08, {expr})) * 10000 + 0.5) / 10000"


def _fixture_flow(t: Tables):
    return flow_rows(t).join(t("fx_market_fixtures"), "market_id")


@query(
    "sig_schedule_rest",
    f"""WITH {CONTEXT_SQL}, {EDGE_SQL} SELECT f.market_id, 'schedule_rest' AS kind, floor(s.edge * 10000 + 0.5) / 10000 AS value,
       {_signal4(_signed_sql('s.edge') + ' * s.confidence * 0.04')} AS contribution
    FROM ref_flow f JOIN fx_market_fixtures x ON x.market_id = f.market_id JOIN sched s ON s.event_id = x.event_id
    WHERE s.confidence > 0 AND abs(s.edge) > 0.01 AND x.outcome IN ('home', 'away')""",
    dbl="value contribution",
)
def _(t: Tables):
    edge = schedule.schedule_edge(schedule.schedule_context(t("fx_events"))).select(
        "event_id",
        F.col("edge").alias("schedule_edge"),
        F.col("confidence").alias("schedule_confidence"),
        F.col("reasons").alias("schedule_reasons"),
    )
    rows = _fixture_flow(t).join(edge, "event_id")
    return evidence.signal_rows(rows, evidence.schedule_signal()).select("market_id", "kind", "value", "contribution")


@query(
    "sig_squad_mismatch",
    f"""WITH {FUNDAMENTALS_SQL}, {MISMATCH_SQL} SELECT f.market_id, 'squad_mismatch' AS kind, floor(s.edge * 10000 + 0.5) / 10000 AS value,
       {_signal4(_signed_sql('s.edge') + ' * s.confidence * 0.06')} AS contribution
    FROM ref_flow f JOIN fx_market_fixtures x ON x.market_id = f.market_id JOIN mismatch s ON s.event_id = x.event_id
    WHERE s.confidence > 0 AND abs(s.edge) > 0.01 AND x.outcome IN ('home', 'away')""",
    dbl="value contribution",
)
def _(t: Tables):
    fixtures = t("fx_events").select("event_id", "home_team_id", "away_team_id")
    edge = schedule.squad_mismatch(fixtures, _fundamentals(t)).select(
        "event_id",
        F.col("edge").alias("mismatch_edge"),
        F.col("confidence").alias("mismatch_confidence"),
        F.col("reasons").alias("mismatch_reasons"),
    )
    rows = _fixture_flow(t).join(edge, "event_id")
    return evidence.signal_rows(rows, evidence.mismatch_signal()).select("market_id", "kind", "value", "contribution")


STEAM_WINDOW = 4320


@query(
    "sig_steam",
    f"""WITH series AS (SELECT selection_id, bookmaker_id, count(*) AS n, min(captured_at) AS first_at, arg_min(price, captured_at) AS p_open, arg_max(price, captured_at) AS p_now,
          count(*) FILTER (WHERE recent) AS rn, arg_min(price, captured_at) FILTER (WHERE recent) AS p0, arg_max(price, captured_at) FILTER (WHERE recent) AS p1
        FROM (SELECT *, captured_at >= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL {STEAM_WINDOW} HOUR AS recent FROM fx_snapshots) t GROUP BY 1, 2),
    main AS (SELECT selection_id, (p_now / p_open - 1) * 100 AS move FROM (SELECT *, row_number() OVER (PARTITION BY selection_id ORDER BY n DESC, first_at, bookmaker_id) AS rk FROM series) t WHERE rk = 1),
    share AS (SELECT selection_id, greatest(count(*) FILTER (WHERE p1 > p0), count(*) FILTER (WHERE p1 < p0)) / count(*) AS share FROM series WHERE rn >= 2 GROUP BY 1),
    steam AS (SELECT m.selection_id, m.move, CASE WHEN s.share >= 0.6 THEN (s.share - 0.6) / 0.4 ELSE 0 END AS score FROM main m JOIN share s ON s.selection_id = m.selection_id),
    pick AS (SELECT event_id, side, min(selection_id) AS selection_id FROM fx_selections WHERE market_type = 'h2h' GROUP BY 1, 2)
    SELECT f.market_id, 'steam' AS kind, floor(s.score * 10000 + 0.5) / 10000 AS value,
       {_signal4("CASE WHEN f.side = 'yes' THEN 1 ELSE -1 END * CASE WHEN s.move < 0 THEN 1 ELSE -1 END * s.score * 0.05")} AS contribution,
       concat('books moved together ', CASE WHEN s.move > 0 THEN 'against' ELSE 'toward' END, ' ', CASE WHEN f.market_id % 2 = 0 THEN concat('Team ', f.market_id) ELSE x.outcome END, ' (', {_pct('s.score')}, ' consensus)') AS summary
    FROM ref_flow f JOIN fx_market_fixtures x ON x.market_id = f.market_id JOIN pick p ON p.event_id = x.event_id AND p.side = x.outcome
      JOIN steam s ON s.selection_id = p.selection_id WHERE s.score > 0 AND abs(s.move) > 0.1 AND x.outcome IN ('home', 'away')""",
    dbl="value contribution",
)
def _(t: Tables):
    picks = (
        t("fx_selections")
        .filter(F.col("market_type") == "h2h")
        .groupBy("event_id", F.col("side").alias("outcome"))
        .agg(F.min("selection_id").alias("selection_id"))
    )
    chosen = _fixture_flow(t).join(picks, ["event_id", "outcome"])
    log = t("fx_snapshots").join(chosen.select("selection_id"), "selection_id", "left_semi")
    moves = movement.movement_features(log, quotes_as_of(t), window_hours=STEAM_WINDOW)
    rows = chosen.join(moves.select("selection_id", "steam_score", "move_from_open_pct"), "selection_id")
    team = F.when(F.col("market_id") % 2 == 0, F.concat(F.lit("Team "), F.col("market_id").cast("string")))
    rows = rows.withColumn("outcome_team", team)
    return evidence.signal_rows(rows, evidence.steam_signal(F.coalesce("outcome_team", "outcome"))).select("market_id", "kind", "value", "contribution", "summary")


@query(
    "sig_ladder",
    f"""WITH m AS (SELECT event_id % 25 AS market_id, max(event_id) AS event_id FROM fx_events GROUP BY 1),
    r AS (SELECT *, price - lag(price) OVER k AS gap, lag(price) OVER k AS price0, lag(strike) OVER k AS strike0 FROM fx_ladder WINDOW k AS (PARTITION BY series, fixture ORDER BY strike, ticker_id)),
    w AS (SELECT ticker_id % 25 AS market_id, max(gap) AS gap, arg_max(strike0, (gap, strike0, price, price0)) AS strike0, arg_max(price, (gap, strike0, price, price0)) AS price, arg_max(price0, (gap, strike0, price, price0)) AS price0 FROM r WHERE gap >= 0.01 GROUP BY 1)
    SELECT f.market_id, 'ladder_incoherence' AS kind, floor(w.gap * 10000 + 0.5) / 10000 AS value,
       floor(greatest(-0.08, least(0.08, CASE WHEN f.side = 'yes' THEN -w.gap ELSE w.gap END)) * 10000 + 0.5) / 10000 AS contribution,
       concat('priced ', {_pct('w.price')}, ' against ', {_pct('w.price0')}, ' for the easier ', {_number('w.strike0')}) AS summary
    FROM ref_flow f JOIN w ON w.market_id = f.market_id""",
    dbl="value contribution",
)
def _(t: Tables):
    rungs = t("fx_ladder").withColumnRenamed("ticker_id", "market_id")
    found = evidence.ladder_incoherence(rungs, ["series", "fixture"])
    per_market = found.withColumn("market_id", F.col("market_id") % 25)
    rows = evidence.with_ladder(flow_rows(t), per_market)
    return evidence.signal_rows(rows, evidence.ladder_signal()).select("market_id", "kind", "value", "contribution", "summary")
