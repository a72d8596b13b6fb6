"""Fixture context: rest and congestion, team fundamentals and squad mismatch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketlens.functions.common import clamp, js_round

WINDOW_DAYS = 7
DAY = 86_400_000_000
MAX_REST_DAYS = 4.0
WEIGHT_FLOOR = 3.0


def schedule_context(events: DataFrame) -> DataFrame:
    """Rest days, fixtures in the previous seven days and back-to-back flag per (event, team).

    Timelines are cut into week segments. A fixture is sent to its own week and to the next one, which is
    as far as the seven-day look-back reaches; one carry row per week brings the previous fixture in.
    """
    span = WINDOW_DAYS * DAY
    sides = F.array(
        F.struct(F.lit("home").alias("side"), F.col("home_team_id").alias("team_id")),
        F.struct(F.lit("away").alias("side"), F.col("away_team_id").alias("team_id")),
    )
    games = (
        events.filter(F.col("commence_at").isNotNull())
        .select("event_id", F.unix_micros("commence_at").alias("t"), F.explode(sides).alias("s"))
        .select("event_id", "t", "s.side", "s.team_id")
        .filter(F.col("team_id").isNotNull())
        .withColumn("week", F.floor(F.col("t") / span))
    )
    shifts = F.explode(F.array(F.lit(0), F.lit(1)))
    copies = games.select("*", shifts.alias("shift")).withColumn("week", F.col("week") + F.col("shift"))
    last = games.groupBy("team_id", "week").agg(F.max("t").alias("t"))
    carry = last.withColumn("week", F.lead("week").over(W.partitionBy("team_id").orderBy("week"))).filter(
        F.col("week").isNotNull()
    )
    rows = copies.withColumn("weight", F.lit(1)).unionByName(
        carry.select(
            "team_id",
            "week",
            "t",
            F.lit(None).cast("bigint").alias("event_id"),
            F.lit(None).cast("string").alias("side"),
            F.lit(2).alias("shift"),
            F.lit(0).alias("weight"),
        )
    )
    line = W.partitionBy("team_id", "week").orderBy("t")
    context = rows.select(
        "event_id",
        "side",
        "team_id",
        "t",
        "shift",
        F.max("t").over(line.rangeBetween(W.unboundedPreceding, -1)).alias("previous"),
        F.coalesce(F.sum("weight").over(line.rangeBetween(-span, -1)), F.lit(0)).alias("games_in_window"),
    ).filter(F.col("shift") == 0)
    rest = (F.col("t") - F.col("previous")) / F.lit(float(DAY))
    return context.select(
        "event_id",
        "side",
        "team_id",
        rest.alias("rest_days"),
        "games_in_window",
        F.coalesce(rest < 1.5, F.lit(False)).alias("back_to_back"),
    )


def schedule_edge(context: DataFrame) -> DataFrame:
    """Home-against-away rest edge per event: edge in -1..1, confidence and reasons."""
    view = F.struct("rest_days", "games_in_window", "back_to_back")
    pairs = (
        context.groupBy("event_id")
        .agg(
            F.max(F.when(F.col("side") == "home", view)).alias("home"),
            F.max(F.when(F.col("side") == "away", view)).alias("away"),
        )
        .filter(F.col("home").isNotNull() & F.col("away").isNotNull())
    )
    home, away = F.col("home"), F.col("away")
    known = home["rest_days"].isNotNull() & away["rest_days"].isNotNull()
    home_rest = F.least(home["rest_days"], F.lit(MAX_REST_DAYS))
    away_rest = F.least(away["rest_days"], F.lit(MAX_REST_DAYS))
    rest_gap = home_rest - away_rest
    rest_on = known & (F.abs(rest_gap) >= 1)
    b2b_on = known & (home["back_to_back"] != away["back_to_back"])
    load_gap = away["games_in_window"] - home["games_in_window"]
    load_on = F.abs(load_gap) >= 2
    parts = [
        (rest_on, clamp(rest_gap / 3.0, -1, 1), 2.0, F.format_string("Rest %.0fd vs %.0fd", home_rest, away_rest)),
        (
            b2b_on,
            F.when(home["back_to_back"], -0.5).otherwise(0.5),
            1.5,
            F.when(home["back_to_back"], "Home on a back-to-back").otherwise("Away on a back-to-back"),
        ),
        (
            load_on,
            clamp(load_gap / 3.0, -1, 1),
            1.0,
            F.format_string("Games in 7d: %d vs %d", home["games_in_window"], away["games_in_window"]),
        ),
    ]
    edge = sum((F.when(on, e).otherwise(0.0) for on, e, _, _ in parts), F.lit(0.0))
    weight = sum((F.when(on, w).otherwise(0.0) for on, _, w, _ in parts), F.lit(0.0))
    reasons = F.array_compact(F.array(*[F.when(on, text) for on, _, _, text in parts]))
    return pairs.select(
        "event_id", edge.alias("raw"), weight.alias("weight"), reasons.alias("reasons")
    ).select(
        "event_id",
        clamp(F.col("raw") / F.greatest("weight", F.lit(WEIGHT_FLOOR)), -1, 1).alias("edge"),
        F.least(F.lit(1.0), F.col("weight") / 4.5).alias("confidence"),
        "reasons",
    )


def team_fundamentals(teams: DataFrame, standings: DataFrame, valuations: DataFrame, injuries: DataFrame) -> DataFrame:
    """Latest standing, valuation, league tier and injury burden of every team.

    The burden sums severities of the latest injury capture only: severities are added per capture first,
    then the newest capture is kept, so no team's injury history is gathered.
    """
    newest = F.struct("captured_at", "id")
    standing = standings.groupBy("team_id").agg(
        F.max_by(F.struct("win_percent", "point_differential", "games_played"), newest).alias("standing")
    )
    valuation = valuations.groupBy("team_id").agg(
        F.max_by(F.struct("squad_value_eur", "league_tier"), newest).alias("valuation")
    )
    burden = (
        injuries.groupBy("team_id", "captured_at")
        .agg(F.sum("severity").alias("severity"))
        .groupBy("team_id")
        .agg(F.max_by("severity", "captured_at").alias("injury_burden"))
    )
    rows = (
        teams.select("team_id", F.coalesce("tier", F.lit(0)).alias("tier"))
        .join(standing, "team_id", "left")
        .join(valuation, "team_id", "left")
        .join(burden, "team_id", "left")
    )
    own_tier = F.coalesce(F.col("valuation.league_tier"), F.lit(0))
    return rows.select(
        "team_id",
        F.when(own_tier > 0, own_tier).otherwise(F.col("tier")).alias("league_tier"),
        F.coalesce(F.col("valuation.squad_value_eur"), F.lit(0.0)).alias("squad_value_eur"),
        F.coalesce(F.col("standing.win_percent"), F.lit(0.0)).alias("win_percent"),
        F.coalesce(F.col("standing.point_differential"), F.lit(0.0)).alias("point_differential"),
        F.coalesce(F.col("standing.games_played"), F.lit(0)).alias("games_played"),
        F.coalesce("injury_burden", F.lit(0.0)).alias("injury_burden"),
        F.col("standing").isNotNull().alias("has_standing"),
        (F.col("valuation").isNotNull() | (F.col("tier") > 0)).alias("has_valuation"),
    )


def euro_text(value: Column) -> Column:
    return (
        F.when(value >= 1e9, F.format_string("€%.2fbn", value / 1e9))
        .when(value >= 1e6, F.format_string("€%.0fm", value / 1e6))
        .otherwise(F.concat(F.lit("€"), js_round(value / 1e3).cast("bigint").cast("string"), F.lit("k")))
    )


def _signed(value: Column) -> Column:
    rounded = js_round(value).cast("bigint").cast("string")
    return F.when(value >= 0, F.concat(F.lit("+"), rounded)).otherwise(rounded)


def squad_mismatch(fixtures: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """Weighted strength edge of each (home, away) pair with confidence and reasons."""
    view = F.struct(*[c for c in fundamentals.columns if c != "team_id"])
    side = fundamentals.select("team_id", view.alias("f"))
    rows = fixtures.join(
        side.select(F.col("team_id").alias("home_team_id"), F.col("f").alias("h")), "home_team_id"
    ).join(side.select(F.col("team_id").alias("away_team_id"), F.col("f").alias("a")), "away_team_id")
    h, a = F.col("h"), F.col("a")
    played = F.least(h["games_played"], a["games_played"])
    form_on = h["has_standing"] & a["has_standing"] & (played >= 10)
    tier_on = (h["league_tier"] > 0) & (a["league_tier"] > 0) & (h["league_tier"] != a["league_tier"])
    value_on = (h["squad_value_eur"] > 0) & (a["squad_value_eur"] > 0)
    burden_gap = a["injury_burden"] - h["injury_burden"]
    per_game = (h["point_differential"] - a["point_differential"]) / F.greatest(F.lit(1), played)
    parts = [
        (
            tier_on,
            clamp((a["league_tier"] - h["league_tier"]) / 3.0, -1, 1),
            3.0,
            F.format_string("Tier %d vs tier %d", h["league_tier"].cast("int"), a["league_tier"].cast("int")),
        ),
        (
            value_on,
            F.tanh(F.log(F.when(value_on, h["squad_value_eur"] / a["squad_value_eur"])) / 1.6),
            2.0,
            F.concat(F.lit("Squad value "), euro_text(h["squad_value_eur"]), F.lit(" vs "), euro_text(a["squad_value_eur"])),
        ),
        (
            form_on,
            clamp((h["win_percent"] - a["win_percent"]) * 2.0, -1, 1),
            1.5,
            F.format_string("Record %.0f%% vs %.0f%%", h["win_percent"] * 100.0, a["win_percent"] * 100.0),
        ),
        (
            form_on,
            F.tanh(per_game / 1.5),
            1.0,
            F.concat(
                F.lit("Scoring differential "), _signed(h["point_differential"]), F.lit(" vs "),
                _signed(a["point_differential"]),
            ),
        ),
        (
            F.abs(burden_gap) >= 2,
            F.tanh(burden_gap / 8.0),
            0.5,
            F.format_string("Absences %.1f vs %.1f", h["injury_burden"], a["injury_burden"]),
        ),
    ]
    edge = sum((F.when(on, e * w).otherwise(0.0) for on, e, w, _ in parts), F.lit(0.0))
    weight = sum((F.when(on, F.lit(w)).otherwise(0.0) for on, _, w, _ in parts), F.lit(0.0))
    reasons = F.array_compact(F.array(*[F.when(on, text) for on, _, _, text in parts]))
    return rows.select(
        *fixtures.columns, edge.alias("raw"), weight.alias("weight"), reasons.alias("reasons")
    ).select(
        *fixtures.columns,
        clamp(F.col("raw") / F.greatest("weight", F.lit(WEIGHT_FLOOR)), -1, 1).alias("edge"),
        F.least(F.lit(1.0), F.col("weight") / 8.0).alias("confidence"),
        "reasons",
    )
