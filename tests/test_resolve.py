"""Name, event and feed resolution cases."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marketlens.functions import text as X
from marketlens.operators import resolve as R
from marketlens.session import cut

TEAMS = [
    (1, 1, "Los Angeles Lakers", []), (1, 2, "Los Angeles Clippers", []), (1, 3, "Crawley Town", ["redsfc"]), (1, 4, "Manchester United", []),
    (1, 5, "Newcastle United", []), (2, 6, "Los Angeles Lakers", []),
]


def teams(spark):
    df = spark.createDataFrame(TEAMS, "sport_id bigint, team_id bigint, name string, aliases array<string>")
    return df.withColumn("search_key", X.search_key(F.col("name")))


def names(spark, *rows):
    return spark.createDataFrame([(1, n) for n in rows], "sport_id bigint, name string")


def test_resolve_teams(spark):
    out = R.resolve_teams(names(spark, "LOS ANGELES LAKERS!", "Reds F.C.", "LA Los Lakers", "Lakers", "United", "Zebra FC", ""), teams(spark))
    got = {r["name"]: (r["team_id"], r["matched_by"]) for r in out.collect()}
    assert got["LOS ANGELES LAKERS!"] == (1, "exact")
    assert got["Reds F.C."] == (3, "alias")
    assert got["LA Los Lakers"] == (1, "fuzzy")
    assert got["Lakers"] == (None, "new")
    assert got["United"] == (4, "fuzzy")
    assert got["Zebra FC"] == (None, "new") and "" not in got


def test_match_existing_never_guesses(spark):
    out = R.match_existing_teams(names(spark, "Crawley", "United", "Newcastle United FC", "Nobody"), teams(spark))
    got = {r["name"]: (r["team_id"], r["matched_by"]) for r in out.collect()}
    assert got["Crawley"] == (3, "contained")
    assert got["United"] == (None, "ambiguous")
    assert got["Newcastle United FC"] == (5, "contained")
    assert got["Nobody"] == (None, "none")


FEED = "provider string, external_id string, sport_id bigint, home_team_id bigint, away_team_id bigint, commence_at timestamp, position bigint"
EVENTS = "event_id bigint, sport_id bigint, home_team_id bigint, away_team_id bigint, commence_at timestamp"
LINKS = "provider string, external_id string, event_id bigint"


def resolved(spark, incoming, events, sources):
    out = R.resolve_events(spark.createDataFrame(incoming, FEED).repartition(5), spark.createDataFrame(events, EVENTS), spark.createDataFrame(sources, LINKS))
    return {r["position"]: (r["event_id"], r["new_event"], r["matched_by"], r["confidence"]) for r in out.collect()}


def one_by_one(incoming, events, sources):
    """The records in order, each against all events."""
    state = [{"id": e, "new": None, "sport": s, "home": h, "away": a, "at": t} for e, s, h, a, t in sorted(events, key=lambda e: e[0])]
    links = {}
    for p, x, e in sources:
        found = next((s for s in state if s["id"] == e), None)
        if found is None:
            found = {"id": e, "new": None, "sport": None, "home": None, "away": None, "at": None}
            state.append(found)
        links[p, x] = found
    out = {}
    for p, x, sport, home, away, at, position in sorted(incoming, key=lambda r: r[-1]):
        event, how = links.get((p, x)), "external_id"
        if event is None and home is not None and away is not None and at is not None:
            mine = [id(e) for (q, _), e in links.items() if q == p]
            near = [e for e in state if (e["sport"], e["home"], e["away"]) == (sport, home, away) and e["at"] is not None and abs(e["at"] - at) <= timedelta(hours=6) and id(e) not in mine]
            event = min(near, key=lambda e: (abs(e["at"] - at), e["at"]), default=None)
            how = "team_pair"
        if event is None:
            event, how = {"id": None, "new": f"{p}:{x}", "sport": sport, "home": home, "away": away, "at": at}, "new"
            state.append(event)
        else:
            event["at"] = at or event["at"]
            event["home"] = home if event["home"] is None else event["home"]
            event["away"] = away if event["away"] is None else event["away"]
        links[p, x] = event
        out[position] = (event["id"], event["new"], how, 0.9 if how == "team_pair" else 1.0)
    return out


def test_resolve_events(spark):
    t = datetime(2024, 3, 1, 18)
    incoming = [
        ("p", "known", 1, 1, 2, t, 0), ("p", "nearer", 1, 1, 2, t + timedelta(hours=1), 1), ("p", "near", 1, 1, 2, t + timedelta(hours=5), 2),
        ("p", "far", 1, 1, 2, t + timedelta(hours=24), 3), ("q", "claimed", 1, 3, 4, t, 4), ("p", "swap", 1, 2, 1, t, 5),
    ]
    events = [(10, 1, 1, 2, t), (11, 1, 3, 4, t), (12, 1, 1, 2, t + timedelta(hours=30, minutes=1))]
    got = resolved(spark, incoming, events, [("p", "known", 99), ("q", "other", 11)])
    assert got[0] == (99, None, "external_id", 1.0) and got[1] == (10, None, "team_pair", 0.9)
    assert [got[k][1:3] for k in (2, 3, 4, 5)] == [("p:near", "new"), ("p:far", "new"), ("q:claimed", "new"), ("p:swap", "new")]


def test_the_loser_of_a_contest_takes_the_other_event(spark):
    t = datetime(2024, 3, 1, 18)
    events = [(10, 1, 1, 2, t), (11, 1, 1, 2, t + timedelta(hours=3))]
    incoming = [("p", "a", 1, 1, 2, t + timedelta(hours=1), 0), ("p", "b", 1, 1, 2, t, 1), ("p", "c", 1, 1, 2, t, 2)]
    got = resolved(spark, incoming, events, [])
    assert [got[k][:3] for k in range(3)] == [(10, None, "team_pair"), (11, None, "team_pair"), (None, "p:c", "new")]


def test_records_of_one_batch_share_a_new_event(spark):
    t = datetime(2024, 3, 1, 18)
    incoming = [("p", "a", 1, 1, 2, t, 0), ("q", "b", 1, 1, 2, t + timedelta(hours=5), 1), ("r", "c", 1, 1, 2, t + timedelta(hours=10), 2), ("q", "d", 1, 1, 2, t, 3), ("s", "e", 1, 1, 2, t - timedelta(hours=5), 4)]
    got = resolved(spark, incoming, [], [])
    # The event moves with its records, so the third is in reach, and the last meets only the event of "d".
    assert [got[k][1:3] for k in range(5)] == [("p:a", "new"), ("p:a", "team_pair"), ("p:a", "team_pair"), ("q:d", "new"), ("q:d", "team_pair")]


@pytest.mark.parametrize("seed", range(4))
def test_events_as_one_by_one(spark, seed):
    rng = random.Random(seed)
    t = datetime(2024, 3, 1)
    when = lambda: None if rng.random() < 0.05 else t + timedelta(hours=rng.choice([1, 1, 30]) * rng.randrange(40), minutes=30 * rng.randrange(2))
    team = lambda: None if rng.random() < 0.08 else rng.randrange(2)
    events = [(i, rng.randrange(2), team(), team(), when()) for i in range(60)]
    sources, seen = [], set()
    for i in range(40):
        key = (rng.choice("pqr"), f"x{rng.randrange(120)}")
        if key not in seen:
            seen.add(key)
            sources.append((*key, rng.choice([rng.randrange(60), 1000 + i])))
    incoming = [(rng.choice("pqr"), f"x{rng.randrange(220)}", rng.randrange(2), team(), team(), when(), k) for k in range(300)]
    assert resolved(spark, incoming, events, sources) == one_by_one(incoming, events, sources)


def test_a_placeholder_pair_streams_by(spark):
    """Many records of one pair at a few times: each is placed without looking at all others."""
    t = datetime(2024, 3, 1)
    incoming = [("pq"[k % 2], f"x{k}", 1, 1, 2, t + timedelta(minutes=k % 50), k) for k in range(20000)]
    got = resolved(spark, incoming, [], [])
    assert len(got) == 20000 and len({v[1] for v in got.values()}) == 10000


def test_cluster_anchor_is_first_seen(spark):
    t = datetime(2024, 3, 1, 12)
    rows = [(0, 5, "a"), (1, 0, "b"), (2, 10, "c"), (3, 12, "d"), (4, 5, "e")]
    df = spark.createDataFrame(
        [("nfl", "A B", "C", t + timedelta(hours=h), p, k) if p % 2 else ("nfl", "C", "a-b", t + timedelta(hours=h), p, k) for p, h, k in rows],
        "sport_slug string, home_team string, away_team string, commence_at timestamp, position bigint, book_key string",
    )
    got = {tuple(r["books"]) for r in R.merge_clusters(R.cluster_feed_events(df)).collect()}
    assert got == {("a", "b", "c", "e"), ("d",)}


def test_clusters_are_looked_up_without_a_broadcast(spark):
    """File sizes tell little of the starts: the lookups must not reach the driver, however small they are thought to be."""
    rows = [("nfl", "A", "B", datetime(2024, 3, 1), 0, "a")]
    df = spark.createDataFrame(rows, "sport_slug string, home_team string, away_team string, commence_at timestamp, position bigint, book_key string")
    plan = R.cluster_feed_events(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Broadcast" not in plan


def anchors_in_order(starts):
    """Indices of the starts that begin a cluster, by the sequential fold."""
    found = []
    for k in sorted(range(len(starts)), key=lambda k: starts[k][1]):
        if all(abs(starts[k][0] - starts[a][0]) > R.EVENT_WINDOW_MICROS for a in found):
            found.append(k)
    return set(found)


@pytest.mark.parametrize("order", ["mixed", "forwards", "backwards", "zigzag"])
def test_anchors_over_many_blocks(spark, order, monkeypatch):
    rounds = []
    monkeypatch.setattr(R, "cut", lambda df: rounds.append(1) or cut(df))
    rng = random.Random(1)
    times = sorted({rng.randrange(600 * R.EVENT_WINDOW_MICROS) for _ in range(1500)})
    rank = {"mixed": lambda k: rng.random(), "forwards": lambda k: k, "backwards": lambda k: -k, "zigzag": lambda k: (k % 7, k)}[order]
    ranks = {k: n for n, k in enumerate(sorted(range(len(times)), key=rank))}
    starts = [(t, ranks[k]) for k, t in enumerate(times)]
    frame = spark.createDataFrame([("x", *s) for s in starts], "pair string, t bigint, first bigint").repartition(4)
    got = {r["t"] for r in R.feed_anchors(frame, ["pair"], width=8).collect()}
    assert got == {starts[k][0] for k in anchors_in_order(starts)}
    assert len(rounds) <= 5


def test_a_long_run_of_starts_takes_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(R, "cut", lambda df: rounds.append(1) or cut(df))
    hour = 3_600_000_000
    frame = spark.range(100_000).select(F.lit("tbd").alias("pair"), (F.col("id") * hour).alias("t"), F.col("id").alias("first"))
    got = sorted(r["t"] // hour for r in R.feed_anchors(frame, ["pair"]).collect())
    assert got == list(range(0, 100_000, 7)) and len(rounds) <= 4


@pytest.mark.parametrize(
    "ticker, home, away, sub, want",
    [
        ("KX-G-DET", "Detroit Lions", "Chicago Bears", None, "home"), ("KX-G-TIE", "A", "B", None, "tie"), ("KX-G-XX", "Ajax", "Bayern", "Reg Time: Ajax", "home"),
        ("KX-G-CHI", "Chicago Cubs", "Chicago Sox", None, None), ("KX", "A", "B", "", None), ("KX-G-X", "Ajax", "Bayern", "Draw", "tie"),
    ],
)
def test_outcome_side(spark, ticker, home, away, sub, want):
    df = spark.createDataFrame([(ticker, home, away, sub)], "t string, h string, a string, s string")
    assert df.select(X.outcome_side(*[F.col(c) for c in "thas"])).collect()[0][0] == want


def test_text_helpers(spark):
    df = spark.createDataFrame([("Arsenal vs. Spurs Winner?", "€1.20bn", "7-Day-IL out", "my Big_list (x)")], "t string, v string, i string, s string")
    r = df.select(
        X.fixture_sides(F.col("t")).alias("f"), X.market_value(F.col("v")).alias("v"), X.injury_severity(F.col("i")).alias("i"), X.list_slug(F.col("s")).alias("s"),
        X.title_label(F.lit("pageViews_total")).alias("l"), X.line_key(F.lit(4.5)).alias("k"), X.line_key(F.lit("4.50")).alias("k2"), X.line_key(F.lit(None).cast("double")).alias("k3"),
    ).collect()[0]
    assert (r["f"]["home"], r["f"]["away"]) == ("Arsenal", "Spurs")
    assert r["v"] == 1_200_000_000 and r["i"] == 0.8 and r["s"] == "my-big_list-x" and r["l"] == "Page Views Total"
    assert r["k"] == r["k2"] == "4.5" and r["k3"] == ""


def joined_rows(df):
    """The most rows that a join of the executed plan made."""
    df.collect()
    found, todo = [0], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        if "Join" in name and node.metrics().contains("numOutputRows"):
            found.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return max(found)


def test_a_shared_last_word_pairs_no_league(spark):
    names = spark.createDataFrame([(1, f"n{i} united", f"n{i}united") for i in range(200)] + [(1, "united", "united")], "sport_id bigint, name string, key string")
    teams = spark.createDataFrame([(1, i, f"t{i} united", f"t{i}united") for i in range(200)] + [(1, 500, "united", "x")], "sport_id bigint, team_id bigint, name string, search_key string")
    fuzzy = R.fuzzy_matches(names, teams)
    rows = {r["name"]: (r["team_id"], round(r["score"], 6)) for r in fuzzy.collect()}
    assert rows == {"united": (500, 1.0)} | {f"n{i} united": (500, 0.7) for i in range(200)}
    assert joined_rows(fuzzy) <= 1000
    contained = R.contained_matches(names, teams)
    rows = {r["name"]: (r["candidates"], r["team_id"]) for r in contained.collect()}
    assert rows == {"united": (201, 0)} | {f"n{i} united": (1, 500) for i in range(200)}
    assert joined_rows(contained) <= 1000
