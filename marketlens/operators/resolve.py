"""Entity resolution: teams, events, markets, selections and fixtures across providers."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketlens.functions.text import (
    FUZZY_THRESHOLD,
    fixture_sides,
    line_key,
    search_key,
    series_of,
    token_similarity,
    tokens,
    words,
)
from marketlens.session import cut

EVENT_WINDOW_MICROS = 6 * 3_600_000_000
# Ticker series of single games, the league they resolve in and the competition name.
GAME_SERIES = {
    "KXEPLGAME": ("epl", "Premier League"),
    "KXLALIGAGAME": ("laliga", "LaLiga"),
    "KXSERIEAGAME": ("seriea", "Serie A"),
    "KXBUNDESLIGAGAME": ("bundesliga", "Bundesliga"),
    "KXUCLGAME": ("ucl", "Champions League"),
    "KXUEFAGAME": ("ucl", "UEFA"),
    "KXUEFANLGAME": ("uefa-nations", "UEFA Nations League"),
    "KXEFLCUPGAME": ("epl", "EFL Cup"),
    "KXEFLL1GAME": ("epl", "EFL League One"),
    "KXCOPADELREYGAME": ("laliga", "Copa del Rey"),
    "KXEREDIVISIEGAME": ("epl", "Eredivisie"),
    "KXCZEFLGAME": ("epl", "Czech First League"),
    "KXLIGUE1GAME": ("epl", "Ligue 1"),
    "KXINTLFRIENDLYGAME": ("intl-friendly", "International Friendly"),
}


def distinct_names(names: DataFrame) -> DataFrame:
    """One row per (sport, trimmed name): repeats of a spelling are folded before anything is matched.

    The distinct spellings are checkpointed, so the matching steps below read the feed only once.
    """
    clean = names.select("sport_id", F.trim("name").alias("name")).filter(F.col("name") != "")
    return cut(clean.distinct().withColumn("key", search_key(F.col("name"))).filter(F.col("key") != ""))


def with_exact(names: DataFrame, teams: DataFrame) -> DataFrame:
    """Names with the team whose search key, or else a learned alias, equals theirs; the lowest id wins."""
    own = teams.select("sport_id", F.col("search_key").alias("key"), "team_id", F.lit(0).alias("rank"))
    learned = teams.select("sport_id", F.explode_outer("aliases").alias("key"), "team_id", F.lit(1).alias("rank"))
    keys = own.unionByName(learned).filter(F.col("key").isNotNull() & (F.col("key") != ""))
    best = keys.groupBy("sport_id", "key").agg(F.min(F.struct("rank", "team_id")).alias("exact"))
    return names.join(best, ["sport_id", "key"], "left")


def _how() -> Column:
    return F.when(F.col("exact.rank") == 0, "exact").otherwise("alias")


def _block(rows: DataFrame, rank: DataFrame, keep: list[str]) -> DataFrame:
    """One row per (row, prefix token): the rarest tokens beside the last that a match of Jaccard 0.5 must share one of."""
    exploded = rows.select(*keep, "sport_id", "tokens", "last", F.explode("others").alias("token"))
    ranked = exploded.join(rank, ["sport_id", "token"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    order = F.sort_array(F.collect_list(F.struct("n", "token")))
    size = F.size(order)
    # Of size + 1 tokens at least half are shared, the last one among them.
    shared = F.greatest(F.ceil((size + 1) / 2.0).cast("int") - 1, F.lit(1))
    grouped = ranked.groupBy(*keep, "sport_id", "tokens", "last").agg(F.slice(order, 1, size - shared + 1).alias("prefix"))
    return grouped.select(*keep, "sport_id", "tokens", "last", F.explode("prefix.token").alias("token"))


def fuzzy_matches(names: DataFrame, teams: DataFrame, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """Best team of similarity at least 0.7.

    Such a pair needs an equal last token and a token overlap of at least one half. If it shares another token, both sides
    meet in a block of (sport, last token, one of their rarest other tokens). If the last token is all it shares, one side
    has just this token and the other two at most; all such pairs of a last token score alike, so only the team with
    the lowest id is kept for each size. A common last word therefore never pairs a whole league.
    """

    def prepared(rows: DataFrame) -> DataFrame:
        rows = rows.filter(F.size("tokens") > 0).withColumn("last", F.element_at("tokens", -1))
        return rows.withColumn("others", F.array_except("tokens", F.array("last")))

    left = prepared(names.withColumn("tokens", tokens(F.col("name"))))
    right = prepared(teams.select("sport_id", "team_id", tokens(F.col("name")).alias("tokens")))
    rank = (
        right.select("sport_id", F.explode("others").alias("token")).groupBy("sport_id", "token").agg(F.count(F.lit(1)).alias("n"))
    )
    a = _block(left, rank, ["name", "key"])
    b = _block(right, rank, ["team_id"]).withColumnRenamed("tokens", "team_tokens")
    columns = ["sport_id", "name", "key", "team_id", "score"]
    score = token_similarity(F.col("tokens"), F.col("team_tokens")).alias("score")
    shared = a.join(b, ["sport_id", "last", "token"]).select(*columns[:-1], score)
    lowest = right.filter(F.size("others") < 2).withColumn("more", F.size("others"))
    lowest = lowest.groupBy("sport_id", "last", "more").agg(F.min(F.struct("team_id", "tokens")).alias("t"))
    lowest = lowest.select("sport_id", "last", "more", "t.team_id", F.col("t.tokens").alias("team_tokens"))
    short = left.filter(F.size("others") < 2).join(lowest, ["sport_id", "last"]).filter(F.size("others") + F.col("more") < 2)
    scored = shared.unionByName(short.select(*columns[:-1], score))
    # A pair may meet in several blocks; the aggregate keeps one best team either way.
    best = scored.filter(F.col("score") >= threshold).groupBy("sport_id", "name", "key").agg(
        F.max(F.struct("score", (-F.col("team_id")).alias("neg"))).alias("m")
    )
    return best.select("sport_id", "name", "key", (-F.col("m.neg")).alias("team_id"), F.col("m.score").alias("score"))


def resolve_teams(names: DataFrame, teams: DataFrame) -> DataFrame:
    """Team of every name: exact key, learned alias, best fuzzy match, else new (NULL id).

    Names are matched against the teams at batch start; names that found nothing share one new team per
    search key (``new_key``).
    """
    keyed = with_exact(distinct_names(names), teams)
    rest = keyed.filter(F.col("exact").isNull()).select("sport_id", "name", "key")
    near = fuzzy_matches(rest, teams).select("sport_id", "name", F.struct("team_id", "score").alias("near"))
    rows = keyed.join(near, ["sport_id", "name"], "left")
    known, close = F.col("exact").isNotNull(), F.col("near").isNotNull()
    return rows.select(
        "sport_id",
        "name",
        "key",
        F.coalesce("exact.team_id", "near.team_id").alias("team_id"),
        F.when(known, _how()).when(close, "fuzzy").otherwise("new").alias("matched_by"),
        F.when(known, F.lit(1.0)).otherwise(F.col("near.score")).alias("score"),
        F.when(~known & ~close, F.col("key")).alias("new_key"),
    )


def learn_aliases(teams: DataFrame, resolved: DataFrame) -> DataFrame:
    """Teams with the keys of new fuzzy matches added to their aliases."""
    learned = resolved.filter(F.col("matched_by") == "fuzzy").groupBy("team_id").agg(F.collect_set("key").alias("learned"))
    none = F.array().cast("array<string>")
    merged = F.sort_array(F.array_union(F.coalesce("aliases", none), F.coalesce("learned", none)))
    return teams.join(learned, "team_id", "left").withColumn("aliases", merged).drop("learned")


def contained_matches(names: DataFrame, teams: DataFrame) -> DataFrame:
    """How many teams contain the name's words, or are contained in them, with the lowest of their ids.

    Names and teams of one word meet folded counts per word. Among the others each side is blocked on its rarest word,
    which the containing side must hold, and candidate pairs are checked whole.
    """
    columns = ["sport_id", "name", "key"]
    left = names.withColumn("w", F.array_distinct(words(F.col("name")))).filter(F.size("w") > 0)
    right = teams.select("sport_id", "team_id", F.array_distinct(words(F.col("name"))).alias("tw")).filter(F.size("tw") > 0)
    held = right.select("sport_id", "team_id", "tw", F.explode("tw").alias("word"))
    counts = [F.count(F.lit(1)).alias("n"), F.min("team_id").alias("team_id")]
    freq = held.groupBy("sport_id", "word").agg(*counts)
    alone = held.filter(F.size("tw") == 1).groupBy("sport_id", "word").agg(*counts)

    def rarest(rows: DataFrame, arr: str, keep: list[str]) -> DataFrame:
        ex = rows.select(*keep, "sport_id", arr, F.explode(arr).alias("word")).join(freq.drop("team_id"), ["sport_id", "word"], "left")
        pick = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word"))["word"]
        return ex.groupBy(*keep, "sport_id", arr).agg(pick.alias("word"))

    one = left.filter(F.size("w") == 1).withColumn("word", F.col("w")[0]).join(freq, ["sport_id", "word"])
    many, large = left.filter(F.size("w") > 1), right.filter(F.size("tw") > 1)
    around_one = many.select(*columns, F.explode("w").alias("word")).join(alone, ["sport_id", "word"])
    needle = rarest(many, "w", ["name", "key"]).join(large.select("*", F.explode("tw").alias("word")), ["sport_id", "word"])
    inside = needle.filter(F.size(F.array_except("w", "tw")) == 0)
    hay = rarest(large, "tw", ["team_id"]).join(many.select("*", F.explode("w").alias("word")), ["sport_id", "word"])
    around = hay.filter(F.size(F.array_except("tw", "w")) == 0)
    # Equal word sets qualify on both sides, so distinct teams are counted.
    pairs = inside.select(*columns, "team_id").unionByName(around.select(*columns, "team_id")).distinct()
    found = pairs.select(*columns, F.lit(1).cast("bigint").alias("n"), "team_id")
    for folded in (one, around_one):
        found = found.unionByName(folded.select(*columns, "n", "team_id"))
    return found.groupBy(*columns).agg(F.sum("n").alias("candidates"), F.min("team_id").alias("team_id"))


def match_existing_teams(names: DataFrame, teams: DataFrame) -> DataFrame:
    """Team of every name without creating any; an ambiguous containment gives NULL and stops there."""
    keyed = with_exact(distinct_names(names), teams)
    rest = keyed.filter(F.col("exact").isNull()).select("sport_id", "name", "key")
    held = contained_matches(rest, teams).select("sport_id", "name", F.struct("candidates", "team_id").alias("held"))
    near = fuzzy_matches(rest, teams).select("sport_id", "name", F.col("team_id").alias("near_id"))
    rows = keyed.join(held, ["sport_id", "name"], "left").join(near, ["sport_id", "name"], "left")
    known, inside = F.col("exact").isNotNull(), F.col("held").isNotNull()
    single = F.col("held.candidates") == 1
    return rows.select(
        "sport_id",
        "name",
        "key",
        F.when(known, F.col("exact.team_id"))
        .when(inside, F.when(single, F.col("held.team_id")))
        .otherwise(F.col("near_id"))
        .alias("team_id"),
        F.when(known, _how())
        .when(inside, F.when(single, "contained").otherwise("ambiguous"))
        .when(F.col("near_id").isNotNull(), "fuzzy")
        .otherwise("none")
        .alias("matched_by"),
    )


class Fixtures:
    """The events of one group of records, in order of id and then of creation, found by start time."""

    def __init__(self) -> None:
        self.names: list[tuple[int | None, str | None]] = []
        self.starts: list[int | None] = []
        self.paired: list[bool] = []
        self.claims: list[set[str]] = []
        self.links: dict[tuple[str, str], int] = {}
        self.times: list[int] = []
        self.at: dict[int, list[int]] = {}
        self.passed: dict[int, dict[str, int]] = {}

    def add(self, event_id: int | None, name: str | None, start: int | None, paired: bool, claims: set[str]) -> int:
        self.names.append((event_id, name))
        self.starts.append(None)
        self.paired.append(False)
        self.claims.append(claims)
        self.update(len(self.names) - 1, start, paired)
        return len(self.names) - 1

    def update(self, event: int, start: int | None, paired: bool) -> None:
        """Moves an event to a known start time; once both teams are known it can be matched."""
        start = self.starts[event] if start is None else start
        paired = paired or self.paired[event]
        if paired and start is not None and (start != self.starts[event] or not self.paired[event]):
            if start not in self.at:
                insort(self.times, start)
                self.at[start] = []
            held = self.at[start]
            if held and held[-1] > event:
                insort(held, event)
                self.passed.pop(start, None)
            else:
                held.append(event)
        self.starts[event], self.paired[event] = start, paired

    def free(self, start: int, provider: str) -> int | None:
        """The first event at a time that the provider has not claimed. Claims and moves are for good, so the place is kept."""
        held, passed = self.at[start], self.passed.setdefault(start, {})
        k = passed.get(provider, 0)
        while k < len(held) and (self.starts[held[k]] != start or provider in self.claims[held[k]]):
            k += 1
        passed[provider] = k
        return held[k] if k < len(held) else None

    def nearest(self, start: int, provider: str) -> int | None:
        """The free event nearest in time within the window; of two equally near the earlier."""
        after = bisect_left(self.times, start)
        before = after - 1
        while True:
            left = start - self.times[before] if before >= 0 else EVENT_WINDOW_MICROS + 1
            right = self.times[after] - start if after < len(self.times) else EVENT_WINDOW_MICROS + 1
            if min(left, right) > EVENT_WINDOW_MICROS:
                return None
            found = self.free(self.times[before] if left <= right else self.times[after], provider)
            if found is not None:
                return found
            before, after = (before - 1, after) if left <= right else (before, after + 1)

    def record(self, provider: str, external_id: str, linked: int | None, start: int | None, paired: bool) -> tuple[int, str]:
        """The event of one record and how it was found."""
        event = linked if linked is not None else self.links.get((provider, external_id))
        how = "external_id"
        if event is None:
            event = self.nearest(start, provider) if paired and start is not None else None
            how = "new" if event is None else "team_pair"
        if event is None:
            event = self.add(None, f"{provider}:{external_id}", start, paired, set())
        else:
            self.update(event, start, paired)
        self.claims[event].add(provider)
        self.links[provider, external_id] = event
        return event, how


REPLAYED = ("grp", "is_record", "position", "provider", "external_id", "event_id", "start", "paired", "claims")
RESOLVED = {"provider": pa.string(), "external_id": pa.string(), "position": pa.int64(), "event_id": pa.int64(), "new_event": pa.string(), "matched_by": pa.string(), "confidence": pa.float64()}


def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records in feed order onto the events of their group; rows come sorted by group, stored events first."""
    group, fixtures, places = None, Fixtures(), {}
    for batch in batches:
        out = []
        for row in zip(*(batch.column(c).to_pylist() for c in REPLAYED)):
            key, is_record, position, provider, external_id, event_id, start, paired, claims = row
            if key != group:
                group, fixtures, places = key, Fixtures(), {}
            if not is_record:
                places[event_id] = fixtures.add(event_id, None, start, paired, set(claims))
                continue
            event, how = fixtures.record(provider, external_id, places.get(event_id), start, paired)
            out.append((provider, external_id, position, *fixtures.names[event], how, 0.9 if how == "team_pair" else 1.0))
        columns = [pa.array(values, kind) for values, kind in zip(zip(*out), RESOLVED.values())] if out else [pa.array([], kind) for kind in RESOLVED.values()]
        yield pa.RecordBatch.from_arrays(columns, names=list(RESOLVED))


def time_groups(spans: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """keys, ``bin``, ``since``: spans of time that follow each other within six hours form one group, known by its start.

    Spans are first folded to one per six-hour bin of their start, so the window holds no more than the bins of a key.
    """
    bins = spans.groupBy(*keys, F.floor(F.col(low) / EVENT_WINDOW_MICROS).alias("bin")).agg(F.min(low).alias("low"), F.max(high).alias("high"))
    earlier = W.partitionBy(*keys).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    up_to = W.partitionBy(*keys).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    reach = F.max("high").over(earlier)
    starts = bins.withColumn("head", F.when(reach.isNull() | (F.col("low") > reach + EVENT_WINDOW_MICROS), F.col("low")))
    return starts.select(*keys, "bin", F.max("head").over(up_to).alias("since"))


def resolve_events(incoming: DataFrame, events: DataFrame, sources: DataFrame) -> DataFrame:
    """Event of every provider record, as if the records came one by one in the order of ``position``.

    A record takes its stored link, or that of an earlier record with its id; else the nearest event of the same sport
    and teams within six hours that its provider has not claimed; else it makes a new event, known by ``new_event``, which
    later records of other providers may match. Every record moves its event to its own start time and fills in teams.

    What happens to an event depends only on records of its teams, and only on those that a chain of start times less than
    six hours apart leads to. Records are dealt by these groups and replayed in order, a group's rows streaming by; no group
    is gathered. Records and events without teams or times, and links to events that are not there, meet only their own id.
    """
    pair = ["sport_id", "home_team_id", "away_team_id"]
    links = sources.select("provider", "external_id", F.col("event_id").alias("linked"))
    rows = incoming.join(links, ["provider", "external_id"], "left").withColumn("start", F.unix_micros("commence_at"))
    # One entity per linked event, and per id that is not linked; its teams are the first that are known.
    entity = F.coalesce(F.concat(F.lit("="), F.col("linked").cast("string")), F.concat_ws(":", "provider", "external_id"))
    rows = cut(rows.select("provider", "external_id", "position", *pair, "start", "linked", entity.alias("entity")))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("position")))
    heard = rows.groupBy("entity").agg(*[first(c).alias(c) for c in pair], F.min("start").alias("low"), F.max("start").alias("high"), F.min("linked").alias("linked"))
    claims = sources.groupBy("event_id").agg(F.collect_set("provider").alias("claims"))
    known = events.withColumn("entity", F.concat(F.lit("="), F.col("event_id").cast("string"))).withColumn("start", F.unix_micros("commence_at"))
    known = known.join(claims, "event_id", "left").select("event_id", "entity", *pair, "start", "claims")
    ours = heard.select("entity", *[F.col(c).alias(f"_{c}") for c in pair], "low", "high", "linked", F.lit(True).alias("heard"))
    both = known.join(ours, "entity", "full")
    both = both.select(
        "entity", F.coalesce("event_id", "linked").alias("event_id"), "start", "claims", F.coalesce("heard", F.lit(False)).alias("heard"),
        (F.col("home_team_id").isNotNull() & F.col("away_team_id").isNotNull()).alias("paired"),
        (F.col("event_id").isNull() & F.col("linked").isNotNull()).alias("lost"),
        *[F.coalesce(c, f"_{c}").alias(c) for c in pair],
        F.least("start", "low").alias("low"), F.greatest("start", "high").alias("high"),
    )
    together = F.col("low").isNotNull() & ~F.col("lost")
    for c in pair:
        together = together & F.col(c).isNotNull()
    spans = time_groups(both.filter(together), pair, "low", "high")
    grouped = both.withColumn("bin", F.when(together, F.floor(F.col("low") / EVENT_WINDOW_MICROS))).join(spans, [*pair, "bin"], "left")
    name = F.when(F.col("since").isNotNull(), F.concat_ws("|", *pair, "since")).otherwise(F.col("entity"))
    grouped = cut(grouped.select("entity", "event_id", "start", "claims", "paired", "heard", name.alias("grp")))
    stored = grouped.filter(F.col("event_id").isNotNull()).join(grouped.filter("heard").select("grp").distinct(), "grp", "left_semi")
    none = F.lit(None).cast("string")
    stored = stored.select(
        "grp", F.lit(False).alias("is_record"), F.col("event_id").alias("position"), none.alias("provider"), none.alias("external_id"),
        "event_id", "start", "paired", F.coalesce("claims", F.array().cast("array<string>")).alias("claims"),
    )
    asked = rows.join(grouped.select("entity", "grp", "event_id"), "entity").select(
        "grp", F.lit(True).alias("is_record"), "position", "provider", "external_id", "event_id", "start",
        (F.col("home_team_id").isNotNull() & F.col("away_team_id").isNotNull()).alias("paired"), F.array().cast("array<string>").alias("claims"),
    )
    line = stored.unionByName(asked).repartition("grp").sortWithinPartitions("grp", "is_record", "position")
    return line.mapInArrow(replay, "provider string, external_id string, position bigint, event_id bigint, new_event string, matched_by string, confidence double")


def pair_key(home: Column, away: Column) -> Column:
    return F.array_sort(F.array(search_key(home), search_key(away)))


UNDECIDED, ANCHOR, COVERED = 0, 1, 2
#: Six-hour bins of one block in the first round, and how much wider blocks grow from round to round.
BLOCK_BINS, WIDER = 1024, 8


def decide_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What can be told about the start times of each block, which come sorted by block and feed order.

    A start near an earlier anchor is covered; one near an earlier start that is open yet stays open, as do the starts lent
    by neighbouring blocks; any other is an anchor. A six-hour bin holds at most one anchor.
    """
    reach, block = EVENT_WINDOW_MICROS, None
    anchors: dict[int, int] = {}
    lowest: dict[int, int] = {}
    highest: dict[int, int] = {}
    for batch in batches:
        found = []
        for key, t, state, lent in zip(*(batch.column(c).to_pylist() for c in ("grp", "t", "state", "lent"))):
            if key != block:
                block, anchors, lowest, highest = key, {}, {}, {}
            b = t // reach
            if state == UNDECIDED:
                if any(abs(anchors[k] - t) <= reach for k in (b - 1, b, b + 1) if k in anchors):
                    state = COVERED
                elif lent or b in lowest or highest.get(b - 1, t - reach - 1) >= t - reach or lowest.get(b + 1, t + reach + 1) <= t + reach:
                    lowest[b], highest[b] = min(t, lowest.get(b, t)), max(t, highest.get(b, t))
                else:
                    state = ANCHOR
            if state == ANCHOR:
                anchors[b] = t
            found.append(state)
        place = batch.schema.get_field_index("state")
        told = batch.set_column(place, batch.schema.field(place), pa.array(found, pa.int32()))
        yield told.filter(pc.and_(pc.invert(told.column("lent")), pc.not_equal(told.column("state"), COVERED)))


def feed_anchors(starts: DataFrame, keys: list[str], width: int = BLOCK_BINS) -> DataFrame:
    """The start times (keys, t, first) that begin a cluster: in order of ``first``, those with no anchor within six hours.

    Time is cut into blocks; each lends its outer starts to its neighbours and decides what doesn't depend on an open one
    of these. A round widens the blocks for what is left, so that even starts in order of time take few rounds, and a
    usual feed takes one.
    """
    state = cut(starts.withColumn("state", F.lit(UNDECIDED)).withColumn("bin", F.floor(F.col("t") / EVENT_WINDOW_MICROS)))
    while True:
        block, place = F.floor(F.col("bin") / width), F.pmod(F.col("bin"), F.lit(width))
        own = state.withColumn("block", block).withColumn("lent", F.lit(False))
        lent = state.filter(place == width - 1).withColumn("block", block + 1).unionByName(state.filter(place == 0).withColumn("block", block - 1))
        rows = own.unionByName(lent.withColumn("lent", F.lit(True))).withColumn("grp", F.struct(*keys, "block"))
        rows = rows.repartition("grp").sortWithinPartitions("grp", "first")
        state = cut(rows.mapInArrow(decide_starts, rows.schema).drop("block", "lent", "grp"))
        if state.filter(F.col("state") == UNDECIDED).isEmpty():
            return state.select(*keys, "t", "first", "bin")
        width *= WIDER


def cluster_feed_events(feed: DataFrame) -> DataFrame:
    """Records of one fixture from several books: same league and team pair within six hours of the first.

    ``position`` is the feed order. Only the distinct start times of a pair matter, in order of first appearance: those that
    begin a cluster are found in rounds over blocks of time, every start time looks up the earliest of these within
    reach in three bins, and every record its start time. Neither the records nor the starts of a pair are gathered. Both
    lookups grow with the feed, though size estimates from its files are small, so they are merged, not broadcast.
    """
    rows = feed.filter(F.col("commence_at").isNotNull()).withColumn("pair", pair_key(F.col("home_team"), F.col("away_team")))
    keys = ["sport_slug", "pair"]
    starts = rows.groupBy(*keys, F.unix_micros("commence_at").alias("t")).agg(F.min("position").alias("first"))
    starts = cut(starts)
    anchors = feed_anchors(starts, keys).select(*keys, "bin", F.col("t").alias("anchor"), F.col("first").alias("rank"))
    near = F.explode(F.array(*[F.floor(F.col("t") / EVENT_WINDOW_MICROS) + F.lit(d) for d in (-1, 0, 1)]))
    reach = starts.withColumn("bin", near).join(anchors.hint("merge"), [*keys, "bin"]).filter(F.abs(F.col("anchor") - F.col("t")) <= EVENT_WINDOW_MICROS)
    lookup = reach.groupBy(*keys, "t").agg(F.min_by("anchor", "rank").alias("anchor"))
    lookup = lookup.select(*keys, F.timestamp_micros("t").alias("commence_at"), F.timestamp_micros("anchor").alias("anchor_at"))
    day = F.date_format("anchor_at", "yyyy-MM-dd")
    return rows.join(lookup.hint("merge"), [*keys, "commence_at"]).withColumn(
        "merged_id", F.concat_ws(":", "sport_slug", F.array_join("pair", "-"), day)
    )


def merge_clusters(clustered: DataFrame) -> DataFrame:
    """One row per cluster: the first record describes it, the books of all are listed."""
    first = F.min_by(
        F.struct("home_team", "away_team", "commence_at"), F.struct("position", "book_key")
    )
    return clustered.groupBy("sport_slug", "pair", "anchor_at", "merged_id").agg(
        first.alias("first"),
        F.sort_array(F.collect_set("book_key")).alias("books"),
        F.count(F.lit(1)).alias("records"),
    ).select("merged_id", "sport_slug", "first.*", "books", "records")


def resolve_markets(incoming: DataFrame, markets: DataFrame) -> DataFrame:
    """Market id per (event, type, line, period, player); NULL marks a new market."""
    keys = ["event_id", "market_type", "line_key", "period", "player_name"]
    wanted = incoming.select(
        "event_id",
        "market_type",
        line_key(F.col("line")).alias("line_key"),
        F.coalesce("period", F.lit("full_game")).alias("period"),
        F.coalesce("player_name", F.lit("")).alias("player_name"),
    ).distinct()
    return wanted.join(markets.select(*keys, "market_id"), keys, "left")


def resolve_selections(incoming: DataFrame, selections: DataFrame) -> DataFrame:
    """Selection per (market, side, point): the newest label, and the team only where none is stored."""
    keys = ["market_id", "side", "point_key"]
    order = F.struct("position", "label")
    wanted = (
        incoming.withColumn("point_key", line_key(F.col("point")))
        .groupBy(*keys)
        .agg(F.max_by("label", order).alias("label"), F.max("team_id").alias("new_team"))
    )
    stored = selections.select(*keys, "selection_id", F.col("team_id").alias("old_team"))
    rows = wanted.join(stored, keys, "left")
    return rows.select(*keys, "selection_id", "label", F.coalesce("old_team", "new_team").alias("team_id"))


def series_lookup(df: DataFrame, ticker: str = "ticker") -> DataFrame:
    """Adds the league and competition of a game ticker; NULL when the series is not a game."""
    series = series_of(F.col(ticker))
    slug, name = None, None
    for key, (league, competition) in GAME_SERIES.items():
        slug = F.when(series == key, league) if slug is None else slug.when(series == key, league)
        name = F.when(series == key, competition) if name is None else name.when(series == key, competition)
    return df.select("*", series.alias("series"), slug.alias("sport_slug"), name.alias("competition"))


def resolve_fixtures(tickers: DataFrame, sports: DataFrame, teams: DataFrame, events: DataFrame) -> DataFrame:
    """Ticker to fixture: league grouping from the series, two clubs from the title, latest meeting of them.

    A club is looked up in every league of the grouping, in display order; the first league that knows it
    decides.
    """
    games = series_lookup(tickers).filter(F.col("sport_slug").isNotNull())
    parsed = games.withColumn("sides", fixture_sides(F.col("title"))).filter(F.col("sides").isNotNull())
    active = sports.filter("active")
    home_league = active.select("sport_slug", "grouping")
    named = parsed.join(home_league, "sport_slug").select(
        "ticker", "series", "sport_slug", "competition", "grouping", "sides.home", "sides.away"
    )
    clubs = (
        named.select("grouping", F.explode(F.array("home", "away")).alias("name"))
        .distinct()
        .join(active.select("grouping", "sport_id", "position"), "grouping")
    )
    matched = match_existing_teams(clubs.select("sport_id", "name"), teams).filter(F.col("team_id").isNotNull())
    found = (
        clubs.withColumn("name", F.trim("name"))
        .join(matched.select("sport_id", "name", "team_id"), ["sport_id", "name"])
        .groupBy("grouping", "name")
        .agg(F.min_by("team_id", F.struct("position", "sport_id")).alias("team_id"))
    )
    home = found.select("grouping", F.col("name").alias("home"), F.col("team_id").alias("home_team_id"))
    away = found.select("grouping", F.col("name").alias("away"), F.col("team_id").alias("away_team_id"))
    latest = (
        events.filter(F.col("commence_at").isNotNull())
        .groupBy("home_team_id", "away_team_id")
        .agg(F.max(F.struct("commence_at", "event_id")).alias("e"))
    )
    rows = named.join(home, ["grouping", "home"], "left").join(away, ["grouping", "away"], "left")
    rows = rows.join(latest, ["home_team_id", "away_team_id"], "left")
    return rows.select(
        "ticker", "series", "competition", "sport_slug", "home", "away", "home_team_id", "away_team_id",
        F.col("e.event_id").alias("event_id"), F.col("e.commence_at").alias("commence_at"),
        (F.col("home_team_id").isNotNull() & F.col("away_team_id").isNotNull()).alias("matched"),
    )


def new_rows(resolved: DataFrame, id_column: str) -> DataFrame:
    return resolved.filter(F.col(id_column).isNull())


