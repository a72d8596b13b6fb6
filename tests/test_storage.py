"""Tables in folders by day, snapshots of a history and the trigram index."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from marketlens.operators.logs import contains_any
from marketlens.operators.search import PART, TrigramIndex
from marketlens.sources import daytables
from marketlens.sources.daytables import History

BASE = datetime(2024, 1, 1)
LOG = "k bigint, price double, at timestamp, id bigint"


def files(path):
    return {f.relative_to(path).as_posix(): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_pruning_removes_old_days_and_rewrites_one(spark, tmp_path):
    path = tmp_path / "t"
    rows = [(i, BASE + timedelta(hours=i)) for i in range(240)] + [(999, None)]
    daytables.write_days(spark.createDataFrame(rows, "id bigint, at timestamp").coalesce(1), str(path), "at")
    before = files(path)
    cutoff = F.lit(BASE + timedelta(days=4, hours=7, minutes=30)).cast("timestamp")
    assert daytables.prune_days(spark, str(path), "at", cutoff) == 104
    assert sorted(r["id"] for r in spark.read.parquet(str(path)).collect()) == [*range(104, 240), 999]
    after = files(path)
    same = {f for f in before if before[f] == after.get(f)}
    assert {f.split("/")[0] for f in before} - {f.split("/")[0] for f in after} == {f"day=2024-01-0{d}" for d in range(1, 5)}
    assert {f.split("/")[0] for f in set(before) - same} == {f"day=2024-01-0{d}" for d in range(1, 6)}
    # Nothing goes the second time, and nothing is written.
    assert daytables.prune_days(spark, str(path), "at", cutoff) == 0 and files(path) == after
    assert daytables.prune_days(spark, str(path), "at", F.lit(BASE + timedelta(days=5)).cast("timestamp")) == 16
    assert daytables.prune_days(spark, str(tmp_path / "none"), "at", cutoff) == 0


def newest(rows, at):
    out = {}
    for k, price, t, i in sorted(rows, key=lambda r: (r[2], r[3])):
        if t <= at:
            out[k] = (price, t, i)
    return out


def test_reads_as_of_an_instant_start_from_a_snapshot(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randrange(9), float(rng.randrange(90)), BASE + timedelta(minutes=rng.randrange(60 * 24 * 24)), i) for i in range(600)]
    history = History(spark, str(tmp_path), ["k"], ["at", "id"])
    assert history.as_of(F.lit(BASE).cast("timestamp")) is None
    history.append(spark.createDataFrame(rows[:500], LOG))
    history.snapshot_every(5)
    read = {}
    for day in (0, 3, 9, 16, 23):
        at = BASE + timedelta(days=day, hours=13)
        found = history.as_of(F.lit(at).cast("timestamp"))
        assert {r["k"]: (r["price"], r["at"], r["id"]) for r in found.collect()} == newest(rows[:500], at)
        read[day] = len({f.rsplit("/", 2)[1] for f in found.inputFiles()})
    assert max(read.values()) <= 6
    history.append(spark.createDataFrame(rows[500:], LOG))  # late rows: snapshots after them no longer hold
    at = BASE + timedelta(days=20)
    assert {r["k"]: (r["price"], r["at"], r["id"]) for r in history.as_of(F.lit(at).cast("timestamp")).collect()} == newest(rows, at)
    history.snapshot_every(5)
    assert {r["k"]: (r["price"], r["at"], r["id"]) for r in history.as_of(F.lit(at).cast("timestamp")).collect()} == newest(rows, at)


def test_indexed_search_equals_a_scan(spark, tmp_path):
    rng = random.Random(2)
    words = ["alpha", "Über", "日本語", "😀😀x", "line\nbreak", "a.b", "100%", "don't", "ΣΑΣ", ""]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(6))), rng.choice([None, "Tail", f"u{i}"])) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, text string, url string")
    index = TrigramIndex(spark, str(tmp_path), "id", ["text", "url"], parts=32, shards=8)
    index.build(df)
    for needle in ("alp", "ÜBER", "日本語", "😀😀X", "e\nb", "a.b ", "0% ", "n't", "tail", "U29", "u1", "zzz", "x", ""):
        want = {r["id"] for r in df.filter(contains_any(["text", "url"], needle)).collect()}
        assert {r["id"] for r in index.search(needle).collect()} == want, needle
    assert PART not in index.search("alpha").columns
    # A rare needle reads one part, of a table in many.
    assert index.candidates("u299").select("part").distinct().count() == 1 and len(list((tmp_path / "rows").glob("*=*"))) == 32
