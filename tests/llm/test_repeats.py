import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.llm import repeats, tables


def brute(rows, length=repeats.LENGTH):
    seen, out = set(), {}
    for key, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - length + 1):
            window = data[s : s + length]
            if window in seen:
                gone[s : s + length] = True
            seen.add(window)
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(gone) else 0
        out[key] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def compare(docs):
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()), key=lambda r: r[0])
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.dedup(docs).collect()}
    assert got == brute(rows)


def test_odd_texts(unique):
    compare(unique)


@pytest.mark.parametrize("hot", [None, 2, 6])
@pytest.mark.parametrize("seed", range(3))
def test_pasted_texts(spark, monkeypatch, seed, hot):
    """Texts pasted from shared and periodic pieces, over many batches, buckets and lanes, without and with hot anchors."""
    if hot:
        monkeypatch.setattr(repeats, "SAMPLE", 1)
        monkeypatch.setattr(repeats, "HOT_SPANS", hot)
    for where, name, size in ((tables, "BATCH_BYTES", 900), (repeats, "BUCKET_BYTES", 3000), (tables, "LANE_BYTES", 2500), (repeats, "STEP_BYTES", 500)):
        monkeypatch.setattr(where, name, size)
    rng = np.random.default_rng(seed)
    pieces = ["".join(rng.choice(list("abcdé "), n)) for n in rng.integers(20, 260, 12)] + ["ab" * 90, "x" * 130, "y" * 99, "z" * 100]
    rows = [(int(i), "".join(pieces[k] for k in rng.integers(0, len(pieces), rng.integers(0, 7)))) for i in rng.permutation(60)]
    compare(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))


def test_odd_cases(odd, empty):
    got = repeats.dedup(odd)
    assert got.columns == [*odd.columns, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    rows = got.collect()
    assert len(rows) == odd.count()
    copies = sorted(r["n_removed"] for r in rows if r["doc_id"] == 2)
    assert copies[0] < copies[1] == copies[2] == rows[0]["n_bytes"] * 0 + max(r["n_bytes"] for r in rows if r["doc_id"] == 2)
    assert repeats.dedup(empty).count() == 0


def test_family_keeps_the_first():
    rng = np.random.default_rng(4)
    family, seen = repeats.Family(), {}
    lost = []
    for batch in range(20):
        n = 50
        columns = {"anchor": rng.integers(0, 40, n).astype(np.uint64), "span": rng.integers(0, 3, n).astype(np.uint64), "order": rng.permutation(10**6)[:n]}
        columns |= {c: np.zeros(n, np.int64) for c in ("doc", "at", "back", "fore")}
        for a, s, o in zip(*(columns[c].tolist() for c in ("anchor", "span", "order")), strict=True):
            seen.setdefault((a, s), set()).add(o)
        family.add(columns)
        sizes = [len(level) for level in family.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))
    lost = repeats.joined(family.repeated)
    for (a, s), orders in seen.items():
        mine = lost["order"][(lost["anchor"] == a) & (lost["span"] == s)]
        assert sorted(mine.tolist()) == sorted(orders)[1:]


def surroundings(n, rng):
    """One line, and so one anchor, between different texts; some of these come again."""
    line = "this very line of the footer stands in each and every document of all"
    texts = ["".join(rng.choice(list("abcdefgh "), 70)) for _ in range(n)]
    return [(i, texts[i] + line + texts[(i * 7) % (n // 2)]) for i in range(n)]


def test_one_anchor_in_many_surroundings(spark, monkeypatch):
    """The windows beside a hot anchor are dealt to all buckets, in like shares."""
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 1 << 18)
    monkeypatch.setattr(tables, "LANE_BYTES", 1 << 18)
    rows = surroundings(10_000, np.random.default_rng(3))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    compare(docs)
    keyed = docs.withColumn("_hash", F.xxhash64("text"))
    assert len(repeats.hot_anchors(keyed)) > 0
    dealt = []
    monkeypatch.setattr(repeats, "compared_notes", lambda notes, buckets, inner=repeats.compared_notes: dealt.append(notes) or inner(notes, buckets))
    repeats.dedup(docs)
    kinds = [r for r in dealt[0].collect() if r["kind"] == repeats.WINDOWS]
    sizes = np.bincount([r["lane"] for r in kinds], [len(repeats.unpack([r["note"]])[0]["key"]) for r in kinds])
    assert len(sizes) > 5 and sizes.min() > 0.9 * sizes.mean() and sizes.max() < 1.1 * sizes.mean()


def test_hot_anchors_are_in_the_sample_by_their_spans(empty, spark, monkeypatch):
    line = "this very line of the footer stands in each and every document of all"
    rows = [(i, "w" * 40 + line + str(i) * 40) for i in range(40)] + [(100 + i, "copy" * 60) for i in range(40)]
    monkeypatch.setattr(repeats, "SAMPLE", 1)
    monkeypatch.setattr(repeats, "HOT_SPANS", 20)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert len(repeats.hot_anchors(docs.filter("doc_id < 100").withColumn("_hash", F.xxhash64("text")))) > 0
    assert len(repeats.hot_anchors(docs.filter("doc_id >= 100").withColumn("_hash", F.xxhash64("text")))) <= 8
    assert len(repeats.hot_anchors(empty.withColumn("_hash", F.xxhash64("text").cast("long")))) == 0


def test_slices_do_not_matter(monkeypatch):
    """The windows of an anchor give the same spans however few are compared at a time."""
    rng = np.random.default_rng(5)
    rows = [t.encode() for _, t in surroundings(200, rng)]
    runs = []
    for doc, text in enumerate(rows):
        found = repeats.anchors(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        runs += [(found["anchor"][k], doc, found["at"][k], found["back"][k], found["fore"][k], text) for k in range(len(found["at"]))]
    a = {n: np.array([r[k] for r in runs], np.uint64 if n == "anchor" else np.int64) for k, n in enumerate(("anchor", "id", "at", "back", "fore"))}
    a["hash"], a["size"] = a["id"], a["back"] - a["fore"] + repeats.LENGTH
    parts = [np.frombuffer(r[5], np.uint8)[b : b + z] for r, b, z in zip(runs, a["at"] - a["back"], a["size"])]
    a["text"] = np.concatenate(parts)
    want = None
    for limit in (300, 5000, 1 << 20):
        monkeypatch.setattr(repeats, "COMPARED_BYTES", limit)
        owner, start, stop = repeats.later_windows(a)
        spans = repeats.merged_spans(a["id"][owner], start, stop)
        got = sorted(zip(*(x.tolist() for x in spans)))
        want = want or got
        assert got == want and len(got) > 50
