import hashlib
import re

from pyspark.sql import functions as F

from marketlens.llm import fingerprints as fp


def shingles(text):
    words = [w for w in re.split(r"[ \t-\r]+", text) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_documents(unique):
    rows = {r["doc_id"]: r for r in fp.document_fingerprints(unique).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in unique.collect()}
    ids = sorted(texts)
    assert set(rows) == set(texts)
    for k, i in enumerate(ids):
        text, follow = texts[i], texts[ids[(k + 1) % len(ids)]]
        moved = len(text) // 4
        edited = text[: len(text) - moved] + follow[:moved]
        r = rows[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for other, near in ((edited, r["near_edited"]), (follow, r["near_next"])):
            a, b = shingles(text), shingles(other)
            exact = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(near - exact) <= (0.2 if len(a | b) > fp.SKETCH else 1e-9)
        if len(shingles(text)) < fp.SKETCH:
            assert r["n_shingles"] == len(shingles(text))
        else:
            assert abs(r["n_shingles"] / len(shingles(text)) - 1) < 0.4
    same = {}
    for i, t in texts.items():
        same.setdefault(t, set()).add(rows[i]["fingerprint"])
    assert all(len(s) == 1 for s in same.values())


def test_windows_of_any_width(unique):
    wide = sorted(map(str, fp.document_fingerprints(unique).collect()))
    rows = fp.with_next(unique.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), ["text"], rows_per_window=2)
    by_id = {r["doc_id"]: r for r in rows.collect()}
    ids = sorted(by_id)
    assert all(by_id[i]["next_text"] == by_id[ids[(k + 1) % len(ids)]]["text"] for k, i in enumerate(ids))
    assert len(wide) == len(ids)


def test_merge_and_containment(spark):
    a, b = set(range(0, 900)), set(range(300, 1500))
    frame = spark.createDataFrame([(sorted(a), sorted(b))], "a array<long>, b array<long>")
    hashed = lambda c: F.transform(c, lambda x: F.xxhash64(x))
    frame = frame.select(*[fp.bottom(hashed(F.col(c))).alias(c) for c in "ab"], fp.bottom(hashed(F.concat("a", "b"))).alias("u"))
    r = frame.select(
        (fp.merge(F.col("a"), F.col("b")) == F.col("u")).alias("same"), fp.resemblance(F.col("a"), F.col("b")).alias("j"),
        fp.containment(F.col("a"), F.col("b")).alias("c"), fp.distinct_count(F.col("u")).alias("n"),
    ).first()
    assert r["same"] and abs(r["j"] - 0.4) < 0.15 and abs(r["c"] - 2 / 3) < 0.25 and abs(r["n"] / 1500 - 1) < 0.3


def test_odd_cases(odd, empty):
    rows = fp.document_fingerprints(odd)
    assert rows.count() == odd.count()
    assert fp.document_fingerprints(empty).count() == 0
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_clumped_and_null_ids_are_spread(spark):
    """Ids in clumps with one far away, ids that many rows bear, and null ids: no range takes more than its share."""
    ids = [*range(2000), *range(10**9, 10**9 + 500), 10**15, *[77] * 800, *[None] * 1200]
    rows = [(i, f"text {k}") for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sizes = sorted(r["count"] for r in docs.groupBy(fp.ranges_of(docs, 100).alias("r")).count().collect())
    assert len(sizes) > 60 and sizes[-1] <= 400
    found = fp.with_next(docs, ["doc_id", "text"], rows_per_window=100).collect()
    follow = {r["text"]: r["next_text"] for r in found}
    assert len(found) == len(rows) and len(set(follow.values())) == len(rows)
    by_text = {t: i for i, t in rows}
    order, at = [], next(t for i, t in rows if i == 10**15)
    for _ in rows:
        at = follow[at]
        order.append(by_text[at])
    assert order == sorted(ids, key=lambda i: (i is not None, i or 0))
