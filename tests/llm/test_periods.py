import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from marketlens.llm import periods
from marketlens.llm.queries import op12_periods


def brute(words, least=12):
    """Every stretch of every period by definition: smallest period, not extendable."""
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            stretch = words[i : i + length]
            smaller = any(all(stretch[t] == stretch[t + d] for t in range(length - d)) for d in range(1, q))
            if length >= max(least, 2 * q) and not smaller:
                found.append((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def answer(doc_id, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    dropped = {i for start, length, q in runs for i in range(start + q, start + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (
        doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest(),
    )


@pytest.mark.parametrize("least", [2, 3, 5, 12])
def test_runs_by_definition(least):
    rng = random.Random(least)
    for _ in range(400):
        letters = rng.choice([1, 2, 3, 5])
        words = [rng.randrange(letters) for _ in range(rng.randrange(60))]
        if rng.random() < 0.6:
            a, p = rng.randrange(30), rng.randrange(1, 9)
            words = words[:a] + (words[a : a + p] or [0]) * rng.randrange(1, 9) + words[a:]
        assert periods.runs_of(np.array(words, np.int64), least) == brute(words, least)


def test_fibonacci_words():
    a, b = "a", "ab"
    while len(b) < 300:
        a, b = b, b + a
    words = [ord(c) for c in b]
    assert periods.runs_of(np.array(words), 2) == brute(words, 2)


def test_long_periodic_text():
    """A text of one repeated word and one of a long period take time in proportion to their length, or nearly."""
    assert periods.runs_of(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    period = np.random.default_rng(1).integers(0, 1 << 40, 40_000)
    assert periods.runs_of(np.unique(np.tile(period, 4), return_inverse=True)[1]) == [(0, 160_000, 40_000)]


def test_odd_rows(odd, empty):
    found = periods.digests(periods.find(periods.looped(odd)))
    short = {r["text"] for r in odd.collect() if r["text"] is None or len(r["text"]) < 20_000}
    want = sorted(map(repr, (answer(r["doc_id"], r["text"]) for r in odd.collect() if r["text"] in short)))
    ids = [r["doc_id"] for r in odd.collect() if r["text"] not in short]
    assert sorted(repr(tuple(r)) for r in found.collect() if r["doc_id"] not in ids) == want
    assert found.count() == odd.count()
    assert periods.digests(periods.find(periods.looped(empty))).count() == 0


def test_collapsed_text(spark):
    loop = "one two three " * 5 + "end"
    row = periods.find(spark.createDataFrame([(1, loop)], "doc_id long, text string")).first()
    assert (row["text"], row["n_words"], [tuple(r) for r in row["runs"]]) == ("one two three end", 16, [(0, 15, 3)])


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    small = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: tuple(r) for r in op12_periods(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(small)
    for doc_id, text in small:
        if len(text or "") < 6000:
            assert got[doc_id] == answer(doc_id, text)
    assert any(r[1] for r in got.values())
