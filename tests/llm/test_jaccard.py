import math
from collections import Counter

import numpy as np
import pytest

from marketlens.llm import components, jaccard

DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"


def shingles(text):
    words = (text or "").replace("\xa0", "_").split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    """(doc_id, class_id, n_links, n_text_links) by an inverted index."""
    sets = [shingles(t) for _, t in rows]
    texts = [t or "" for _, t in rows]
    holders, parent = {}, list(range(len(rows)))
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    out = []
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in holders[x] if j != i)
        near = {j for j, k in shared.items() if k / (len(s) + len(sets[j]) - k) >= 0.8}
        near |= {j for j, t in enumerate(texts) if j != i and t == texts[i]}
        for j in near:
            a, b = sorted((find(i), find(j)))
            parent[b] = a
        out.append((len(near), len({texts[j] for j in near} - {texts[i]})))
    return [(rows[i][0], rows[find(i)][0], *out[i]) for i in range(len(rows))]


def compare(docs):
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    got = sorted(map(tuple, jaccard.document_links(docs).collect()))
    assert got == sorted(brute(rows))


def test_documents(spark):
    compare(spark.read.parquet(DOCUMENTS))


def test_odd_texts(unique):
    compare(unique.na.fill({"text": ""}))


@pytest.mark.parametrize("part", [4, 16])
def test_large_parts_are_split(spark, monkeypatch, part):
    """A group of near copies far larger than a part, beside copies and strangers."""
    monkeypatch.setattr(jaccard, "PART", part)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 900, 120)]
    rows = []
    for i in range(70):
        words = list(base)
        words[int(rng.integers(0, 120))] = f"new{i}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, rows[0][1]) for i in range(5)]
    rows += [(200 + i, " ".join(f"v{x}" for x in rng.integers(0, 10**6, 80))) for i in range(20)]
    compare(spark.createDataFrame(rows, "doc_id long, text string"))


def test_one_per_class(odd, unique, empty):
    kept = jaccard.one_per_class(unique)
    assert kept.schema == unique.schema
    classes = {r[1] for r in brute(sorted((r["doc_id"], r["text"] or "") for r in unique.collect()))}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(classes)
    assert jaccard.document_links(odd).count() == odd.count()
    texts = [r["text"] or "" for r in jaccard.one_per_class(odd).collect()]
    assert len(texts) == len(set(texts))
    assert jaccard.document_links(empty).count() == 0 and jaccard.one_per_class(empty).count() == 0


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)]
    frame = spark.createDataFrame([(a.to_bytes(4, "big"), b.to_bytes(4, "big")) for a, b in edges], "a binary, b binary")
    got = {int.from_bytes(r["node"], "big"): int.from_bytes(r["root"], "big") for r in components.components(frame).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_signatures_lose_few_pairs():
    """Of pairs at the threshold, whose signature bytes agree with its probability, fewer than 1e-6 fall below MAYBE."""
    orders, p = jaccard.ORDERS, jaccard.THRESHOLD
    least = next(k for k in range(orders + 1) if k >= jaccard.MAYBE * orders)
    assert sum(math.comb(orders, k) * p**k * (1 - p) ** (orders - k) for k in range(least)) < 1e-6


def test_unlucky_signatures_are_compared(spark):
    """Signatures of a pair at the threshold that agree in 34 of 64 places still make an edge."""
    a = np.arange(64, dtype=np.uint8)
    b = a.copy()
    b[34:] += 100
    for texts in ([a, b], [a, b, a + 128]):
        rows = [(7, len(texts), bytes([i]), t.tobytes()) for i, t in enumerate(texts)]
        parts = spark.createDataFrame([(p, n, bytearray(k), bytearray(s)) for p, n, k, s in rows], "part long, n long, key binary, sketch binary")
        edges = [{bytes(r["a"]), bytes(r["b"])} for r in jaccard.candidate_edges(parts).collect()]
        assert edges == [{b"\0", b"\1"}]


def test_components_of_random_graphs(spark):
    """Classes are those of a union-find; hubs of the least, a middle and the largest number, paths and loops are there."""
    rng = np.random.default_rng(8)
    edges = [(0, i) for i in range(1, 300)] + [(900, i) for i in range(301, 600)] + [(700, i) for i in range(650, 750)]
    edges += [(i, i + 1) for i in range(1000, 1100)] + [(int(a), int(b)) for a, b in rng.integers(2000, 2300, (140, 2))] + [(5, 5), (3000, 3001), (3001, 3000)]
    root = {n: n for e in edges for n in e if e[0] != e[1]}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        if a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    order = rng.permutation(len(edges))
    found = components.components(spark.createDataFrame([edges[i] for i in order], "a long, b long")).collect()
    assert len(found) == len(root) and {r["node"]: r["root"] for r in found} == {n: find(n) for n in root}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
