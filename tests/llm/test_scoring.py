import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from marketlens.llm import scoring


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


class Model:
    """The same model counted with dictionaries."""

    def __init__(self, texts, order):
        self.order, self.plain = order, Counter(w for t in texts for w in t)
        self.counts = {order: Counter(g for t in texts for g in self.runs(t))}
        for k in range(order - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.cuts = {k: self.cut(c) for k, c in self.counts.items()}
        self.contexts = {k: {} for k in self.counts}
        for k, c in self.counts.items():
            for g, v in c.items():
                held = self.contexts[k].setdefault(g[:-1], [0, 0, 0, 0])
                held[0] += v
                held[min(v, 3)] += 1

    def runs(self, text):
        padded = ["<s>"] * (self.order - 1) + text
        return [tuple(padded[k : k + self.order]) for k in range(len(text))]

    @staticmethod
    def cut(counts):
        n1, n2, n3, n4 = (sum(v == k for v in counts.values()) for k in (1, 2, 3, 4))
        out = [0, 0.5, 1.0, 1.5]
        if n1 and n2:
            y = n1 / (n1 + 2 * n2)
            out[1:3] = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2
            out[3] = 3 - 4 * y * n4 / n3 if n3 else out[3]
        return [min(max(x, low), high) for x, low, high in zip(out, (0, 0.05, 0.05, 0.05), (0, 0.95, 1.95, 2.95))]

    def probability(self, run):
        p = 1 / (len(self.plain) + 1)
        for k in range(1, self.order + 1):
            held = self.contexts[k].get(run[-k:-1])
            if held:
                v = self.counts[k][run[-k:]]
                p = max(v - self.cuts[k][min(v, 3)], 0) / held[0] + sum(self.cuts[k][c] * held[c] for c in (1, 2, 3)) / held[0] * p
        return p


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


@pytest.mark.parametrize("order", [2, 3, 4])
@pytest.mark.parametrize("sample", [1, 1 << 40])
def test_brute_force(spark, unique, monkeypatch, order, sample):
    """With hot words spread and without."""
    for name, size in (("BATCH_BYTES", 3000), ("BUCKET_BYTES", 20000), ("LANE_BYTES", 40000), ("HOT_SAMPLE", sample)):
        monkeypatch.setattr(scoring, name, size)
    if sample == 1:
        assert len(scoring.frequent_words(unique.select("doc_id", "text")).hot) > 5
    texts = {r["doc_id"]: tokens(r["text"]) for r in unique.collect()}
    model = Model([t for i, t in texts.items() if not held(i)], order)
    n, v = sum(model.plain.values()), len(model.plain)
    rows = scoring.score(unique, order=order).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        t = texts[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held(r["doc_id"]), len(t), n)
        assert r["n_known"] == sum(model.plain[w] > 0 for w in t)
        assert math.isclose(r["base_score"], sum(math.log10((model.plain[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert math.isclose(r["score"], sum(math.log10(model.probability(g)) for g in model.runs(t)), rel_tol=1e-9)


def test_probabilities_sum_to_one(unique):
    model = Model([tokens(r["text"]) for r in unique.limit(8).collect()], 3)
    for context in list(model.contexts[3])[:20]:
        assert math.isclose(sum(model.probability((*context, w)) for w in [*model.plain, "unseen"]), 1, rel_tol=1e-9)


def test_held_out_beats_base(spark):
    rows = scoring.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").groupBy().sum("score", "base_score").first()
    assert rows[0] > rows[1]


def test_odd_cases(odd, empty, spark):
    rows = scoring.score(odd).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in odd.collect())
    assert scoring.score(empty).count() == 0
    lone = next(i for i in range(100) if held(i))
    got = scoring.score(spark.createDataFrame([(lone, "a b")], "doc_id long, text string")).first()
    assert (got["n_tokens"], got["n_known"], got["train_tokens"], got["score"], got["base_score"]) == (3, 0, 0, 0.0, 0.0)


def test_sums_travel_whole():
    """Sums of a bucket come out of their packed form to the last bit."""
    n = 1000
    rng = np.random.default_rng(4)
    sums = {"row": np.arange(n), "id": rng.integers(0, 10**6, n), "base": -rng.random(n) * 900, "score": -rng.random(n) * 900}
    found = scoring.unpacked_columns(scoring.unpack([scoring.pack(**{k: scoring.packed_column(k, v) for k, v in sums.items()})])[0])
    assert all(np.array_equal(found[k], v) for k, v in sums.items())
