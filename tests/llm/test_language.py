from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from marketlens.llm import language
from marketlens.llm.tables import text_buffer

DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DOCUMENTS)
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 100 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_runs_and_products():
    """Products from counted runs equal those of the summed vectors."""
    import pyarrow as pa

    texts = ["Ab c", "", "é1é", "no letters: none", "..", "日本"]
    runs, rows = language.text_runs(*text_buffer(pa.array(texts)))
    symbols = lambda t: [0, *[x for k, x in enumerate(s) if x or (k and s[k - 1])], 0] if (s := [int(language.symbol_table()[ord(c)]) for c in t]) is not None else []
    for i, text in enumerate(texts):
        s = symbols(text)
        want = [a * 16384 + b * 128 + c for a, b, c in zip(s, s[1:], s[2:]) if a + b and b + c]
        assert runs[rows == i].tolist() == want
    prototypes = {"x": np.random.default_rng(1).normal(size=language.DIMENSIONS)}
    prototypes["x"] /= np.linalg.norm(prototypes["x"])
    _, score = language.Profiles(prototypes).predict(*text_buffer(pa.array(texts)))
    mine = runs[rows == 3]
    vector = language.run_vectors(mine).astype(float).sum(axis=0)
    length = np.sqrt(language.DIMENSIONS * sum(n * n for n in Counter(mine.tolist()).values()))
    assert abs(score[3] - max(0, vector @ prototypes["x"] / length)) < 1e-5


def test_odd_cases(odd, empty):
    rows = language.identify(odd).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in odd.collect())
    for r in odd.filter("doc_id is not null").collect():
        known = any(c.isalpha() for c in r["text"] or "")
        got = {x["lang_pred"] for x in rows if x["doc_id"] == r["doc_id"]}
        assert got <= {"en", "fr", "und"} and ("und" not in got or not known or r["doc_id"] == 5)
        assert known or got == {"und"}
    assert language.identify(empty).count() == 0
    nothing = language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in nothing} == {("und", 0.0)}


def test_filter(odd, empty):
    kept = language.filter_languages(odd)
    assert kept.schema == odd.schema
    want = Counter(str(r) for r in odd.collect() if any(c.isalpha() for c in r["text"] or ""))
    assert Counter(str(r) for r in kept.collect()) == want
    assert language.filter_languages(empty).count() == 0


def test_filter_without_usable_labels(odd):
    """Texts with letters stay if no row has a language, or only rows that identify() would hold out."""
    want = sorted(str(r["text"]) for r in odd.collect() if any(c.isalpha() for c in r["text"] or ""))
    nothing = F.lit(None).cast("string")
    for lang in (nothing, F.when(language.held_out(4, 2), F.col("lang")).otherwise(nothing)):
        kept = language.filter_languages(odd.withColumn("lang", lang))
        assert kept.columns == odd.columns
        assert sorted(str(r["text"]) for r in kept.collect()) == want
