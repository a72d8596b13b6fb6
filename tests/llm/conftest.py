"""A small table with every odd case: nulls, empty, blank and long texts, ties, repeated rows, clashing extra columns."""

import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in ("_id", "_hash", "_lane", "lane", "key", "task", "row", "part", "n_lines", "rows", "sketch", "c0")],
    ]
)


def prose(rng, words):
    vocabulary = ["alpha", "beta", "gamma", "delta", "Über", "the", "of", "and", "to", "x1", "naïve", "日本", "don't", "Σας"]
    text = []
    for i in range(words):
        text.append(rng.choice(vocabulary) + str(rng.randint(0, 400)) * (rng.random() < 0.5))
        text.append("\n" if i % 9 == 8 else " ")
    return "".join(text).strip()


def odd_rows():
    rng = random.Random(7)
    passage = prose(rng, 70)
    base = [prose(rng, n) for n in (3, 40, 120, 200, 90, 60)]
    near = base[3].split(" ")
    near[50] = "changed"
    texts = [
        *base, None, "", "   \n\t ", "word", "日本 語 の テキスト", "12 34 !!", base[2], base[2], " ".join(near),
        prose(rng, 30) + "\n" + passage, prose(rng, 25) + "\n" + passage + "\n" + prose(rng, 20), passage,
        prose(rng, 30000), "a" * 3000, "<|endoftext|> tail <|startoftext|>", "same\nline\nsame\nline\nsame\nline", "é" * 150 + " " + "é" * 150,
    ]
    rows = [(i, t, ("en", "fr", None)[i % 3], "s", None if t is None else len(t), *["x"] * 12) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (None, base[1], "en", None, 1, *[None] * 12), (None, None, None, None, None, *[None] * 12), (5, "other text of five words here", "en", "s", 9, *["y"] * 12)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def unique(spark):
    """The rows with different, non-null ids."""
    seen, rows = set(), []
    for r in odd_rows():
        if r[0] is not None and r[0] not in seen:
            seen.add(r[0])
            rows.append(r)
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
