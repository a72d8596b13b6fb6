import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from marketlens.llm import mining
from marketlens.llm.queries import op11_hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, v string, q int, b int, tag string, size int, length int"


def brute(rows, every=100, positives=5, negatives=10):
    good = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or not all(x is not None and math.isfinite(x) for x in v):
            continue
        whole = tuple(math.floor(256 * x) for x in v)
        if sum(x * x for x in whole) < 2**61:
            good[i, (label + 1) % 10 if i % 7 == 0 else label, whole] = True
    good = list(good)
    out = []
    for i, label, v in good:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, u)), j, m) for j, m, u in good if j != i and len(u) == len(v))
        for p, j, _ in [s for s in scored if s[2] == label][:positives]:
            hard = [(n, t) for n, t, m in scored if m != label and 30 * -p <= 100 * -n <= 90 * -p][:negatives]
            out += [(i, j, r + 1, t, -p, -n) for r, (n, t) in enumerate(hard)]
    return sorted(out)


def check(spark, rows, every=100, **sizes):
    frame = spark.createDataFrame([(i, v, label, "x", 1, 2, "t", 3, 4) for i, v, label in rows], SCHEMA).repartition(4)
    got = sorted(tuple(r) for r in mining.hard_negatives(frame, every=every, **sizes).collect())
    assert got == brute(rows, every)
    return got


def clustered(n, size, seed=1, scale=1.0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, size))
    rows = []
    for i in range(n):
        v = centers[rng.integers(12)] + rng.normal(size=size) * (0.05 if i % 2 else 1.0)
        rows.append((i, (v * scale * rng.lognormal(0, 0.5)).tolist(), int(rng.integers(4) if i % 5 else 0)))
    return rows


def test_brute_force(spark):
    assert check(spark, clustered(900, 16), 20)
    assert check(spark, clustered(700, 8, 2), 10, block=90, anchor_block=13)
    assert check(spark, clustered(300, 4, 3, scale=0.01), 10, block=50)  # many ties of small scores


def test_large_components(spark):
    assert check(spark, clustered(200, 8, 4, scale=1e4), 10)
    assert check(spark, clustered(200, 4, 5, scale=7e5), 10, block=64)  # beyond what doubles hold exactly
    check(spark, clustered(100, 4, 6, scale=1e7), 10)
    check(spark, [(i, [1e300, 1.0], 1) for i in range(5)] + clustered(40, 2), 10)


def test_odd_cases(spark):
    rows = clustered(80, 4)
    rows += [(100, None, 1), (101, [float("nan"), 1.0, 1.0, 1.0], 1), (102, [float("inf"), 0.0, 0.0, 0.0], 1), (103, [None, 1.0, 1.0, 1.0], 1), (None, [1.0] * 4, 1), (104, [1.0] * 4, None)]
    rows += [(200, [], 1), (201, [], 1), (202, [], 2), (300, [0.0] * 4, 1), (400, [1.0, 2.0], 1), (402, [1.0, 2.0], 1), (403, [0.5, 1.0], 2)]
    rows += [(i, rows[20][1], i % 3) for i in range(500, 560)] + [rows[20], rows[20], (-100, rows[20][1], 0), (-1, rows[20][1], 1)]
    assert check(spark, rows, 20, block=30)
    check(spark, rows[:1], 20)
    check(spark, [], 20)


def test_rows_of_one_id(spark):
    """Candidates each, never of their own id; as anchors they keep their own lists."""
    rows = clustered(60, 4) + [(5, [1.0, 2.0, 3.0, 4.0], 2), (20, [2.0, -1.0, 0.5, 1.0], 1)]
    assert check(spark, rows, 20, block=16)


@pytest.mark.parametrize("scale", [1e-2, 1.0, 1e4])
def test_bounds_hold_and_prune(scale):
    found = pd.DataFrame(columns=["vec_id", "tag", "label", "ints", "length", "angles"])
    rng = np.random.default_rng(7)
    centers = rng.normal(size=(5, 24))
    vectors = np.floor(256 * scale * (centers[rng.integers(5, size=400)] + 0.05 * rng.normal(size=(400, 24)))).astype("<i4")
    units = centers / np.linalg.norm(centers, axis=1, keepdims=True)
    lengths = np.linalg.norm(vectors.astype(float), axis=1)
    angles = np.arccos(np.clip(vectors @ units.T / np.maximum(lengths, 1e-300)[:, None], -1, 1))
    found["vec_id"] = found["tag"] = np.arange(400)
    found["label"], found["length"] = 0, lengths
    found["ints"], found["angles"] = [v.tobytes() for v in vectors], [a.astype("<f8").tobytes() for a in angles]
    side = mining.Side(found)
    low, high = mining.score_bounds(side, side)
    true = vectors.astype(np.int64) @ vectors.T.astype(np.int64)
    assert (low <= true).all() and (true <= high).all()
    if scale >= 1:
        assert np.median((high - low) / np.outer(lengths, lengths)) < 0.5


def test_window():
    for p in range(-200, 200):
        low, high = mining.window_of(p, 30, 90)
        assert [n for n in range(-400, 400) if 30 * p <= 100 * n <= 90 * p] == list(range(low, high + 1))


def test_query(spark):
    path = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in op11_hard_negatives(spark, path).collect())
    assert got and got == brute(rows)


def test_sql_gives_the_same_rows(spark):
    path = "/root/testdata/sf0.1"
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet'")
        want = sorted(db.execute(mining.ORACLE_SQL).fetchall())
    assert want and sorted(tuple(r) for r in op11_hard_negatives(spark, path).collect()) == want
