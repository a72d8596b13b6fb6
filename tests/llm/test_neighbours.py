import math

import numpy as np

from marketlens.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, v string, q int, part int"


def brute(rows, every, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in good:
        if i % every == 0:
            found = sorted((-float((v * u).sum()), j) for j, u in good if j != i and len(u) == len(v))
            out[i] = [(j, -s) for s, j in found[:k]]
    return out


def check(spark, rows, every, k, kind="float", **sizes):
    frame = spark.createDataFrame([(i, v, 0, "x", 1, 2) for i, v in rows], SCHEMA.replace("float", kind)).repartition(4)
    got = {}
    for r in neighbours.nearest(frame, frame.filter(f"vec_id % {every} = 0"), k, **sizes).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = {i: found for i, found in brute(rows, every, k).items() if found}
    assert set(got) == set(want)
    for i, found in want.items():
        assert [(r, j) for r, j, _ in got[i]] == [(n + 1, j) for n, (j, _) in enumerate(found)]
        assert np.allclose([s for *_, s in got[i]], [s for _, s in found], rtol=1e-12, atol=1e-15)


def vectors(n, size, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, rng.normal(size=size).astype(np.float32).tolist()) for i in range(n)]


def test_brute_force(spark):
    check(spark, vectors(700, 16), 20, 20)
    check(spark, vectors(700, 16), 10, 5, block=60, query_block=17)


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "FAN_IN", 3)
    check(spark, vectors(400, 8), 20, 7, block=20, query_block=5)


def test_odd_cases(spark):
    rows = vectors(60, 4)
    rows += [(60, None), (61, [0.0] * 4), (80, [float("nan"), 1.0, 1.0, 1.0]), (100, [float("inf"), 1.0, 1.0, 1.0]), (62, [None, 1.0, 1.0, 1.0]), (None, [1.0] * 4), (63, []), (120, [1.0, 2.0]), (64, [3.0, 1.0])]
    rows += [(i, rows[0][1]) for i in range(200, 260)] + [(i, [2.0**-100, 2.0**60, 5.0, -2.0]) for i in (300, 301)]
    check(spark, rows, 20, 20, block=50)
    check(spark, rows[:1], 20, 20)
    check(spark, [], 20, 20)


def test_bounds_hold():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(200, 32)) * rng.lognormal(0, 3, (200, 1))
    copies, scale, near, rest = neighbours.quantized(a)
    assert np.abs(copies).max() <= 127 and (copies == np.rint(copies)).all()
    products = (copies @ copies.T) * scale[:, None] * scale
    bound = rest[:, None] * np.linalg.norm(a, axis=1) + near[:, None] * rest
    assert (np.abs(products - a @ a.T) <= bound * (1 + 1e-9) + 1e-9 * np.abs(a @ a.T).max()).all()


def near_ties(n, size, seed):
    """Whole numbers whose products differ by little, beside a common part that makes them large."""
    rng = np.random.default_rng(seed)
    common = rng.integers(100, 128, size)
    return [(i, (common + rng.integers(-2, 3, size)).astype(float).tolist()) for i in range(n)]


def test_many_components():
    for size in (2048, 8192):
        rows = near_ties(600, size, size)
        base, ids = np.array([v for _, v in rows]), np.arange(600)
        want = base[:10] @ base.T  # whole numbers, exact
        for i, found, scores in neighbours.best_of_block(base[:10], ids[:10], base, ids, 20):
            order = [j for j in np.lexsort([ids, -want[i]]).tolist() if j != i][:20]
            assert found == order and scores == want[i][order].tolist()


def test_huge_and_tiny_values(spark):
    big = [(i, [x * 2.0**500 for x in v]) for i, v in vectors(80, 6, 2)]
    check(spark, big, 20, 7, "double", block=30)
    check(spark, [(i, [x * 2.0**-450 for x in v]) for i, v in vectors(80, 6, 3)], 20, 7, "double")
    mixed = [(i, [x * 2.0 ** (i % 5 * 90) for x in v]) for i, v in vectors(80, 6, 4)]
    check(spark, mixed, 20, 7, "double", block=30)


def test_rows_of_one_id(spark):
    rows = vectors(50, 4) + [(20, [5.0, -1.0, 2.0, 0.5]), (7, [1.0, 1.0, 1.0, 9.0])]
    frame = spark.createDataFrame([(i, v, 0, "x", 1, 2) for i, v in rows], SCHEMA)
    for sizes in ({}, {"block": 16}):
        got = {}
        for r in neighbours.nearest(frame, frame.filter("vec_id % 20 = 0"), 9, **sizes).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
        for query, found in got.items():
            asked = [np.array(v, float) for i, v in rows if i == query]
            want = sorted(-float((a * np.array(v, float)).sum()) for a in asked for i, v in rows if i != query)[:9]
            assert [r for r, *_ in sorted(found)] == list(range(1, 10))
            assert np.allclose([s for _, s, _ in sorted(found)], [-s for s in want], rtol=1e-6)
