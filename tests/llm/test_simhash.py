import random
import re

import numpy as np
import xxhash

from marketlens.llm import simhash
from marketlens.llm.queries import op13_simhash


def print_of(text):
    data = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(b + 32 if 65 <= b <= 90 else b for b in data))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """The least index of each print's component, by flood fill."""
    values = np.array(prints, np.uint64)
    label = [None] * len(prints)
    for i in range(len(prints)):
        if label[i] is None:
            label[i], todo = i, [i]
            while todo:
                for j in np.flatnonzero(np.bitwise_count(values ^ values[todo.pop()]) <= 2).tolist():
                    if label[j] is None:
                        label[j] = i
                        todo.append(j)
    return label


def answer(rows):
    prints = [print_of(text) for _, text in rows]
    members = {}
    for i, root in enumerate(brute_components(prints)):
        members.setdefault(root, []).append(i)
    least = {i: min((rows[j][0] for j in group if rows[j][0] is not None), default=None) for group in members.values() for i in group}
    return sorted(((rows[i][0], f"{prints[i]:016x}", least[i]) for i in range(len(rows))), key=repr)


def test_code_is_perfect():
    assert len(set(simhash.ERRORS.tolist())) == 2048 and all(bin(e).count("1") <= 3 for e in simhash.ERRORS.tolist())
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 5000)
    indices, new = simhash.codewords(words)
    assert set(new.sum(axis=1).tolist()) <= {1, 6}
    first = [set(row[keep].tolist()) for row, keep in zip(indices, new)]
    for flips in (1, 2):
        moved = words.copy()
        for k in range(flips):
            moved ^= 1 << ((rng.integers(0, 11, 5000) * 2 + k) % 23)
        indices, new = simhash.codewords(moved)
        assert all(a & set(row[keep].tolist()) for a, row, keep in zip(first, indices, new))


def test_every_linked_pair_shares_a_key():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 1 << 63, 64, np.uint64)
    for value in prints[:4]:
        keys, _ = simhash.keys_of(np.array([value]))
        assert len(keys) == len(set(keys.tolist())) <= 18
        moved = [value ^ np.uint64(1 << a) ^ np.uint64(0 if a == b else 1 << b) for a in range(64) for b in range(a + 1)]
        others, owners = simhash.keys_of(np.array(moved, np.uint64))
        assert set(owners[np.isin(others, keys)].tolist()) == {int(m) for m in moved}


def test_words_of_other_spaces(spark):
    """Only ASCII white space parts words, and only A-Z change."""
    texts = ["A b c\x1fd Eİ", "one\x0btwo\x0cthree four", " x", "É é", "word", "two words", ""]
    got = {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in simhash.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: print_of(t) for i, t in enumerate(texts)}


def prints_frame(spark, values):
    return spark.createDataFrame([(v - (1 << 64) * (v >> 63),) for v in values], "fp long")


def test_crowded_keys(spark):
    """Many fingerprints around one: hot keys are dealt by the places between, with the same components."""
    rng = random.Random(3)
    base = rng.getrandbits(64)
    values = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for _ in range(3000)} | {rng.getrandbits(64) for _ in range(500)} | {base ^ 1 << 63}
    values = sorted(values)
    want = brute_components(values)
    for crowd in (2, 64, 10**6):
        edges = simhash.links(prints_frame(spark, values), crowd).collect()
        at = {v - (1 << 64) * (v >> 63): i for i, v in enumerate(values)}
        parent = list(range(len(values)))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for r in edges:
            a, b = at[r["a"]], at[r["b"]]
            assert bin(values[a] ^ values[b]).count("1") <= 2
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        assert [root(i) for i in range(len(values))] == want


def test_odd_rows(spark, odd, empty):
    got = sorted((tuple(r) for r in simhash.near_copies(odd).collect()), key=repr)
    assert got == answer([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert simhash.near_copies(empty).count() == 0


def test_chain_of_near_copies(spark):
    """Texts that differ by little steps form one component although its ends are far apart."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(300)}" for _ in range(400)]
    rows = []
    for i in range(60):
        words[rng.randrange(400)] = f"x{i}"
        rows.append((100 - i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in simhash.near_copies(frame).collect()), key=repr)
    assert got == answer(rows)
    assert len({r[2] for r in got}) < 60


def test_query(spark):
    path = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in op13_simhash(spark, path).collect()), key=repr) == answer(rows)
