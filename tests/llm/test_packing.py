import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from marketlens.llm import packing

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_ids(odd):
    for r in odd.select("text").collect():
        assert packing.token_ids(r["text"]).tolist() == ids_of(r["text"]).tolist()


def test_pieces_and_sequences(unique):
    for capacity in (64, 2048):
        rows = packing.pack_documents(unique, capacity=capacity).collect()
        texts = {r["doc_id"]: ids_of(r["text"]) for r in unique.collect()}
        pieces = {}
        for r in rows:
            pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        assert set(pieces) == set(texts)
        for i, parts in pieces.items():
            parts.sort()
            ids = texts[i]
            assert [p[0] for p in parts] == list(range(len(parts))) and sum(p[2] for p in parts) == len(ids)
            assert all(p[2] == capacity for p in parts[1:]) and (len(ids) > capacity) == (len(parts) > 1)
            assert all(zlib.crc32(ids[s : s + n].tobytes()) == crc for _, s, n, crc in parts)
        filled = {}
        for r in rows:
            filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in filled.values():
            parts.sort()
            assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist() and sum(n for _, n in parts) <= capacity


def test_few_sequences():
    lengths = np.sort(np.random.default_rng(1).integers(1, 2049, 5000))[::-1]
    sequence, _ = packing.sum_of_squares(lengths)
    assert sequence.max() + 1 <= 1.005 * np.ceil(lengths.sum() / 2048) + 1


def test_each_step_is_least():
    rng, capacity = np.random.default_rng(2), 12
    lengths = rng.integers(1, capacity + 1, 300)
    sequence, offset = packing.sum_of_squares(lengths, capacity)
    gaps = {}

    def squares(g):
        counts = np.bincount([x for x in g.values() if 0 < x < capacity], minlength=capacity + 1)
        return int((counts**2).sum())

    for s, q, o in zip(lengths.tolist(), sequence.tolist(), offset.tolist(), strict=True):
        options = [squares(gaps | {b: g - s}) for b, g in gaps.items() if g >= s] or [squares(gaps | {-1: capacity - s})]
        assert o == capacity - gaps.get(q, capacity)
        gaps[q] = gaps.get(q, capacity) - s
        assert squares(gaps) == min(options)


def test_odd_cases(odd, empty):
    rows = packing.pack_documents(odd)
    assert rows.groupBy().sum("length").first()[0] == sum(len(ids_of(r["text"])) for r in odd.collect())
    assert packing.pack_documents(empty).count() == 0


def test_groups_are_sized_by_pieces(spark, monkeypatch):
    """A few long documents make as many groups as their pieces need."""
    texts = [" ".join(f"word{(i * 7 + k) % 500}" for k in range(9000)) for i in range(6)] + ["short"] * 4
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    count = sum(len(packing.cut(len(ids_of(t)), 64)) for t in texts)
    assert count / 2 < packing.estimated_pieces(docs, 64) < 2 * count
    asked = []
    monkeypatch.setattr(packing, "groups_for", lambda rows, per_group: asked.append(rows) or -(-rows // 100))
    rows = packing.pack_documents(docs, capacity=64).collect()
    assert len(rows) == count and asked[0] > count / 2
