import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from marketlens.llm import bpe

LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def expected(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def test_random_texts():
    rng = random.Random(3)
    letters = [chr(c) for c in (*range(1, 0x600), 0x1E00, 0x2028, 0x3042, 0xAC00, 0x1F600)] + ["'s", "'ll", "ing", " ", "\n", "aaa", "<|endoftext|>", "Σ", "İ"] * 20
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 9)))
        ids, decoded = expected(text)
        assert bpe.encode(text) == ids and bpe.decode(ids) == decoded
    for _ in range(3000):
        text = "".join(rng.choice("abeinosth ") for _ in range(rng.randint(1, 60)))
        assert bpe.encode(text) == expected(text)[0]


def test_every_token_encodes_to_itself_or_apart():
    words = bpe.vocabulary(bpe.TOKENIZER)
    for token, i in list(LIBRARY.get_vocab().items())[::97]:
        if token.endswith("</w>") and token[:-4].isascii() and token[:-4].islower():
            assert words.encode_piece(token[:-4]) == LIBRARY.encode(token[:-4], add_special_tokens=False).ids


def test_caches_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_PIECES", 10)
    words = bpe.Vocabulary(bpe.TOKENIZER)
    for i in range(50):
        words.parts_of(f"word{'x' * i} other")
    assert len(words.pieces) <= 11
    blob = "q" * 5000
    assert words.parts_of(blob)[0][0] == len(LIBRARY.encode(blob, add_special_tokens=False).ids) and blob not in words.pieces


def test_digests(odd, empty):
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(odd).collect())
    want = []
    for r in odd.collect():
        ids, decoded = expected(r["text"])
        want.append((str(r["doc_id"]), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.digests(empty).count() == 0
    assert {tuple(r["ids"]) for r in bpe.encoded(odd).collect()} == {tuple(expected(r["text"])[0]) for r in odd.collect()}
