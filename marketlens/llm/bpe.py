"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece exactly one token can end its encoding. An automaton over the vocabulary gives the tokens
that end at each place, longest first; one of them is right if the token stored for the prefix before it may stand next to
it, which is decided by undoing the merges of both along their common border. Back-pointers from the whole piece then give
the ids. Pieces are cached, since words repeat.

Null texts count as empty (no tokens); rows that repeat give rows that repeat; an empty table gives an empty result; other
columns are not read. Texts are handled whole; memory is bounded by one batch and the caches.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import ahocorasick
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marketlens.llm.tables import slices

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Entries of each cache before it is emptied.
CACHED_PIECES, CACHED_PAIRS = 400_000, 1_000_000
#: Longer words are encoded anew each time, so that the cache stays small in bytes too.
CACHED_LETTERS = 64
#: Texts whose characters all lie below this one are split here; the library splits the others, whose character classes
#: depend on the version of Unicode.
SETTLED = "\u0530"
BLANKS = "\\t-\\r \\x85\\xa0"
#: Stands for the end of a word behind its last letter.
STOP = "\0"
ENDLESS = 1 << 60


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies."""
    letters, extra = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            letters.append(chr(b))
        else:
            letters.append(chr(extra))
            extra += 1
    return letters


def settled_words() -> re.Pattern:
    """The vocabulary's split of normalized text, its classes spelled out for the settled characters."""
    kinds = {"L": "", "N": ""}
    for code in range(ord(SETTLED)):
        kind = unicodedata.category(chr(code))[0]
        if kind in kinds:
            kinds[kind] += f"\\u{code:04x}"
    letters, digits = kinds["L"], kinds["N"]
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{BLANKS}{letters}{digits}]+")


class Vocabulary:
    """Tokens, merges and the automaton of a byte-level vocabulary whose words carry an end mark."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.mark = model["end_of_word_suffix"]
        ids = model["vocab"]
        self.names = {i: token for token, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: token for token, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            left, right, whole = ids[a], ids[b], ids[a + b]
            self.rank[left, right] = rank
            self.parts[whole], self.made[whole] = (left, right), rank
        self.automaton = ahocorasick.Automaton()
        for token, i in ids.items():
            if i in self.special.values():
                continue
            key = token[: -len(self.mark)] + STOP if token.endswith(self.mark) else token
            self.automaton.add_word(key, (len(key), i))
        self.automaton.make_automaton()
        letters = byte_letters()
        self.letters = dict(enumerate(letters))
        self.bytes = {letter: b for b, letter in enumerate(letters)}
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, tuple[int, str, str]] = {}
        self.words = settled_words()
        self.unsettled = re.compile(f"[^\\0-{chr(ord(SETTLED) - 1)}]")
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.library = Tokenizer.from_file(path)

    def compatible(self, left: int, right: int) -> bool:
        """Whether encoding the two texts together keeps the border between these two tokens.

        Along the border the last part of ``left`` meets the first part of ``right``. Two parts that exist at the same
        time merge if their merge comes before the merges that use them up; of equal merges the leftmost is first.
        """
        a, b, a_used, b_used = left, right, ENDLESS, ENDLESS
        kept = True
        while True:
            rank = self.rank.get((a, b), ENDLESS)
            if rank < a_used and rank <= b_used and rank < ENDLESS:
                kept = False
                break
            a_made, b_made = self.made.get(a, -1), self.made.get(b, -1)
            if a_made < 0 and b_made < 0:
                break
            if a_made > b_made:
                a, a_used = self.parts[a][1], a_made
            else:
                b, b_used = self.parts[b][0], b_made
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        self.pairs[left << 32 | right] = kept
        return kept

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one word given in byte letters, its end mark implied."""
        text = piece + STOP
        last, size = [-1] * (len(text) + 1), [0] * (len(text) + 1)
        known = self.pairs.get
        for stop, (length, token) in self.automaton.iter(text):
            end = stop + 1
            if last[end] >= 0:
                continue
            if length < end:
                before = last[end - length]
                kept = known(before << 32 | token)
                if not (self.compatible(before, token) if kept is None else kept):
                    continue
            last[end], size[end] = token, length
        ids, at = [], len(text)
        while at:
            if last[at] < 0:
                raise ValueError(f"{piece!r} can't be encoded")
            ids.append(last[at])
            at -= size[at]
        return ids[::-1]

    def piece(self, word: str) -> tuple[int, str, str]:
        """Token count, decimal ids and decoded tokens of a word; the strings joined by spaces."""
        plain = word if word.isascii() and word.isalpha() else "".join([self.letters[b] for b in word.encode()])
        ids = self.encode_piece(plain)
        found = len(ids), " ".join(map(str, ids)), " ".join([self.names[i] for i in ids])
        if len(word) <= CACHED_LETTERS:
            if len(self.pieces) >= CACHED_PIECES:
                self.pieces.clear()
            self.pieces[word] = found
        return found

    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens, normalized."""
        plain = text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")
        plain = plain.lower()
        if self.unsettled.search(plain):
            found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return [bytes(self.bytes[c] for c in letters).decode() for letters, _ in found]
        return self.words.findall(plain)

    def parts_of(self, text: str) -> list[tuple[int, str, str]]:
        """(count, ids, decoded) of the words and special tokens of a text, in order."""
        out: list[tuple[int, str, str]] = []
        known = self.pieces.get
        for k, part in enumerate(self.specials.split(text) if "<|" in text else [text]):
            if k % 2:
                out.append((1, str(self.special[part]), part))
            else:
                out += [known(word) or self.piece(word) for word in self.split(part)]
        return out


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(text: str | None, path: str = TOKENIZER) -> list[int]:
    """Ids of the whole text, null as empty."""
    return [int(i) for _, ids, _ in vocabulary(path).parts_of(text or "") for i in ids.split(" ")]


def decode(ids: list[int], path: str = TOKENIZER) -> str:
    """Tokens joined by a space, as a vocabulary without a decoder is read back."""
    names = vocabulary(path).names
    return " ".join(names[i] for i in ids)


def digests(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary(path)
        sha = hashlib.sha256
        for batch in slices(batches, "text"):
            counts, ids, decoded = [], [], []
            for text in batch.column("text"):
                found = coder.parts_of(text.as_py() or "")
                counts.append(sum(x[0] for x in found))
                ids.append(sha(" ".join([x[1] for x in found]).encode()).hexdigest())
                decoded.append(sha(" ".join([x[2] for x in found]).encode()).hexdigest())
            arrays = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, DIGESTS)


def encoded(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, ids and decoded text of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids = [encode(text.as_py(), path) for text in batch.column("text")]
            arrays = [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([decode(x, path) for x in ids], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
