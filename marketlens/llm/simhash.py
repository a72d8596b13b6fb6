"""Near duplicates by SimHash and Golay-code fuzzy hashing.

A text's fingerprint has a bit set where more than half of the hashes of its three-word shingles have it. Fingerprints
link at two or fewer differing bits. They are cut into three segments of at most 23 bits. The perfect binary Golay code of
23 bits decodes every word to the one codeword within three bits; a word and the 23 words one bit away decode to one or six
codewords, and two words at most two bits apart share one of these, that of a word between them. Of two differing bits at
least one segment holds none, so linked fingerprints agree in one whole segment and share a codeword of the next: these
two, 33 bits or more, are the keys, three to eighteen for each fingerprint. What shares a key is verified bit by bit.

A key with more than ``CROWD`` different fingerprints is hot. Its members are not compared with each other: each is dealt to
itself and the 64 fingerprints one bit away, and two are linked exactly if they share such a place; no more than 65 can
stand at one. So neither a group of copies nor one of near copies fills a task, and no pairs are written out, only edges that
span what was found. Equal fingerprints are one from the start. Components come from alternating stars.

Null, empty and blank texts have fingerprint zero, linked like any other; rows that repeat give rows that repeat; a null
doc_id is never a component id while the component has another; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.components import components
from marketlens.llm.tables import slices
from marketlens.session import cut

WIDTH, SEED, BITS, APART = 3, 42, 64, 2
#: Shingles whose bits are counted at a time.
COUNTED = 1 << 15
#: Fixed value: a generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
LENGTH, CHECKS = 23, 11
#: First bit and width of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Different fingerprints of a key that are still compared with each other.
CROWD = 64


def fingerprint(text: bytes) -> int:
    """The SimHash of a text's words, A-Z in lower case."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(WIDTH, len(words))
    starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), COUNTED):
        spans = zip(starts[at : at + COUNTED].tolist(), ends[at : at + COUNTED].tolist())
        hashes = np.fromiter((xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in spans), np.uint64)
        counts += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (its 64 bits as a long) of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = np.array([fingerprint(x.as_py() or b"") for x in batch.column("text").cast(pa.binary())], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, fp long")


def syndromes() -> np.ndarray:
    """The remainder by the generator of each single bit."""
    out = []
    for bit in range(LENGTH):
        value = 1 << bit
        for k in range(LENGTH - 1, CHECKS - 1, -1):
            if value >> k & 1:
                value ^= GENERATOR << (k - CHECKS)
        out.append(value)
    return np.array(out, np.int64)


ONE_BIT = syndromes()
#: The pattern of at most three bits with each remainder; the code is perfect, so each has exactly one.
ERRORS = np.zeros(1 << CHECKS, np.int64)
for _size in (1, 2, 3):
    for _bits in combinations(range(LENGTH), _size):
        ERRORS[np.bitwise_xor.reduce(ONE_BIT[list(_bits)])] = sum(1 << b for b in _bits)


def codewords(segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 12-bit indices of the codewords that each segment and its neighbours one bit away decode to, and which are new in their row."""
    remainder = np.zeros(len(segments), np.int64)
    for bit in range(LENGTH):
        remainder ^= np.where(segments >> bit & 1, ONE_BIT[bit], 0)
    around = np.concatenate([[0], 1 << np.arange(LENGTH)])
    words = segments[:, None] ^ around ^ ERRORS[remainder[:, None] ^ np.concatenate([[0], ONE_BIT])]
    indices = np.sort(words >> CHECKS, axis=1)
    new = np.ones(indices.shape, bool)
    new[:, 1:] = indices[:, 1:] != indices[:, :-1]
    return indices, new


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, the print of each): one whole segment and a codeword of the next."""
    prints = prints.astype(np.uint64)
    cuts = [(prints >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    keys, owners = [], []
    for k, whole in enumerate(cuts):
        indices, new = codewords(cuts[(k + 1) % len(cuts)])
        keys.append((((k << 22 | whole)[:, None] << 12) | indices)[new])
        owners.append(np.repeat(prints, new.sum(axis=1)))
    return np.concatenate(keys), np.concatenate(owners)


def keyed(prints: DataFrame) -> DataFrame:
    """key, fp: the keys of each fingerprint."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owners = keys_of(batch.column("fp").to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(owners.view(np.int64))], names=["key", "fp"])

    return prints.select("fp").mapInArrow(work, "key long, fp long")


def spanning(prints: np.ndarray) -> list[tuple[int, int]]:
    """Edges that span the components of links within one small group."""
    apart = np.bitwise_count(prints[:, None] ^ prints)
    parent = list(range(len(prints)))
    edges = []
    for a, b in zip(*(x.tolist() for x in np.nonzero(np.triu(apart <= APART, 1)))):
        one, other = a, b
        while parent[one] != one:
            one = parent[one]
        while parent[other] != other:
            other = parent[other]
        if one != other:
            parent[other] = one
            edges.append((a, b))
    return edges


def compared(groups: DataFrame) -> DataFrame:
    """a, b: edges among the fingerprints of each group, a column ``fps`` of bounded arrays."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for group in batch.column("fps"):
                prints = group.values.to_numpy(zero_copy_only=False)
                for a, b in spanning(prints.view(np.uint64)):
                    left.append(prints[a])
                    right.append(prints[b])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return groups.select("fps").mapInArrow(work, "a long, b long")


def met_between(prints: DataFrame) -> DataFrame:
    """a, b: edges among all ``prints`` that share themselves or a fingerprint one bit away from both."""
    steps = F.array(F.lit(0).cast("long"), *[F.lit((1 << bit) - (1 << BITS) * (bit == BITS - 1)).cast("long") for bit in range(BITS)])
    places = prints.select("fp", F.explode(steps).alias("step")).select("fp", F.col("fp").bitwiseXOR(F.col("step")).alias("place"))
    met = places.groupBy("place").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("fps")).filter("size(fps) > 1")
    return met.select("a", F.explode("fps").alias("b")).filter("a <> b").distinct()


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """a, b: edges that span the components of the different fingerprints ``fp``."""
    met = keyed(prints)
    counts = cut(met.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    shared = cut(met.join(counts, "key"))
    groups = shared.filter(F.col("n") <= crowd).groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps")
    hot = shared.filter(F.col("n") > crowd).select("fp").distinct()
    return compared(groups).unionByName(met_between(hot)).distinct()


def near_copies(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that links reach, for every row."""
    rows = cut(fingerprints(docs))
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(cut(links(prints, crowd)))
    reached = roots.join(prints, roots["node"] == prints["fp"]).select("fp", "root", "first")
    least = reached.groupBy("root").agg(F.min("first").alias("component_id"))
    found = cut(reached.join(least, "root").select("fp", "component_id"))
    named = cut(prints.join(found, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")))
    out = rows.join(named, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
