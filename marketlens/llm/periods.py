"""Periodic runs of words by descending-LCP Kruskal, and the texts without their repetitions.

A run is a stretch of consecutive words with smallest period q (words q apart are the same) and a length of at least
max(``least``, 2q) that no neighbouring word extends. Per text the suffixes of the words are sorted by doubling, and
neighbours in that order are joined by falling length of their longest common prefix (LCP): union-find classes hold
their positions in order, the smaller class enters the larger. When a class of LCP L makes two positions d <= L apart
neighbours, the words from the first on have smallest period d for exactly d + L words; if the word before does not go on
with it, that is a run. The first two positions a period apart of each run become neighbours this way, so none is missed,
and positions whose next ``least`` / 2 words occur once in their text can be left out from the start.

Texts are worked on one by one: memory grows with the longest text, not with the table, and nothing is shuffled. Words are
what lies between ASCII white space. Null, empty and blank texts have no words, no runs and an empty collapsed text; rows
that repeat are rows that repeat; an empty table gives an empty result; other columns are not read. A null doc_id is kept.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.tables import mix, slices

LEAST = 12
#: A class enters another one by one if it has less than this part of its positions.
ONE_BY_ONE = 16
RUN = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
FOUND = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, text string"


def repeated_stretches(words: np.ndarray, width: int) -> bool:
    """False only if no ``width`` words occur twice; hashes that meet by chance cost time, not rightness."""
    if len(words) <= width:
        return False
    mixed = mix(words)
    total = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + mixed[k : k + len(total)]
    total.sort()
    return bool((total[1:] == total[:-1]).any())


def ranked(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Ranks from 1 of the pairs."""
    return np.unique(left.astype(np.int64) * (int(right.max()) + 1) + right, return_inverse=True)[1].astype(np.int32) + 1


def shifted(ranks: np.ndarray, by: int) -> np.ndarray:
    """The ranks of the places ``by`` further on, 0 beyond the end."""
    out = np.zeros_like(ranks)
    out[: max(0, len(ranks) - by)] = ranks[by:]
    return out


def suffixes(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The places whose next ``width`` words occur again, in the order of their suffixes, and the LCP of each with the one before."""
    levels = [words.astype(np.int32) + 1]
    while 2 << (len(levels) - 1) <= width:
        levels.append(ranked(levels[-1], shifted(levels[-1], 1 << (len(levels) - 1))))
    stretch = ranked(levels[-1], shifted(levels[-1], width - (1 << (len(levels) - 1))))
    again = np.flatnonzero(np.bincount(stretch)[stretch] > 1)
    if not len(again):
        return again, again
    while len(np.unique(levels[-1][again])) < len(again):
        levels.append(ranked(levels[-1], shifted(levels[-1], 1 << (len(levels) - 1))))
    order = again[np.argsort(levels[-1][again])]
    left, right = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(len(left), np.int64)
    last = len(words)
    for k in reversed(range(len(levels))):
        inside = np.maximum(left, right) < last
        same = np.zeros(len(left), bool)
        same[inside] = levels[k][left[inside]] == levels[k][right[inside]]
        step = same.astype(np.int64) << k
        shared += step
        left += step
        right += step
    return order, np.concatenate([[0], shared])


def neighbours(order: np.ndarray, shared: np.ndarray, width: int) -> Iterator[tuple[int, int, int]]:
    """(place, distance, LCP) of places that become neighbours in a class at a distance within its LCP."""
    classes = [[place] for place in order.tolist()]
    parent = list(range(len(classes)))
    lcp = shared.tolist()
    joined = np.flatnonzero(shared >= width)
    for at in joined[np.argsort(-shared[joined], kind="stable")].tolist():
        length = lcp[at]
        one, other = at - 1, at
        while parent[one] != one:
            parent[one] = one = parent[parent[one]]
        while parent[other] != other:
            parent[other] = other = parent[parent[other]]
        if len(classes[one]) < len(classes[other]):
            one, other = other, one
        large, small = classes[one], classes[other]
        for i, place in enumerate(small):
            k = bisect_left(large, place)
            if k and place - large[k - 1] <= length and (not i or small[i - 1] < large[k - 1]):
                yield large[k - 1], place - large[k - 1], length
            if k < len(large) and large[k] - place <= length and (i + 1 == len(small) or small[i + 1] > large[k]):
                yield place, large[k] - place, length
        if len(small) * ONE_BY_ONE < len(large):
            for place in small:
                insort(large, place)
        else:
            large += small
            large.sort()
        parent[other], classes[other] = one, None


def runs_of(words: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs, by start, then period; ``words`` are numbers from 0, equal for equal words."""
    width = max(1, (least + 1) // 2)
    if len(words) < max(2, least) or not repeated_stretches(words, width):
        return []
    found = []
    for place, period, length in neighbours(*suffixes(words, width), width):
        if length + period >= least and (place == 0 or words[place - 1] != words[place + period - 1]):
            found.append((place, length + period, period))
    return sorted(found, key=lambda run: (run[0], run[2]))


def numbered(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(word, len(seen)) for word in words), np.int64, len(words))


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def find(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and text: the kept words joined by one space."""
    if least < 2:
        raise ValueError("a run has two words at least")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts, runs, texts = [], [], []
            for text in batch.column("text").cast(pa.binary()):
                words = (text.as_py() or b"").split()
                found = runs_of(numbered(words), least) if len(words) >= least else []
                counts.append(len(words))
                runs.append([dict(zip(("start", "length", "period"), run)) for run in found])
                texts.append(b" ".join(without_repeats(words, found)))
            arrays = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "runs", "text"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, FOUND)


def looped(docs: DataFrame) -> DataFrame:
    """doc_id and text, where one document in ten repeats some of its words to its end.

    With h the CRC-32 of the id in decimal, g = floor(h / 10) and n words, documents with h % 10 = 0 and n > 0 go on from
    word a = g % n with their p = 1 + floor((n - a) / (3 + g % 8)) words from there, over and over. A null id changes nothing.
    """
    number = F.crc32(F.encode(F.col("doc_id").cast("long").cast("string"), "UTF-8"))
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), number.alias("h"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda word: word != "")
    some = some.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("words")).withColumn("g", F.floor(F.col("h") / 10))
    some = some.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    some = some.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))

    def part(array: Column | str, start: Column, length: Column) -> Column:
        return F.slice(array, start, length)

    rest = F.col("n") - F.col("a")
    tail = F.flatten(F.array_repeat(part("words", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    text = F.concat_ws(" ", F.concat(part("words", F.lit(1), F.col("a")), part(tail, F.lit(1), rest)))
    return some.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """One row per row of ``find``: the longest run (ties: smallest start, then period) and digests of all runs and of the text."""
    best = F.array_min(F.transform("runs", lambda run: F.struct((-run["length"]).alias("least"), run["start"].alias("start"), run["period"].alias("period"), run["length"].alias("length"))))
    line = F.transform("runs", lambda run: F.concat(F.concat_ws(",", run["start"], run["length"], run["period"]), F.lit("\n")))
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.concat_ws("", line), 256).alias("runs_sha256"),
        F.sha2(F.col("text"), 256).alias("collapsed_sha256"),
    )
