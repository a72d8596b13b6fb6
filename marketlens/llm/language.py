"""Language ID by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A run of three symbols is bound into one vector: the product of its letters'
vectors, rotated by two, one and no places. A text's vector is the sum over its runs, a language's prototype the sum over
the texts of that language, and a text gets the language whose prototype has the largest cosine. Since sums are linear, a
text's product with a prototype is the sum of its runs' products, so each run is compared with the prototypes once. The
length of a text's vector is taken from its run counts, to which random vectors of this size concentrate; it is the same
for all languages and so only scales the score.

Symbols are lower-case letters in 127 classes and one blank for everything else. Prototypes are learned from all labelled
training rows; they are collected to the driver, ``DIMENSIONS`` numbers for each of at most ``MOST_LANGUAGES`` languages.
Null texts and texts without a letter are ``und`` with score 0, as is everything if nothing can be learned; rows that
repeat are predicted alike; a null doc_id counts as an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.tables import slices, text_buffer

DIMENSIONS = 4096
#: Four standard deviations of the cosine of a random vector.
CHANCE = 4 / DIMENSIONS**0.5
MOST_LANGUAGES = 2000
UNKNOWN = "und"
SEED = 20
CLASSES = 128
RUNS = CLASSES**3
SCORES = "doc_id long, held_out boolean, lang_pred string, score double"


@cache
def symbol_table() -> np.ndarray:
    """Class of each code point: 0 for all but letters, a-z apart, the others by their number."""
    table = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        if chr(code).isalpha():
            small = chr(code).lower()
            low = ord(small) if len(small) == 1 else code
            table[code] = low - 96 if 97 <= low <= 122 else 27 + low % (CLASSES - 27)
    return table


@cache
def letter_vectors() -> np.ndarray:
    return np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (CLASSES, DIMENSIONS))


def run_vectors(runs: np.ndarray) -> np.ndarray:
    """The bound vectors of runs numbered by their three classes."""
    letters = letter_vectors()
    first = np.roll(letters, 2, axis=1)[runs // CLASSES**2]
    second = np.roll(letters, 1, axis=1)[runs // CLASSES % CLASSES]
    return first * second * letters[runs % CLASSES]


def text_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of all rows and the row of each. Blanks are single, and one stands before and behind each text."""
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    starts = heads[offsets]
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    symbols = symbol_table()[codes]
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(starts))
    keep = symbols != 0
    inner = np.flatnonzero(~keep[1:]) + 1
    keep[inner] = (symbols[inner - 1] != 0) & (rows[inner] == rows[inner - 1])
    symbols, rows = symbols[keep], rows[keep]
    sizes = np.bincount(rows, minlength=len(offsets) - 1) + 2
    ends = np.cumsum(sizes)
    padded = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
    padded[np.arange(len(symbols)) + 2 * rows + 1] = symbols
    owner = np.repeat(np.arange(len(sizes)), sizes)
    runs = padded[:-2] * CLASSES**2 + padded[1:-1] * CLASSES + padded[2:]
    inside = (owner[:-2] == owner[2:]) & (padded[1:-1] + padded[2:] > 0) & (padded[:-2] + padded[1:-1] > 0)
    return runs[inside], owner[:-2][inside]


def held_out(parts: int, left: int):
    """Whether crc32 of the decimal doc_id leaves ``left`` when divided by ``parts``."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.pmod(F.crc32(F.encode(name, "UTF-8")), F.lit(parts)) == left


def learn(labelled: DataFrame) -> dict[str, np.ndarray]:
    """The prototype of each language, of unit length, from rows with text and lang."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in slices(batches, "text"):
            runs, rows = text_runs(*text_buffer(batch.column("text")))
            names = batch.column("lang").to_pylist()
            kinds = {name: i for i, name in enumerate(dict.fromkeys(names))}
            kind = np.array([kinds[name] for name in names])[rows]
            for name, i in kinds.items():
                found = np.bincount(runs[kind == i], minlength=1)
                present = np.flatnonzero(found)
                if name in counts:
                    places, back = np.unique(np.concatenate([counts[name][0], present]), return_inverse=True)
                    counts[name] = places, np.bincount(back, np.concatenate([counts[name][1], found[present]]))
                else:
                    counts[name] = present, found[present].astype(np.float64)
        sums = {name: np.zeros(DIMENSIONS) for name in counts}
        for name, (present, weights) in counts.items():
            for at in range(0, len(present), 2048):
                sums[name] += weights[at : at + 2048] @ run_vectors(present[at : at + 2048]).astype(np.float64)
        for name, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["lang", "total"])

    rows = labelled.filter("text IS NOT NULL AND lang IS NOT NULL").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    parts = rows.mapInArrow(fold, "lang string, total array<double>")
    sums = parts.select("lang", F.posexplode("total").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    vectors = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).select("lang", "v.x")
    found = {r["lang"]: np.array(r["x"]) for r in vectors.limit(MOST_LANGUAGES + 1).collect()}
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return {name: v / size for name, v in sorted(found.items()) if (size := float(np.linalg.norm(v)))}


class Profiles:
    """Products of runs with prototypes, worked out when a run is first met."""

    def __init__(self, prototypes: dict[str, np.ndarray]):
        self.names = list(prototypes)
        self.vectors = np.array(list(prototypes.values())).T.astype(np.float32).reshape(DIMENSIONS, -1)
        self.place = np.full(RUNS, -1, np.int32)
        self.products = np.zeros((0, len(self.names)), np.float32)

    def lookup(self, runs: np.ndarray) -> np.ndarray:
        """The place of each run in ``products``."""
        new = np.flatnonzero(np.bincount(runs[self.place[runs] < 0], minlength=1))
        for at in range(0, len(new), 1024):
            part = new[at : at + 1024]
            self.place[part] = len(self.products) + np.arange(len(part))
            self.products = np.concatenate([self.products, run_vectors(part).astype(np.float32) @ self.vectors])
        return self.place[runs]

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language number (-1: unknown) and cosine of each row."""
        n = len(offsets) - 1
        runs, rows = text_runs(data, offsets)
        best, score = np.full(n, -1), np.zeros(n)
        if not len(runs) or not self.names:
            return best, score
        place = self.lookup(runs)
        firsts = np.flatnonzero(np.diff(rows, prepend=-1))
        known = rows[firsts]
        dots = np.stack([np.add.reduceat(self.products[:, k].astype(np.float64)[place], firsts) for k in range(len(self.names))], axis=1)
        width = len(self.products)
        squares, step = np.zeros(n), max(1, (1 << 20) // width)
        for at in range(0, n, step):
            low, high = np.searchsorted(rows, [at, at + step])
            cells = np.bincount((rows[low:high] - at) * width + place[low:high], minlength=step * width).reshape(step, width)
            squares[at : at + step] = np.einsum("ij,ij->i", cells, cells, dtype=np.float64)[: n - at]
        cosines = dots / np.sqrt(DIMENSIONS * squares[known])[:, None]
        best[known] = cosines.argmax(axis=1)
        score[known] = np.clip(cosines.max(axis=1), 0, 1)
        return best, score


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred and score of every row, from its text alone; ``held_out`` is handed through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(prototypes)
        names = np.array([*profiles.names, UNKNOWN], object)
        for batch in slices(batches, "text"):
            best, score = profiles.predict(*text_buffer(batch.column("text")))
            arrays = [batch.column("doc_id"), batch.column("held_out"), pa.array(names[best], pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", F.col("text").cast("string").alias("text")).mapInArrow(run, SCORES)


def identify(docs: DataFrame, parts: int = 4, left: int = 2) -> DataFrame:
    """Learn from the rows that are not held out and predict every row."""
    marked = docs.select("doc_id", "text", "lang", held_out(parts, left).alias("held_out"))
    return predict(marked, learn(marked.filter("NOT held_out")))


def filter_languages(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """``docs`` without the rows that have no letter, no text, or no language to which their cosine is ``least`` or more.

    With ``CHANCE`` texts go that are no nearer to any learned language than a random vector may be. Learns from all
    labelled rows; without any, all rows with letters stay.
    """
    known = docs.filter(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    prototypes = learn(known.select("text", "lang"))
    return recognized(known, prototypes, least) if prototypes else known


def recognized(docs: DataFrame, prototypes: dict[str, np.ndarray], least: float = 0.0) -> DataFrame:
    """The rows of ``docs``, whole, to which the prototypes give a language with a score of ``least`` or more."""
    schema = docs.schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(prototypes)
        for batch in slices(batches, "text"):
            best, score = profiles.predict(*text_buffer(batch.column("text")))
            yield batch.filter(pa.array((best >= 0) & (score >= least)))

    return docs.mapInArrow(keep, schema)
