"""Hard-negative mining by angular triangle filtering.

Vectors are rounded to integers, and a score is the integer product of two vectors. Each row stores its length and its
angles to a few reference directions. By the triangle inequality of angles, the angle between two rows lies between the
difference and the sum of their angles to any one direction; the cosines of these, times both lengths, give bounds of the
score, widened for rounding and then to whole numbers. In a tile, rows stand by the direction nearest to them: bounds come
from that direction and from the one nearest to the anchor. Only rows whose bounds reach what is asked for, the k-th best
certain score or a window of scores, are multiplied out. Results don't depend on the directions, only the time does.

Two passes over tiles of anchors and rows: the first finds each anchor's positives, the best rows of its label; the second,
for each anchor and positive, the best rows of other labels with low * positive <= 100 * score <= high * positive. Tiles are
dealt by hash, so no label or direction fills a task; each returns a bounded number of rows per anchor, and the best of all
tiles are taken by rank, which Spark cuts before it shuffles.

Rows take no part if vec_id, label or vector is null, if a component is null or not finite, or if the squared length of the
rounded vector is 2^61 or more, as scores might not fit a long. Only vectors of equal length meet; empty and zero vectors
score 0. Equal rows count once; different rows under one vec_id are candidates each, but never meet as anchor and other, and
have each their own lists as anchors. Ties go to the smaller vec_id. A table without rows gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.tables import groups_for
from marketlens.session import cut

POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Directions, and the rows that they are worked out from: a bounded sample, which decides the time only.
DIRECTIONS, SAMPLE, TURNS = 32, 2048, 6
BLOCK, ANCHOR_BLOCK, TILE = 16384, 2048, 64
#: Angles are known to about 2e-8; the bounds are widened by this part of the product of lengths.
SLACK = 1e-6
#: Squared lengths from here on could give scores beyond a long; up to EXACT products in double precision are exact.
LARGEST, EXACT = 2.0**61, 2.0**52
ROWS = "vec_id long, tag long, label long, size int, ints binary, length double, angles binary"
NO_SCORE = np.iinfo(np.int64).min


def rounded(vectors: DataFrame, column: str, label: Column) -> DataFrame:
    """vec_id, tag, label, size and the integer components of the rows that take part; tag tells rows of one id apart."""
    x = F.col(column).cast("array<double>")
    scaled = F.transform(x, lambda c: F.floor(c * 256))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0**40))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.when(finite, scaled).alias("v"))
    rows = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    squares = F.aggregate("v", F.lit(0.0), lambda total, c: total + c.cast("double") * c.cast("double"))
    return rows.filter(squares < LARGEST).distinct().withColumn("tag", F.xxhash64("vec_id", "label", "v"))


def directions(rows: DataFrame) -> np.ndarray:
    """Unit vectors near which rows lie, by spherical k-means over a sample in the order of a hash; zeros if there are none."""
    sample = [np.array(r["v"], float) for r in rows.select("v").orderBy(F.xxhash64("tag", F.lit(1))).limit(SAMPLE).collect()]
    wide = max([len(v) for v in sample], default=0)
    units = np.zeros((len(sample), max(1, wide)))
    for i, v in enumerate(sample):
        units[i, : len(v)] = v / (np.linalg.norm(v) or 1)
    found = units[:DIRECTIONS]
    for _ in range(TURNS if len(found) else 0):
        nearest = (units @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, units)
        sizes = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(sizes > 1e-9, sums / np.maximum(sizes, 1e-9), found)
    return found if len(found) else np.zeros((1, 1))


def placed(rows: DataFrame, found: np.ndarray) -> DataFrame:
    """The rows with their integers packed, their length and their angle to each direction."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ints, lengths, angles = [], [], []
            for row in batch.column("v"):
                v = row.values.to_numpy(zero_copy_only=False).astype(np.int64)
                near = min(len(v), found.shape[1])
                length = float(np.linalg.norm(v.astype(float)))
                cosines = found[:, :near] @ v[:near] / (length or 1.0)
                ints.append(v.astype("<i4").tobytes())
                lengths.append(length)
                angles.append(np.arccos(np.clip(cosines, -1, 1)).astype("<f8").tobytes())
            arrays = [batch.column("vec_id"), batch.column("tag"), batch.column("label"), batch.column("size")]
            arrays += [pa.array(ints, pa.binary()), pa.array(lengths, pa.float64()), pa.array(angles, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in ROWS.split(", ")])

    return rows.select("vec_id", "tag", "label", F.size("v").alias("size"), "v").mapInArrow(work, ROWS)


class Side:
    """The rows of one side of a tile as arrays."""

    def __init__(self, rows: pd.DataFrame):
        n = len(rows)
        self.ids, self.tags, self.labels = (rows[c].to_numpy() for c in ("vec_id", "tag", "label"))
        self.vectors = np.frombuffer(b"".join(rows["ints"]), "<i4").reshape(n, -1)
        self.lengths = rows["length"].to_numpy()
        angles = np.frombuffer(b"".join(rows["angles"]), "<f8").reshape(n, -1)
        self.nearest = angles.argmin(axis=1)
        #: Along each direction and across it; the cosine of a difference or sum of angles is a product of these, plus or minus.
        self.along, self.across = self.lengths[:, None] * np.cos(angles), self.lengths[:, None] * np.sin(angles)


def score_bounds(anchors: Side, rows: Side) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers between which the score of each anchor with each row lies."""
    low = np.empty((len(anchors.ids), len(rows.ids)))
    high = np.empty_like(low)
    for k in np.unique(rows.nearest):
        at = np.flatnonzero(rows.nearest == k)
        along = np.outer(anchors.along[:, k], rows.along[at, k])
        across = np.outer(anchors.across[:, k], rows.across[at, k])
        low[:, at], high[:, at] = along - across, along + across
    for k in np.unique(anchors.nearest):
        at = np.flatnonzero(anchors.nearest == k)
        along = np.outer(anchors.along[at, k], rows.along[:, k])
        across = np.outer(anchors.across[at, k], rows.across[:, k])
        low[at], high[at] = np.maximum(low[at], along - across), np.minimum(high[at], along + across)
    slack = SLACK * np.outer(anchors.lengths, rows.lengths) + 1
    return np.floor(low - slack), np.ceil(high + slack)


def scores(anchor: np.ndarray, length: float, rows: Side, at: np.ndarray) -> np.ndarray:
    """The integer products of one anchor with some rows."""
    if length * float(rows.lengths[at].max(initial=0)) < EXACT:
        return (rows.vectors[at].astype(np.float64) @ anchor.astype(np.float64)).astype(np.int64)
    return rows.vectors[at].astype(np.int64) @ anchor.astype(np.int64)


def kth_best(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def best(found: np.ndarray, rows: Side, at: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort([rows.tags[at], rows.ids[at], -found])[:k]


def tiles(anchors: DataFrame, rows: DataFrame, search, schema: str, blocks: int, anchor_blocks: int) -> DataFrame:
    """What ``search(anchors, rows)`` finds in each tile of anchors and rows of equal length."""
    deal = lambda n, salt: F.pmod(F.xxhash64("tag", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumn("q", deal(anchor_blocks, 2)).withColumn("b", every(blocks))
    right = rows.withColumn("b", deal(blocks, 3)).withColumn("q", every(anchor_blocks))
    names = [x.split()[0] for x in schema.split(", ")]

    def work(ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(ask) and len(have):
            side = Side(have)
            for at in range(0, len(ask), TILE):
                out += search(ask.iloc[at : at + TILE], side)
        return pd.DataFrame(out, columns=names).astype(dict.fromkeys(names, "int64"))

    tile = ["q", "b", "size"]
    return left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInPandas(work, schema)


def first(found: DataFrame, keys: list[str], score: str, row: str, k: int) -> DataFrame:
    """The ``k`` best rows of each key with their rank."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), f"{row}_id", f"{row}_tag")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_positives(ask: pd.DataFrame, rows: Side, k: int) -> list[tuple]:
    anchors = Side(ask)
    low, high = score_bounds(anchors, rows)
    out = []
    for i, own in enumerate(anchors.ids):
        at = np.flatnonzero((rows.labels == anchors.labels[i]) & (rows.ids != own))
        at = at[high[i, at] >= kth_best(low[i, at], k)]
        found = scores(anchors.vectors[i], anchors.lengths[i], rows, at)
        out += [(own, anchors.tags[i], rows.ids[at[j]], rows.tags[at[j]], found[j]) for j in best(found, rows, at, k)]
    return out


def window_of(positive: int, low: int, high: int) -> tuple[int, int]:
    """The whole scores n with low * positive <= 100 * n <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


def search_negatives(ask: pd.DataFrame, rows: Side, k: int, low_part: int, high_part: int) -> list[tuple]:
    anchors = Side(ask)
    low, high = score_bounds(anchors, rows)
    out = []
    for i, own in enumerate(anchors.ids):
        other = np.flatnonzero((rows.labels != anchors.labels[i]) & (rows.ids != own))
        lowest, highest = low[i, other], high[i, other]
        wanted = []
        survive = np.zeros(len(other), bool)
        for positive in ask["positives"].iloc[i]:
            least, most = window_of(int(positive["score"]), low_part, high_part)
            certain = lowest[(lowest >= least) & (highest <= most)]
            mask = (highest >= max(least, kth_best(certain, k))) & (lowest <= most) & (least <= most)
            survive |= mask
            wanted.append((positive, least, most))
        at = other[survive]
        found = scores(anchors.vectors[i], anchors.lengths[i], rows, at)
        for positive, least, most in wanted:
            inside = np.flatnonzero((found >= least) & (found <= most))
            for j in best(found[inside], rows, at[inside], k):
                t = inside[j]
                out.append((own, anchors.tags[i], positive["id"], positive["tag"], positive["score"], rows.ids[at[t]], rows.tags[at[t]], found[t]))
    return out


def mine(
    rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = BLOCK, anchor_block: int = ANCHOR_BLOCK
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, for the ``rounded`` rows that ``anchors`` picks."""
    placed_rows = cut(placed(rows, directions(rows)))
    asked = placed_rows.filter(anchors)
    blocks, anchor_blocks = groups_for(placed_rows.count(), block), groups_for(asked.count(), anchor_block)
    pairs = "anchor_id long, anchor_tag long, positive_id long, positive_tag long, positive_score long"
    found = tiles(asked, placed_rows, lambda ask, have: search_positives(ask, have, positives), pairs, blocks, anchor_blocks)
    found = first(found, ["anchor_id", "anchor_tag"], "positive_score", "positive", positives)
    lists = found.groupBy(F.col("anchor_id").alias("vec_id"), F.col("anchor_tag").alias("tag")).agg(
        F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_tag").alias("tag"), F.col("positive_score").alias("score"))).alias("positives")
    )
    asked = cut(asked.join(lists, ["vec_id", "tag"]))
    triples = pairs + ", negative_id long, negative_tag long, negative_score long"
    hard = tiles(asked, placed_rows, lambda ask, have: search_negatives(ask, have, negatives, low, high), triples, blocks, anchor_blocks)
    hard = first(hard, ["anchor_id", "anchor_tag", "positive_id", "positive_tag"], "negative_score", "negative", negatives)
    return hard.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def hard_negatives(vectors: DataFrame, column: str = "embedding", every: int = 100, noisy: int = 7, labels: int = 10, **sizes: int) -> DataFrame:
    """Negatives of the rows whose vec_id is divisible by ``every``; where ``noisy`` divides it, the label is first moved on by one."""
    moved = F.when(F.col("vec_id") % noisy == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return mine(rounded(vectors, column, moved), F.col("vec_id") % every == 0, **sizes)


#: The same rows where vec_id is unique and all vectors are of one length; scores stay far below 2^53.
ORACLE_SQL = """
WITH good AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
    FROM good a JOIN good b ON b.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT anchor_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM scored WHERE same) p WHERE place <= 5
), negatives AS (
    SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
        s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
    FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT * FROM negatives WHERE rank <= 10
"""
