"""Approximate nearest neighbours by a block matrix join with proven bounds, so that the result is exact.

Vectors are dealt into blocks of bounded size. Each block of queries meets each block of vectors in one task, where int8
copies are multiplied as tiles, in pieces whose sums single precision holds exactly. Each vector is first divided by a power
of two, so that no size overflows. A vector is its scale times its copy plus a rest; with the length of the rests, the true
product lies within a known distance of the tile's. Pairs whose upper bound falls below the k-th largest lower bound are
out; the others are multiplied again in double precision, and the k best of a block are merged with those of other blocks
by heaps, a bounded number of blocks at a time.

Vectors that are null, zero, empty or hold null or non-finite components take no part; only vectors of equal length meet.
Ties go to the smaller vec_id. Equal rows count once; different vectors under one vec_id are candidates each, but not of a
query with that id, and as queries their lists are merged. Products beyond the range of doubles are infinite. A table without queries gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.tables import groups_for

BLOCK = 8192
QUERY_BLOCK = 2048
#: Blocks whose results one merge takes.
FAN_IN = 64
#: Rows of queries in one tile.
TILE = 256
#: Components whose int8 products add up to less than 2^24, which single precision holds exactly.
EXACT_SUM = 1024
FOUND = "query_id long, part int, ids array<long>, scores array<double>"


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """vec_id and the double vector of the rows that take part."""
    v = F.col(column).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(finite).filter(F.exists("v", lambda x: x != 0)).distinct()


def quantized(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 copies (as floats, whose products are exact), scales, lengths of the copies, and lengths of the rests."""
    scale = np.abs(vectors).max(axis=1) / 127
    scale[scale == 0] = np.finfo(float).tiny
    copies = np.clip(np.rint(vectors / scale[:, None]), -127, 127)
    near = copies * scale[:, None]
    return copies.astype(np.int8).astype(np.float32), scale, np.linalg.norm(near, axis=1), np.linalg.norm(vectors - near, axis=1)


def to_unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors divided by powers of two so that their largest components lie from 0.5 to 1, and the exponents."""
    exponents = np.frexp(np.abs(vectors).max(axis=1))[1]
    return np.ldexp(vectors, -exponents[:, None]), exponents


def tile_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The whole-number products of int8 copies, exact for any number of components."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], EXACT_SUM):
        out += a[:, at : at + EXACT_SUM] @ b[:, at : at + EXACT_SUM].T
    return out


def best_of_block(queries: np.ndarray, query_ids: np.ndarray, base: np.ndarray, base_ids: np.ndarray, k: int) -> Iterator[tuple[int, list, list]]:
    """The k best of ``base`` for each query: (query id, ids, scores), best first."""
    unit_queries, _ = to_unit(queries)
    unit_base, exponents = to_unit(base)
    weight = np.ldexp(1.0, exponents - exponents.max())
    q, q_scale, q_near, q_rest = quantized(unit_queries)
    b, b_scale, b_near, b_rest = quantized(unit_base)
    b_length = np.linalg.norm(unit_base, axis=1)
    q_length = np.linalg.norm(unit_queries, axis=1)
    b_scale, b_near, b_rest, b_length = b_scale * weight, b_near * weight, b_rest * weight, b_length * weight
    for at in range(0, len(q), TILE):
        rows = slice(at, at + TILE)
        near = tile_products(q[rows], b) * q_scale[rows, None] * b_scale
        bound = q_rest[rows, None] * b_length + q_near[rows, None] * b_rest + 1e-9 * (q_length[rows, None] * b_length)
        own = query_ids[rows, None] == base_ids
        low = np.where(own, -np.inf, near - bound)
        least = np.partition(low, len(base) - k, axis=1)[:, len(base) - k] if len(base) > k else np.full(len(low), -np.inf)
        survive = (near + bound >= least[:, None]) & ~own
        for i, row in enumerate(survive):
            at_base = np.flatnonzero(row)
            exact = (base[at_base] * queries[at + i]).sum(axis=1)
            order = np.lexsort([base_ids[at_base], -exact])[:k]
            yield int(query_ids[at + i]), base_ids[at_base][order].tolist(), exact[order].tolist()


def merged(parts: list[tuple[list, list]], k: int) -> tuple[list, list]:
    """The k best of lists that are each sorted best first."""
    lists = [[(-score, i) for i, score in zip(ids, scores, strict=True)] for ids, scores in parts]
    best = list(islice(heapq.merge(*lists), k))
    return [i for _, i in best], [-s for s, _ in best]


def found_frame(rows: list[tuple]) -> pd.DataFrame:
    kinds = {"query_id": "int64", "part": "int32", "ids": "object", "scores": "object"}
    return pd.DataFrame(rows, columns=list(kinds)).astype(kinds)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, column: str = "embedding", block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of ``vectors`` with the largest inner product with each query."""
    if k < 1:
        raise ValueError("k must be positive")
    base, asked = usable(vectors, column), usable(queries, column)
    blocks = groups_for(vectors.select(F.lit(1)).count(), block)
    query_blocks = groups_for(queries.select(F.lit(1)).count(), query_block)
    deal = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    size = F.size("v").alias("size")
    left = asked.select("vec_id", "v", size, deal(query_blocks, 1).alias("q")).withColumn("b", every(blocks))
    right = base.select("vec_id", "v", size, deal(blocks, 2).alias("b")).withColumn("q", every(query_blocks))
    tile = ["q", "b", "size"]

    def search(key: tuple, ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        if not len(ask) or not len(have):
            return found_frame([])
        found = best_of_block(np.vstack(ask["v"]), ask["vec_id"].to_numpy(), np.vstack(have["v"]), have["vec_id"].to_numpy(), k)
        return found_frame([(q, int(key[1]), ids, scores) for q, ids, scores in found])

    rows = left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInPandas(search, FOUND)
    while True:  # also with one block, as several rows may ask under one id
        blocks = groups_for(blocks, FAN_IN)
        rows = merge_parts(rows, k)
        if blocks == 1:
            break
    rows = rows.select("query_id", F.posexplode(F.arrays_zip("ids", "scores")).alias("rank", "hit"))
    return rows.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.ids").alias("vec_id"), F.col("hit.scores").alias("score"))


def merge_parts(rows: DataFrame, k: int) -> DataFrame:
    """One list for each query and ``FAN_IN`` parts."""

    def merge(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        lists: dict[tuple[int, int], list] = {}
        for query, group, ids, scores in zip(part["query_id"], part["group"], part["ids"], part["scores"], strict=True):
            lists.setdefault((query, group), []).append((list(ids), list(scores)))
        out = [(query, group, *merged(parts, k)) for (query, group), parts in lists.items()]
        return found_frame(out)

    grouped = rows.withColumn("group", F.floor(F.col("part") / FAN_IN).cast("int")).withColumn("lane", F.pmod(F.xxhash64("query_id"), F.lit(256)))
    return grouped.groupBy("group", "lane").applyInPandas(merge, FOUND)


def document_neighbours(vectors: DataFrame, every: int, k: int) -> DataFrame:
    """The ``k`` nearest of every row whose vec_id is divisible by ``every``."""
    return nearest(vectors, vectors.filter(F.col("vec_id") % every == 0), k)
