"""Connected components of an edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.session import cut

MOST_TURNS = 60
#: Tasks that the edges of one node can spread over.
SALTS = 64


def _asked(edges: DataFrame, key: str, least: DataFrame) -> DataFrame:
    """``edges`` with ``m``, the least smaller neighbour of their node ``key``, null where it has none.

    Each node is asked for once per salt and the edges meet the answers by node and salt, so that the edges of a hub spread.
    """
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("a", "b"), F.lit(SALTS)))
    answers = salted.select(key, "salt").distinct().join(least.withColumnRenamed("a", key), key)
    return salted.join(answers, [key, "salt"], "left")


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's larger (or no larger) neighbours linked to the least of its neighbourhood; in ``edges`` a is larger."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    if large:
        return _asked(edges, "b", least).select("a", F.coalesce("m", "b").alias("b")).distinct()
    others = _asked(edges, "a", least).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node of its component, null edges are left out.

    Turns end when the edges are stars around their roots, which takes about log(nodes) turns; each turn is checkpointed.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state = None
    for _ in range(MOST_TURNS):
        edges = cut(_stars(_stars(edges, True), False))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
