"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marketlens.llm import bpe, fingerprints, jaccard, language, lines, mining, neighbours, packing, periods, repeats, scoring, sharding, simhash
from marketlens.llm.tables import read_table

SHARDS = 40
QUERY_EVERY = 20
NEIGHBOURS = 20


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.document_shards(read_table(spark, sf_dir, "documents"), SHARDS)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "text", "n_lines", "n_removed", "n_runs")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(read_table(spark, sf_dir, "documents"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.document_neighbours(read_table(spark, sf_dir, "embeddings"), QUERY_EVERY, NEIGHBOURS)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read_table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.document_fingerprints(read_table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read_table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.document_links(read_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.hard_negatives(read_table(spark, sf_dir, "embeddings"))


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digests(periods.find(periods.looped(read_table(spark, sf_dir, "documents"))))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sharding,
        op2_line_dedup,
        op3_packing,
        op4_suffix_dedup,
        op5_lm_scoring,
        op6_neighbours,
        op7_language,
        op8_fingerprints,
        op9_bpe,
        op10_jaccard_join,
        op11_hard_negatives,
        op12_periods,
        op13_simhash,
    )
}
#: SQL for the queries that it can express within reason; the tests compare the others with brute force.
ORACLES: dict[str, str] = {"op2_line_dedup": lines.ORACLE_SQL, "op11_hard_negatives": mining.ORACLE_SQL}
