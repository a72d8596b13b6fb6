"""A training-data pipeline: each stage works on the documents that the one before it kept.

1. Language ID: documents go whose text is no nearer to any learned language than chance.
2. Line dedup: later copies of runs of lines, of long lines and of one-line documents are deleted from the texts.
3. N-gram Jaccard join: one document of each class of near duplicates stays, the one of the least doc_id.
4. Suffix-array dedup: bytes of 100-byte strings that start earlier are deleted from the texts.
5. Best-fit packing: the texts are tokenized and packed; one row per piece.

All but the last return the columns of the documents; where a stage changes texts, ``n_chars`` follows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import jaccard, language, lines, packing, repeats
from marketlens.llm.tables import small_batches
from marketlens.session import cut

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _like(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """``changed`` with the columns of ``docs``, and the length of its texts where they have one."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        columns = [F.length("text").cast(kind).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return changed.select(*columns)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return language.filter_languages(docs, language.CHANCE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return _like(lines.dedup(docs, report=False, alone=lines.ALONE), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return jaccard.one_per_class(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return _like(repeats.dedup(docs, report=False), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", languages),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packed),
]
#: SQL can't express signatures, byte-wise repeats and tokens; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents, one after another; what a stage keeps is checkpointed for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
