"""Substring search over a trigram index.

The index holds a table in parts by a hash of its key, and for every three letters that occur in a row's searched fields the
row's key and part, in shards by a hash of the letters. A needle of three letters or more reads the shards of its own
trigrams, keeps the keys that have all of them, and reads the parts these lie in; the substring itself is checked last. A
shorter needle reads the whole table. Letter case is ignored, as in ``logs.contains_any``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.operators.logs import contains_any

WIDTH = 3
PART, SHARD = "__part", "__shard"


def trigrams(text: Column) -> Column:
    """The different runs of three letters of a text in lower case."""
    low = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    return F.array_distinct(F.regexp_extract_all(low, F.lit(f"(?s)(?=({'.' * WIDTH}))"), F.lit(1)))


class TrigramIndex:
    def __init__(self, spark: SparkSession, root: str, key: str, fields: list[str], parts: int = 64, shards: int = 64):
        self.spark, self.key, self.fields, self.parts, self.shards = spark, key, fields, parts, shards
        self.rows, self.grams = f"{root.rstrip('/')}/rows", f"{root.rstrip('/')}/grams"

    def _shard(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.shards)).cast("int")

    def build(self, df: DataFrame) -> None:
        """Writes rows and postings. Postings of a shard are sorted by trigram, so that its files are read in part."""
        df = df.withColumn(PART, F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int"))
        df.repartition(PART).write.mode("overwrite").partitionBy(PART).parquet(self.rows)
        every = F.array_distinct(F.flatten(F.array(*[trigrams(F.col(c)) for c in self.fields])))
        grams = df.select(F.explode(every).alias("gram"), F.col(self.key).alias("key"), F.col(PART).alias("part")).withColumn(SHARD, self._shard(F.col("gram")))
        grams.repartition(SHARD, "gram").sortWithinPartitions(SHARD, "gram").write.mode("overwrite").partitionBy(SHARD).parquet(self.grams)

    def candidates(self, needle: str) -> DataFrame:
        """key, part: the rows that hold every trigram of a needle of three letters or more."""
        low = needle.lower()
        wanted = sorted({low[i : i + WIDTH] for i in range(len(low) - WIDTH + 1)})
        shards = [r[0] for r in self.spark.createDataFrame([(g,) for g in wanted], "gram string").select(self._shard(F.col("gram"))).distinct().collect()]
        hits = self.spark.read.parquet(self.grams).filter(F.col(SHARD).isin(shards) & F.col("gram").isin(wanted))
        return hits.groupBy("key", "part").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(wanted)).select("key", "part")

    def search(self, needle: str) -> DataFrame:
        """The rows with ``needle`` in one of the fields."""
        rows = self.spark.read.parquet(self.rows)
        if len(needle) >= WIDTH:
            found = self.candidates(needle)
            parts = [r[0] for r in found.select("part").distinct().collect()]  # no more than there are parts
            rows = rows.filter(F.col(PART).isin(parts)).join(found.select(F.col("key").alias(self.key)), self.key, "left_semi")
        return rows.filter(contains_any(self.fields, needle)).drop(PART)
