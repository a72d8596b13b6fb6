import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marketlens.llm import sharding


def test_documents(odd):
    rows = sharding.document_shards(odd, 7).collect()
    texts = odd.select("doc_id", "text").collect()
    key = lambda i, t: (-1 if i is None else i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))
    assert Counter(key(r["doc_id"], r["text"]) for r in texts) == Counter((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"]) for r in rows)
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(7))
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    assert sorted(r["row_number"] for r in rows) == list(range(len(rows)))


@pytest.mark.parametrize("rows", [1, 2, 3, 5, 17, 101, 1000, 4099])
def test_permutation(spark, rows):
    ids = spark.range(rows)
    first = {r["id"]: r["position"] for r in sharding.shard(ids, 3, seed=1).collect()}
    again = {r["id"]: r["position"] for r in sharding.shard(ids.repartition(5), 3, seed=1).collect()}
    other = {r["id"]: r["position"] for r in sharding.shard(ids, 3, seed=2).collect()}
    assert sorted(first.values()) == list(range(rows)) and first == again
    assert rows < 100 or sum(first[i] == other[i] for i in first) < rows / 10


def test_repeated_and_empty(spark, empty):
    hot = spark.range(900).select(F.lit(1).alias("id"), F.lit("t").alias("_bucket")).unionAll(spark.range(100).select("id", F.lit("u")))
    rows = sharding.shard(hot, 8).collect()
    assert sorted(r["position"] for r in rows) == list(range(1000))
    assert sharding.document_shards(empty, 40).count() == 0
    with pytest.raises(ValueError):
        sharding.shard(spark.range(3).withColumn("slot", F.lit(1)), 2)


def test_no_python(odd):
    plan = sharding.document_shards(odd, 40)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
